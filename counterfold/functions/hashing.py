"""Keyed randomness: a hash of (seed, stream, key) in place of a generator.

A hash gives the same draw for the same key on any cluster layout and after a
task retry, which ``rand(seed)`` does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 4294967296.0


def hash32(seed: object, *parts: Column | str) -> Column:
    """Unsigned 32-bit hash of ``seed|part|part...`` as a long."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform01(seed: object, *parts: Column | str) -> Column:
    """Hash mapped into the open interval (0, 1)."""
    return (hash32(seed, *parts).cast("double") + 0.5) / F.lit(HASH_RANGE)


def normal01(seed: object, *parts: Column | str) -> Column:
    """Standard normal draw from two hash uniforms (Box-Muller)."""
    u1 = uniform01(f"{seed}.a", *parts)
    u2 = uniform01(f"{seed}.b", *parts)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def hash32_sql(seed: object, *parts: str) -> str:
    """The same 32-bit hash as text for the SQL used to check results."""
    body = ", ".join([f"'{seed}'", *parts])
    return f"(('0x' || substr(md5(concat_ws('|', {body})), 1, 8))::UBIGINT::BIGINT)"
