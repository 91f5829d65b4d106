"""Named queries with the SQL that checks them."""

from __future__ import annotations

import dataclasses as dc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dc.dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(*covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its own name; ``covers`` are inventory ids."""

    def add(fn: Run) -> Run:
        if fn.__name__ in REGISTRY:
            raise ValueError(f"query {fn.__name__} is registered twice")
        REGISTRY[fn.__name__] = Query(fn.__name__, fn, sql, covers)
        return fn

    return add


def r9(col: str | Column, digits: int = 9) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits)


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    for name in names:
        df = df.withColumn(name, r9(name, digits))
    return df


# ------------------------------------------------------------------ shared SQL


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


EVENT_ROUNDS = """acts AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS action
  FROM (SELECT DISTINCT event_type FROM events)),
ev AS (SELECT event_id AS round_id, user_id AS user_idx, user_id AS context_id, action,
  CASE WHEN value >= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward, epoch_us(ts) AS t,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS feature
  FROM events JOIN acts USING (event_type))"""

EVENT_SPLIT = EVENT_ROUNDS + """,
evn AS (SELECT *, row_number() OVER (ORDER BY t, round_id) - 1 AS rk, count(*) OVER () AS nn FROM ev),
evs AS (SELECT * EXCLUDE (rk, nn), CASE WHEN rk < floor(nn * 0.8::DOUBLE) THEN 'train'
  WHEN rk < floor(nn * 0.8::DOUBLE) + floor(nn * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS part FROM evn),
train AS (SELECT * FROM evs WHERE part = 'train'),
scored AS (SELECT * FROM evs WHERE part <> 'train'),
test AS (SELECT s.*, count(*) OVER (PARTITION BY user_idx, action) / (count(*) OVER (PARTITION BY user_idx))::DOUBLE
  AS propensity FROM scored s)"""

GREEDY = """gq AS (SELECT context_id, action, avg(reward) AS q, count(*) AS n FROM train GROUP BY ALL),
greedy AS (SELECT context_id, action, 1.0::DOUBLE AS prob FROM
  (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY q DESC, action) AS k FROM gq) WHERE k = 1),
popular AS (SELECT c.context_id, p.action, 1.0::DOUBLE AS prob FROM (SELECT DISTINCT context_id FROM ev) c,
  (SELECT action FROM train GROUP BY action ORDER BY count(*) DESC, action LIMIT 1) p),
uniform AS (SELECT c.context_id, a.action, 1.0::DOUBLE / (SELECT count(*) FROM acts) AS prob
  FROM (SELECT DISTINCT context_id FROM ev) c, acts a),
policies AS (SELECT 'greedy_mean' AS agent, * FROM greedy UNION ALL SELECT 'popular', * FROM popular),
everyone AS (SELECT * FROM policies UNION ALL SELECT 'random', * FROM uniform)"""

LINE_ROUNDS = """brands AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS action
  FROM (SELECT DISTINCT p_brand FROM part)),
ln AS (SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_quantity AS BIGINT), CAST(round(l_discount * 100) AS BIGINT),
    CAST(round(l_tax * 100) AS BIGINT))) AS round_id,
  o_custkey AS user_idx, o_custkey AS context_id, action,
  CASE WHEN l_quantity >= 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward, p_size::DOUBLE AS feature,
  epoch_us(l_shipdate) AS t
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN brands USING (p_brand) JOIN orders ON l_orderkey = o_orderkey)"""

BLOCK = """prio AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS action
  FROM (SELECT DISTINCT o_orderpriority FROM orders)),
bl AS (SELECT o_orderkey AS row_seq, o_custkey AS user_idx, action,
  CASE WHEN o_totalprice >= 250000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward, epoch_us(o_orderdate) AS t
  FROM orders JOIN prio USING (o_orderpriority)),
block AS (SELECT user_idx, action, reward, row_seq FROM
  (SELECT *, row_number() OVER (PARTITION BY user_idx, action ORDER BY row_seq DESC) AS k FROM bl) WHERE k = 1),
weights AS (SELECT user_idx AS context_id, count(*) AS n_rounds, min(row_seq) AS representative
  FROM block GROUP BY user_idx)"""
