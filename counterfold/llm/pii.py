"""Personal data in texts, also where it is disguised, with offsets in the source.

Plain identifiers are found in the text as it stands.  For disguised ones, two
transducers rewrite the text: one maps characters (homoglyphs, full-width
forms, invisible characters), one maps tokens (spelled digits, ``at`` and
``dot`` in words or brackets).  Both keep, for every character they emit, the
source range it came from, so that an identifier found in the rewritten text
is reported as a span of source characters.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from counterfold.llm.common import in_slices, texts

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No part can be shortened with success, so a run of digits is tried once, from its start.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ո": "n", "ս": "u", "օ": "o",
    "А": "A", "В": "B", "Е": "E", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "З": "3", "б": "6",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ɑ": "a", "ⅼ": "l",
}
#: Characters that are not seen.
_INVISIBLE = frozenset("\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff")
#: Spelled digits.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
}
_WORD = "|".join(DIGIT_WORDS)
_SPELLED = re.compile(rf"\b(?:{_WORD})\b(?:[\s.-]{{1,3}}(?:{_WORD}|dot|point|[0-9])\b){{3,}}", re.I)
_AROUND = r"[\[({<]\s{0,2}%s\s{0,2}[\])}>]"
_AT = re.compile(rf"\s?{_AROUND % '(?:at|@)'}\s?|\s@\s|\s@|@\s", re.I)
_DOT = re.compile(rf"\s?{_AROUND % r'(?:dot|point|\.)'}\s?", re.I)
#: Pieces are bounded only against long chains: a local part has at most 64 characters, a domain 127 names.
_BARE = re.compile(
    r"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9_%+-]+(?:(?:\.|\sdot\s)[A-Za-z0-9_%+-]+){0,63}+)(?P<at>\sat\s|@)"
    r"(?P<domain>[A-Za-z0-9-]+(?:(?:\.|\sdot\s)[A-Za-z0-9-]+){1,127}+)", re.I)
_LAST_NAME = re.compile(r"[A-Za-z]{2,12}\b")
#: Last names of domains that bare words may end in; words of common
#: languages ("on", "it", "in", ...) are left out.
_TOPS = frozenset(
    "ar au biz br ca ch cl cn co com cz de dk edu es eu fi fr gov gr hu ie info int io jp kr mil mobi mx name net nl nz "
    "org pl pt ru se tech tv ua uk za app blog cloud dev online shop site store xyz example test".split())
_IN_WORDS = re.compile(r"\sdot\s", re.I)
_ANY_DOT = re.compile(r"\.|\sdot\s", re.I)
_TRIGGER = re.compile(r"[\])}>]|\sdot\s|\s@|@\s|\sat\s[a-z0-9-]+\.[a-z0-9]", re.I)
_PLUS = re.compile(r"\bplus[\s-]{1,3}(?=[0-9])", re.I)


def _map_char(ch: str) -> str:
    """What a character of another form stands for; itself if for nothing."""
    if ch in _INVISIBLE:
        return ""
    if ch in HOMOGLYPHS:
        return HOMOGLYPHS[ch]
    plain = unicodedata.normalize("NFKC", ch)
    if plain.isascii() and plain.strip():
        return plain
    digit = unicodedata.digit(ch, None)
    if digit is not None:
        return str(digit)
    kind = unicodedata.category(ch)
    return "-" if kind == "Pd" else " " if kind == "Zs" else ch


class Rewritten:
    """A text under rewriting: characters and the source range of each."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start = list(range(len(text)))
        self.stop = list(range(1, len(text) + 1))

    def characters(self) -> None:
        if self.text.isascii():
            return
        table: dict[str, str] = {}
        out, start, stop = [], [], []
        for at, ch in enumerate(self.text):
            new = ch if ch.isascii() else table[ch] if ch in table else table.setdefault(ch, _map_char(ch))
            for c in new:
                out.append(c)
                start.append(self.start[at])
                stop.append(self.stop[at])
        self.text, self.start, self.stop = "".join(out), start, stop

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put other characters in the place of ranges; each stands for its whole range."""
        if not edits:
            return
        out, start, stop, at = [], [], [], 0
        for a, b, new in sorted(edits):
            if a < at:
                continue
            out.append(self.text[at:a])
            start += self.start[at:a]
            stop += self.stop[at:a]
            out.append(new)
            start += [self.start[a]] * len(new)
            stop += [self.stop[b - 1]] * len(new)
            at = b
        out.append(self.text[at:])
        start += self.start[at:]
        stop += self.stop[at:]
        self.text, self.start, self.stop = "".join(out), start, stop


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    """Runs of spelled digits as digits; ``dot`` and ``point`` in them as dots."""
    edits = []
    for m in _SPELLED.finditer(text):
        new = re.sub(rf"{_WORD}", lambda w: DIGIT_WORDS[w[0].lower()], m[0], flags=re.I)
        new = re.sub(r"[\s.-]*(?:dot|point)[\s.-]*", ".", new, flags=re.I)
        new = re.sub(r"[\s-]+", "", new)
        edits.append((m.start(), m.end(), new))
    return edits


def _at_dot_edits(text: str) -> list[tuple[int, int, str]]:
    edits = [(m.start(), m.end(), "@") for m in _AT.finditer(text)]
    edits += [(m.start(), m.end(), ".") for m in _DOT.finditer(text)]
    return edits


def _bare_edits(text: str, made: Callable[[int], bool]) -> list[tuple[int, int, str]]:
    """``at`` and ``dot`` as bare words; ``made`` tells whether a dot comes from a rewriting.

    Of the domain's dots the last one counts that is followed by a known last
    name, or by any name where the address shows itself elsewhere: by its ``@``
    or by this dot's having been rewritten.
    """
    edits, at = [], 0
    while m := _BARE.search(text, at):
        at = m.start("domain")
        for dot in reversed(list(_ANY_DOT.finditer(text, *m.span("domain")))):
            top = _LAST_NAME.match(text, dot.end(), m.end())
            plain = dot[0] == "."
            if top is None or plain and m["at"] == "@":
                continue
            if m["at"] != "@":
                if top[0].lower() not in _TOPS and not (plain and made(dot.start())):
                    continue
                edits.append((*m.span("at"), "@"))
            at = top.end()
            edits += [(d.start(), d.end(), ".") for d in _IN_WORDS.finditer(text, m.start(), at)]
            break
    return edits


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    total += sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> list[tuple[str, int, int]]:
    """Leftmost, non-overlapping: the longest run before each ``@`` that no match has taken."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Identifiers in plain sight: (kind, start, end), by start, then kind."""
    found = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", *m.span()) for m in _IP.finditer(text)
                      if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def disguised_spans(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifiers that only the rewritten text shows, as spans of the source."""
    odd = not text.isascii() and any(_map_char(c) != c for c in set(text) if not c.isascii())
    spelled = _SPELLED.search(text) is not None
    marked = _TRIGGER.search(text) is not None and (
        _AT.search(text) or _DOT.search(text) or _bare_edits(text, lambda _: False))
    if not (odd or spelled or marked):
        return []
    new = Rewritten(text)
    new.characters()
    new.replace(_spelled_edits(new.text))
    new.replace([(m.start(), m.end(), "+") for m in _PLUS.finditer(new.text)])
    new.replace(_at_dot_edits(new.text))
    new.replace(_bare_edits(new.text, lambda i: text[new.start[i]:new.stop[i]] != "."))
    if new.text == text:
        return []
    there = set(plain)
    added = []
    for kind, a, b in plain_spans(new.text):
        start, stop = new.start[a], new.stop[b - 1]
        # what is disguised often leaves a shorter plain match; the whole is reported besides it
        if text[start:stop] != new.text[a:b] and (kind, start, stop) not in there:
            added.append((kind, start, stop))
    return added


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data of every row of ``docs`` (``doc_id``, ``text``).

    ``n_email``, ``n_ip``, ``n_card`` and ``n_phone`` count all spans, plain and
    disguised; ``base_sha256`` is the digest of the plain ones alone and
    ``spans`` lists all, as ``kind:start:end`` in code points of the source, by
    start, then kind.  A disguised span may overlap plain ones, which stay; one
    with the range of a plain one of its kind is not added.  Null and empty texts have no spans.  Rows that repeat, or
    without a ``doc_id``, are read each; no rows give none; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1024):
            counts: list[list[int]] = [[] for _ in KINDS]
            sums, spans = [], []
            for text in texts(batch):
                plain = plain_spans(text)
                added = disguised_spans(text, plain)
                both = sorted({*plain, *added}, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if added else plain
                for of_kind, kind in zip(counts, KINDS, strict=True):
                    of_kind.append(sum(s[0] == kind for s in both))
                sums.append(hashlib.sha256(_joined(plain).encode()).hexdigest())
                spans.append(_joined(both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()),
                 pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
