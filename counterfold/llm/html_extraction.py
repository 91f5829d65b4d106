"""Main text of web pages as the maximum-scoring run of words and tags.

Every word scores positive and every tag negative; one scan finds the
contiguous region with the highest sum.  The weights are learned from pages
that mark their own content (exactly one ``article`` or ``main`` element):
for each element name and class word, the log odds that words below it are
content.  Elements whose odds are low (menus, footers, adverts, ...) are taken
out of the region, and their words score nothing.  On a page that marks its
content nothing else scores: the region reaches from the first marked words to
the last, and what stands between marked elements is taken out of it.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfold.llm.common import in_slices

#: Pages the weights are fitted on, at most (expected).
SAMPLE_PAGES = 2_000
#: Features kept of those pages, the most frequent ones.
MOST_FEATURES = 4_096

_TOKEN = re.compile(
    r"<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")

#: Fixed values of the markup language: elements without content, elements
#: whose content is no text, elements that begin and end a block.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"body", "html", "head"}
#: What is never content, whatever the sample shows: words for menus, page
#: frames, notices, adverts, forms and reader comments.
_NEVER_ELEMENT = frozenset(
    "nav footer aside form button select option svg object canvas audio video menu dialog head header".split())
_NEVER_CLASS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent notice alert "
    "popup modal sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist "
    "disqus reply replies share sharing social related recommended newsletter subscribe signup login search pagination "
    "pager toolbar widget contentinfo complementary".split())
_ALWAYS_ELEMENT = frozenset(("article", "main"))
#: What holds a page or its content, whatever its classes say.
_FRAME = _ALWAYS_ELEMENT | {"html", "body"}
#: Elements that a page itself sets apart; a form may hold a whole page.
_APART = _NEVER_ELEMENT - {"form"}
#: Words of a class that tell of a state of the page ("no-comments"), not of what the element is.
_STATE = frozenset("has have with without no not".split())
#: Belief before any page is seen, in words.
_PRIOR = 50.0


def _features(name: str, attributes: str) -> list[str]:
    """The element's name and its whole class tokens, in lower case without numbers, words joined by hyphens."""
    out = [name]
    if attributes and "=" in attributes:
        for m in _CLASS.finditer(attributes):
            for token in (m[1] or m[2] or m[3] or "").lower().split():
                words = [w for w in _SPLIT.split(token) if w and not w.isdigit()]
                if words:
                    out.append("." + "-".join(words))
    return out


def _pieces(feature: str) -> list[str]:
    """The words of a class token of several, none of one that tells of a state."""
    words = feature[1:].split("-") if feature[0] == "." else []
    return [f".{w}" for w in words] if len(words) > 1 and _STATE.isdisjoint(words) else []


def prior(feature: str) -> float:
    """Which way a feature points before any page is seen: 1 content, -1 none, 0 unknown."""
    if feature in _ALWAYS_ELEMENT:
        return 1.0
    if feature in _NEVER_ELEMENT or feature[0] == "." and feature[1:] in _NEVER_CLASS:
        return -1.0
    return min((prior(f) for f in _pieces(feature)), default=0.0)


def tokens(page: str) -> Iterator[tuple[str, str, list[str]]]:
    """('text', text, []), ('open', name, features) and ('close', name, []) in page order."""
    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            if at < len(page):
                yield "text", page[at:], []
            return
        if m.start() > at:
            yield "text", page[at:m.start()], []
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            yield "close", name, []
            continue
        yield "open", name, _features(name, m[3] or m[6] or "")
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            yield "close", name, []


class _Path:
    """The open elements; unclosed and unopened ones do no harm."""

    def __init__(self) -> None:
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.count: dict[str, int] = {}

    def enter(self, name: str, features: list[str]) -> None:
        if name in _VOID:
            return
        if name in _CLOSES_P and self.open and self.open[-1][0] == "p":
            self.leave("p")
        self.open.append((name, tuple(features)))
        self.count[name] = self.count.get(name, 0) + 1

    def leave(self, name: str) -> None:
        if not self.count.get(name):
            return
        while True:
            gone, _ = self.open.pop()
            self.count[gone] -= 1
            if gone == name:
                return


def _labelled(page: str) -> list[tuple[str, int, int]]:
    """(feature, words in content, words elsewhere) of a page that marks its content."""
    inside: dict[str, list[int]] = {}
    marks = 0
    path = _Path()
    for kind, what, features in tokens(page):
        if kind == "open":
            path.enter(what, features + [piece for f in features for piece in _pieces(f)])
            marks += what in _ALWAYS_ELEMENT
        elif kind == "close":
            path.leave(what)
        else:
            n = len(what.split())
            if n:
                content = path.count.get("article", 0) + path.count.get("main", 0) > 0
                for f in {f for _, fs in path.open for f in fs}:
                    inside.setdefault(f, [0, 0])[not content] += n
    return [(f, a, b) for f, (a, b) in inside.items()] if marks == 1 else []


def fit_weights(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Log odds that words below an element with a feature are content.

    Fitted on pages with exactly one ``article`` or ``main`` element, out of a
    sample of ``sample_pages``; without any, the odds are those of the prior.
    """
    share = min(1.0, sample_pages / max(1, pages.count()))
    picked = F.pmod(F.xxhash64("page_id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000) + 1
    rows = pages.select("page_id", "html").where(picked).limit(2 * sample_pages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [r for page in batch.column("html").to_pylist() if page for r in _labelled(page)]
            cols = list(zip(*got, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                names=["feature", "inside", "outside"])

    seen = (
        rows.mapInArrow(count, "feature string, inside long, outside long").groupBy("feature")
        .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        .orderBy(F.desc(F.col("inside") + F.col("outside")), "feature").limit(MOST_FEATURES).collect()
    )
    return {r.feature: log_odds(r.feature, r.inside, r.outside) for r in seen}


def log_odds(feature: str, inside: int = 0, outside: int = 0) -> float:
    lean = prior(feature)
    return math.log((inside + 1 + _PRIOR * max(0.0, lean)) / (outside + 1 + _PRIOR * max(0.0, -lean)))


class Extractor:
    """Main text of a page under given weights."""

    #: A feature with odds below this marks an element as no content.
    never = -2.0

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = dict(weights)

    def _odds(self, features: list[str]) -> float:
        """Odds of an element: its class tokens may call it no content, its mere name may not.

        Names that only lay a page out (div, section, p, ...) stay above ``never`` whatever was
        learned, as their words are content on other pages; elements that a page
        itself sets apart stay below it.
        """
        name = features[0]
        own = self._known(name)
        if name in _APART:
            own = min(own, log_odds(name))
        elif name not in _NEVER_ELEMENT:
            own = max(own, self.never)
        return self._joined([own, *(self._known(f) for f in features[1:])])

    def _joined(self, known: list[float]) -> float:
        return min(known) if min(known) < self.never else max(known)

    def _known(self, feature: str) -> float:
        """A whole class token decides if it was seen, else its pieces do."""
        if feature not in self.weights:
            pieces = _pieces(feature)
            self.weights[feature] = self._joined([self._known(f) for f in pieces]) if pieces else log_odds(feature)
        return self.weights[feature]

    def _cost(self, odds: float, dead: bool) -> float:
        """What a tag costs: more where odds are against content, next to nothing for an element that is taken out.

        Text goes on after an advert or a box of comments, so these part no region.
        """
        return 0.01 if dead else 0.01 + 0.1 * max(0.0, -odds)

    def __call__(self, page: str) -> str:
        if not page:
            return ""
        seen = list(tokens(page))
        return self._text(seen, self._holders(seen))

    def _gone(self, what: str, odds: float, content: bool) -> bool:
        # a site's header frames the page; one within the content holds its heading
        return what in _RAW or what not in _FRAME and odds < self.never and not (what == "header" and content)

    def _holders(self, seen: list[tuple[str, str, list[str]]]) -> set[int]:
        """Places of elements that odds call no content, but that hold the page's marked content.

        They count if all marks of the page are in such elements: where the page has
        a main element or one mark, or its marks hold more words than the rest does.
        """
        if not any(kind == "open" and what in _ALWAYS_ELEMENT for kind, what, _ in seen):
            return set()
        path = _Path()
        places: list[int] = []  # of the open elements, gone ones only, else -1
        marks: list[tuple[bool, list[int]]] = []
        words = rest = gone = 0
        for at, (kind, what, features) in enumerate(seen):
            content = path.count.get("article", 0) + path.count.get("main", 0) > 0
            if kind == "text":
                n = len(what.split())
                words, rest = (words + n, rest) if content else (words, rest + n * (not gone))
            elif kind == "close":
                path.leave(what)
                gone -= sum(i >= 0 for i in places[len(path.open):])
                del places[len(path.open):]
            elif what not in _VOID:
                path.enter(what, features)
                gone -= sum(i >= 0 for i in places[len(path.open) - 1:])
                del places[len(path.open) - 1:]
                if what in _ALWAYS_ELEMENT and not content:
                    apart = any(n in _APART or n in _RAW for n, _ in path.open)
                    holders = [i for i in places if i >= 0]
                    if not holders:
                        return set()  # the page marks its content in plain sight
                    if not apart:
                        marks.append((what == "main", holders))
                places.append(at if self._gone(what, self._odds(features), content) else -1)
                gone += places[-1] >= 0
        if len(marks) == 1 or any(main for main, _ in marks) or words > rest:
            return {i for _, holders in marks for i in holders}
        return set()

    def _text(self, seen: list[tuple[str, str, list[str]]], holders: set[int]) -> str:
        marked = False
        items: list[tuple[str, str, bool]] = []  # kind, text or element, usable
        within: list[bool] = []  # in marked content
        scores: list[float] = []
        path: list[tuple[str, bool, float]] = []
        count: dict[str, int] = {}
        dead = content = 0
        for at, (kind, what, features) in enumerate(seen):
            if kind == "text":
                n = len(what.split())
                items.append(("text", what, dead == 0))
                scores.append(0.0 if dead else float(n) if content else 0.5 * n)
                within.append(content > 0)
                continue
            within.append(False)
            if kind == "open":
                odds = self._odds(features)
                gone = at not in holders and self._gone(what, odds, content > 0)
                cost = self._cost(odds, dead > 0 or gone or content > 0)
                if what not in _VOID:
                    if what in _CLOSES_P and path and path[-1][0] == "p":
                        _, was_dead, _ = path.pop()
                        dead -= was_dead
                        count["p"] -= 1
                    path.append((what, gone, cost))
                    count[what] = count.get(what, 0) + 1
                    dead += gone
                    if what in _ALWAYS_ELEMENT:
                        content += 1
                        marked = marked or not dead
                items.append(("tag", what, True))
                scores.append(-cost)
            elif count.get(what):
                cost = 0.01
                while True:
                    name, was_dead, its = path.pop()
                    count[name] -= 1
                    dead -= was_dead
                    content -= name in _ALWAYS_ELEMENT
                    cost = max(cost, its)
                    if name == what:
                        break
                items.append(("tag", what, True))
                scores.append(-cost)
            else:
                items.append(("tag", what, True))
                scores.append(-0.01)
        if marked:
            items = [(kind, what, usable and (kind == "tag" or inside)) for (kind, what, usable), inside in zip(items, within, strict=True)]
            scores = [s if inside else 0.0 for s, inside in zip(scores, within, strict=True)]
        best, best_at, total, start = 0.0, (0, 0), 0.0, 0
        for i, s in enumerate(scores):
            if total <= 0:
                total, start = 0.0, i
            total += s
            if total > best:
                best, best_at = total, (start, i + 1)
        return _blocks(items[best_at[0]:best_at[1]])


def _blocks(items: list[tuple[str, str, bool]]) -> str:
    blocks, now = [], []
    for kind, what, usable in [*items, ("tag", "p", True)]:
        if kind == "text":
            if usable:
                now.append(html.unescape(what))
        elif what in _BLOCK:
            text = " ".join("".join(now).split())
            if text:
                blocks.append(text)
            now = []
        elif what == "br":
            now.append(" ")
    return "\n\n".join(blocks)


def extract_main_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row of ``pages``.

    ``text`` is the main text of the whole ``html``: character references
    decoded, white space within a block one space, blocks joined by two line
    feeds.  A null or empty page, and one without content, gives the empty
    text.  Rows that repeat are read each, no rows give none, other columns are
    ignored.
    """
    if weights is None:
        weights = fit_weights(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor(weights)
        for batch in in_slices(batches, 512):
            out = [extract(page) if page else "" for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
