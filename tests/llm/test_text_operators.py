"""Token counts, packing, line dedup, personal data and page text on small fixtures."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from counterfold.llm import html_extraction, line_dedup, packing, pii, token_counts, word_codec
from tests.llm.conftest import AWKWARD


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


# ------------------------------------------------------------------ tokens


def test_codec_equals_the_library(tokenizer):
    rng = random.Random(5)
    alphabet = "abz ABZéÉßİΣσ́क中\U0001f600 \t\n\x1c\x85  ''sstllre.,!?-_<|>0129²Ⅻ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|startoftext|>b <|endoftext|", "we're I'LL 'S's", "x" * 5000, *(t or "" for _, t, _ in AWKWARD)]
    codec = word_codec.WordCodec("word_bpe_49k.json", limit=200)  # small: it is emptied on the way
    got = [np.frombuffer(b, "<u4").tolist() for s in range(0, len(texts), 100) for b in codec.encode(texts[s:s + 100])]
    assert got == [ids_of(tokenizer, t) for t in texts]


def test_latin_texts_need_no_cache_of_words(tokenizer):
    rng = random.Random(6)
    latin = [chr(c) for c in range(0x180)]
    texts = ["".join(latin), *(a + b for a in latin for b in ("x", " ", "'s", "1", "\u0149"))]
    texts += ["".join(rng.choices(latin, k=40)) for _ in range(3000)]
    got = [np.frombuffer(b, "<u4").tolist() for b in word_codec.WordCodec("word_bpe_49k.json").encode(texts)]
    assert got == [ids_of(tokenizer, t) for t in texts]
    codec = word_codec.WordCodec("word_bpe_49k.json")
    codec.encode([f"{a}Été{b}" for a in ("", "(", "\"", "1") for b in (".", ",", "!", ")", "'s", "2")])  # 24 words
    assert not codec.words and set(codec.pieces) == {"(", '"', "1", "été", ".", ",", "!", ")", "'s", "2"}


def test_runs_of_letters_skip_the_pattern(monkeypatch):
    words = ["Straße", "İstanbul", "ÀÉÎ", "abc", "don't", "a1b2", "x,y", "ªº", "ǅ"]
    want = [np.array(word_codec.WordCodec("word_bpe_49k.json").tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    asked = []

    class Noted:
        def findall(self, text, pieces=word_codec.PIECES):
            asked.append(text)
            return pieces.findall(text)

    monkeypatch.setattr(word_codec, "PIECES", Noted())
    assert word_codec.WordCodec("word_bpe_49k.json").encode(words) == want
    assert "abc" not in asked and "straße" not in asked and "don't" in asked


def test_token_counts(awkward, nothing, tokenizer):
    out = token_counts.count_tokens(awkward, limit=9)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((str(i), len((t or "").encode()), len(ids_of(tokenizer, t)), len(ids_of(tokenizer, t)) > 9) for i, t, _ in AWKWARD)
    assert sorted((str(r[0]), *r[1:]) for r in out.collect()) == want
    assert token_counts.count_tokens(nothing).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_closest_fill_is_closest(seed):
    rng = random.Random(seed)
    capacity = rng.randrange(5, 60)
    counts = {n: rng.randrange(0, 4) for n in rng.sample(range(1, 70), 12)}
    chosen = packing.closest_fill(dict(counts), capacity)
    assert all(k <= counts[n] for n, k in chosen.items())
    fitting = [n for n, c in counts.items() if c and n <= capacity]
    if not fitting:
        assert chosen == {}
        return
    first, sums = max(fitting), {0}
    for n, c in counts.items():
        sums = {s + k * n for s in sums for k in range(c + 1 - (n == first)) if s + k * n <= capacity - first}
    assert sum(n * k for n, k in chosen.items()) == first + max(sums)


@pytest.mark.parametrize("pool", [50, 4_000_000])
def test_packing_is_an_exact_cover(awkward, nothing, tokenizer, pool):
    out = packing.pack_documents(awkward.repartition(2), capacity=64, pool_ids=pool).collect()
    docs, sequences = collections.defaultdict(list), collections.defaultdict(list)
    ids = {zlib.crc32(str((i, len(ids_of(tokenizer, t)))).encode()): [*ids_of(tokenizer, t), 1] for i, t, _ in AWKWARD}
    for r in out:
        own = ids[zlib.crc32(str((r.doc_id, r.doc_tokens - 1)).encode())]
        piece = np.array(own[r.start:r.start + r.length], "<u4")
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32
        docs[r.doc_id, r.doc_tokens].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    times = collections.Counter((i, len(ids_of(tokenizer, t)) + 1) for i, t, _ in AWKWARD)
    for (key, pieces), copies in zip(sorted(docs.items(), key=str), [times[k] for k in sorted(docs, key=str)], strict=True):
        covered = collections.Counter(x for s, n in pieces for x in range(s, s + n))
        assert covered == {x: copies for x in range(key[1])}
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == 64 or end & (end - 1) == 0
    assert set(docs) == set(times) and packing.pack_documents(nothing).count() == 0


# ------------------------------------------------------------------ lines


def kept_by_hand(docs, min_docs, min_chars=1, keep_first=False):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = collections.defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders[key(line)].add((i, t))
    out, seen = [], set()
    for i, t in docs:
        kept = []
        for line in (t or "").split("\n"):
            k = key(line)
            goes = len(k) >= max(1, min_chars) and len(holders[k]) >= min_docs
            if goes and keep_first and k not in seen:
                seen.add(k)
                goes = False
            if not goes:
                kept.append(line)
        out.append((i, "\n".join(kept), len((t or "").split("\n")), len((t or "").split("\n")) - len(kept)))
    return out


@pytest.mark.parametrize("parts", ["1", "7"])
def test_lines_against_brute_force(spark, parts):
    rng = random.Random(2)
    lines = ["Common  line", " common  LINE\t", "other", "", "  ", "rÉsumé", "x"]
    docs = [(i, "\n".join(rng.choice([*lines, f"own {i}", f"pair {i // 2}"]) for _ in range(rng.randrange(1, 9)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "Common  line\n" * 3000), (None, "common  line\nq")]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        got = line_dedup.drop_repeated_lines(frame, 10)
        rows = sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got.collect())
        assert rows == sorted((str(i), *rest) for i, *rest in kept_by_hand(docs, 10))
        assert all(r.kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in got.collect())
        long_only = line_dedup.drop_repeated_lines(frame, 2, min_chars=6).collect()
        assert sorted((str(r.doc_id), r.text) for r in long_only) == sorted((str(i), t) for i, t, *_ in kept_by_hand(docs, 2, 6))
        # of each dropped line one occurrence stays, whichever document comes first in the sorted order
        first = line_dedup.drop_repeated_lines(frame, 10, keep_first=True).agg(F.sum("n_dropped")).first()[0]
        assert first == sum(r[3] for r in kept_by_hand(docs, 10, keep_first=True))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_lines_of_awkward_rows(awkward, nothing):
    out = line_dedup.drop_repeated_lines(awkward, 2)
    assert out.count() == len(AWKWARD) and {"keep", "toxic", "score", "source"} <= set(out.columns)
    assert {r.keep for r in out.collect()} == {"mine"}
    got = {r.doc_id: r.text for r in out.where("doc_id in (1, 6, 2)").collect()}
    assert got == {1: "", 6: "", 2: ""}  # one line in two documents; the repeated row is one document
    assert line_dedup.drop_repeated_lines(nothing).count() == 0


# ------------------------------------------------------------------ personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_hand(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) \
                    or kind == "card" and 12 <= len(digits) <= 19 and total % 10 == 0 or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(BASE).index(s[0])))


def test_plain_spans_equal_the_patterns():
    rng = random.Random(1)
    for alphabet in ("ab.@+-1 29()%_", "0123456789 -.", "1.2 ", "a@b."):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(45)))
            assert pii.plain_spans(text) == base_by_hand(text), text


@pytest.mark.parametrize("text, kind, source", [
    ("write to bob (at) mail (dot) example (dot) com now", "email", "bob (at) mail (dot) example (dot) com"),
    ("bob at mail dot example dot com ok", "email", "bob at mail dot example dot com"),
    ("mail j.d[at]foo.org", "email", "j.d[at]foo.org"),
    ("bоb@mаil.com", "email", "bоb@mаil.com"),
    ("bob＠mail．com", "email", "bob＠mail．com"),
    ("u@​mail.com", "email", "u@​mail.com"),
    ("call plus one five five five zero one two three four five six", "phone", "plus one five five five zero one two three four five six"),
    ("at one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ("１９２.１６８.１.１ z", "ip", "１９２.１６８.１.１"),
    ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
])
def test_disguises_map_back_to_the_source(text, kind, source):
    plain = pii.plain_spans(text)
    assert [(k, text[a:b]) for k, a, b in pii.disguised_spans(text, plain)] == [(kind, source)]


@pytest.mark.parametrize("text, kind, whole, part", [
    ("to jоhn@mail.com now", "email", "jоhn@mail.com", "hn@mail.com"),
    ("to jane@example.cоm now", "email", "jane@example.cоm", "jane@example.c"),
    ("to jane@mаil.example.com now", "email", "jane@mаil.example.com", None),
    ("to jane@mail.exаmple.com now", "email", "jane@mail.exаmple.com", "jane@mail.ex"),
    ("to john@mail.example dot com now", "email", "john@mail.example dot com", "john@mail.example"),
    ("call +44 20 7946 0９５８ now", "phone", "+44 20 7946 0９５８", "+44 20 7946 0"),
])
def test_whole_spans_beside_shorter_plain_ones(spark, text, kind, whole, part):
    row = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = sorted((text.index(w), text.index(w) + len(w)) for w in (whole, part) if w)
    assert row.spans == ",".join(f"{kind}:{a}:{b}" for a, b in want) and row[f"n_{kind}"] == len(want)
    plain = ",".join(f"{k}:{a}:{b}" for k, a, b in base_by_hand(text))
    assert row.base_sha256 == hashlib.sha256(plain.encode()).hexdigest()


@pytest.mark.parametrize("source", [
    "bob at example (dot) com", "bob at example [dot] com", "bob at example (dot) museum", "bob at example.com", "bob at mail dot example.com",
    "a.b.c.d.e at example dot com", "a dot b dot c dot d dot e dot f at example dot com", "bob at a.b.c.d.e.f.g dot com",
])
def test_addresses_with_at_in_words(source):
    for text in (source, f"write to {source} or so.", f"look at {source}. Then"):
        assert [(k, text[a:b]) for k, a, b in pii.disguised_spans(text, pii.plain_spans(text))] == [("email", source)], text


def test_at_in_words_needs_a_last_name():
    for text in ("look at this.then", "at 3.50 or at 10.5", "we met at noon.Next day", "at a.b at c.d", "x dot " * 3000 + "at y"):
        assert pii.disguised_spans(text, pii.plain_spans(text)) == []


def test_clean_texts_have_no_disguises():
    for text in ("meet me at noon (at the dot)", "one two three", "look at the dot on it", "café … “q” ™ 10²", "a@b", "[at]", "at dot at dot"):
        assert pii.disguised_spans(text, pii.plain_spans(text)) == []


def test_personal_data_query(spark, awkward, nothing):
    text = "a@b.cd or +1 (988) 555-2485 or 4041894974608795 or 42.144.35.254 or x [at] y.com"
    row = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in base_by_hand(text))
    assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (2, 1, 1, 1) and row.spans.startswith(base[:12])
    assert pii.find_personal_data(awkward).where("spans <> ''").count() == 0
    assert pii.find_personal_data(awkward).count() == len(AWKWARD) and pii.find_personal_data(nothing).count() == 0


# ------------------------------------------------------------------ pages

PAGES = [
    (1, "<html><body><nav><a>m e n u x y z</a></nav><div class='ad'>buy buy buy buy buy</div><article><h1>Head</h1><p>One  <b>t</b>wo &amp;&lt;<br>x"
        "<p>Last.</article><footer>f f f f f f f f</footer>", "Head\n\nOne two &< x\n\nLast."),
    (2, "<p>no marks</p><div class=\"comments list\"><p>reader says much much more</p></div><form>q w e r t y</form>", "no marks"),
    (3, None, ""), (4, "", ""), (5, "<nav>only menu words here</nav>", ""), (6, "plain text", "plain text"),
    (7, "<main><h1>T</h1><aside>s s s s s s s s</aside><script>var a='<p>';</script><p>B</p><!-- c --></main><div>tail words are here now</div>", "T\n\nB"),
    (8, "<article><p>a</p>" + "<p>x <i>y</i></p>" * 3000 + "</article>", "a\n\n" + "\n\n".join(["x y"] * 3000)),
    (9, "<div><p>unclosed <span>words <a href='", "unclosed words <a href='"),
]


def test_pages(spark, nothing):
    pages = spark.createDataFrame([(i, f"u{i}", h, "mine") for i, h, _ in PAGES] + [(None, None, None, None)], "page_id long, url string, html string, text string")
    got = html_extraction.extract_main_text(pages).collect()
    assert {r.page_id: r.text for r in got if r.page_id} == {i: want for i, _, want in PAGES}
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(PAGES) + 1
    assert html_extraction.extract_main_text(pages.limit(0)).count() == 0


INTRO = " ".join(f"intro{i}" for i in range(25))
LONG = " ".join(f"w{i}" for i in range(200))


@pytest.mark.parametrize("page, want", [
    (f"<main><h1>Title</h1><p>{INTRO}</p><article><p>{LONG}</p></article></main>", f"Title\n\n{INTRO}\n\n{LONG}"),
    (f"<main><article><p>{LONG}</p></article><p>{INTRO}</p></main>", f"{LONG}\n\n{INTRO}"),
    (f"<article>{INTRO}</article><article>{LONG}</article>", f"{INTRO}\n\n{LONG}"),
    (f"<article>{LONG}</article><article>short one</article>", f"{LONG}\n\nshort one"),
    (f"<p>before</p><article>a b</article><div>{LONG}</div><nav>menu</nav><article>c d</article><p>after</p>", "a b\n\nc d"),
    (f"<article>{INTRO}<article>inner words</article>{INTRO}</article>", f"{INTRO}\n\ninner words\n\n{INTRO}"),
    ("<article><h1>Title</h1>" + "<div><img></div>" * 500 + f"<p>{LONG}</p></article>", f"Title\n\n{LONG}"),
])
def test_all_marked_content_is_kept(page, want):
    assert html_extraction.Extractor({})(page) == want


@pytest.mark.parametrize("page, want", [
    (f"<body class='has-sidebar'><p>{LONG}</p></body>", LONG),
    (f"<body class='sidebar'><p>{LONG}</p><div class='sidebar'>s s s</div></body>", LONG),
    (f"<div id='page-with-sidebar'><article><p>{LONG}</p></article></div><p>other words</p>", LONG),
    (f"<div id='page-with-sidebar'><p>{LONG}</p></div>", LONG),
    (f"<article class='post no-comments'><p>{LONG}</p><div class='comments-area'>reader says</div></article>", LONG),
    (f"<form class='search'><div class='widget'><main><p>{LONG}</p></main></div></form>", LONG),
    (f"<div class='left-sidebar'><article>{INTRO}</article><article>{INTRO}</article></div>", f"{INTRO}\n\n{INTRO}"),
    (f"<p>{LONG}</p><div class='related-posts'><article>{INTRO}</article><article>{INTRO}</article></div>", LONG),
    (f"<p>{LONG}</p><aside><article>{INTRO}</article></aside>", LONG),
])
def test_wrappers_do_not_take_the_page_away(page, want):
    assert html_extraction.Extractor({})(page) == want


def test_a_whole_class_token_decides_before_its_pieces():
    extract = html_extraction.Extractor({".social-story": 3.0, ".plain-box": -4.0, ".box": 2.0})
    assert extract("<div class='social-story'>one two</div>") == "one two"
    assert extract("<div class='plain-box'>one two</div>") == ""
    assert extract("<div class='social-box'>one two</div>") == ""  # not seen: its pieces decide


def test_weights_come_from_labelled_pages(spark):
    page = "<body><div class='zq'>some other words</div><article><div class='good'>body words</div></article></body>"
    pages = spark.createDataFrame([(i, "u", page) for i in range(50)], "page_id long, url string, html string")
    weights = html_extraction.fit_weights(pages)
    assert weights[".zq"] < -2 < 0 < weights[".good"]
    plain = page.replace("article", "section")
    assert html_extraction.Extractor(weights)(plain) == "body words"


def test_layout_elements_are_never_taken_out(spark):
    """Weights learned where all menus stand in divs, on pages whose text stands in divs without marks."""
    menus = "<body>" + "<div class='topnav'>menu words of a long long menu</div>" * 9 + "<article><section>body words</section></article></body>"
    pages = spark.createDataFrame([(i, "u", menus) for i in range(200)], "page_id long, url string, html string")
    weights = html_extraction.fit_weights(pages)
    assert weights["div"] < -2 and weights[".topnav"] < -2
    extract = html_extraction.Extractor(weights)
    assert extract(f"<div id=page><div class=entry><p>{INTRO}</div></div>") == INTRO
    assert extract(f"<div class='topnav'>menu</div><div>{INTRO}</div><aside>side words</aside><div>end</div>") == f"{INTRO}\n\nend"
    inside = "<main><aside>" + "side words " * 50 + "</aside><p>body</p></main>"
    lifted = html_extraction.fit_weights(spark.createDataFrame([(i, "u", inside) for i in range(200)], "page_id long, url string, html string"))
    assert lifted["aside"] > -2 and html_extraction.Extractor(lifted)(inside) == "body"


@pytest.mark.parametrize("box", ["<div class=comments>reader says</div>", "<aside>side</aside>", "<form>a b c</form>", "<div class='ad'>buy</div>" * 30])
def test_text_goes_on_after_what_is_taken_out(box):
    page = f"<p>one two three four</p>{box}<p>more real words here now</p>"
    assert html_extraction.Extractor({})(page) == "one two three four\n\nmore real words here now"


def test_page_text_of_the_test_pages(spark, sf_dir):
    """On pages that mark their article, the text is that of the article's blocks."""
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html_extraction.extract_main_text(pages).collect()}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") + 9:r.html.rindex("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_lines_of_a_document_on_many_rows(spark):
    """Positions of dropped lines are kept once, however many rows repeat the document."""
    rows = [(1, "same line\nown 1\nsame line")] * 500 + [(i, f"same line\nown {i}") for i in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    maps = {r.doc_id: r.n_dropped for r in line_dedup.line_keep_bitmaps(docs).collect()}
    assert maps == {1: 2, **{i: 1 for i in range(2, 12)}}
    out = line_dedup.drop_repeated_lines(docs).where("doc_id = 1").select("text", "n_dropped").distinct().collect()
    assert [tuple(r) for r in out] == [("own 1", 2)]
