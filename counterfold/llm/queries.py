"""The operators of this package over their whole tables, with check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterfold.llm.ann import approximate_top_k
from counterfold.llm.common import read_table
from counterfold.llm.exact_topk import exact_top_k
from counterfold.llm.html_extraction import extract_main_text
from counterfold.llm.lexical_search import search_documents
from counterfold.llm.line_dedup import drop_repeated_lines
from counterfold.llm.mixing import mix_units
from counterfold.llm.ngram_join import near_duplicates
from counterfold.llm.packing import pack_documents
from counterfold.llm.pii import find_personal_data
from counterfold.llm.prefix_trie import prefix_trie
from counterfold.llm.substring_dedup import drop_repeated_passages
from counterfold.llm.token_counts import count_tokens
from counterfold.llm.toxicity import fit_toxicity, held_out, score_toxicity
from counterfold.llm.vectors import usable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


# A line's place in the text is its number; what stays is joined in that order.
SQL["op9_line_dedup"] = r"""
WITH cut AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM cut),
gone AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
per AS (SELECT doc_id, count(*) AS n_lines, count(g.k) AS n_dropped,
    string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.k IS NULL) AS kept
  FROM keyed LEFT JOIN gone g USING (k) GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM per"""


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))


@query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read_table(spark, sf_dir, "documents"))


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_units(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


@query
def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").where(usable(F.col("embedding"))).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64)).alias("vector"))
    return exact_top_k(vectors, F.col("vec_id") % 20 == 0, 20)


SQL["op6_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


@query
def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return approximate_top_k(vectors, F.col("vec_id") % 20 == 0, 20)


@query
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


# Links between all pairs that share an n-gram, then the least id along any path of links.
SQL["op4_ngram_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
ln AS MATERIALIZED (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
ed AS MATERIALIZED (SELECT a, b FROM ln UNION ALL SELECT b, a FROM ln),
re(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT re.x, ed.b FROM re JOIN ed ON re.y = ed.a),
least_id AS (SELECT x, min(y) AS component_id FROM re GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least_id ON x = d.doc_id"""


@query
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_passages(docs, window=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


# The windows of equal words in order of document and place; a word goes if a later one of them began at most 19 words before it.
SQL["op13_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 18, 1)), lambda i: array_to_string(ws[i:i + 19], ' '))) AS g,
    unnest(range(1, greatest(len(ws) - 18, 1))) AS i FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
c AS (SELECT u.doc_id, u.i, word,
    max(r.i) OVER (PARTITION BY u.doc_id ORDER BY u.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NULL AS kept
  FROM u LEFT JOIN r ON r.doc_id = u.doc_id AND r.i = u.i),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE NOT kept) AS n_removed,
    string_agg(word, ' ' ORDER BY i) FILTER (WHERE kept) AS t FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN s ON s.doc_id = w.doc_id"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


# A node is the path of its turns' digests; a subtree is what starts with its path. crc32 goes bit by bit.
SQL["op12_prefix_trie"] = r"""
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(c::VARCHAR, ''),
    lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM o)),
re AS (SELECT k.c, 0 AS part, o.i, r, t FROM k JOIN o ON o.c = base AND o.i <= h
  UNION ALL SELECT k.c, 1, o.i, r, t FROM k JOIN o ON o.c = k.c AND o.i > h),
se AS (SELECT c, row_number() OVER w AS d, length(t) AS size, string_agg(md5(length(r) || ':' || r || t), ',') OVER w AS path
  FROM re WINDOW w AS (PARTITION BY c ORDER BY part, i)
  UNION ALL SELECT c, 0, 0, '' FROM k),
le AS (SELECT c, max(d) AS n FROM se GROUP BY c),
nd AS (SELECT path, d, min(se.c) AS c, count(*) AS m, max(size) AS size,
    string_agg(se.c::VARCHAR, ',' ORDER BY se.c) FILTER (WHERE d = n) AS ends FROM se JOIN le USING (c) GROUP BY path, d),
ch AS (SELECT v.path, p.c AS up FROM nd v JOIN nd p ON p.d = v.d - 1 AND p.path = substr(v.path, 1, greatest(33 * v.d - 34, 0))),
le2 AS (SELECT path, NOT EXISTS (SELECT 1 FROM nd y WHERE y.d = x.d + 1 AND starts_with(y.path, x.path)) AS leaf FROM nd x),
su AS (SELECT v.path, count(*) FILTER (WHERE leaf) AS n_leaves, sum((u.m - 1) * u.size)::BIGINT AS saved
  FROM nd v JOIN nd u ON u.d >= v.d AND starts_with(u.path, v.path) JOIN le2 ON le2.path = u.path GROUP BY v.path)
SELECT nd.c AS conv_id, nd.d AS depth, up AS parent_conv_id, nd.m AS n_convs,
  (SELECT count(*) FROM nd y WHERE y.d = nd.d + 1 AND starts_with(y.path, nd.path)) AS n_children, n_leaves, saved AS saved_tokens,
  sha256(coalesce(ends, '')) AS ends_sha256
FROM nd JOIN su USING (path) LEFT JOIN ch USING (path)"""


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


SQL["op11_lexical_search"] = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
z AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM d),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, z GROUP BY term, nn),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // l))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN d USING (doc_id), z GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
