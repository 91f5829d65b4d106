"""Registered queries: their columns, and their SQL where there is any."""

from __future__ import annotations

import pytest

from counterfold.llm.queries import QUERIES, SQL
from tools.compare import connect, differences

COLUMNS = {
    "op1_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op2_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op3_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op4_ngram_join": ["doc_id", "n_shingles", "component_id"],
    "op5_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op6_exact_topk": ["query_id", "rank", "vec_id", "score"],
    "op7_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op8_ann": ["query_id", "rank", "vec_id", "score"],
    "op9_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op10_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op11_lexical_search": ["item_id", "rank", "doc_id", "score"],
    "op12_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op13_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
}


def test_all_are_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) == set(COLUMNS) and {*COLUMNS, "pipeline"} <= set(entry.queries())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_covers_its_table(spark, sf_dir, name):
    out = QUERIES[name](spark, sf_dir)
    assert out.columns == COLUMNS[name]
    if name == "op12_prefix_trie":  # nodes are named by their smallest member; the root counts them all
        ids = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
        assert [r.n_convs for r in out.where("depth = 0").collect()] == [ids]
        return
    table, key = {
        "op2_html_extraction": ("pages", "page_id"), "op6_exact_topk": ("embeddings", "vec_id"), "op8_ann": ("embeddings", "vec_id"),
        "op11_lexical_search": ("benchmark", "item_id"),
    }.get(name, ("documents", "doc_id"))
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key)
    if table == "embeddings":
        source, out = source.where(f"{key} % 20 = 0"), out.withColumnRenamed("vec_id", "found").withColumnRenamed("query_id", key)
    assert out.select(key).distinct().count() == source.distinct().count() == source.join(out.select(key).distinct(), key).count()
