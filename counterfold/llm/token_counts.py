"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast table with the token counts of frequent pre-tokens
(white-space separated words, the first cut that the tokenizer makes); tier two
is a bounded cache in each worker, filled by encoding the words that both
miss.  No pre-token is ever shuffled: the plan is one map over the documents.
The table is fitted on a bounded sample of documents and only saves time; a
word's count is the library's wherever it comes from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfold.llm.common import in_slices, texts
from counterfold.llm.word_codec import WordCodec, split_words

#: Documents on which the table of frequent pre-tokens is fitted, at most (expected).
SAMPLE_DOCUMENTS = 4_000
#: Entries of the broadcast table, at most; at most 64 characters each.
TABLE_ENTRIES = 65_536
_LONGEST = 64


def frequent_lengths(
    docs: DataFrame, vocabulary: str, sample_documents: int = SAMPLE_DOCUMENTS, entries: int = TABLE_ENTRIES,
) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of a bounded sample of ``docs``."""
    n = docs.count()
    share = min(1.0, sample_documents / max(1, n))
    picked = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in in_slices(batches, 256):
            for text in texts(batch):
                seen.update(split_words(text))
            if len(seen) > 16 * entries:  # bounded, whatever the sample holds
                seen = Counter(dict(seen.most_common(8 * entries)))
        words = [w for w, _ in seen.most_common(entries) if len(w) <= _LONGEST]
        codec = WordCodec(vocabulary, limit=2 * entries)
        codec.learn(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([len(codec.words[w]) // 4 for w in words], pa.int32())],
            names=["word", "tokens"])

    table = docs.select("text").where(picked).limit(2 * sample_documents).repartition(1)
    return dict(table.mapInArrow(run, "word string, tokens int").toPandas().itertuples(index=False))


def count_tokens(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048, cache_entries: int = 300_000,
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row of ``docs``.

    A null or empty text has no bytes and no tokens.  Rows with the same or a
    null ``doc_id`` are counted each; no rows give none; columns other than
    ``doc_id`` and ``text`` are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    table = spark.sparkContext.broadcast(frequent_lengths(docs, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, codec, rare = table.value, WordCodec(vocabulary, limit=cache_entries // 2), {}
        for batch in in_slices(batches, 256):
            cut = [split_words(t) for t in texts(batch)]
            new = {w for ws in cut for w in ws if w not in frequent and w not in rare}
            if len(rare) + len(new) > cache_entries:
                rare = {}
                new = {w for ws in cut for w in ws if w not in frequent}
            codec.learn(new)
            rare |= {w: len(codec.words[w]) // 4 for w in new}
            n = [sum([frequent[w] if w in frequent else rare[w] for w in ws]) for ws in cut]
            tokens = pa.array(n, pa.int64())
            size = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.large_string())), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size, tokens, pc.greater(tokens, limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
