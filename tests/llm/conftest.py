from __future__ import annotations

import pytest

#: Texts that every operator must take: null, empty, blank, very long, repeated, odd characters.
AWKWARD = [
    (1, "one two three four five six seven", "a"), (2, None, None), (3, "", "a"), (4, " \t\n\x0b ", "b"),
    (5, "long words here " * 20_000, "a"), (6, "one two three four five six seven", "b"), (6, "one two three four five six seven", "b"),
    (None, "a row without an id", "c"), (None, None, None), (9, "Über straße İ ΣΣ x́ café <|endoftext|> \U0001f600 a b\x1cc don't I'll", "c"),
    (10, "x\n\ny\n  Same Line \n", "a"), (11, "word" * 3000, "c"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward documents with extra columns whose names operators might use themselves."""
    rows = [(*r, 7, "mine", True, 0.5) for r in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, keep string, toxic boolean, score double")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
