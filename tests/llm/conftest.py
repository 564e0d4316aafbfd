import pytest
from hypothesis import strategies as st

#: Names that operators use inside or add.
CLASHES = (
    "key", "rep", "grp", "bucket", "rank", "hash", "range", "sig", "row", "id", "part", "copy", "place", "u", "cdf", "a", "b", "near_a", "spot", "digest", "size", "_n", "_row", "_start", "_bytes", "_part",
    "mix_source", "mix_rate", "mix_u", "mix_key", "mix_copy", "mix_copies", "mix_slot", "mix_part", "mix_place", "score", "kept", "n_words", "sample", "ids", "spans", "a.b", "text.x", "c0",
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Texts that every operator must take: null, empty, blank, short, repeated, long, with odd white space and marks.
ODD = [None, "", " ", "\n\n", "one", "one two three four", "a " * 3000, "x" * 5000, " a\x1cb\x85c d", "é" * 50 + " ñ " * 40, "word " * 40 + "\nword word\nword word\n\n", "▁ x <|endoftext|> y", "\U0001f600 " * 30]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, ties, repeated rows, null ids and a column that clashes with names used inside."""
    rows = [(k, t, "en", "a" if k % 3 else None, len(t or "")) for k, t in enumerate(ODD)]
    rows += [rows[6], rows[9], rows[9], (None, "word " * 60, None, "b", None), (None, None, None, None, None), (99, ODD[9], "fr", "b", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(1).alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(9, 1, 0), (10, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


words = st.sampled_from(["a", "b", "c", "dd", "e-e", "é"])
