import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["size", "shard", "slot", "_rank", "_group", "n_words", "hit_spans", "_score", "copies", "_key", "_node", "target"]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from texts, or from (doc_id, text, lang, source)."""

    def documents(rows, clash=False):
        full = [(i, r, "en", "s", None if r is None else len(r)) if not isinstance(r, tuple) else (*r, None if r[1] is None else len(r[1])) for i, r in enumerate(rows)]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("x") for c in CLASHING})
        return df

    return documents


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} and some filler number {i}" for i in range(6000))
    return [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (2, None, None, None),
        (None, "a text without an id", "en", None),
        (3, "", "de", "b"),
        (4, "   \n\t ", None, "b"),
        (5, long, "fr", "a"),
        (6, long, "fr", "a"),
        (7, "日本語 テキスト 😀 é", "ja", "c"),
        (None, None, None, None),
    ]
