"""Callers' columns come back as they were, whatever their names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillstone.llm import mixing, sharding, toxicity
from quillstone.llm.shared import settle

NAMES = ["_metadata", "_file", "_row", "_FILE_", "_copies", "_copy", "_score", "_terms", "toxic", "_node", "_key", "_doc", "_count", "label", "node", "quality", "_quality", "_times", "_new", "_cut", "words", "a.b", "_in0", "_part", "file", "row", "head", "bands", "_id", "_tie"]
TEXTS = ["an idiot of a text number " + " ".join(f"w{i * 7 + j}" for j in range(40)) for i in range(30)]


@pytest.fixture(scope="module")
def docs(make):
    df = make([(i if i % 5 else None, t, "en", "s" if i % 3 else None) for i, t in enumerate(TEXTS)] + [(77, None, None, None), (77, "", "en", "t")])
    return df.withColumns({n: F.concat(F.lit(f"{n} of "), F.coalesce(F.md5("text"), F.lit("none"))) for n in NAMES})


def values(df):
    return {(r["doc_id"], r["text"], *(r[n] for n in NAMES)) for r in df.collect()}


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_them(spark, sf_dir, docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    after = settle(stage(spark, docs, sf_dir), f"test-{name}")
    assert after.columns[: len(docs.columns)] == docs.columns
    got = values(after)
    assert got <= values(docs) and (k in (0, 3) or len(got) == len(values(docs)))


def test_operators_keep_them(spark, docs):
    for after in (mixing.mix(docs), sharding.interleave(docs), toxicity.with_scores(docs, toxicity.Lexicon(["idiot"], [5.0], frozenset(), -1.0), "s", "n")):
        assert values(after) == values(docs)


def test_null_and_repeated_ids_share_no_slice(spark):
    df = spark.createDataFrame([(None, f"text {i}", "s") for i in range(4000)], "doc_id long, text string, source string")
    places = sharding.sharded_documents(df)
    sizes = [r["count"] for r in places.groupBy("shard").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) - min(sizes) <= 1
    mixed = mixing.mix(df.groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.first("text").alias("text")), size=F.lit(2), times=F.col("n"))
    assert mixed.count() == 4000 and {r["copies"] for r in mixed.collect()} == {1}
