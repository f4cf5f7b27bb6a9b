import corpus_pipeline
import pytest

from quillstone.llm import near_duplicates, toxicity
from quillstone.llm.shared import settle, table


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = settle(stage(spark, docs, sf_dir), f"test-{name}")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages(spark, sf_dir, stages):
    columns = table(spark, sf_dir, "documents").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert all(after.columns == columns for _, after in stages[:-1]) and stages[-1][1].columns == [*columns, "shard", "slot"]


def test_each_stage_against_its_operator(spark, sf_dir, stages):
    (before, after), (b2, a2), (_, a3), (b4, a4), (b5, a5) = stages
    lexicon = toxicity.learn(before, table(spark, sf_dir, "labels"))
    assert ids(after) == ids(toxicity.with_scores(before, lexicon).where(f"_score < {toxicity.THRESHOLD}"))
    heads = {r["class_id"] for r in near_duplicates.near_classes(b2).collect()}
    assert ids(a2) == heads and a2.count() == len(heads)
    from quillstone.llm.decontamination import find_hits

    assert find_hits(a3, table(spark, sf_dir, "benchmark")).where("size(hit_items) > 0").count() == 0
    assert a3.where("n_chars != length(text)").count() == 0
    assert ids(a4) <= ids(b4) and a5.count() == b5.count() == a4.count()
    sizes = [r["count"] for r in a5.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_run_is_repeatable(spark, sf_dir, stages):
    got = {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {tuple(r) for r in stages[-1][1].collect()}


def test_empty_and_odd(spark, sf_dir, make, odd_rows):
    for rows in ([], odd_rows):
        docs = make(rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = settle(stage(spark, docs, sf_dir), "test-odd")
        assert docs.count() <= 3 * len(rows)
