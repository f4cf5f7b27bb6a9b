import pytest

from quillstone.operators.dataset import features_of
from quillstone.operators.predicate import field


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    from quillstone.store import Root

    c = Root(spark, str(tmp_path_factory.mktemp("ds"))).collection("rows")
    c.put_many((f"doc{i:02d}", {"id": i, "name": f"item{i}", "category": "ABC"[i % 3], "score": i * 10}) for i in range(30))
    return c


def test_index_and_slice(rows):
    ds = rows.dataset()
    assert len(ds) == 30 and ds[0]["id"] == 0 and ds[-1]["id"] == 29
    assert [d["id"] for d in ds[5:12:3]] == [5, 8, 11]
    assert [d["id"] for d in ds[3:0:-1]] == [3, 2, 1]
    with pytest.raises(IndexError):
        ds[30]


def test_select_keeps_order_and_repeats(rows):
    assert [d["id"] for d in rows.dataset().select([5, 2, 5]).select([2, 1])] == [5, 2]


def test_shuffle(rows):
    ds = rows.dataset()
    a, b, c = ([d["id"] for d in ds.shuffle(s)] for s in (1, 1, 2))
    assert a == b != c and sorted(c) == list(range(30))


def test_map_filter_take_skip_batch(rows):
    ds = rows.dataset().map(lambda d: {"double": d["id"] * 2}).filter(lambda d: d["double"] >= 40)
    assert [d["double"] for d in ds.skip(1).take(2)] == [42, 44]
    assert [len(b) for b in rows.dataset().batch(8)] == [8, 8, 8, 6]
    assert rows.dataset().batches(8).count() == 4
    assert len(rows.dataset().filter({"category": "A"})) == 10
    assert len(rows.dataset().filter(field("score", "int") >= 200).shuffle(3).take(4)) == 4


def test_features_and_split(rows):
    assert rows.dataset().features == {"id": "int64", "name": "string", "category": "string", "score": "int64"}
    assert features_of(rows.typed().schema) == {"category": "string", "id": "int64", "name": "string", "score": "int64", "_id": "string"}
    parts = rows.dataset().split(0.7, 0.15, 0.15, seed=4)
    assert [len(p) for p in parts] == [21, 5, 4]
    assert sorted(d["id"] for p in parts for d in p) == list(range(30))


def test_iterable(rows):
    it = rows.iterable()
    assert [d["id"] for d in it] == list(range(30)) == [d["id"] for d in it]
    assert sorted(d["id"] for d in it.shuffle(7, seed=3)) == list(range(30))
    assert [d["id"] for d in it.shuffle(7, seed=3)] == [d["id"] for d in it.shuffle(7, seed=3)]
    assert [d["id"] for d in it.filter({"category": "B"}).take(2)] == [1, 4]
    assert [d["id"] for d in it.skip(27)] == [27, 28, 29]
    assert [d["x"] for d in it.filter({"category": "C"}).map(lambda d: {"x": d["id"]}).take(1)] == [2]
    assert [len(b) for b in it.batch(12)] == [12, 12, 6]
    assert all(sorted(d["id"] for d in epoch) == list(range(30)) for epoch in it.epochs(2))
