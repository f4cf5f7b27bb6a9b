import json
import os
import time

import pytest

from quillstone import errors, layout
from quillstone.operators.predicate import And, Eq, Exists, Matches, NotExists, Or
from quillstone.store import Root


@pytest.fixture
def people(root):
    c = root.collection("people")
    with c.bulk():
        c.put("a", {"name": "Ann", "age": 30, "city": "Rome", "active": True})
        c.put("b", {"name": "Bob", "age": 25, "city": None})
        c.put("c", {"name": "Cy", "age": 30.0, "meta": {"x": {"y": [1, 2]}}})
    return c


def ids(df):
    return sorted(r["_id"] for r in df.select("_id").collect())


def test_crud(people):
    assert people.get("a") == {"name": "Ann", "age": 30, "city": "Rome", "active": True}
    assert "b" in people and "zz" not in people
    assert len(people) == 3 and list(people) == ["a", "b", "c"]
    people["a"] = {"name": "Ann", "age": 31}
    assert people["a"]["age"] == 31 and list(people) == ["a", "b", "c"]
    del people["b"]
    assert list(people) == ["a", "c"]
    with pytest.raises(errors.DocumentNotFound):
        people.get("b")
    with pytest.raises(KeyError):
        people.delete("b")
    assert people.get_or_none("b") is None
    people.put("b", {"name": "Bob2"})
    assert list(people) == ["a", "c", "b"]


def test_old_version_never_matches(people):
    people.put("a", {"name": "Ann", "age": 99})
    assert ids(people.scan(predicate={"age": 30})) == ["c"]
    assert ids(people.scan(predicate={"age": 99})) == ["a"]


def test_delete_all_survives_reopening(spark, root, people):
    people.delete_where(Exists("name"))
    assert people.count() == 0 and people.is_empty()
    assert Root(spark, root.path, "r").collection("people").count() == 0


def test_predicates(people):
    assert ids(people.scan(predicate=Eq("age", 30))) == ["a", "c"]
    assert ids(people.scan(predicate=Eq("age", 30, strict=True))) == ["a"]
    assert ids(people.scan(predicate=Eq("age", "30"))) == []
    assert ids(people.scan(predicate=Exists("city"))) == ["a", "b"]
    assert ids(people.scan(predicate=NotExists("city"))) == ["c"]
    assert ids(people.scan(predicate=Eq("city", None))) == ["b"]
    assert ids(people.scan(predicate={"city": None})) == ["b", "c"]
    assert ids(people.scan(predicate=Eq("meta.x.y", [1, 2]))) == ["c"]
    assert ids(people.scan(predicate=Eq("meta.x", {"y": [1, 2]}))) == ["c"]
    assert ids(people.scan(predicate=Eq("active", True))) == ["a"]
    assert ids(people.scan(predicate=And([]))) == ["a", "b", "c"]
    assert ids(people.scan(predicate=Or([]))) == []
    assert ids(people.scan(predicate=Eq("age", 25) | Exists("active"))) == ["a", "b"]
    assert ids(people.scan(predicate=Matches({}))) == ["a", "b", "c"]


def test_projection(people):
    got = people.scan(fields=["name", "meta.x"]).columns
    assert got == ["_id", "name", "x"]


def test_typed_view(people):
    df = people.typed()
    assert df.columns[-1] == "_id" and set(df.columns) == {"name", "age", "city", "active", "meta", "_id"}
    assert df.where("_id = 'c'").select("meta.x.y").first()[0] == [1, 2]
    text = people.typed(json_strings=True).where("_id = 'c'").select("meta").first()[0]
    assert json.loads(text) == {"x": {"y": [1, 2]}}


@pytest.mark.parametrize("good", ["doc001", "é1", "my-doc_123.v2"])
def test_good_ids(spark, good):
    from pyspark.sql import functions as F

    assert layout.validate_id(good) == good
    assert spark.range(1).select(layout.valid_id(F.lit(good))).first()[0]


@pytest.mark.parametrize("bad", ["", "../evil", ".hidden", "a..b", "a\n", "a b"])
def test_bad_ids(spark, root, bad):
    from pyspark.sql import functions as F

    with pytest.raises(errors.InvalidDocumentId):
        root.collection("c").put(bad, {})
    assert not spark.range(1).select(layout.valid_id(F.lit(bad))).first()[0]


def test_strict_across_sessions(spark, root):
    c = root.collection("s", strict=True)
    c.put("a", {"n": 1, "t": "x"})
    with pytest.raises(errors.SchemaMismatch):
        c.put("b", {"n": 1.5, "t": "x"})
    c.flush()
    again = Root(spark, root.path).collection("s")
    assert again.strict
    with pytest.raises(errors.SchemaMismatch):
        again.put("b", {"n": 1})
    again.put("b", {"t": "y", "n": 2})
    with pytest.raises(errors.SchemaMismatch):
        again.write(spark.createDataFrame([("k", 1.5)], "k string, n double"), "k")
    assert again.count() == 2


def test_read_only(spark, root, people):
    people.flush()
    view = Root(spark, root.path, "r").collection("people")
    for write in (lambda: view.put("x", {}), lambda: view.delete("a"), view.compact, lambda: view.put_lines("{}")):
        with pytest.raises(errors.ReadOnlyStore):
            write()
    with pytest.raises(errors.CollectionNotFound):
        Root(spark, root.path, "r").collection("missing")
    assert view.count() == 3


def test_other_layouts_and_malformed_lines(spark, tmp_path):
    base = tmp_path / "old" / "collections" / "c"
    os.makedirs(base / "docs")
    os.makedirs(base / "meta")
    (base / "docs" / "one.json").write_text('{\n  "v": 1\n}')
    (base / "docs" / "two.json").write_text('{"v": 2}')
    (base / "docs" / "broken.json").write_text('{"v": ')
    (base / "meta" / "data.jsonl").write_text('{"_id":"two","v":22}\nnot json\n\n{"_id":"three","v":3}\n{"_id":"three","v":33}\n')
    c = Root(spark, str(tmp_path / "old")).collection("c")
    assert {r["_id"]: r["v"] for r in c.typed("v bigint").collect()} == {"one": 1, "two": 22, "three": 33}
    c.delete("one")
    c.put("four", {"v": 4})
    assert c.compact() == 3
    assert {r["_id"]: r["v"] for r in c.typed("v bigint").collect()} == {"two": 22, "three": 33, "four": 4}
    assert c.stats()["batches"] == 1
    c.put("two", {"v": 222})
    assert c.get("two") == {"v": 222}


def test_compaction_keeps_ids_of_files(spark, tmp_path):
    base = tmp_path / "f" / "collections" / "c" / "docs"
    os.makedirs(base)
    (base / "x.json").write_text("{}")
    (base / "y.json").write_text('{\n "a": "b, c"\n}')
    c = Root(spark, str(tmp_path / "f")).collection("c")
    assert c.compact() == 2
    assert c.get("x") == {} and c.get("y") == {"a": "b, c"}


def test_uncommitted_batches_are_ignored(root, people):
    people.flush()
    base = layout.batches_dir(root.path, "people")
    os.makedirs(f"{base}/000000009-put")
    with open(f"{base}/000000009-put/part-0", "w") as f:
        f.write('{"_id":"ghost"}\n')
    assert "ghost" not in people
    assert people.uncommitted() == ["000000009-put"]
    assert not people.validate()["ok"]
    people.validate(fix=True)
    assert people.validate()["ok"]


def test_bulk_lines_and_frames(spark, root):
    c = root.collection("bulk", batch_size=100)
    assert c.put_lines('{"_id":"l1","v":1}\n\n{"_id":"l2","v":2}') == 2
    assert c.put_many((f"d{i:03d}", {"id": i, "value": 2 * i, "category": "ABC"[i % 3]}) for i in range(250)) == 250
    assert c.count() == 252
    assert c.write(spark.range(5).withColumnRenamed("id", "n")) == 5
    assert c.get("doc000003") == {"n": 3}
    with pytest.raises(errors.InvalidDocumentId):
        c.write(spark.createDataFrame([("a/b",)], "k string"), "k")
    assert c.count() == 257
    assert ids(c.get_many(["d001", "d002", "nope"])) == ["d001", "d002"]
    assert c.get_at(2) == {"id": 0, "value": 0, "category": "A"}
    with pytest.raises(IndexError):
        c.get_at(999)


def test_schemas_and_types(root):
    c = root.collection("mixed")
    for i, v in enumerate(["hello", 42, 3.14, True, None, [1, 2, 3], {"deep": {"nested": True}}]):
        c.put(f"m{i}", {"value": v})
    assert c.stats()["schemas"] == 7
    assert c.schemas().count() == 7
    assert [c.get(f"m{i}")["value"] for i in range(7)] == ["hello", 42, 3.14, True, None, [1, 2, 3], {"deep": {"nested": True}}]


def test_collections_are_apart(root):
    for name in ("train", "test"):
        root.collection(name).put("same", {"split": name})
        root.collection(name).flush()
    root.collection("train").put("same", {"split": "train"})
    c = root.collection("train")
    c.put("same", {"split": "train"})
    c.flush()
    t = root.collection("test")
    t.put("same", {"split": "test"})
    assert c.get("same") == {"split": "train"} and t.get("same") == {"split": "test"}
    assert root.list_collections() == ["test", "train"]


def test_lock(root):
    with root.write_lock(), pytest.raises(errors.StoreLocked):
        other = Root(root.spark, root.path)
        with other.write_lock(wait=0.2):
            pass


def test_exports_and_preload(people):
    import quillstone

    assert quillstone.Eq("age", 25).column() is not None and quillstone.backend().startswith("spark")
    assert all(hasattr(quillstone, n) for n in quillstone.__all__)
    kept = people.preload()
    assert kept.is_cached and kept.count() == 3
    kept.unpersist()


def test_tuned_session(spark):
    from quillstone.session import tuned

    own = tuned(spark.newSession(), 10 << 30)
    assert int(own.conf.get("spark.sql.shuffle.partitions")) == 80
    assert int(tuned(spark.newSession(), 0).conf.get("spark.sql.shuffle.partitions")) == spark.sparkContext.defaultParallelism


def test_a_batch_committed_during_compaction_stays(spark, root, people, monkeypatch):
    """Another writer waits for the compaction and is neither lost nor hidden by the snapshot."""
    import threading

    other, seen = Root(spark, root.path), []

    def late():
        c = other.collection("people")
        c.put("late", {"name": "Late"})
        c.flush()
        seen.append(time.monotonic())

    thread, publish = threading.Thread(target=late), type(people)._publish

    def slow(self, kind, staged):
        if kind == "snapshot":
            thread.start()
            time.sleep(1.0)
            assert not seen
        publish(self, kind, staged)

    monkeypatch.setattr(type(people), "_publish", slow)
    people.compact()
    thread.join()
    assert sorted(people) == ["a", "b", "c", "late"]
    monkeypatch.undo()
    people.compact()
    assert sorted(people) == ["a", "b", "c", "late"]


def test_a_lock_left_behind_is_taken_over(spark, root, people):
    path = layout.lock_file(root.path)
    root.files.write(path, json.dumps({"owner": "dead", "time": time.time() - 3600}))
    people.put("d", {"name": "Dee"})
    people.flush()
    assert "d" in people and not root.files.exists(path)


def test_a_lost_lock_stops_its_holder(root):
    with pytest.raises(errors.StoreLocked), root.write_lock(lease=30) as still:
        root.files.write(layout.lock_file(root.path), json.dumps({"owner": "another", "time": time.time()}))
        still()
    root.files.delete(layout.lock_file(root.path))


def test_a_failed_commit_keeps_the_buffer(root, people, monkeypatch):
    people.flush()
    real = type(people)._publish

    def fail(self, kind, staged):
        raise errors.StoreLocked("held")

    with people.bulk():
        people.put("e", {"name": "Eve"})
        monkeypatch.setattr(type(people), "_publish", fail)
        with pytest.raises(errors.StoreLocked):
            people.flush()
        monkeypatch.setattr(type(people), "_publish", real)
    assert people["e"] == {"name": "Eve"}


def test_places_after_deletion(people):
    people.delete("a")
    people.put("a", {"name": "Ann2"})
    people.delete("b")
    people.put("a", {"name": "Ann3"})
    people.flush()
    assert list(people) == ["c", "a"] and people["a"] == {"name": "Ann3"}


def test_bad_ids_fail_the_write(spark, root):
    c = root.collection("bad")
    with pytest.raises(errors.InvalidDocumentId, match="x/y"):
        c.write(spark.createDataFrame([("ok", 1), ("x/y", 2)], "id string, v int"), "id")
    assert c.count() == 0 and c.write(spark.createDataFrame([("ok", 1), ("fine", 2)], "id string, v int"), "id") == 2


def test_data_source_infers_from_all_documents(spark, root):
    from quillstone.sources import datasource

    c = root.collection("many")
    c.write(spark.range(1500).selectExpr("concat('k', lpad(id, 5, '0')) AS id", "CASE WHEN id < 1400 THEN CAST(id AS DOUBLE) END AS n"), "id")
    c.write(spark.sql("SELECT 'z' AS id, 1.5D AS n, 'late' AS extra"), "id")
    got = {f.name: f.dataType.simpleString() for f in datasource.infer(root.path, "many").fields}
    assert got == {"id": "string", "n": "double", "extra": "string", "_id": "string"}


def test_blobs_and_saved_schemas(root, people):
    people.flush()
    lines = b"".join(bytes(r["content"]) for r in people.blobs().orderBy("path").collect()).decode().splitlines()
    assert sorted(json.loads(x)["_id"] for x in lines) == ["a", "b", "c"]
    saved = people.save_schemas().collect()
    assert sum(r["count"] for r in saved) == 3 and len(saved) == 3
    assert all(people.schema(r["schema_id"]) == json.loads(r["schema"]) for r in saved) and people.schema("none") is None
    assert people.strict_schema_id is None
    assert root.collection("nothing").blobs().count() == 0
    assert people.count() == 3 and people.validate()["ok"]
