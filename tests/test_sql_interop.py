import json
import zipfile

import pandas as pd
import pyarrow as pa
import pytest

from quillstone import cli, errors, interop, sql
from quillstone.sources import archive, datasource, hub


@pytest.fixture
def users(root):
    c = root.collection("users")
    c.put_many((f"doc_{i:03d}", {"id": i, "name": f"user{i}", "age": 20 + i % 50, "score": i * 1.5, "active": i % 2 == 0}) for i in range(100))
    return c


def test_session(root, users):
    root.collection("products").put_many((f"p{i}", {"name": f"product{i}", "price": 10 + 5 * i}) for i in range(10))
    s = sql.Session(root).register("users").register("products", "p")
    assert s.query("SELECT count(*) FROM users WHERE age > 30").first()[0] == sum(20 + i % 50 > 30 for i in range(100))
    assert s.query("SELECT name FROM users UNION ALL SELECT name FROM p").count() == 110
    assert s.query("SELECT count(*) FROM users WHERE age >= ? AND active = ?", [60, True]).first()[0] == sum(20 + i % 50 >= 60 and i % 2 == 0 for i in range(100))
    assert len(s.query_df("SELECT users.name FROM users JOIN p ON users.id = p.price")) == 10
    top = s.query("SELECT active, name FROM users QUALIFY row_number() OVER (PARTITION BY active ORDER BY score DESC) = 1").collect()
    assert {(r[0], r[1]) for r in top} == {(True, "user98"), (False, "user99")}
    assert s.export("SELECT id, name FROM users WHERE age >= 60", "old", "id") == 20
    assert root.collection("old").count() == 20
    assert s.export("SELECT name FROM users", "copy") == 100
    assert root.collection("copy").exists("row_00000099")
    assert s.query(f"SELECT count(*) FROM read_collection('{root.path}', 'users')").first()[0] == 100
    s.close()
    assert not root.spark.catalog.tableExists("users")


def test_helpers(root, users):
    assert sql.count_where(root, "users", "age > 30 AND active") == sum(20 + i % 50 > 30 and i % 2 == 0 for i in range(100))
    got = {r[0]: r[1] for r in sql.aggregate(root, "users", "active", "count(*) AS n").collect()}
    assert got == {True: 50, False: 50}
    assert sql.query(root, "users", "SELECT avg(score) FROM data").first()[0] == 74.25
    assert sql.copy_to(root, "SELECT id, id * 2 AS twice FROM range(5)", "twice", "id") == 5
    with pytest.raises(errors.InvalidDocument):
        sql.Session(root).register(root.collection("empty").name)


def test_sparse_frames(root):
    c = root.collection("sparse")
    c.put_many([("x", {"a": 1}), ("y", {"b": 2}), ("z", {"a": 3, "b": 4})])
    t = interop.read_arrow(root, "sparse").to_pylist()
    assert sorted(map(json.dumps, t)) == sorted(map(json.dumps, [{"a": 1, "b": None, "_id": "x"}, {"a": None, "b": 2, "_id": "y"}, {"a": 3, "b": 4, "_id": "z"}]))
    assert sorted(interop.read_pandas(root, "sparse", ["b"])["b"].dropna()) == [2, 4]
    assert interop.read_pandas(root, "missing").empty
    assert sum(b.num_rows for b in interop.arrow_batches(root, "sparse", 2)) == 3


def test_writers(root, tmp_path):
    frame = pd.DataFrame({"text": ["a", "b"], "score": [0.5, 1.5]})
    assert interop.write_pandas(root, frame, "frame") == 2
    assert root.collection("frame").get("doc000001") == {"text": "b", "score": 1.5}
    assert interop.write_arrow(root, pa.table({"k": ["u", "v"], "n": [1, 2]}), "arrow", "k") == 2
    assert interop.write_dataset(root, {"train": frame, "test": frame[:1]}) == {"train": 2, "test": 1}
    assert root.collection("train").exists("doc_00000001")
    (tmp_path / "in.json").write_text('[{"_id": "own", "v": 1}, {"v": 2}]')
    assert interop.import_json(root, str(tmp_path / "in.json"), "imported") == 2
    c = root.collection("imported")
    assert list(c) == ["own", "import_1"]
    interop.export_json(c, str(tmp_path / "out.json"))
    assert json.loads((tmp_path / "out.json").read_text()) == [{"_id": "own", "v": 1}, {"_id": "import_1", "v": 2}]
    interop.export_table(c, str(tmp_path / "csv"), "csv")
    assert root.spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    assert interop.merged(c, root.collection("frame")).count() == 4


def test_archive(root, users, tmp_path):
    users.flush()
    packed = str(tmp_path / f"s{archive.SUFFIX}")
    archive.pack(root.path, packed)
    box = archive.Container(packed)
    assert box.is_zip and not box.is_writable and box.list_collections() == ["users"]
    from quillstone.store import Root

    assert Root(root.spark, box.folder(str(tmp_path / "un")), "r").collection("users").count() == 100
    with pytest.raises(errors.InvalidContainer):
        box.write("x", b"")
    evil = str(tmp_path / "evil.zip")
    with zipfile.ZipFile(evil, "w") as z:
        z.writestr("../x", "boo")
    with pytest.raises(errors.InvalidContainer):
        archive.unpack(evil, str(tmp_path / "e"))
    assert not (tmp_path / "x").exists()


def test_hub(root, users, monkeypatch, tmp_path):
    users.flush()
    assert len(hub.load_remote(root.spark, root.path)) == 100
    assert sum(1 for _ in hub.load_remote(root.spark, root.path, split="users", streaming=True).take(3)) == 3
    info = hub.dataset_info(root.spark, root.path)
    assert info.collections == ("users",) and info.size_bytes > 0
    assert hub.parse_uri("owner/repo@v1") == ("github", "owner/repo@v1")
    assert hub.parse_uri("S3://bucket/key") == ("s3", "bucket/key")
    assert hub.provider("github").parse("owner/repo@v1") == {"host": "github.com", "owner": "owner", "repo": "repo", "revision": "v1"}
    assert hub.provider("git").parse("git.example.com/o/r")["host"] == "git.example.com"
    assert hub.provider("s3").resolve("b/k", tmp_path) == "s3a://b/k"
    assert hub.provider("azure").parse("acc/box/k/l") == {"account": "acc", "container": "box", "key": "k/l"}
    assert hub.provider("hf").parse("o/n@main") == {"owner": "o", "name": "n", "revision": "main"}
    with pytest.raises(NotImplementedError):
        hub.provider("ftp").resolve("host/x", tmp_path)
    for bad in ("nope", "a b/c"):
        with pytest.raises(ValueError):
            hub.provider("github").parse(bad)
    with pytest.raises(ValueError):
        hub.provider("gopher")
    monkeypatch.setenv(hub.CACHE_VARIABLE, str(tmp_path / "cache"))
    (hub.cache_dir() / "git").mkdir()
    hub.clear_cache()
    assert not (tmp_path / "cache").exists()


def test_data_source(root, users):
    users.delete("doc_005")
    users.put("doc_006", {"id": 6, "name": "new", "age": 1, "score": 0.0, "active": False})
    users.flush()
    datasource.register(root.spark)
    df = root.spark.read.format("quillstone").options(root=root.path, collection="users").load()
    assert df.count() == 99 and df.columns[-1] == "_id"
    assert df.where("_id = 'doc_006'").select("name").collect()[0][0] == "new"
    assert df.where("_id IN ('doc_005', 'doc_007') AND age > 0").count() == 1
    assert root.spark.sql(f"SELECT count(*) FROM read_collection('{root.path}', 'users') a JOIN read_collection('{root.path}', 'users') b ON a.id = b.id").first()[0] == 99


def test_cli(spark, tmp_path, capsys):
    path = str(tmp_path / "cli")
    run = lambda *a: cli.main(list(a), spark)
    assert run("init", path) == 0
    assert run("put", path, "a", "--data", '{"x": {"y": 1}, "z": 2}') == 0
    assert run("put", path, "b", "--data", '{"z": 3}') == 0
    capsys.readouterr()
    assert run("get", path, "a") == 0
    assert json.loads(capsys.readouterr().out) == {"x": {"y": 1}, "z": 2}
    assert run("scan", path, "--jsonl", "--fields", "x.y,z", "--limit", "1") == 0
    assert json.loads(capsys.readouterr().out) == {"_id": "a", "y": 1, "z": 2}
    assert run("scan", path) == 0
    assert [d["_id"] for d in json.loads(capsys.readouterr().out)] == ["a", "b"]
    assert run("stats", path, "--json") == 0
    assert json.loads(capsys.readouterr().out)[0]["documents"] == 2
    assert run("sql", path, "SELECT sum(z) AS s FROM data") == 0
    assert json.loads(capsys.readouterr().out) == {"s": 5}
    assert run("validate", path) == 0 and run("delete", path, "a") == 0 and run("reindex", path) == 0
    assert run("get", path, "a") == 1
    assert run("export", path, str(tmp_path / "x.json")) == 0 and run("import", path, str(tmp_path / "x.json"), "-c", "again") == 0
    assert run("pack", path, str(tmp_path / "p.qz")) == 0 and run("unpack", str(tmp_path / "p.qz"), str(tmp_path / "q")) == 0
    capsys.readouterr()
    assert run("list", str(tmp_path / "q")) == 0
    assert capsys.readouterr().out.split() == ["again", "default"]


def test_stream(spark, root, tmp_path):
    from pyspark.sql import functions as F

    from quillstone.streaming.collections import read_changes, write_stream
    from quillstone.streaming.windows import first_of_each, tumbling_counts

    source = spark.range(20).select(F.concat(F.lit("k"), (F.col("id") % 15).cast("string")).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit("view").alias("event_type"))
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    c = root.collection("streamed")
    q = write_stream(first_of_each(stream, ["k"], "1 hour"), c, "k", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert c.count() == 15
    q = read_changes(c).writeStream.format("memory").queryName("changes").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("changes").count() == 15
    assert tumbling_counts(source, "10 minutes").count() == 2
