"""Files against manifests, sharded tables that resume, JSON lines and zipped files."""

import hashlib
import json

import pytest
from ledgerlens.sources import files
from pyspark.sql import functions as F

MANIFEST = "path string, size long, sha256 string"


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, data in (("a.txt", b"alpha"), ("deep/b c.bin", b"\x00\xff" * 10), ("empty", b""), ("extra", b"x"), ("extra2", b"y")):
        (tmp_path / "in" / name).write_bytes(data)
    return tmp_path / "in"


def test_digests(spark, folder):
    got = {r.path: (r.size, r.sha256) for r in files.digests(spark, str(folder)).collect()}
    assert got == {"a.txt": (5, sha(b"alpha")), "deep/b c.bin": (20, sha(b"\x00\xff" * 10)), "extra": (1, sha(b"x")), "extra2": (1, sha(b"y"))}
    assert [r.path for r in files.digests(spark, str(folder), "*.txt").collect()] == ["a.txt"]


def test_states(spark, folder):
    due = [("a.txt", 5, sha(b"alpha")), ("deep/b c.bin", 40, sha(b"\x00\xff" * 20)), ("empty", 0, sha(b"")), ("extra2", 1, "0"), ("gone", 1, sha(b"g"))]
    named = spark.createDataFrame(due, MANIFEST)
    states = files.compared(files.digests(spark, str(folder)), named)
    assert {r.path: r.state for r in states.collect()} == {"a.txt": "ok", "deep/b c.bin": "short", "empty": "missing", "extra2": "changed", "gone": "missing", "extra": "extra"}
    with pytest.raises(ValueError, match="deep/b c.bin short, empty missing, extra extra, extra2 changed, gone missing"):
        files.verified(spark, str(folder), named)
    assert files.verified(spark, str(folder), named.where("path = 'a.txt'"), ("ok", "extra")).count() == 4
    with pytest.raises(ValueError, match="twice"):
        files.verified(spark, str(folder), named.union(named))


def test_shards_resume(spark, tmp_path):
    rows, folder = spark.range(100).withColumn("t", F.concat(F.lit("t"), F.col("id").cast("string"))), str(tmp_path / "table")
    assert files.complete_shards(spark, folder) == set()
    assert files.write_shards(rows, folder, 3, "id") == 3 and files.write_shards(rows, folder, 3, "id") == 0
    whole = sorted(r.id for r in files.read_shards(spark, folder, 3).collect())
    assert whole == list(range(100)) and files.manifest(spark, folder).where("rows > 0").count() >= 3
    part = next((tmp_path / "table/data/shard-000001").glob("part-*"))
    part.write_bytes(part.read_bytes()[:-1] + b"\0")  # damage a shard
    (tmp_path / "table/data" / f".{part.name}.crc").unlink(missing_ok=True)
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    next((tmp_path / "table/manifest/shard-000002").glob("part-*")).unlink()  # and lose an entry
    assert files.complete_shards(spark, folder) == {0}
    with pytest.raises(ValueError, match=r"\[1, 2\]"):
        files.read_shards(spark, folder, 3)
    assert files.write_shards(rows, folder, 3, "id") == 2
    assert sorted(r.id for r in files.read_shards(spark, folder, 3).collect()) == whole
    assert not [p for p in (tmp_path / "table").rglob("_writing*")]


def test_json_lines_are_strict(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"id": 1, "t": "x"}\n{"id": null}\n')
    (tmp_path / "bad.jsonl").write_text('{"id": 1, "t": "x"}\n{"id": "one"}\n')
    assert [tuple(r) for r in files.json_lines(spark, str(tmp_path / "good.jsonl"), "id long, t string").collect()] == [(1, "x"), (None, None)]
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.json_lines(spark, str(tmp_path / "bad.jsonl"), "id long, t string").collect()


def test_zip_by_position(spark, tmp_path):
    lines = [json.dumps({"i": i}) for i in range(50)]
    (tmp_path / "labels").write_text("\n".join(lines) + "\n")
    (tmp_path / "inputs").write_text("\n".join(reversed(lines)))
    (tmp_path / "short").write_text("\n".join(lines[:-1]) + "\n")
    (tmp_path / "empty").write_text("")
    read = lambda name: files.numbered_lines(spark, str(tmp_path / name))
    got = sorted(tuple(r) for r in files.zipped(read("labels"), read("inputs")).collect())
    assert got == [(i, lines[i], lines[49 - i]) for i in range(50)] and read("empty").count() == 0
    with pytest.raises(Exception, match="line without right side: 49"):
        files.zipped(read("labels"), read("short")).collect()


def test_remaining(spark):
    todo = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "id long")
    done = spark.createDataFrame([(2, "c"), (9, "c")], "id long, config_sha256 string")
    assert sorted(str(r.id) for r in files.remaining(todo, done, "id", F.lit("c")).collect()) == ["1", "3", "None"]
    for other in ("d", None):
        with pytest.raises(ValueError):
            files.remaining(todo, done, "id", F.lit(other))
    assert files.remaining(todo, done.limit(0), "id", F.lit("d")).count() == 5
