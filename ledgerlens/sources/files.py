"""Files as tables: digests against manifests, sharded tables with resume, and JSON lines under a strict schema.

Digests come from a binaryFile scan, a row a file (of 2 GB at most), hashed where it is read. A manifest is a table of path,
size and sha256; a full outer join with what is found gives every file a state. A shard is written aside and renamed as a
whole; its manifest entry, written after it was read again, makes it count as complete, and only while its files still have
the recorded digests. So a broken run leaves no half shard, and the next one writes what is missing.

Defined results. Paths are relative to the scanned folder. A manifest that names a path twice is rejected. JSON lines that
aren't of the schema end the read. Files without content give no rows; Spark's scan passes over them, so they count as absent.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.shared import filesystem, put_whole, shared_folder
from ledgerlens.sources.tables import read

STATES = ["ok", "changed", "short", "missing", "extra"]


def digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, size, sha256 of every file under folder whose name fits the pattern."""
    fs, root = filesystem(spark, folder)
    base = fs.makeQualified(root).toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.substring_index("path", base, -1).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def compared(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and state of every file that is found or named: ok, changed, short (changed and smaller), missing or extra."""
    named = manifest.select(F.col("path").alias("named"), F.col("size").alias("due_size"), F.col("sha256").alias("due"))
    both = found.join(named, F.col("path") == F.col("named"), "full_outer")
    state = F.when(F.col("path").isNull(), "missing").when(F.col("named").isNull(), "extra").when(F.col("sha256").eqNullSafe(F.col("due")), "ok").when(F.col("size") < F.col("due_size"), "short").otherwise("changed")
    return both.select(F.coalesce("path", "named").alias("path"), state.alias("state"))


def require(states: DataFrame, allowed: tuple[str, ...] = ("ok",)) -> None:
    """Raise, naming some of them, if any file has another state."""
    bad = states.where(~F.col("state").isin(*allowed)).orderBy("path").limit(20).collect()
    if bad:
        raise ValueError("files differ from their manifest: " + ", ".join(f"{r['path']} {r['state']}" for r in bad))


def verified(spark: SparkSession, folder: str, manifest: DataFrame, allowed: tuple[str, ...] = ("ok",)) -> DataFrame:
    """The states of the folder's files, all of them allowed ones."""
    if manifest.groupBy("path").count().where("count > 1").limit(1).count():
        raise ValueError("the manifest names a path twice")
    states = compared(digests(spark, folder), manifest)
    require(states, allowed)
    return states


def _data(spark: SparkSession, folder: str) -> DataFrame:
    return digests(spark, folder, "part-*")


def write_shard(rows: DataFrame, folder: str, shard: int) -> bool:
    """Write a shard and, after reading it again, its manifest entry; false if it was complete before."""
    spark, place = rows.sparkSession, f"{folder}/data/shard-{shard:06d}"
    if shard in complete_shards(spark, folder):
        return False
    for old in (place, f"{folder}/manifest/shard-{shard:06d}"):
        fs, path = filesystem(spark, old)
        fs.delete(path, True)  # a shard without a valid entry
    put_whole(rows, place)
    found = spark.read.parquet(place)
    if found.schema.simpleString() != rows.schema.simpleString():
        raise ValueError(f"shard {shard} reads back as {found.schema.simpleString()}")
    entries = _data(spark, place).withColumns({"shard": F.lit(shard), "rows": F.lit(found.count())})
    put_whole(entries, f"{folder}/manifest/shard-{shard:06d}")
    return True


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """shard, path (within the shard), size, sha256, rows (of the shard)."""
    schema = "path string, size long, sha256 string, shard int, rows long"
    fs, path = filesystem(spark, f"{folder}/manifest")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/manifest") if fs.exists(path) else spark.createDataFrame([], schema)


def shard_states(spark: SparkSession, folder: str) -> DataFrame:
    """shard and whether every file of it has its recorded digest. A row a shard that the manifest names."""
    named = manifest(spark, folder)
    fs, path = filesystem(spark, f"{folder}/data")
    if not fs.exists(path):
        return named.select("shard").distinct().withColumn("complete", F.lit(False))
    full = named.withColumn("path", F.concat(F.format_string("shard-%06d/", "shard"), "path"))
    states = compared(_data(spark, f"{folder}/data"), full)
    return states.withColumn("shard", F.regexp_extract("path", r"^shard-(\d+)/", 1).cast("int")).join(named.select("shard").distinct(), "shard").groupBy("shard").agg(F.bool_and(F.col("state") == "ok").alias("complete"))


def complete_shards(spark: SparkSession, folder: str) -> set[int]:
    return {r["shard"] for r in shard_states(spark, folder).where("complete").collect()}


def write_shards(rows: DataFrame, folder: str, shards: int, key: str) -> int:
    """Deal rows by the key's hash into shards and write those that aren't complete; how many that were. A rerun goes on where a broken run stopped."""
    dealt = rows.withColumn("__shard", F.pmod(F.xxhash64(key), F.lit(shards)))
    return sum(write_shard(dealt.where(F.col("__shard") == i).drop("__shard"), folder, i) for i in range(shards))


def read_shards(spark: SparkSession, folder: str, shards: int) -> DataFrame:
    """All rows, after every shard was found complete."""
    missing = set(range(shards)) - complete_shards(spark, folder)
    if missing:
        raise ValueError(f"shards {sorted(missing)} of {folder} are missing or changed")
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/data")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a line that isn't of the schema ends the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), value. A file is read by one task."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "\n$", "").alias("value"))
    return texts.where("value <> ''").select("file", F.posexplode(F.split("value", "\n")).alias("line", "value"))


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """line, left, right of two files' lines by position; a line without a partner ends the read. left, right: line, value."""
    pairs = left.select("line", F.col("value").alias("left")).join(right.select("line", F.col("value").alias("right")), "line", "full_outer")
    strict = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit(f"line without {c} side: "), F.col("line").cast("string")))).otherwise(F.col(c)).alias(c)
    return pairs.select("line", strict("left"), strict("right"))


def remaining(todo: DataFrame, done: DataFrame, key: str, config: Column) -> DataFrame:
    """Rows of todo that done lacks. Rows of done made under another configuration end the job: they can't be mixed."""
    foreign = done.where(~F.col("config_sha256").eqNullSafe(config)).limit(1).count()
    if foreign:
        raise ValueError("earlier rows were made under another configuration")
    return todo.join(done.select(key).distinct(), key, "left_anti")


def _round_trip(s, d) -> DataFrame:
    """Documents as JSON lines in the shared folder, read again."""
    folder = f"{shared_folder(s)}/json-{uuid.uuid4().hex}"
    read(s, d, "documents").select("doc_id", "text", "lang", "source").write.json(folder)
    return json_lines(s, folder, "doc_id long, text string, lang string, source string").select("doc_id", F.sha2("text", 256).alias("sha256"), "lang", "source")


def _sharded(s, d) -> DataFrame:
    folder = f"{shared_folder(s)}/shards-{uuid.uuid4().hex}"
    write_shards(read(s, d, "documents").select("doc_id", "text"), folder, 4, "doc_id")
    return read_shards(s, folder, 4).select("doc_id", F.sha2("text", 256).alias("sha256"))


def _manifest_states(s, d) -> DataFrame:
    """Documents against a manifest of the labelled ones, which records other digests for those of low quality."""
    docs = read(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))
    labels = read(s, d, "labels").select((F.col("doc_id") + F.when(F.col("toxic") == 1, 10_000_000).otherwise(0)).cast("string").alias("path"), "quality", F.col("doc_id").cast("string").alias("of"))
    due = labels.join(docs.select(F.col("path").alias("of"), "size", "sha256"), "of").select("path", (F.col("size") + 1 - F.col("quality")).alias("size"), F.when(F.col("quality") == 1, F.col("sha256")).otherwise("0").alias("sha256"))
    return compared(docs, due)


QUERIES = {
    "src1_json_lines": _round_trip,
    "src3_shards": _sharded,
    "src7_remaining": lambda s, d: remaining(read(s, d, "documents").select("doc_id"), read(s, d, "labels").select("doc_id", F.lit("a").alias("config_sha256")), "doc_id", F.lit("a")),
    "src17_states": _manifest_states,
}

SQL = {
    "src1_json_lines": "SELECT doc_id, sha256(text) AS sha256, lang, source FROM documents",
    "src3_shards": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "src7_remaining": "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)",
    "src17_states": """WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS path, strlen(text) AS size, sha256(text) AS sha FROM documents),
m AS (SELECT CAST(l.doc_id + CASE WHEN toxic = 1 THEN 10000000 ELSE 0 END AS VARCHAR) AS named, strlen(text) + 1 - quality AS due_size, CASE WHEN quality = 1 THEN sha256(text) ELSE '0' END AS due FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT coalesce(path, named) AS path, CASE WHEN path IS NULL THEN 'missing' WHEN named IS NULL THEN 'extra' WHEN sha = due THEN 'ok' WHEN size < due_size THEN 'short' ELSE 'changed' END AS state FROM f FULL JOIN m ON path = named""",
}
