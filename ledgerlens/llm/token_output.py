"""Token ids in training order, as binary shards of fixed stride.

Documents are tokenised and packed into sequences of one length. Each sequence gets a dense number and from it, by a
keyed Feistel permutation of 0 .. n - 1 (a network over the next even power of two, walked along its cycle until the
value falls in range), a global slot. Slots are dealt to shards by range; a task writes one shard: slot s lies in shard
s // shard_rows at byte (s % shard_rows) * stride. So a reader finds any slot by arithmetic, reads on from there in
sequence, and resumes from the number of slots that it has seen.

A shard is written under a name of the attempt's own and then renamed, so that a repeated task leaves the same file.

Defined results. Null and empty texts are one token, the separator. Repeated rows are written one by one. An empty table
gives no shards. Extra columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored
from ledgerlens.llm.packing import LENGTH, sequences

ROUNDS = 6
#: Sequences of a shard: 16 MiB at 2,048 ids of two bytes.
SHARD_ROWS = 4096
WIDTH = 2
#: Offsets of so many partitions (two longs each) are broadcast; of more they are joined by a shuffle.
MAX_BROADCAST_PARTITIONS = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def round_keys(key: bytes) -> list[np.uint64]:
    return [np.uint64(int.from_bytes(hashlib.blake2b(bytes([r]), key=key[:64], digest_size=8).digest(), "little")) for r in range(ROUNDS)]


def _mixed(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x ^ key) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(values: np.ndarray, n: int, key: bytes, back: bool = False) -> np.ndarray:
    """The slot of each number in 0 .. n - 1, or with `back` the number of each slot."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = round_keys(key)
    out, open_ = np.array(values, np.uint64), np.arange(len(values))
    while len(open_):
        left, right = out[open_] >> half, out[open_] & mask
        if back:
            for k in reversed(keys):
                left, right = right ^ (_mixed(left, k) & mask), left
        else:
            for k in keys:
                left, right = right, left ^ (_mixed(right, k) & mask)
        out[open_] = left << half | right
        open_ = open_[out[open_] >= n]
    return out.astype(np.int64)


def slot_column(n: int, key: bytes):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for numbers in batches:
            yield pa.array(permuted(numbers.to_numpy(zero_copy_only=False), n, key))

    return F.arrow_udf(run, "bigint")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `number`, dense from 0. Their sequence_id counts from partition * 2^40; the driver gets a count for each partition."""
    part = F.shiftright("sequence_id", 40)
    counts = rows.groupBy(part.alias("part")).count().orderBy("part").collect()
    firsts, total = [], 0
    for r in counts:
        firsts.append((r["part"], total))
        total += r["count"]
    offsets = rows.sparkSession.createDataFrame(firsts, "part long, before long")
    if len(firsts) <= MAX_BROADCAST_PARTITIONS:
        offsets = F.broadcast(offsets)
    return rows.withColumn("part", part).join(offsets, "part").withColumn("number", F.col("before") + F.col("sequence_id").bitwiseAND(F.lit((1 << 40) - 1))).drop("part", "before")


def _open(folder: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (LocalFileSystem(), folder)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _writer(folder: str, shard_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        out, name, due, own = None, "", 0, uuid.uuid4().hex

        def closed():
            out.close()
            fs.move(f"{root}/{name}.{own}", f"{root}/{name}")

        for batch in batches:
            slots, ids, crcs = batch.column(0).to_pylist(), batch.column(1), []
            for slot, data in zip(slots, ids):
                if slot % shard_rows == 0:
                    if out:
                        closed()
                    name = shard_name(slot // shard_rows)
                    out, due = fs.open_output_stream(f"{root}/{name}.{own}"), slot
                if out is None or slot != due:
                    raise ValueError(f"slot {slot} came where {due} was due")
                due += 1
                crcs.append(zlib.crc32(view := data.as_buffer()))
                out.write(view)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(crcs, pa.int64())], names=["slot", "sequence_id", "n_tokens", "pieces", "row_crc32"])
        if out:
            closed()

    return run


def write_shards(docs: DataFrame, tokenizer: str, key: bytes, folder: str, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write the shards and layout.json into folder, which all executors reach. Returns a row a sequence: slot, shard, byte_offset, sequence_id, n_tokens, pieces (doc_id, start, length), row_crc32."""
    rows = numbered(stored(sequences(docs, tokenizer, id_col, text, length, width), level=9))
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    fs, root = _open(folder)
    fs.create_dir(root)
    with fs.open_output_stream(f"{root}/layout.json") as out:
        out.write(json.dumps({"sequences": n, "length": length, "width": width, "shard_rows": shard_rows}).encode())
    dealt = rows.withColumn("slot", slot_column(n, key)("number")).withColumn("shard", F.expr(f"cast(slot div {shard_rows} as int)"))
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("slot").select("slot", "ids", "sequence_id", "n_tokens", "pieces")
    schema = "slot long, sequence_id long, n_tokens long, pieces array<struct<doc_id:long,start:long,length:long>>, row_crc32 long"
    written = stored(dealt.mapInArrow(_writer(folder, shard_rows), schema))
    stride = length * width
    return written.select("slot", F.expr(f"slot div {shard_rows}").alias("shard"), (F.col("slot") % shard_rows * stride).alias("byte_offset"), "sequence_id", "n_tokens", "pieces", "row_crc32")


def read_slots(folder: str, first: int = 0, most: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) from a slot onward, in order."""
    fs, root = _open(folder)
    with fs.open_input_stream(f"{root}/layout.json") as f:
        layout = json.loads(f.read())
    stride, last = layout["length"] * layout["width"], layout["sequences"]
    last = last if most is None else min(last, first + most)
    while first < last:
        shard, row = divmod(first, layout["shard_rows"])
        with fs.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(row * stride)
            for first in range(first, min(last, (shard + 1) * layout["shard_rows"])):
                yield first, np.frombuffer(f.read(stride), f"<u{layout['width']}")
        first += 1
