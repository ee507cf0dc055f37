"""Token ids in binary files with keyed access.

Format. A folder ``blocks`` of Parquet files, written by Spark so that any shared store will do; one row is one block of
ids of consecutive documents in ascending order of doc_id (null ids first), of about ``BLOCK_IDS`` ids:

    shard, block       place in the order; shards are the writer's partitions
    before             ids of the shard before the block
    first_key, last_key, n_docs, n_ids
    payload            the ids, unsigned little-endian, 2 bytes each where the vocabulary allows it, else 4
    width              2 or 4
    keys               the doc_ids, int64, in file order (to enumerate; lookups don't read it)
    pilots, slots      the minimal perfect hash of the block's distinct keys

The index of a block maps each key to its own slot of as many slots as there are keys: a key's hash picks a bucket, the
bucket's pilot its slot. A slot stores a 32-bit fingerprint of the key, the offset of the first document with that key in
the payload, its length in ids and the number of repeated rows (whose lengths follow from ``more``). A key is found by its
block's key range, then in constant time; a foreign key is told by its fingerprint but for one in 2**32.

``start`` of a document is the ids of all shards before, of the shard before its block, and its offset. Only a row for each
shard is added up. Null and empty texts hold the end id alone; repeated rows are written each. A text of any length lies in one block, which
is as long as it needs. An empty table gives files without blocks. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import spec_of, word_bpe
from .common import NULL_ID, arrow_map, col, in_chunks, ints, mix, new_path, pack, ranges, unpack, with_row_id
from .op2_bpe import vocabulary_path

END_ID = 2
BLOCK_IDS = 1 << 20
_SCHEMA = "shard int, block int, before long, first_key long, last_key long, n_docs int, n_ids long, width int, payload binary, keys binary, pilots binary, slots binary"


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(seed))


def _slot(h: np.ndarray, pilot: np.ndarray, m: int) -> np.ndarray:
    return (mix(h ^ (pilot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(m)).astype(np.int64)


def build_hash(keys: np.ndarray) -> np.ndarray:
    """Pilots of a minimal perfect hash of distinct keys: buckets of about three keys, the largest placed first."""
    m = len(keys)
    n_buckets = m // 3 + 1
    bucket = (_hash(keys, 1) % np.uint64(n_buckets)).astype(np.int64)
    h = _hash(keys, 2)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=n_buckets)
    start = np.cumsum(size) - size
    taken = np.zeros(m, bool)
    pilots = np.zeros(n_buckets, np.int64)
    tries = np.arange(256)
    for b in np.argsort(-size, kind="stable").tolist():
        if not size[b]:
            break
        mine = h[order[start[b] : start[b] + size[b]]]
        base = 0
        while True:
            place = _slot(mine[None, :], (base + tries)[:, None], m)
            free = ~taken[place].any(1)
            if size[b] > 1:
                s = np.sort(place, 1)
                free &= (s[:, 1:] != s[:, :-1]).all(1)
            if free.any():
                k = int(np.argmax(free))
                pilots[b] = base + k
                taken[place[k]] = True
                break
            base += len(tries)
    return pilots


def slots_of(keys: np.ndarray, pilots: np.ndarray, m: int) -> np.ndarray:
    bucket = (_hash(keys, 1) % np.uint64(len(pilots))).astype(np.int64)
    return _slot(_hash(keys, 2), pilots[bucket], m)


def build_index(keys: np.ndarray, lens: np.ndarray) -> tuple[bytes, bytes]:
    """(pilots, slots) of a block's documents, given in file order with equal keys side by side."""
    new = np.append(True, keys[1:] != keys[:-1])
    first = np.flatnonzero(new)
    own = keys[first]
    pilots = build_hash(own)
    at = slots_of(own, pilots, len(own))
    offset = np.cumsum(lens) - lens
    fp, off, row = np.zeros(len(own), np.uint32), np.zeros(len(own), np.int64), np.zeros(len(own), np.int32)
    fp[at] = _hash(own, 3).astype(np.uint32)
    off[at], row[at] = offset[first], first
    count = np.zeros(len(own), np.int32)
    count[at] = np.diff(np.append(first, len(keys)))
    return pilots.astype("<i4").tobytes(), pack(fp, off, row, count, lens.astype(np.int64))


def find(keys: np.ndarray, pilots: bytes, slots: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (key, repetition) found: place in ``keys``, offset and length in ids."""
    pilot = np.frombuffer(pilots, "<i4").astype(np.int64)
    fp, off, row, count, lens = unpack(slots, "u4", "i8", "i4", "i4", "i8")
    if not len(fp) or not len(keys):
        return (np.zeros(0, np.int64),) * 3
    at = slots_of(keys, pilot, len(fp))
    hit = np.flatnonzero(fp[at] == _hash(keys, 3).astype(np.uint32))
    at = at[hit]
    if (count[at] == 1).all():
        return hit, off[at], lens[row[at]]
    who, offset, length = [], [], []
    for i, s in zip(hit.tolist(), at.tolist()):
        n = lens[row[s] : row[s] + count[s]]
        who += [i] * len(n)
        offset += (off[s] + np.cumsum(n) - n).tolist()
        length += n.tolist()
    return np.array(who), np.array(offset), np.array(length)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode all rows and write them to ``path``/blocks in ascending order of id."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(spec_of(vocabulary or vocabulary_path()))

    def run(batches):
        coder = word_bpe(spec.value)
        width = 2 if max(len(coder.m.names) - 1, end_id) < 1 << 16 else 4
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        keys: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        data: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            k, n = np.concatenate(keys), np.concatenate(lens)
            pilots, slots = build_index(k, n)
            payload = np.concatenate(data).astype(f"<u{width}").tobytes()
            values = [shard, number, before, int(k[0]), int(k[-1]), len(k), int(n.sum()), width, payload, k.tobytes(), pilots, slots]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], [c.split()[0] for c in _SCHEMA.split(", ")])

        for batch, texts in in_chunks(batches, "text"):
            ids, counts = coder.encode(texts)
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            keys.append(ints(batch.column(0)))
            lens.append(counts + 1)
            data.append(ids)
            held += len(ids)
            if held >= block_ids:
                yield block()
                number, before, held = number + 1, before + held, 0
                keys, lens, data = [], [], []
        if held:
            yield block()

    frame = with_row_id(docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")), "doc_id", "text")
    frame = frame.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "rid").sortWithinPartitions("doc_id", "rid")
    arrow_map(frame, run, _SCHEMA).write.option("compression", "zstd").parquet(f"{path}/blocks")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``base``: the ids of all blocks before."""
    found = spark.read.parquet(f"{path}/blocks")
    totals = found.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    totals = totals.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("shards_before"))
    return found.join(totals, "shard").withColumn("base", F.col("shards_before") + F.col("before"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as uint32, of every document in the files, each found by its key."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keys = np.unique(np.frombuffer(r["keys"], "i8"))
                ids = np.frombuffer(r["payload"], f"<u{r['width']}").astype("<u4")
                who, offset, n = find(keys, r["pilots"], r["slots"])
                crc = [zlib.crc32(ids[a : a + k].tobytes()) for a, k in zip(offset.tolist(), n.tolist())]
                key = keys[who]
                yield pa.RecordBatch.from_arrays([pa.array(key, mask=key == NULL_ID), pa.array(r["base"] + offset), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(blocks(spark, path).select("base", "width", "payload", "keys", "pilots", "slots"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _route(bounds: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Keys to the shards whose range holds them: one, or several where a repeated id runs over an end."""
    shard, low, high = bounds

    def run(batches):
        for batch in batches:
            keys = ints(batch.column(0))
            a, b = np.searchsorted(high, keys, side="left"), np.searchsorted(low, keys, side="right")
            n = np.maximum(b - a, 0)
            yield pa.RecordBatch.from_arrays([pa.array(shard[ranges(a, n)], pa.int32()), pa.array(np.repeat(keys, n))], ["shard", "doc_id"])

    return run


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id, ids of the asked-for keys (a ``doc_id`` column) that the files hold; null keys find nothing.

    Keys go to their shard by binary search over the shards' ranges (three numbers for each of the writer's partitions, sent to the tasks), to their block
    by a join within the shard, then to their slot. Payloads are read for the blocks that are asked for.
    """
    found = spark.read.parquet(f"{path}/blocks")
    shards = sorted(tuple(r) for r in found.groupBy("shard").agg(F.min("first_key"), F.max("last_key")).collect())  # in the order of the keys
    bounds = tuple(np.array([s[k] for s in shards], np.int64) for k in range(3))
    asked = keys.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    routed = arrow_map(asked, _route(bounds), "shard int, doc_id long").join(found.select("shard", "block", "first_key", "last_key"), "shard")
    routed = routed.where("doc_id between first_key and last_key").groupBy("shard", "block").agg(F.collect_list("doc_id").alias("asked"))
    found = found.select("shard", "block", "width", "payload", "pilots", "slots").join(routed, ["shard", "block"])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                asked_keys = np.array(r["asked"], np.int64)
                ids = np.frombuffer(r["payload"], f"<u{r['width']}").astype(np.int64)
                who, offset, n = find(asked_keys, r["pilots"], r["slots"])
                yield pa.RecordBatch.from_arrays([pa.array(asked_keys[who]), pa.array([ids[a : a + k].tolist() for a, k in zip(offset.tolist(), n.tolist())], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return arrow_map(found.select("width", "payload", "pilots", "slots", "asked"), run, "doc_id long, ids array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ids")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_digests(spark, path)
