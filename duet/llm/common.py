"""Shared plumbing of the corpus operators: shared-folder tables, Arrow streams, packed columns, components."""

from __future__ import annotations

import os
import struct
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Text bytes that a numpy pass holds at once in a Python worker.
CHUNK_BYTES = 1 << 20
#: Bytes of a batch on its way to a Python worker; texts can be long, and a fixed number of rows would hold too much.
BATCH_BYTES = 4 << 20
#: Stand-in order of a null id: before every other.
NULL_ID = -(1 << 63)

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give every executor this package (once per application), so that workers import it wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="duet-"), "duet_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("duet", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, else the one given to ``setCheckpointDir``.

    A temporary folder is made only in local mode (as in tests), where driver and executors are one process; elsewhere a
    session without a shared folder is refused, since tables in a machine's own folder would be lost to the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="duet-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """The tables that one call of an operator writes to the shared folder.

    Each call has its own, so calls in other threads are untouched. ``drop`` deletes all but the tables named; what hasn't
    been read from the others by then is lost.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folders = spark, []

    def path(self, name: str) -> str:
        folder = f"{shared_dir(self.spark)}/duet-{uuid.uuid4().hex}"
        self.folders.append(folder)
        return f"{folder}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Cut lineage: write df as a table and read it back."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """Delete the tables written so far but for the last ``keep``."""
        end = len(self.folders) - keep
        for folder in self.folders[:end]:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        del self.folders[:end]


_left: dict[tuple[str, int], Scratch] = {}


def stage_scratch(spark: SparkSession) -> Scratch:
    """The tables of a pipeline stage. Its result is written before the next stage begins (the pipeline's contract), so those that
    the stage before left in this thread are deleted."""
    key = (spark.sparkContext.applicationId, threading.get_ident())
    if key in _left:
        _left[key].drop()
    _left[key] = Scratch(spark)
    return _left[key]


def new_path(spark: SparkSession, name: str) -> str:
    return Scratch(spark).path(name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder, where it stays, and read it back."""
    return Scratch(df.sparkSession).table(df, name)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with this package at hand on the executors and batches bounded in bytes.

    The bound is a session setting that Spark reads when the plan runs; one that is higher is lowered, and stays so.
    """
    spark = df.sparkSession
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def fields(df: DataFrame, columns: dict[str, str], *more: str) -> StructType:
    """A schema of df's columns under other names (new name to old), whatever their types, and of further fields "name type"."""
    old = {f.name: f for f in df.schema.fields}
    own = [StructField(new, old[c].dataType) for new, c in columns.items()]
    return StructType(own + [f for m in more for f in StructType.fromDDL(m).fields])


def col(name: str) -> F.Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_row_id(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and ``rid``, a number of the row. A second evaluation may number the rows anew (a scan is split by
    the cores alive, a shuffle deals in any order), so what is joined by ``rid`` has to be written first."""
    return docs.select(*[col(c) for c in columns]).withColumn("rid", F.monotonically_increasing_id())


def packed(records: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Records in the order of their keys: each key that occurs, and its records' bytes end to end. The cost is the
    records', however many keys there may be."""
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    ends = (np.append(edge, len(key)) * records.dtype.itemsize).astype(np.int32)
    data = pa.py_buffer(np.ascontiguousarray(records).tobytes())
    return key[edge], pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(ends.tobytes()), data])


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def bytes_of(column: pa.Array) -> Iterator[bytes]:
    """Each string of the column as UTF-8 bytes, null as empty, without making a str."""
    for x in column.cast(pa.large_binary()):
        b = x.as_buffer()
        yield b"" if b is None else b.to_pybytes()


def in_chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts together hold about ``limit`` bytes at most (a longer text comes alone)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start, held, size = 0, [], 0
        for i, b in enumerate(bytes_of(column)):
            if held and size + len(b) > limit:
                yield batch.slice(start, i - start), held
                start, held, size = i, [], 0
            held.append(b)
            size += len(b)
        if held:
            yield batch.slice(start, len(held)), held


def ints(column: pa.Array, null: int = NULL_ID) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False), dtype=np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pack(*arrays: np.ndarray) -> bytes:
    """Several arrays in one byte string, lengths first."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return struct.pack(f"<{len(raw)}q", *map(len, raw)) + b"".join(raw)


def unpack(blob: bytes, *dtypes: str) -> list[np.ndarray]:
    n = len(dtypes)
    lens = struct.unpack_from(f"<{n}q", blob)
    out, at = [], 8 * n
    for size, dtype in zip(lens, dtypes):
        out.append(np.frombuffer(blob, dtype, size // np.dtype(dtype).itemsize, at))
        at += size
    return out


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of range(s, s + n) for every (s, n)."""
    lens = np.asarray(lens, np.int64)
    total = int(lens.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lens), lens)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows; sets bucket counts."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0))).first()[0])


def parallelism(spark: SparkSession, n: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), n)


def by_bucket(batches: Iterator[pa.RecordBatch], key: str = "bucket") -> Iterator[tuple[int, list[dict]]]:
    """Rows of a partition that is sorted by ``key``, one list of rows for each key."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != now:
                if held:
                    yield now, held
                now, held = row[key], []
            held.append(row)
    if held:
        yield now, held


def components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, label): the smallest node reachable over the links, for every node on a link.

    Minimum labels spread over links, and each node then takes its label's label, so the rounds grow with the
    logarithm of the longest chain. Every round is a table in the shared folder; nothing but a count reaches the driver.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = scratch.table(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = scratch.table(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.x).select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        step = scratch.table(step, "step")
        up = step.select(F.col("node").alias("up"), F.col("new").alias("up_label"))
        nxt = scratch.table(step.join(up, step.new == up.up).select("node", F.least("new", "up_label").alias("label"), "old"), "labels")
        if nxt.where("label <> old").isEmpty():
            return nxt.select("node", "label")
        labels = nxt.select("node", "label")
