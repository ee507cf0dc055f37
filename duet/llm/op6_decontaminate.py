"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased; in scripts without spaces between words (Chinese, Japanese, Thai, Lao,
Khmer, Burmese) every letter is a word. A benchmark item and a document that share a seed of ``MATCH`` words are
tiled: again and again the longest common run of unmarked words, of ``MATCH`` words at least, is marked in both, until none is
left; runs are found by rolling Karp-Rabin hashes at falling search lengths and checked word by word. The share of an
item's words under tiles is its coverage; tiles may lie in any order, so moved passages count. A document with a coverage
of ``COVER`` or more is contaminated by that item. An item of fewer than ``MATCH`` words is its own seed: it
contaminates every document that holds all its words as one run, a single word too.

The benchmark is the query set: it is split into blocks of bounded size, each block's seeds are sent to all tasks, and every
document is compared with every block, so nothing sent grows with the corpus or, at a time, with the benchmark. Null and
empty texts and items match nothing; null ids are allowed and stay null. Repeated rows are judged alike, one row each. Texts
of any length are searched whole. Without documents or items nothing is found. Other columns, whatever their names and types, are
ignored by ``find`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, col, fields, in_chunks, stage_scratch

MATCH, COVER = 5, 0.5
#: Bytes of benchmark text whose seeds are sent to the tasks at a time.
BLOCK_BYTES = 8 << 20
_WORD = re.compile(r"[^\W_]+")
#: Letters of scripts that are written without spaces.
_DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_ANY_DENSE = re.compile(f"[{_DENSE}]")
_DENSE_WORD = re.compile(rf"(?=[{_DENSE}])[^\W_]|[^\W_{_DENSE}]+")
_MOD, _BASE = (1 << 61) - 1, 1_000_003


def words_of(text: bytes) -> list[str]:
    s = text.decode("utf-8", "replace").lower()
    return (_WORD if s.isascii() or not _ANY_DENSE.search(s) else _DENSE_WORD).findall(s)


def _common_runs(a: list[int], b: list[int], free_a: list[bool], free_b: list[bool], size: int) -> list[tuple[int, int]]:
    """Starts (i, j) of equal unmarked runs of ``size`` words, by rolling Karp-Rabin hashes, each checked."""

    def windows(x: list[int], free: list[bool]):
        top, h, run = pow(_BASE, size - 1, _MOD), 0, 0
        for k, (v, f) in enumerate(zip(x, free)):
            if not f or v < 0:
                h = run = 0
                continue
            if run == size:
                h = (h - x[k - size] * top) % _MOD
                run -= 1
            h = (h * _BASE + v) % _MOD
            run += 1
            if run == size:
                yield h, k - size + 1

    table = defaultdict(list)
    for h, i in windows(a, free_a):
        table[h].append(i)
    return [(i, j) for h, j in windows(b, free_b) for i in table.get(h, ()) if a[i : i + size] == b[j : j + size]]


def tile(item: list[int], doc: list[int], least: int = MATCH) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, words): the longest first, the leftmost of equals. Negative words match nothing."""
    free_a, free_b = [v >= 0 for v in item], [v >= 0 for v in doc]
    tiles: list[tuple[int, int, int]] = []
    size = min(len(item), len(doc))
    while size >= least:
        runs = _common_runs(item, doc, free_a, free_b, size)
        if not runs:
            # The next length that can match: halve, find the longest extension there, and search that length.
            probe = max(least, size // 2)
            if probe == size:
                break
            found = _common_runs(item, doc, free_a, free_b, probe)
            longest = 0
            for i, j in found:
                n = probe
                while i + n < len(item) and j + n < len(doc) and free_a[i + n] and free_b[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                longest = max(longest, n)
            if longest:
                size = longest
            elif probe == least:
                break
            else:
                size = probe - 1
            continue
        for i, j in sorted(runs):
            if all(free_a[i : i + size]) and all(free_b[j : j + size]):
                tiles.append((i, j, size))
                free_a[i : i + size] = [False] * size
                free_b[j : j + size] = [False] * size
        size -= 1
    return tiles


class Seeds:
    """The items of a block by their words' numbers, and the runs of ``MATCH`` words that begin in them."""

    def __init__(self, items: list[tuple[int | None, bytes]]) -> None:
        self.number: dict[str, int] = {}
        self.items = []
        short: dict[int, dict[tuple[int, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        seeds = defaultdict(set)
        for k, (item_id, text) in enumerate(items):
            words = words_of(text)
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            self.items.append((item_id, ids))
            if 0 < len(ids) < MATCH:
                short[len(ids)][tuple(ids)].append(k)
            for i in range(len(ids) - MATCH + 1):
                seeds[tuple(ids[i : i + MATCH])].add(k)
        self.key = {s: sorted(v) for s, v in seeds.items()}
        flat = np.array(list(self.key), np.int64).reshape(-1, MATCH)
        self.hashes = np.unique(self.hash(flat))
        #: For each length of short items: their words, and the hashes of these.
        self.short = {n: (dict(v), np.unique(self.hash(np.array(list(v), np.int64)))) for n, v in short.items()}

    @staticmethod
    def hash(columns: np.ndarray) -> np.ndarray:
        h = np.zeros(len(columns), np.int64)
        for k in range(columns.shape[1]):
            h = h * np.int64(6364136223846793005) + columns[:, k]
        return h

    def matches(self, text: bytes) -> list[tuple[int | None, float, int, list[tuple[int, int]]]]:
        """(item id, coverage, tiles, [(first word of the text, words)]) of the items that share a seed; a short item's first place only."""
        words = words_of(text)
        out = []
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        known = np.cumsum(np.append(0, ids == 0))
        for size, (items, hashes) in self.short.items():
            at = np.flatnonzero(known[size:] == known[:-size]) if len(ids) >= size else np.zeros(0, np.int64)
            if not len(at):
                continue
            first: dict[tuple[int, ...], int] = {}
            for p in at[np.isin(self.hash(np.stack([ids[at + k] for k in range(size)], 1)), hashes)].tolist():
                first.setdefault(tuple(ids[p : p + size].tolist()), p)
            out += [(self.items[k][0], 1.0, 1, [(p, size)]) for run, p in first.items() for k in items.get(run, ())]
        at = np.flatnonzero(known[MATCH:] == known[:-MATCH]) if len(ids) >= MATCH else np.zeros(0, np.int64)
        if not len(at):
            return out
        near = np.searchsorted(self.hashes, h := self.hash(np.stack([ids[at + k] for k in range(MATCH)], 1)))
        at = at[self.hashes[np.minimum(near, len(self.hashes) - 1)] == h] if len(self.hashes) else at[:0]
        by_item = defaultdict(list)
        for p in at.tolist():
            for k in self.key.get(tuple(ids[p : p + MATCH].tolist()), ()):
                by_item[k].append(p)
        for k, places in by_item.items():
            item_id, item = self.items[k]
            # Only words under a seed of the item can be in a tile; stretches between them are left out.
            doc: list[int] = []
            origin: list[int] = []
            last = None
            for p in places:
                if last is not None and p > last:
                    doc.append(-1)
                    origin.append(-1)
                for q in range(p if last is None else max(p, last), p + MATCH):
                    doc.append(int(ids[q]))
                    origin.append(q)
                last = p + MATCH
            tiles = tile(item, doc)
            covered = sum(n for _, _, n in tiles)
            out.append((item_id, covered / len(item), len(tiles), sorted((origin[j], n) for _, j, n in tiles)))
        return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES):
    """The benchmark in blocks of about ``block_bytes`` at most, one at a time."""
    total = int(benchmark.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0])
    n = total // block_bytes + 1
    frame = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(n)).alias("part"))
    for k in range(n):
        rows = frame.where(F.col("part") == k).select("item", "text").collect()
        yield sorted(((r["item"], (r["text"] or "").encode("utf-8", "surrogatepass")) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", cover: float = COVER) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles and the tiles' spans in words, of every contaminated document and its items."""
    spark = docs.sparkSession
    ship_type = pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64())]))
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    schema = fields(docs, {"doc_id": id_col}, f"item_id {item_kind}, coverage double, n_tiles long, tiles array<struct<first_word:long,words:long>>")
    frame = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    out = None
    for items in item_blocks(benchmark, item_col, item_text):
        sent = spark.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            seeds = Seeds(sent.value)
            for batch, texts in in_chunks(batches, "text"):
                rows = [(i, *m) for i, t in enumerate(texts) for m in seeds.matches(t) if m[1] >= cover]
                take = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                spans = [[{"first_word": a, "words": n} for a, n in r[4]] for r in rows]
                item_type = pa.string() if item_kind == "string" else pa.int64() if item_kind == "bigint" else pa.int32()
                yield pa.RecordBatch.from_arrays([take, pa.array([r[1] for r in rows], item_type), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array(spans, ship_type)], ["doc_id", "item_id", "coverage", "n_tiles", "tiles"])

        part = arrow_map(frame, run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", cover: float = COVER) -> DataFrame:
    """The rows that no item contaminates, with all their columns; one pass over the texts for each block of items."""
    for items in item_blocks(benchmark, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(items)
        place = docs.columns.index(text_col)

        def run(batches, sent=sent, place=place):
            seeds = Seeds(sent.value)
            for batch, texts in in_chunks(batches, f"k{place}"):
                yield batch.filter(pa.array([all(m[1] < cover for m in seeds.matches(t)) for t in texts], pa.bool_()))

        names = docs.columns
        own = [f"k{i}" for i in range(len(names))]
        docs = arrow_map(docs.toDF(*own), run, fields(docs.toDF(*own), {k: k for k in own})).toDF(*names)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find(docs, benchmark).select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "n_tiles")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a contaminating item."""
    stage_scratch(spark)
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
