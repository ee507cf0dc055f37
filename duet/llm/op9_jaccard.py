"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and the groups they form.

1. Shingles are hashed in numpy and dealt out by hash, packed in binary columns (a few bytes each). A shingle that only one
   set has can't be in an intersection; each task first settles those that two of its own sets share, so a very common
   shingle leaves a task once. Back at the documents, a set of which over a fifth is unshared can't have a partner.
2. What is left is joined exactly, one representative for each class of equal sets: its rarest shared shingles, as many as
   prefix filtering needs, connect it with every set that may be a partner. Sets are laid out in the order of their connected
   candidates and, among these, of their least shingle, and cut into blocks of bounded size.
3. Each block is joined with itself, and two blocks by a task of their own where a set of one shares such a rare shingle with a
   set of the other and their sizes allow a link; other pairs of blocks are never met. In a task, index lists are
   skipped by position, as sets stand in the order of their size and only those within 0.8 can match; and the overlaps of
   a set with all others are derived from those of a very similar set already done, by the lists of the few shingles in
   which the two differ. Tasks return spanning links and numbers of links, never all pairs.

Shingles are compared by hashes of 48 to 64 bits, the more the larger the input: two different shingles of a pair of sets of 1,000
each count as one with odds of under one in 10**8. Null and empty texts have no set and stay alone; under five words the whole sequence is the only shingle. Texts
of any length are one set. Repeated rows are in one group. A null id never names a group that has another id. An empty table gives no rows. Other columns are
ignored; ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, by_bucket, col, components, in_chunks, ints, mix, pack, packed, parallelism, ranges, stage_scratch, text_bytes, unpack, with_row_id

WORDS, PERCENT = 5, 80
#: Text bytes after which a task sends its shingles on, shingles of a bucket, sets and shingles of a block.
FLUSH_BYTES, BUCKET, BLOCK_SETS, BLOCK_TOKENS = 4 << 20, 1 << 20, 2048, 1 << 21
#: Sets done whose overlaps a task keeps to derive others from.
KEEP_DONE = 48
_P = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and the number of words of each text."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _SPACE[raw]
    start = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    end = np.flatnonzero(blank & np.append(False, ~blank[:-1]))
    up, down = _power(len(raw))
    total = np.append(np.uint64(0), np.cumsum((_LOWER[raw] + np.uint64(1)) * up))
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    edges = np.cumsum(lens)
    return h, np.diff(np.searchsorted(start, edges), prepend=0)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, in order, laid end to end, and how many each text has."""
    words, n = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), n)
    whole = np.zeros(0, np.uint64)
    if len(words) >= WORDS:
        whole = words[: len(words) - WORDS + 1].copy()
        for k in range(1, WORDS):
            whole = whole * np.uint64(0xD1342543DE82EF95) + words[k : len(words) - WORDS + 1 + k]
        inside = doc[: len(whole)] == doc[WORDS - 1 :]
        whole, whole_doc = mix(whole[inside]), doc[: len(whole)][inside]
    else:
        whole_doc = np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    first = (np.cumsum(n) - n)[short]
    extra = np.zeros(len(short), np.uint64)
    for k in range(WORDS - 1):
        has = n[short] > k
        extra[has] = extra[has] * np.uint64(0xD1342543DE82EF95) + words[first[has] + k]
    extra = mix(extra + n[short].astype(np.uint64))
    h, d = np.concatenate([whole, extra]), np.concatenate([whole_doc, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.bincount(d[new], minlength=len(texts)).astype(np.int64)


def set_keys(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free hashes of each set."""
    out = []
    for seed in (0x51ED270B, 0x2545F491):
        total = np.append(np.uint64(0), np.cumsum(mix(h ^ np.uint64(seed))))
        ends = np.cumsum(n)
        out.append((total[ends] - total[ends - n]).view(np.int64))
    return out[0], out[1]


_ROWS = "bucket long, base long, kind int, payload binary, docs binary"
#: A shingle on its way to its bucket: the 40 bits of its hash below those of the bucket. Beside it goes its document in the block, as
#: the difference to the one before; ``_SAME`` stands for a shingle that several of the block's sets have and that is settled.
_LOW, _TOKEN, _SAME = 40, np.dtype([("high", "u1"), ("low", "<u4")]), 65_535


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    arrays = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(rows), pa.binary())], ["bucket", "base", "kind", "payload", "docs"])


def _send(bits: int):
    """A block of consecutive rows to packed rows: kind 0 the block's roster, 1 shared tokens found here, 2 tokens to compare.
    The work is that of sorting the block's tokens, whatever the number of buckets."""
    shift = np.uint64(max(0, 64 - _LOW - bits))

    def block(base: int, ids: np.ndarray, h: np.ndarray, n: np.ndarray) -> list[pa.RecordBatch]:
        k1, k2 = set_keys(h, n)
        aside = -1 - base % 1009  # rows that need no comparison are spread anyhow
        rows = [(aside, base, 0, pack(ids, n, k1, k2))]
        _, first, back = np.unique(np.stack([k1, k2, n], 1), axis=0, return_index=True, return_inverse=True)
        lead = np.zeros(len(n), bool)
        lead[first] = True  # of equal sets one speaks for all
        doc = np.repeat(np.arange(len(n)), n)
        use = lead[doc]
        h, doc = h[use] >> shift, doc[use]
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
        run = np.cumsum(new) - 1
        size = np.bincount(run) if len(h) else np.zeros(0, np.int64)
        many = size[run] > 1
        if many.any():
            rows.append((aside, base, 1, pack(doc[many].astype(np.int32), h[many].view(np.int64))))
        out = [_batch(rows)]
        use = ~many | new
        h, doc, many = h[use], doc[use], many[use]
        bucket = (h >> (np.uint64(64 - bits) - shift)).astype(np.int64)
        doc = np.where(many, _SAME, doc)
        order = np.argsort(bucket << 16 | doc, kind="stable")
        bucket, doc, h = bucket[order], doc[order], h[order]
        token = np.empty(len(h), _TOKEN)
        token["high"], token["low"] = (h >> np.uint64(32)).astype(np.uint8), h.astype(np.uint32)
        step = np.diff(doc, prepend=0)
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(h) else np.zeros(0, np.int64)
        step[start] = doc[start]
        names, payload = packed(token, bucket)
        m = len(names)
        arrays = [pa.array(names), pa.array(np.full(m, base)), pa.array(np.full(m, 2, np.int32)), payload, packed(step.astype("<u2"), bucket)[1]]
        out.append(pa.RecordBatch.from_arrays(arrays, ["bucket", "base", "kind", "payload", "docs"]))
        return out

    def run(batches):
        held: list = []
        size = base = count = 0
        for batch, texts in in_chunks(batches, "text"):
            rid = ints(batch.column(2))
            h, n = shingles(texts)
            if held and (size + sum(map(len, texts)) > FLUSH_BYTES or rid[0] != base + count or count + len(texts) > 60_000):
                yield from block(base, *(np.concatenate(x) for x in zip(*held)))
                held, size, count = [], 0, 0
            if not held:
                base = int(rid[0])
            held.append((ints(batch.column(0)), h, n))
            size += sum(map(len, texts))
            count += len(texts)
        if held:
            yield from block(base, *(np.concatenate(x) for x in zip(*held)))

    return run


def _compare(bits: int):
    """Tokens of a bucket that more than one set has, back to their blocks; the other kinds pass through."""
    under = min(_LOW, 64 - bits)  # bits of a token below its bucket's

    def run(batches):
        for bucket, rows in by_bucket(batches):
            if bucket < 0:
                yield _batch([(0, r["base"], r["kind"], r["payload"]) for r in rows])
                continue
            token = np.frombuffer(b"".join(r["payload"] for r in rows), _TOKEN)
            src = np.repeat(np.arange(len(rows)), [len(r["payload"]) // _TOKEN.itemsize for r in rows])
            low = (token["high"].astype(np.uint64) << np.uint64(32) | token["low"]) & np.uint64((1 << under) - 1)
            order = np.argsort(low, kind="stable")
            new = np.append(True, low[order][1:] != low[order][:-1])
            number = np.cumsum(new) - 1
            many = np.zeros(len(low), bool)
            many[order] = np.bincount(number)[number] > 1
            doc = np.concatenate([np.cumsum(np.frombuffer(r["docs"], "<u2"), dtype=np.int64) for r in rows])
            hit = np.flatnonzero(many & (doc != _SAME))
            whole = (low[hit] | np.uint64(bucket << under)).view(np.int64)
            src, doc = src[hit], doc[hit].astype(np.int32)
            edge = np.searchsorted(src, np.arange(len(rows) + 1))
            out = [(0, r["base"], 1, pack(doc[a:b], whole[a:b])) for r, a, b in zip(rows, edge[:-1], edge[1:]) if b > a]
            if out:
                yield _batch(out)

    return run


_SETS = "rid long, doc_id long, n long, k1 long, k2 long, tokens binary"


def _assemble(batches):
    """Each row of a block with its set's size, keys and, where enough of the set is shared, its shared tokens."""
    for base, rows in by_bucket(batches, "base"):
        ids, n, k1, k2 = next(unpack(r["payload"], "i8", "i8", "i8", "i8") for r in rows if r["kind"] == 0)
        got = [unpack(r["payload"], "i4", "i8") for r in rows if r["kind"] == 1]
        doc = np.concatenate([g[0] for g in got] or [np.zeros(0, np.int32)])
        token = np.concatenate([g[1] for g in got] or [np.zeros(0, np.int64)])
        order = np.lexsort((token, doc))
        doc, token = doc[order], token[order]
        have = np.bincount(doc, minlength=len(n))
        end = np.cumsum(have)
        alive = (100 * have >= PERCENT * n) & (have > 0)
        tokens = [token[e - c : e].tobytes() if a else None for a, c, e in zip(alive.tolist(), have.tolist(), end.tolist())]
        null = ids == -(1 << 63)
        yield pa.RecordBatch.from_arrays([pa.array(base + np.arange(len(n))), pa.array(ids, mask=null), pa.array(n), pa.array(k1), pa.array(k2), pa.array(tokens, pa.binary())], ["rid", "doc_id", "n", "k1", "k2", "tokens"])


def sets(docs: DataFrame, id_col: str, text_col: str, rid_col: str | None = None) -> DataFrame:
    """rid, doc_id, n, set keys and shared tokens of every row; tokens are null where the set can't have a partner."""
    spark = docs.sparkSession
    own = [col(rid_col).alias("rid")] if rid_col else []
    frame = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"), *own)
    frame = frame if rid_col else with_row_id(frame, "doc_id", "text")
    bits = max(8, (text_bytes(docs, text_col) // 6 // BUCKET).bit_length())
    parts = parallelism(spark, 0)
    sent = arrow_map(frame, _send(bits), _ROWS).repartition(parts, "bucket").sortWithinPartitions("bucket", "base")
    back = arrow_map(sent, _compare(bits), _ROWS).repartition(parts, "base").sortWithinPartitions("base", "kind")
    return arrow_map(back, _assemble, _SETS)


def _tokens(batches):
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("tokens"))
        got = [np.frombuffer(x.as_py(), "i8") for x in column]
        n = [len(g) for g in got]
        take = np.repeat(np.arange(len(got)), n)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), batch.column(1).take(pa.array(take)), pa.array(np.concatenate(got) if got else np.zeros(0, np.int64))], ["cid", "n", "token"])


class Block:
    """Sets in the order of their size with their index, in flat arrays."""

    def __init__(self, rows: list[dict]) -> None:
        rows = sorted(rows, key=lambda r: (r["n"], r["cid"]))
        self.cid = np.array([r["cid"] for r in rows], np.int64)
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.w = np.array([r["w"] for r in rows], np.int64)
        self.part = np.array([r["part"] for r in rows], np.int64)
        got = [np.unique(np.frombuffer(r["tokens"], "i8")) for r in rows]
        self.len = np.array([len(g) for g in got], np.int64)
        flat = np.concatenate(got) if got else np.zeros(0, np.int64)
        self.names, self.flat = np.unique(flat, return_inverse=True)
        self.at = np.cumsum(self.len) - self.len
        owner = np.repeat(np.arange(len(rows)), self.len)
        order = np.lexsort((owner, self.flat))
        self.key = self.flat[order] * len(rows) + owner[order]  # of each shingle its list of sets, by size
        self.list = owner[order]

    def tokens(self, y: int) -> np.ndarray:
        return self.flat[self.at[y] : self.at[y] + self.len[y]]

    def counts(self, tokens: np.ndarray, low: int, high: int) -> np.ndarray:
        """How many of the tokens each of the sets low..high - 1 has; the lists are skipped to that stretch."""
        m = len(self.n)
        a, b = np.searchsorted(self.key, tokens * m + low), np.searchsorted(self.key, tokens * m + high)
        return np.bincount(self.list[ranges(a, b - a)] - low, minlength=high - low)[: high - low]


def join_blocks(rows: list[dict], same: bool) -> list[tuple[int, int, int]]:
    """(cid, root, links) of the sets of one block, or of two blocks of which only the pairs between both are links to count."""
    x = Block(rows)
    m = len(x.n)
    parent = np.arange(m)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    links = np.zeros(m, np.int64)
    first = x.part.min() if m else 0
    low_need, high_need = np.searchsorted(x.n, -(-x.n * PERCENT // 100)), np.searchsorted(x.n, x.n * 100 // PERCENT, side="right")
    low_wide, high_wide = np.searchsorted(x.n, x.n * 0.7), np.searchsorted(x.n, x.n / 0.7, side="right")
    done: list[tuple[int, int, int, np.ndarray]] = []
    for y in range(m):
        if not same and x.part[y] != first:
            continue
        near = max(((c[y - a], k) for k, (_, a, b, c) in enumerate(done) if a <= low_need[y] and high_need[y] <= b and a <= y < b), default=(0, -1))
        mine = x.tokens(y)
        if near[0] * 4 > len(mine) * 3:  # derive from the set done that shares most
            z, low, high, base = done[near[1]]
            other = x.tokens(z)
            gone, come = np.setdiff1d(other, mine, assume_unique=True), np.setdiff1d(mine, other, assume_unique=True)
            c = base + x.counts(come, low, high) - x.counts(gone, low, high)
        else:
            low, high = int(low_wide[y]), int(high_wide[y])
            c = x.counts(mine, low, high)
        done.append((y, low, high, c))
        if len(done) > KEEP_DONE:
            done.pop(0)
        a, b = int(low_need[y]), int(high_need[y])
        inter = c[a - low : b - low]
        linked = a + np.flatnonzero(100 * inter >= PERCENT * (x.n[y] + x.n[a:b] - inter))
        linked = linked[linked != y] if same else linked[x.part[linked] != first]
        if len(linked):
            links[y] += x.w[linked].sum()
            if not same:
                links[linked] += x.w[y]
            r = root(y)
            for o in linked.tolist():
                s = root(o)
                if s != r:
                    r, s = (r, s) if x.cid[r] < x.cid[s] else (s, r)
                    parent[s] = r
    return [(int(x.cid[i]), int(x.cid[root(i)]), int(links[i])) for i in range(m)]


def _join(batches):
    for _, rows in by_bucket(batches, "task"):
        out = join_blocks(rows, rows[0]["i"] == rows[0]["j"])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["cid", "root", "links"])


def _lay_out(least: int):
    """Sorted sets with their room in the layout (their tokens, ``least`` at least) and where it begins within the task."""

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            t = batch.column(batch.schema.get_field_index("t"))
            room = np.maximum(np.asarray(pc.list_value_length(t), np.int64), least)
            begin = at + np.cumsum(room) - room
            at += int(room.sum())
            blobs = pa.array([np.asarray(x.values, np.int64).tobytes() for x in t], pa.binary())
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(room), part)), pa.array(begin), pa.array(room), get("cid"), get("n"), get("w"), blobs], ["part", "begin", "room", "cid", "n", "w", "tokens"])

    return run


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rid_col: str | None = None) -> DataFrame:
    """rid (that of ``rid_col``, if named), doc_id, n_shingles, component_id, n_links and keep (true for one row of each group) of every row."""
    spark = docs.sparkSession
    parts, scratch = parallelism(spark, 0), Scratch(spark)
    rows = scratch.table(sets(docs, id_col, text_col, rid_col), "sets")
    who = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid"))
    classes = rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("rid").alias("cid"), F.min(who).alias("who"), F.count("*").alias("w"), F.first("tokens", ignorenulls=True).alias("tokens"))
    classes = scratch.table(classes, "classes")
    reps = classes.where("tokens is not null").select("cid", "n", "tokens")
    tall = arrow_map(reps, _tokens, "cid long, n long, token long")
    df = scratch.table(tall.groupBy("token").count().where("count > 1"), "frequencies")  # a table, so that a skewed join can be split
    listed = tall.join(df, "token").groupBy("cid", "n").agg(F.collect_list(F.struct("count", "token")).alias("t"))
    need = F.ceil(F.col("n") * F.lit(PERCENT) / F.lit(100)).cast("long")
    listed = listed.where(F.size("t") >= need).withColumn("t", F.array_sort("t"))
    listed = scratch.table(listed.select("cid", "n", F.expr("transform(t, x -> x.token)").alias("t")), "shared")
    # The prefix of n - need + 1 rarest shingles begins with those that are unshared.
    first = listed.select("cid", F.explode(F.slice("t", 1, F.greatest(F.lit(0), F.size("t") - need + 1))).alias("token"))
    hubs = scratch.table(first.groupBy("token").agg(F.min("cid").alias("hub"), F.count("*").alias("sets")).where("sets > 1"), "hubs")
    stars = first.join(hubs, "token").where("hub <> cid").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    order = components(stars, scratch=scratch).withColumnRenamed("node", "cid")
    members = order.join(listed, "cid").join(classes.select("cid", "w"), "cid").withColumn("least", F.array_min("t"))
    members = members.repartitionByRange("label", "least", "cid").sortWithinPartitions("label", "least", "cid").select("cid", "n", "w", "t")
    laid = scratch.table(arrow_map(members, _lay_out(-(-BLOCK_TOKENS // BLOCK_SETS)), "part long, begin long, room long, cid long, n long, w long, tokens binary"), "members")
    # Blocks are cut from the whole layout, however many tasks sorted it; what is added up is a row for each task.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = laid.groupBy("part").agg(F.sum("room").alias("whole")).select("part", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("before"))
    members = laid.join(F.broadcast(ends), "part").select(F.floor((F.col("before") + F.col("begin")) / F.lit(BLOCK_TOKENS)).alias("block"), "cid", "n", "w", "tokens")
    sizes = members.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    # Blocks of a shingle; equal lists of blocks, as the many common shingles of one family have, give their pairs once.
    lists = first.join(hubs.select("token"), "token").join(members.select("cid", "block"), "cid").groupBy("token").agg(F.sort_array(F.collect_set("block")).alias("b")).where("size(b) > 1").select("b").distinct()
    pairs = lists.select(F.posexplode("b").alias("k", "i"), "b").select("i", F.explode(F.slice("b", F.col("k") + 2, F.greatest(F.size("b") - F.col("k") - 1, F.lit(0)))).alias("j")).distinct()
    left, right = sizes.toDF("i", "i_low", "i_high"), sizes.toDF("j", "j_low", "j_high")
    pairs = pairs.join(left, "i").join(right, "j").where(f"100 * i_high >= {PERCENT} * j_low and 100 * j_high >= {PERCENT} * i_low").select("i", "j")
    pairs = scratch.table(pairs, "pairs")
    tasks = sizes.select("block", F.col("block").alias("i"), F.col("block").alias("j")).unionByName(pairs.select(F.explode(F.array("i", "j")).alias("block"), "i", "j"))
    dealt = members.join(tasks, "block").select(F.xxhash64("i", "j").alias("task"), "cid", "n", "w", F.col("block").alias("part"), "i", "j", "tokens")
    dealt = dealt.repartition(parts, "task").sortWithinPartitions("task", "cid")
    found = scratch.table(arrow_map(dealt, _join, "cid long, root long, links long"), "found")
    if pairs.isEmpty():
        label = found.select("cid", "root", "links")
    else:
        links = found.groupBy("cid").agg(F.sum("links").alias("links"))
        label = links.join(components(found, "cid", "root", scratch).withColumnRenamed("node", "cid"), "cid", "left").select("cid", F.coalesce("label", "cid").alias("root"), "links")
    full = classes.drop("tokens").join(label, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    heads = full.groupBy("root").agg(F.min("who").alias("head"))
    full = scratch.table(full.join(heads, "root").select("k1", "k2", "n", "head", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links")), "full")
    out = rows.drop("tokens").join(full, ["k1", "k2", "n"], "left")
    out = out.select("rid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("head.rid") == F.col("rid"), F.lit(True)).alias("keep"))
    out = scratch.table(out, "groups")
    scratch.drop(keep=1)  # all that the groups were made of
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "n_links")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id, with its own columns. The numbers of the rows are written
    with them, as a second scan may be split otherwise (it depends on the cores alive) and would number them anew."""
    names = [f"k{i}" for i in range(len(docs.columns))]  # own columns may have any names
    numbered = stage_scratch(spark).table(with_row_id(docs.toDF(*names), *names), "numbered")
    kept = jaccard_groups(numbered, f"k{docs.columns.index('doc_id')}", f"k{docs.columns.index('text')}", "rid").where("keep").select("rid")
    return numbered.join(kept, "rid", "left_semi").select(*names).toDF(*docs.columns)
