"""Suffix-array dedup of exact repeats: bytes under a 100-byte string that also starts earlier are removed.

A text is its UTF-8 bytes; earlier means a smaller id, then the earlier row, then the earlier start. Strings are judged on
the input and never cross documents.

1. Of equal texts the first stays in the work; in the others every byte repeats (if there are 100).
2. Every 100-byte window is owned by an anchor, a position of its least 32-byte hash, which depends on the window's content
   only. Where one hash is the least of many windows in a row (a letter or a short pattern over and over), one anchor owns as many of them as it reaches. Anchors are dealt out by hash, packed; one that occurs once owns no repeat.
3. The windows of repeated anchors travel as short contexts, dealt out by anchor hash, so equal windows meet in a bucket.
   A task first settles the contexts that it has twice itself, so a common passage leaves a task once.
4. A bucket's contexts are suffix-sorted blockwise: ranks of a difference-cover sample (positions whose residue modulo ``V``
   lies in a perfect difference set) are computed first, by doubling; then the window starts are sorted one block of
   leading bytes at a time, to ``V`` bytes by words, and longer ties by the sample ranks at the offset that the cover
   gives each pair, in rounds of pivots. Neighbours in the order that share 100 bytes form classes; all but a class's
   earliest member are repeats.
5. The repeats come back to their documents as stretches; their union is removed.

Equal texts (by digest) and contexts that a task holds twice (byte by byte) are settled before the suffix order, which would put
them side by side too; they would only make it longer. Null texts are empty and lose nothing. Null ids come first. Repeated
rows are documents of their own, the later ones removed. Texts of any length are cut in pieces of ``PIECE`` bytes for the search of anchors and sent in contexts.
An empty table gives no rows. Other columns, whatever their names and types, are ignored, and kept by the pipeline stage.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import NULL_ID, Scratch, arrow_map, by_bucket, bytes_of, col, fields, in_chunks, ints, mix, pack, packed, parallelism, ranges, stage_scratch, text_bytes, unpack, with_row_id

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Modulus of the difference cover; the words that sort to its depth hold 32 bytes.
V = 31
#: Anchors of a bucket, and of a bucket of contexts; context bytes that a task settles at once; suffixes sorted at once; bytes of a
#: long text that are searched for anchors at once.
ANCHORS, BUCKET, FLUSH_BYTES, BLOCK, PIECE = 1 << 18, 1 << 14, 4 << 20, 1 << 18, 1 << 20
#: In an anchor's packed place, the mark of one that stands for several of the same hash.
_SELF = 128


@lru_cache(maxsize=1)
def cover() -> tuple[np.ndarray, np.ndarray]:
    """The first perfect difference set modulo V that contains 0 and 1, and for each difference d an offset k such that both
    i + k and j + k are in the cover when (i, j) are; table[i % V, j % V] = k."""
    for more in combinations(range(2, V), 4):
        d = (0, 1, *more)
        if len({(a - b) % V for a in d for b in d}) == V:
            break
    inside = np.isin(np.arange(V), d)
    table = np.zeros((V, V), np.int64)
    for i in range(V):
        for j in range(V):
            table[i, j] = next(k for k in range(V) if inside[(i + k) % V] and inside[(j + k) % V])
    return inside, table


def words8(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as a big-endian number; raw is padded by eight."""
    n = len(raw) - 8
    out = np.empty(n + 8, np.uint64)
    for s in range(8):
        m = (len(raw) - s) // 8
        out[s : s + 8 * m : 8] = raw[s : s + 8 * m].view(">u8")
    return out[:n]


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all windows of the texts: (text, anchor hash, anchor position, first window, windows), positions within the text.
    The number of windows is marked with ``_SELF`` where the anchor stands for several."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(lens.sum())
    many = np.maximum(lens - LENGTH + 1, 0)
    if not many.any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    raw = np.frombuffer(b"".join(texts) + b"\0" * 40, np.uint8)
    w = words8(raw)
    n = total - GRAM + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k, c in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        h += mix(w[k : n + k] ^ np.uint64(c)) * np.uint64(c | 1)
    del w
    h = mix(h)
    low = np.uint64(max(24, total.bit_length()))
    key = (h >> low << low) | np.arange(n, dtype=np.uint64)
    least, size = key, 1
    while size * 2 <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if SPAN > size:
        least = np.minimum(least[: len(least) - (SPAN - size)], least[SPAN - size :])
    del key
    starts = np.cumsum(lens) - lens
    s = ranges(starts, many)
    a = (least[s] & np.uint64((1 << int(low)) - 1)).astype(np.int64)
    new = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    at, first, own = a[new], s[new], np.diff(np.append(new, len(a)))
    at, first, own = _reach(at, first, own, h[at], np.searchsorted(np.cumsum(lens), first, side="right"))
    text = np.searchsorted(np.cumsum(lens), at, side="right")
    return text, h[at].view(np.int64), at - starts[text], first - starts[text], own


def _reach(at: np.ndarray, first: np.ndarray, own: np.ndarray, h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of anchors with one hash in a row, only as many as are needed to reach all windows of the stretch: for the first window
    that has none yet always the last one in it."""
    same = (h[1:] == h[:-1]) & (text[1:] == text[:-1]) & (first[1:] == first[:-1] + own[:-1])
    if not same.any():
        return at, first, own
    run = np.cumsum(np.append(True, ~same)) - 1
    size = np.bincount(run)
    single = size[run] == 1
    out = [np.stack([at[single], first[single], own[single]])]
    edge = np.cumsum(size) - size
    for r in np.flatnonzero(size > 1).tolist():
        i, j = int(edge[r]), int(edge[r] + size[r])
        place, window, end = at[i:j], int(first[i]), int(first[j - 1] + own[j - 1])
        got = []
        while window < end:
            p = int(place[np.searchsorted(place, window + SPAN - 1, side="right") - 1])
            stop = min(end, p + 1)
            got.append((p, window, (stop - window) | _SELF))
            window = stop
        out.append(np.array(got, np.int64).T)
    at, first, own = np.concatenate(out, 1)
    order = np.argsort(first, kind="stable")
    return at[order], first[order], own[order]


def _pieces(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts in pieces that share no window, with each piece's text and offset."""
    out, text, offset = [], [], []
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            out.append(t[a : a + PIECE + LENGTH - 1])
            text.append(i)
            offset.append(a)
    return out, np.array(text, np.int64), np.array(offset, np.int64)


def _order_ties(order: np.ndarray, tie: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sort within the stretches of ``order`` that share a ``tie`` number, by cover-sample ranks, in rounds of pivots."""
    _, table = cover()
    out = order.copy()
    size = np.bincount(tie)
    live = np.flatnonzero(size[tie] > 1)
    group = tie[live]
    while len(live):
        edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        n = np.diff(np.append(edge, len(group)))
        me = out[live]
        pivot = np.repeat(me[edge + n // 2], n)
        k = table[me % V, pivot % V]
        side = np.sign(rank[me + k] - rank[pivot + k])
        by = np.lexsort((side, group))  # stretches stay in place; what is under the pivot comes first
        out[live] = me[by]
        group, side = group[by] * 3 + side[by] + 1, side[by]
        group = np.cumsum(np.append(0, group[1:] != group[:-1]))
        more = (side != 0) & (np.bincount(group)[group] > 1)
        live, group = live[more], group[more]
    return out


def sample_ranks(w: np.ndarray, n: int) -> np.ndarray:
    """For the cover positions of a text of n bytes (w: its words, padded), ranks by over 100 bytes; other places hold 0."""
    inside, _ = cover()
    at = np.flatnonzero(inside[np.arange(n) % V])
    rank = np.zeros(n + 8 * V, np.int64)
    now = np.unique(w[at], return_inverse=True)[1]
    for k in (8, 16, 24):
        step = np.unique(w[at + k], return_inverse=True)[1]
        now = np.unique(now * (len(at) + 1) + step, return_inverse=True)[1]
    for reach in (V, 2 * V):  # at + reach has the same residue, so it is a cover position too
        rank[at] = now + 1
        now = np.unique((now + 1) * (len(at) + 2) + rank[at + reach], return_inverse=True)[1]
    rank[at] = now + 1
    return rank


def classes(text: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The window starts in suffix order, and the number of the class of equal windows that each is in."""
    n = len(text)
    w = words8(np.frombuffer(text + b"\0" * (16 * V), np.uint8))
    rank = sample_ranks(w, n)
    lead = w[starts]
    by = np.argsort(lead, kind="stable")
    starts, lead = starts[by], lead[by]
    edge = np.flatnonzero(np.append(True, lead[1:] != lead[:-1]))
    orders, marks = [], []
    a = 0
    while a < len(starts):  # one block of whole leading words at a time
        b = int(np.searchsorted(edge, min(a + BLOCK, len(starts))))
        b = int(edge[b]) if b < len(edge) else len(starts)
        b = len(starts) if b <= a else b
        part = starts[a:b]
        o = np.lexsort((w[part + 24], w[part + 16], w[part + 8], lead[a:b]))
        part = part[o]
        same = np.append(False, np.ones(len(part) - 1, bool))
        for k in (0, 8, 16, 24):
            x = w[part + k]
            same[1:] &= x[1:] == x[:-1]
        part = _order_ties(part, np.cumsum(~same) - 1, rank)
        same = np.append(False, np.ones(len(part) - 1, bool))
        for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            x = w[part + k]
            same[1:] &= x[1:] == x[:-1]
        orders.append(part)
        marks.append(~same)
        a = b
    if not orders:
        return starts, np.zeros(0, np.int64)
    return np.concatenate(orders), np.cumsum(np.concatenate(marks)) - 1


_SENT = "bucket long, payload binary"
#: An anchor on its way to its bucket (v: its place, or ``_SETTLED`` for a hash that the task has found twice); a stretch or place of a row.
_ANCHOR, _PLACE, _SETTLED = np.dtype([("h", "<u8"), ("rid", "<i8"), ("v", "<i8")]), np.dtype([("rid", "<i8"), ("v", "<i8")]), -1


def _rows(bucket: np.ndarray, payload: pa.Array | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), payload if isinstance(payload, pa.Array) else pa.array(payload, pa.binary())], ["bucket", "payload"])


def _aside(rid: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Places that need no bucket, in buckets below 0."""
    out = np.empty(len(rid), _PLACE)
    out["rid"], out["v"] = rid, v
    return _rows(np.array([-1 - int(rid[0]) % 1009]), [out.tobytes()])


def _pairs(rid: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rid)), pa.array(np.ascontiguousarray(v))], ["rid", "v"])


def _settled(rows: list[dict]) -> pa.RecordBatch:
    got = np.frombuffer(b"".join(r["payload"] for r in rows), _PLACE)
    return _pairs(got["rid"], got["v"])


def _send_anchors(bits: int):
    """Packed anchors by bucket; the work is that of sorting them, whatever the number of buckets."""

    def flush(held: list) -> list[pa.RecordBatch]:
        h, rid, v = (np.concatenate(x) for x in zip(*held))
        h = h.view(np.uint64)
        order = np.argsort(h, kind="stable")
        h, rid, v = h[order], rid[order], v[order]
        new = np.append(True, h[1:] != h[:-1])
        run = np.cumsum(new) - 1
        many = (np.bincount(run)[run] > 1) | np.bincount(run, weights=v & _SELF)[run].astype(bool)
        out = [_aside(rid[many], v[many])] if many.any() else []
        use = ~many | new
        record = np.empty(int(use.sum()), _ANCHOR)
        record["h"], record["rid"], record["v"] = h[use], rid[use], np.where(many, _SETTLED, v)[use]
        out.append(_rows(*packed(record, (record["h"] >> np.uint64(64 - bits)).astype(np.int64))))
        return out

    def run(batches):
        held: list = []
        size = 0
        for batch, texts in in_chunks(batches, "text"):
            head = batch.column(3).to_pylist()
            rid = ints(batch.column(0))
            pieces, owner, offset = _pieces([t if x else b"" for t, x in zip(texts, head)])
            for k in range(0, len(pieces), 1 if len(pieces) > len(texts) else len(pieces)):
                part = slice(k, k + 1) if len(pieces) > len(texts) else slice(None)
                piece, h, at, first, n = anchors(pieces[part])
                if len(h):
                    held.append((h, rid[owner[part][piece]], at + offset[part][piece] << 16 | (at - first) << 8 | n))
                    size += len(h)
                if size * SPAN // 2 > FLUSH_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _repeated_anchors(batches):
    """(rid, v) of the anchors that occur twice or more."""
    for bucket, rows in by_bucket(batches):
        if bucket < 0:
            yield _settled(rows)
            continue
        got = np.frombuffer(b"".join(r["payload"] for r in rows), _ANCHOR)
        order = np.argsort(got["h"], kind="stable")
        got = got[order]
        run = np.cumsum(np.append(False, got["h"][1:] != got["h"][:-1]))
        hit = got[((np.bincount(run)[run] > 1) | (got["v"] == _SETTLED)) & (got["v"] != _SETTLED)]
        yield _pairs(hit["rid"], hit["v"])


def _send_contexts(bits: int):
    """Contexts of repeated anchors; those that an earlier place of this task has too are settled here."""

    def flush(held: list[tuple[int, int, int, int, int, bytes]]) -> list[pa.RecordBatch]:
        held.sort(key=lambda x: x[:3])
        seen: set[tuple[int, bytes]] = set()
        keep, rid, v = [], [], []
        for x in held:
            key = (x[4], x[5])
            if key in seen:
                rid.append(x[1])
                v.append(x[2] << 24 | len(x[5]))
            else:
                seen.add(key)
                keep.append(x)
        out = [_aside(np.array(rid, np.int64), np.array(v, np.int64))] if rid else []
        gram = np.frombuffer(b"".join(x[5][x[4] : x[4] + GRAM] for x in keep), "<u8").reshape(-1, GRAM // 8)
        h = np.zeros(len(keep), np.uint64)
        for k in range(GRAM // 8):
            h = mix(h * np.uint64(31) + gram[:, k])
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
        blobs = []
        for part in np.split(order, edge[1:]):
            rows = [keep[i] for i in part.tolist()]
            blobs.append(pack(*(np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2, 3)), np.frombuffer(b"".join(r[5] for r in rows), np.uint8)))
        out.append(_rows(bucket[order][edge], blobs))
        return out

    def run(batches):
        held: list = []
        size = 0
        for batch, texts in in_chunks(batches, "text"):
            ids, rid, values = ints(batch.column(1)), ints(batch.column(0)), batch.column(3)
            for i, t in enumerate(texts):
                got = values[i]
                if not got.is_valid:
                    continue
                for v in got.values.to_numpy().tolist():
                    at, before, n = v >> 16, v >> 8 & 255, v & _SELF - 1
                    first = at - before
                    c = t[first : first + n - 1 + LENGTH]
                    held.append((int(ids[i]), int(rid[i]), first, n, before, c))
                    size += len(c) + 100
                    if size > FLUSH_BYTES:
                        yield from flush(held)
                        held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _repeated_windows(batches):
    """(rid, v) of stretches whose windows occur earlier; v holds start and length."""
    for bucket, rows in by_bucket(batches):
        if bucket < 0:
            yield _settled(rows)
            continue
        got = [unpack(r["payload"], "i8", "i8", "i8", "i8", "u1") for r in rows]
        ids, rid, first, n = (np.concatenate([g[k] for g in got]) for k in range(4))
        text = b"".join(g[4].tobytes() for g in got)
        size = n - 1 + LENGTH
        begin = np.cumsum(size) - size
        starts = ranges(begin, n)
        owner = np.repeat(np.arange(len(n)), n)
        place = ranges(first, n)
        order, number = classes(text, starts)
        back = np.empty(len(text), np.int64)
        back[starts] = np.arange(len(starts))
        which = back[order]
        # Documents of the bucket in their order, so that (document, place) is one number.
        doc = np.empty(len(n), np.int64)
        o = np.lexsort((rid, ids))
        doc[o] = np.cumsum(np.append(0, rid[o][1:] != rid[o][:-1]))
        key = (doc[owner] << 36 | place)[which]
        edge = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else np.zeros(0, np.int64)
        least = np.repeat(np.minimum.reduceat(key, edge), np.diff(np.append(edge, len(key)))) if len(key) else key
        late = which[key > least]
        r, p = rid[owner[late]], place[late]
        o = np.lexsort((p, r))
        r, p = r[o], p[o]
        if not len(r):
            continue
        new = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)))
        end = np.append(new[1:], len(r)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(r[new]), pa.array(p[new] << 24 | (p[end] - p[new] + LENGTH))], ["rid", "v"])


def _merge(values: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for v in sorted(values):
        a, b = v >> 24, (v >> 24) + (v & 0xFFFFFF)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), scratch: Scratch | None = None) -> DataFrame:
    """rid, doc_id, text, the columns ``keep``, head (false: an equal text is earlier) and v, the packed stretches, of every row."""
    spark = docs.sparkSession
    parts = parallelism(spark, 0)
    names = {f"k{i}": c for i, c in enumerate(keep)}
    frame = with_row_id(docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"), *[col(c).alias(k) for k, c in names.items()]), "doc_id", "text", *names)
    frame = (scratch or Scratch(spark)).table(frame, "numbered")
    many = text_bytes(frame) * 2 // SPAN
    anchor_bits, bits = max(8, (many // ANCHORS).bit_length()), max(8, (many // BUCKET).bit_length())
    heads = frame.where("text is not null").groupBy(F.unhex(F.md5(F.encode("text", "utf-8"))).alias("m"), F.octet_length("text").alias("n"))
    heads = heads.agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), "rid")).alias("first")).select(F.col("first.rid").alias("rid"), F.lit(True).alias("head"))
    # All three joins ask for the same columns of the texts, so that their one exchange is used again.
    marked = frame.join(heads, "rid", "left").select("rid", "doc_id", "text", F.coalesce("head", F.lit(False)).alias("head"), *names)
    sent = arrow_map(marked, _send_anchors(anchor_bits), _SENT).repartition(parts, "bucket").sortWithinPartitions("bucket")
    again = arrow_map(sent, _repeated_anchors, "rid long, v long").groupBy("rid").agg(F.collect_list("v").alias("at"))
    contexts = frame.join(again, "rid", "left").select("rid", "doc_id", "text", "at", *names)
    sent = arrow_map(contexts, _send_contexts(bits), _SENT).repartition(parts, "bucket").sortWithinPartitions("bucket")
    late = arrow_map(sent, _repeated_windows, "rid long, v long").groupBy("rid").agg(F.collect_list("v").alias("v"))
    info = heads.join(late, "rid", "full")
    return frame.join(info, "rid", "left").select("rid", "doc_id", "text", *names, F.coalesce("head", F.lit(False)).alias("head"), "v")


def _cut(text: bytes, head: bool, v: list[int] | None) -> list[tuple[int, int]]:
    """The maximal removed runs."""
    if not head:
        return [(0, len(text))] if len(text) >= LENGTH else []
    return _merge(v or [])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for t, head, v in zip(bytes_of(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                runs = _cut(t, head, v)
                kept, last = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(t[last:a])
                    last = b
                kept.update(t[last:])
                out.append((len(t), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return arrow_map(repeats(docs, id_col, text_col).select("doc_id", "text", "head", "v"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def whole_characters(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left without the runs, without characters of which a part is removed."""
    parts, last = [], 0
    for a, b in [*runs, (len(text), len(text))]:
        parts.append(text[last:a].decode("utf-8", "ignore"))
        last = b
    return "".join(parts).encode()


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """docs with their repeats cut from the text (``n_chars``, if there, is counted anew); rows of which nothing is left go."""
    columns = docs.columns
    rest = tuple(c for c in columns if c != text_col)

    def run(batches):
        for batch in batches:
            texts = []
            for t, head, v in zip(bytes_of(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                runs = _cut(t, head, v)
                texts.append((whole_characters(t, runs).decode("utf-8", "replace") if runs else None, bool(runs)))
            new = [x.as_py() if not changed else s for (s, changed), x in zip(texts, batch.column(0))]
            gone = pa.array([not (changed and not s) for s, changed in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), *(batch.column(i) for i in range(3, batch.num_columns))], ["text", *(f"k{i}" for i in range(len(rest)))]).filter(gone)

    names = {f"k{i}": c for i, c in enumerate(rest)}
    found = repeats(docs, id_col, text_col, rest, scratch).select("text", "head", "v", *names)
    order = [("text" if c == text_col else f"k{rest.index(c)}") for c in columns]
    out = arrow_map(found, run, StructType([StructField("text", StringType()), *fields(docs, names).fields])).select(*order)
    if "n_chars" in columns:
        k = columns.index("n_chars")
        out = out.withColumn(order[k], F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.toDF(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated stretches; a document that repeats as a whole goes."""
    return remove(docs, scratch=stage_scratch(spark))
