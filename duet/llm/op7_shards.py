"""Sharding by a k-d tree over document metadata: all leaves near the target bytes, equal texts in one shard.

Rows are first gathered, by size and hashes of the text, into groups of equal texts; a group's smallest id, its size (on a
logarithmic scale), and the ranks of its smallest language and source among all names are its place in four dimensions.

A group is never parted unless it weighs more than a whole shard. What can't be cut finely goes first: a group over a shard
is dealt out by a hash into pieces that fill whole shards one after the other (and part of one more), and groups over
1 / ``FINE`` of a shard go, the heaviest first, where most room is. There are at most ``shards * FINE`` of these. The tree
then places all others in the room that is left: it splits every open node at once, along the dimension in which
the node is widest (its range over the whole table's range), at the weighted quantile that gives each side the share of its
leaves' room: the weighted median where both have as much. Quantiles are found by histograms of ``BINS`` bins a leaf, in rounds that look into
the bin that holds the cut, until it holds one item or under ``NEAR`` of a shard; equal places are cut by a hash. Only node
and bin sums reach the driver: at most ``BINS * shards`` of a round. The law is ``bytes``.

Null texts have size ``OVERHEAD`` and CRC 0 and form a group; an empty text is another. Null ids, languages and sources come
first along their dimension. Repeated rows and ids are separate rows with slots of their own. Texts of any length are one
row; one over a shard makes its shard as large as it is. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, with_row_id

SHARDS, OVERHEAD = 40, 16
#: Bins of a node's histogram, for each of its leaves; the share of a shard from which a group is placed by room; pieces of a
#: group over a shard, for each shard; the share of a shard by which a cut may be off.
BINS, FINE, PIECES, NEAR = 1024, 16, 64, 0.002
DIMENSIONS = ("d_id", "d_size", "d_lang", "d_source")
#: Bytes of names that are sent to every task; more are joined.
NAME_BYTES = 16 << 20
_GROUP = ["h", "size", "text_crc32"]


def rows_of(docs: DataFrame) -> DataFrame:
    return with_row_id(docs, "doc_id", "text", "lang", "source").select(
        "rid", F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("h"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"),
    )


def in_order(df: DataFrame, by: list[str], scratch: Scratch, name: str) -> DataFrame:
    """df sorted over all tasks, with ``place``: the rows of the same ``by[0]`` before. Counts of partitions are added up, a row each."""
    df = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("m", F.monotonically_increasing_id())
    df = scratch.table(df, name).withColumn("part", F.shiftright("m", 33))
    parts = df.groupBy(by[0], "part").agg(F.min("m").alias("start"), F.count("*").alias("n"))
    order = Window.partitionBy(by[0]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    return df.join(F.broadcast(before), [by[0], "part"]).withColumn("place", F.col("m") - F.col("start") + F.col("before")).drop("m", "part", "start", "before")


def ranked(items: DataFrame, scratch: Scratch) -> DataFrame:
    """items with d_lang and d_source: the rank of the whole name among the distinct names, 0 for null."""
    tall = items.select(F.explode(F.array(F.struct(F.lit(0).alias("dim"), F.col("lang").alias("name")), F.struct(F.lit(1).alias("dim"), F.col("source").alias("name")))).alias("x"))
    names = scratch.table(tall.select("x.dim", "x.name").where("name is not null").distinct(), "names")
    size = int(names.agg(F.coalesce(F.sum(F.octet_length("name") + 32), F.lit(0))).first()[0])
    if size <= NAME_BYTES:
        names = names.withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy("name")) - 1)
    else:
        names = scratch.table(in_order(names, ["dim", "name"], scratch, "sorted_names"), "ranks")
    for dim, column in enumerate(("lang", "source")):
        own = names.where(F.col("dim") == dim).select(F.col("name").alias(column), (F.col("place") + 1).alias(f"d_{column}"))
        if size <= NAME_BYTES:
            items = items.join(F.broadcast(own), column, "left")
        else:  # a frequent name is dealt over 16 tasks
            items = items.withColumn("salt", F.pmod("h", F.lit(16))).join(own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<long>"))), [column, "salt"], "left").drop("salt")
        items = items.withColumn(f"d_{column}", F.coalesce(f"d_{column}", F.lit(0)))
    return items.drop("lang", "source")


def place_heavy(groups: list, pieces: dict[tuple, dict[int, int]], target: float, shards: int) -> tuple[list[tuple], list[float]]:
    """[(h, size, crc, piece, shard)] of the groups that are placed by room, and the room that each shard has left.

    groups: (h, size, crc, weight); pieces: of those over a shard, the weight of each piece.
    """
    room, out = [target] * shards, []
    for g in sorted(pieces, key=lambda g: (-sum(pieces[g].values()), g)):
        s = None
        for p, w in sorted(pieces[g].items()):
            if s is None or room[s] < w / 2:
                s = max(range(shards), key=lambda k: (room[k], -k))
            out.append((*g, p, s))
            room[s] -= w
    for *g, w in sorted((tuple(g) for g in groups if tuple(g[:3]) not in pieces), key=lambda g: (-g[3], g)):
        s = max(range(shards), key=lambda k: (room[k], -k))
        out.append((*g, 0, s))
        room[s] -= w
    return out, [max(0.0, r) for r in room]


def _tie() -> F.Column:
    return F.shiftrightunsigned(F.xxhash64("h", "size", F.lit(7)), 1)


def _table(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A few rows, one for each open node (at most twice the shards), joined by broadcast: a round's plan is always the same."""
    values = ", ".join("(" + ", ".join("CAST(NULL AS BIGINT)" if v is None else f"{v}L" for v in r) + ")" for r in rows or [(0,) * len(names)])
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})").limit(len(rows)))


def _along() -> F.Column:
    """An item's value along its node's dimension."""
    return F.element_at(F.array(*[F.col(d) for d in DIMENSIONS]), F.col("dim").cast("int") + 1)


def find_cuts(items: DataFrame, seek: dict[int, dict], near: float) -> dict[int, tuple]:
    """Cuts (dimension, value, tie) of nodes: left of a cut is what comes before it by value and, at the value, by tie.

    seek: dim, leaves, need (bytes left of the
    cut), and the range a <= value < b in which the cut lies. A node is first cut by value and, within one value, by tie."""
    cuts: dict[int, tuple] = {}
    for s in seek.values():
        s |= {"under": 0, "value": None}
    x = F.when(F.col("value").isNull(), _along()).otherwise(F.col("tie"))
    while seek:
        rows = [(n, s["dim"], s["a"], s["b"], -(-(s["b"] - s["a"]) // (BINS * s["leaves"])), s["value"]) for n, s in seek.items()]
        here = items.join(_table(items.sparkSession, rows, "node", "dim", "a", "b", "step", "value"), "node")
        here = here.where(F.col("value").isNull() | (F.col("value") == _along())).withColumn("x", x).where("x >= a and x < b").withColumn("bin", F.expr("(x - a) div step"))
        sums: dict[int, list] = {}
        found = here.groupBy("node", "bin").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("w").alias("w"), F.count("*").alias("n")).drop("bin").toArrow()
        for node, *r in zip(*(c.to_pylist() for c in found.columns)):
            sums.setdefault(node, []).append(r)
        for n, s in list(seek.items()):
            run = s["under"]
            for lo, hi, w, count in sorted(sums[n]):
                if run + w >= s["need"]:
                    break
                run += w
            else:
                run -= w
            if lo < hi and w > near:
                s["a"], s["b"], s["under"] = lo, hi + 1, run
            elif s["value"] is None and count > 1 and w > near:
                s["a"], s["b"], s["under"], s["value"] = 0, (1 << 63) - 1, run, lo
            else:  # cut before or after what is left, whichever is nearer
                at = lo if s["need"] - run < run + w - s["need"] else hi + 1
                cuts[n] = (s["dim"], at, 0) if s["value"] is None else (s["dim"], s["value"], at)
                del seek[n]
    return cuts


def build_tree(items: DataFrame, room: list[float], scratch: Scratch, near: float = 0) -> DataFrame:
    """items with their ``shard``: leaf k takes a share of the weight as large as its share of the room. A level of the tree
    scans the items for the extents and two to four times for the cuts, and writes them with their nodes."""
    spark = items.sparkSession
    extent = [f(F.col(d)).alias(f"{name}_{d}") for d in DIMENSIONS for name, f in (("min", F.min), ("max", F.max))]
    nodes = {1: (0, len(room))}
    wide: dict[str, int] = {}
    items = items.withColumn("node", F.lit(1).cast("long"))
    while open_ := {n: x for n, x in nodes.items() if x[1] > 1}:
        here = items.join(_table(spark, [(n,) for n in open_], "node"), "node")
        stats = {r["node"]: r for r in here.groupBy("node").agg(F.sum("w").alias("w"), *extent).collect()}
        if not stats:
            return items.drop("node").withColumn("shard", F.lit(0).cast("long"))
        wide = wide or {d: max(1, stats[1][f"max_{d}"] - stats[1][f"min_{d}"]) for d in DIMENSIONS}
        seek: dict[int, dict] = {}
        nodes = {n: x for n, x in nodes.items() if x[1] == 1}
        for n, (first, count) in open_.items():
            nodes[2 * n], nodes[2 * n + 1] = (first, count // 2), (first + count // 2, count - count // 2)
            if r := stats.get(n):  # a node without items isn't cut
                d = max(range(len(DIMENSIONS)), key=lambda k: ((r[f"max_{DIMENSIONS[k]}"] - r[f"min_{DIMENSIONS[k]}"]) / wide[DIMENSIONS[k]], k))
                left, whole = sum(room[first : first + count // 2]), sum(room[first : first + count])
                share = left / whole if whole else (count // 2) / count
                seek[n] = {"dim": d, "leaves": count, "need": r["w"] * share, "a": r[f"min_{DIMENSIONS[d]}"], "b": r[f"max_{DIMENSIONS[d]}"] + 1}
        cuts = _table(spark, [(n, *c) for n, c in find_cuts(items, seek, near).items()], "node", "dim", "cut", "cut_tie")
        before = (_along() < F.col("cut")) | ((_along() == F.col("cut")) & (F.col("tie") < F.col("cut_tie")))
        below = F.when(F.col("dim").isNull(), F.col("node")).when(before, 2 * F.col("node")).otherwise(2 * F.col("node") + 1)
        items = scratch.table(items.join(cuts, "node", "left").withColumn("node", below.cast("long")).drop("dim", "cut", "cut_tie"), "level")
    return items.join(_table(spark, [(n, first) for n, (first, _) in nodes.items()], "node", "shard"), "node").drop("node")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.table(rows_of(docs), "rows")
    groups = rows.groupBy(*_GROUP).agg(F.sum("size").alias("w"), F.min("doc_id").alias("d_id"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    groups = scratch.table(groups, "groups")
    total, lowest = groups.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.min("d_id"), F.lit(0))).first()
    target = total / shards
    # At most shards * FINE groups weigh over target / FINE, at most as many as shards over target.
    heavy = [tuple(r) for r in groups.where(F.col("w") > target / FINE).select(*_GROUP, "w").collect()]
    giants = [(*g, -(-g[3] * PIECES // max(1, int(target)))) for g in heavy if g[3] > target]
    table = _table(spark, [(*g[:3], g[4]) for g in giants], *_GROUP, "pieces")
    dealt = rows.join(table, _GROUP, "left").withColumn("piece", F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", "rid"), F.col("pieces"))).cast("long")).drop("pieces")
    pieces: dict[tuple, dict[int, int]] = {}
    if giants:
        for *g, p, w in dealt.join(table, _GROUP).groupBy(*_GROUP, "piece").agg(F.sum("size")).collect():
            pieces.setdefault(tuple(g), {})[p] = w
    placed, room = place_heavy(heavy, pieces, target, shards)
    light = groups.where(F.col("w") <= target / FINE)
    items = light.withColumn("d_id", F.coalesce("d_id", F.lit(lowest - 1).cast("long"))).withColumn("d_size", (F.log2("size") * 65536).cast("long"))
    items = scratch.table(ranked(items, scratch).withColumn("tie", _tie()), "items")
    where = build_tree(items, room, scratch, NEAR * target).select(*_GROUP, F.col("shard").cast("int").alias("shard"))
    # A row's shard: of the placed groups by broadcast, so that none of their rows meet in a task; of the others by a join.
    big = _table(spark, placed, *_GROUP, "piece", "big")
    dealt = dealt.join(big, [*_GROUP, "piece"], "left")
    own = dealt.where("big is not null").select("doc_id", "size", "text_crc32", F.col("big").cast("int").alias("shard"), "rid")
    rest = dealt.where("big is null").join(where, _GROUP).select("doc_id", "size", "text_crc32", "shard", "rid")
    out = in_order(own.unionByName(rest), ["shard", "doc_id", "rid"], scratch, "placed")
    scratch.drop(keep=1)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
