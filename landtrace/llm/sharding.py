"""Shards of near equal bytes by a k-d tree over document metadata.

Documents with equal texts form a group that stays whole. A group is a point: its metadata
scaled to 0..1, with its bytes as weight. A node that has to give ``k`` leaves is cut along the
dimension in which it is widest, at the value that gives its lower half ``ceil(k / 2) / k`` of its
bytes. Equal values are told apart by the group's hash, so a cut lies between two groups however
many of them share a value. Cuts are found by descending a histogram of the sort codes, 16 bits
a pass; the driver sees one row per node.

A NULL text counts as an empty one, of size 1. NULL metadata counts as 0. A group larger than a shard makes that shard
larger. Repeated rows are placed each, beside each other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landtrace.llm.common import outer_id, row_id, settle

CHUNK = 65_536
PASSES = ((48, 15), (32, 16), (16, 16), (0, 16))


def unit(col: Column) -> Column:
    """A category as a place in 0..1."""
    return F.pmod(F.xxhash64(col), F.lit(1 << 20)).cast("double") / (1 << 20)


def default_dimensions() -> dict[str, Column]:
    return {
        "source": unit(F.col("source")), "lang": unit(F.col("lang")),
        "size": F.log2(F.coalesce(F.octet_length(F.col("text")), F.lit(0)) + F.lit(1)) / 40,
    }


def _table(spark: SparkSession, rows: Sequence[tuple], **kinds: pa.DataType) -> DataFrame:
    """A row per node, sent as Arrow: from tuples Spark would start Python on the executors to read them."""
    columns = zip(*rows) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), columns)}))


LONG, DOUBLE = pa.int64(), pa.float64()


def _cuts(points: DataFrame, nodes: DataFrame) -> dict[int, int]:
    """node -> code below which ``goal`` bytes lie, by histogram descent."""
    spark = points.sparkSession
    found = {r["node"]: (0, 0.0, r["goal"]) for r in nodes.collect()}
    for shift, _ in PASSES:
        at = _table(spark, [(n, *f) for n, f in found.items()], node=LONG, prefix=LONG, below=DOUBLE, goal=DOUBLE)
        inside = points.join(F.broadcast(at), "node").filter(
            F.col("prefix") == (F.shiftright("code", shift + 16) if shift < 48 else F.lit(0)))
        bins = inside.groupBy("node", "below", "goal", F.shiftright("code", shift).alias("bin")).agg(F.sum("w").alias("w"))
        running = F.sum("w").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        bins = bins.select("node", "bin", "goal", (F.col("below") + running).alias("upto"), F.col("w"))
        # the first bin that reaches the goal, else the last
        best = bins.groupBy("node").agg(
            F.min(F.when(F.col("upto") >= F.col("goal"), F.struct("bin", "upto", "w"))).alias("hit"),
            F.max(F.struct("bin", "upto", "w")).alias("last"),
        ).select("node", F.coalesce("hit", "last").alias("hit")).collect()
        for r in best:
            h = r["hit"]
            found[r["node"]] = (h["bin"], float(h["upto"]) - float(h["w"]), found[r["node"]][2])
    # the group at the goal goes to the side that it leaves nearer to it
    at = _table(spark, [(n, *f) for n, f in found.items()], node=LONG, code=LONG, below=DOUBLE, goal=DOUBLE)
    on = points.join(F.broadcast(at), ["node", "code"]).groupBy("node").agg(F.sum("w").alias("w"), F.max("below").alias("b"), F.max("goal").alias("g"))
    cuts = {n: p for n, (p, _, _) in found.items()}
    for r in on.collect():
        if r["b"] + float(r["w"]) - r["g"] < r["g"] - r["b"]:
            cuts[r["node"]] += 1
    return cuts


def kd_tree(groups: DataFrame, dimensions: list[str], leaves: int) -> DataFrame:
    """``groups`` (``g``, ``w`` and the dimensions) with ``shard`` 0 .. ``leaves`` - 1."""
    spark = groups.sparkSession
    points = groups.withColumn("node", F.lit(0).cast("long"))
    todo = {0: leaves}  # first shard of the node -> shards to make of it
    while any(k > 1 for k in todo.values()):
        open_nodes = _table(spark, [(n, k) for n, k in todo.items() if k > 1], node=LONG, k=LONG)
        extent = points.join(F.broadcast(open_nodes), "node").groupBy("node").agg(
            F.max("k").alias("k"), F.sum("w").alias("w"),
            *[(F.max(d) - F.min(d)).alias(d) for d in dimensions])
        widest = F.array_position(F.array(*dimensions), F.greatest(*dimensions) if len(dimensions) > 1 else F.col(dimensions[0]))
        plan = [(r["node"], int(r["d"]), float(r["w"]) * -(-r["k"] // 2) / r["k"])
                for r in extent.select("node", "k", "w", widest.alias("d")).collect()]
        if not plan:
            break
        cut_by = _table(spark, plan, node=LONG, d=pa.int32(), goal=DOUBLE)
        value = F.get(F.array(*dimensions), F.col("d") - 1)
        code = F.shiftleft(F.round(value * ((1 << 31) - 1)).cast("long"), 32) + F.pmod(F.col("g"), F.lit(1 << 32))
        coded = settle(points.join(F.broadcast(cut_by), "node", "left").select(
            *groups.columns, "node", F.when(F.col("d").isNotNull(), code).alias("code")))
        cuts = _cuts(coded, cut_by)
        right = {n: -(-todo[n] // 2) for n in cuts}
        lines = _table(spark, [(n, c, n + right[n]) for n, c in cuts.items()], node=LONG, cut=LONG, upper=LONG)
        points = settle(coded.join(F.broadcast(lines), "node", "left").select(
            *groups.columns, F.when(F.col("code") >= F.col("cut"), F.col("upper")).otherwise(F.col("node")).alias("node")))
        todo = {m: k for n, whole in todo.items() for m, k in (
            ((n, right[n]), (n + right[n], whole - right[n])) if n in right else ((n, 1),))}
    return points.withColumn("shard", F.col("node").cast("int"))


def numbered(rows: DataFrame, part: str, order: list[str], n_rows: int, name: str) -> DataFrame:
    """Gapless numbers from 0 in each ``part``, without one task for the whole part."""
    buckets = max(1, -(-n_rows // CHUNK))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(buckets)))
    counts = rows.groupBy(part, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(part, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy(part, "_b").orderBy(*order)) - 1
    return rows.withColumn("_rank", rank).join(starts, [part, "_b"]).withColumn(name, F.col("_start") + F.col("_rank"))


def kd_shards(
    docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, id_col: str = "doc_id",
    text_col: str = "text", dimensions: Mapping[str, Column] | None = None,
) -> DataFrame:
    """doc_id, size, text_crc32, shard and the row's slot in it.

    Give the number of ``shards``, or the ``target_bytes`` of one.
    """
    dimensions = dict(dimensions or default_dimensions())
    names = [f"_d{i}" for i in range(len(dimensions))]
    text = F.col(text_col).cast("string")
    rows = docs.select(
        row_id(id_col).alias("_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("g"),
        *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in zip(names, dimensions.values())],
    )
    groups = settle(rows.groupBy("g").agg(
        F.sum("size").alias("w"), F.count("*").alias("_rows"), *[F.min(n).alias(n) for n in names]))
    total = groups.agg(F.sum("w").alias("w"), F.sum("_rows").alias("n")).first()
    if target_bytes:
        shards = max(1, -(-(total["w"] or 0) // target_bytes))
    placed = kd_tree(groups.drop("_rows"), names, shards).select("g", "shard")
    rows = rows.drop(*names).join(placed, "g")
    out = numbered(rows, "shard", ["_id", "g"], total["n"] or 0, "slot")
    return out.select(outer_id().alias(id_col), "size", "text_crc32", "shard", F.col("slot").cast("long"))
