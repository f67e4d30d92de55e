"""Aggregates. Each combines map-side, so a key holding much of the table still
reaches the final task as a few partial rows per mapper."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landtrace.sources.scratch import scratch_path


def histogram(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(name))


def total(col: Column) -> Column:
    """Sum that ignores NULLs and is 0 for a group holding nothing else."""
    return F.coalesce(F.sum(col), F.lit(0))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """The row of each key that comes first (or last) in ``order``, as an aggregate.

    NULLs in ``order`` come after all values, from either end.
    """
    rest = [c for c in df.columns if c not in keys]
    empty = [(F.col(c).isNotNull() if last else F.col(c).isNull()).alias(f"_{c}") for c in order]
    ordered = F.struct(*[x for pair in zip(empty, order) for x in pair], *[c for c in rest if c not in order])
    row = (F.max if last else F.min)(ordered).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def error_metrics(df: DataFrame, by: Sequence[str], observed: str = "observed", estimated: str = "estimated") -> DataFrame:
    """MAE, bias and percent bias of observed against estimated; NULL pairs are ignored."""
    diff = F.col(observed) - F.col(estimated)
    return df.groupBy(*by).agg(
        F.avg(F.abs(diff)).alias("mae"),
        F.avg(diff).alias("bias"),
        (F.try_divide(F.sum(diff), F.sum(F.abs(F.col(observed)))) * 100).alias("pbias"),
    )


def quantile_bands(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float] = (0.05, 0.25, 0.75, 0.95)
) -> DataFrame:
    """Nested quantile intervals: group 1 is the outermost pair of ``probs``.

    The middle one of an odd number is a last group by itself, with equal bounds.
    Values are counted first, so the exact percentile (linear interpolation) keeps one
    entry per distinct value - a bounded number for differences of years.
    """
    probs = sorted(probs)
    levels = F.array(*[F.lit(p) for p in probs])
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    quantiles = counted.groupBy(*by).agg(F.percentile(value, levels, F.col("_n")).alias("_q"))
    half = (len(probs) + 1) // 2
    bands = [
        F.struct(
            F.lit(i + 1).alias("group_id"),
            F.col("_q")[i].alias("min"), F.col("_q")[len(probs) - 1 - i].alias("max"),
        )
        for i in range(half)
    ]
    return quantiles.select(*by, F.inline(F.array(*bands)))


def majority(df: DataFrame, by: Sequence[str], value: str, ties: str = "all") -> DataFrame:
    """Most frequent value of each group with its count ``n``.

    ``ties="all"`` keeps every tied value, ``"smallest"`` one. The window runs over the
    counts: one row per distinct value (class codes, lengths), not over the data.
    """
    counts = histogram(df, *by, value)
    if ties == "smallest":
        best = F.min(F.struct((-F.col("n")).alias("m"), F.col(value))).alias("_b")
        return counts.groupBy(*by).agg(best).select(
            *by, F.col("_b")[value].alias(value), (-F.col("_b.m")).alias("n")
        )
    top = F.max("n").over(Window.partitionBy(*by))
    return counts.withColumn("_top", top).filter("n = _top").drop("_top")


def with_subtotals(df: DataFrame, keys: Sequence[str], coarse: Sequence[str], measure: str) -> DataFrame:
    """Sums by ``keys`` and by the ``coarse`` subset; dropped keys are NULL, ``is_total`` tells.

    The table is reduced to ``keys`` first; only that result goes through the grouping sets.
    """
    detail = df.groupBy(*keys).agg(total(F.col(measure)).alias(measure))
    flagged = next(k for k in keys if k not in coarse)
    return detail.groupingSets([list(keys), list(coarse)], *keys).agg(
        F.grouping(flagged).cast("int").alias("is_total"), F.sum(measure).alias(measure)
    )


def value_range(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    """One row with the smallest and largest value over all bands; NULLs are ignored."""
    cols = [F.col(b) for b in bands]
    low, high = (cols[0], cols[0]) if len(cols) == 1 else (F.least(*cols), F.greatest(*cols))
    return df.agg(F.min(low).alias("low"), F.max(high).alias("high"))


def shares(df: DataFrame, group: Sequence[str], count_col: str) -> DataFrame:
    """Percent of each row within its group and of each group within the whole.

    The sum of a group is a window over its rows, which a finished crosstab keeps few; the
    grand total is a combined aggregate of its own.
    """
    of_all = df.agg(F.sum(count_col)).scalar()
    sums = df.withColumns({"_t": F.sum(count_col).over(Window.partitionBy(*group)), "_all": of_all})
    return sums.select(
        *df.columns,
        (F.col(count_col) / F.col("_t") * 100).alias("perc"),
        (F.col("_t") / F.col("_all") * 100).alias("total_perc"),
    )


def grouped_density(
    df: DataFrame, by: Sequence[str], value: str, bandwidth: float = 2.0,
    low: float = 1.0, high: float = 36.0, n: int = 512,
) -> DataFrame:
    """Gaussian kernel density of each group at ``n`` points from ``low`` to ``high``.

    Values beyond these limits are left out before anything is counted, as axis limits do.
    Rows are counted by distinct value first; the grid is generated per counted value, so
    the kernel work depends on the number of values and not on the number of rows.
    """
    counts = histogram(df.filter(F.col(value).between(low, high)), *by, value, name="_n")
    step = (high - low) / (n - 1)
    kernel = F.exp(-F.pow((F.col("x") - F.col(value)) / bandwidth, 2) / 2)
    scale = bandwidth * (2 * 3.141592653589793) ** 0.5
    return (
        counts.withColumn("grid_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("x", F.lit(low) + F.col("grid_id") * F.lit(step))
        .groupBy(*by, "grid_id", "x")
        .agg((F.sum(F.col("_n") * kernel) / (F.sum("_n") * F.lit(scale))).alias("density"))
    )


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float] = (0.05, 0.25, 0.75, 0.95), bins: int = 1024,
) -> DataFrame:
    """Exact quantiles (linear interpolation) of a continuous measure: ``by`` and ``quantiles``, an array like ``probs``.

    Distributed selection: for each rank that is asked for, the range that holds it is cut into ``bins``, and the bin that holds it
    becomes the next range, from its smallest to its largest value, until these are equal. Each pass aggregates map-side to at
    most ``bins`` rows per group and rank, so no buffer grows with the values. NULL and NaN don't count; groups of them alone drop out.
    """
    spark = df.sparkSession
    number = F.col(value).cast("double")
    path = scratch_path(spark, "quantiles")
    df.filter(number.isNotNull() & ~F.isnan(number)).groupBy(*by, number.alias("_v")).agg(F.count("*").alias("_n")).write.parquet(path)
    counted = spark.read.parquet(path)
    sizes = counted.groupBy(*by).agg(F.sum("_n").alias("_size"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    places = F.array(*[F.lit(float(p)) for p in probs])
    ranks = F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(
        F.floor((F.col("_size") - 1) * p), F.ceil((F.col("_size") - 1) * p)))))
    found = sizes.select(*by, "_size", F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_below"), "_lo", "_hi")
    same = reduce(and_, [F.col(f"c.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by])
    step = 0
    while True:
        found.write.parquet(f"{path}-{step}")
        found = spark.read.parquet(f"{path}-{step}")
        open_ranges = found.filter("_lo < _hi")
        if open_ranges.isEmpty():
            break
        inside = counted.alias("c").join(open_ranges.alias("r"), same & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        # halves, so that the width of a range of very large numbers stays finite
        at = F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins)
        bin_ = F.when(F.col("_v") == F.col("_hi"), bins - 1).otherwise(F.least(at, F.lit(bins - 1)))
        keys = [F.col(f"r.{k}").alias(k) for k in by]
        counts = inside.groupBy(*keys, "_size", "_rank", "_below", bin_.alias("_bin")).agg(
            F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = Window.partitionBy(*by, "_rank").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
        narrowed = counts.filter("_rank >= _below and _rank < _below + _n").select(found.columns)
        found, step = found.filter("_lo = _hi").unionByName(narrowed), step + 1
    values = found.groupBy(*by).agg(F.first("_size").alias("_size"), F.map_from_entries(F.collect_list(F.struct("_rank", "_lo"))).alias("_at"))

    def quantile(p: Column) -> Column:
        place = (F.col("_size") - 1) * p
        low, high = F.col("_at")[F.floor(place)], F.col("_at")[F.ceil(place)]
        return low + (high - low) * (place - F.floor(place))

    return values.select(*by, F.transform(places, quantile).alias("quantiles"))
