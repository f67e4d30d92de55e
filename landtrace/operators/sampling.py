"""Reproducible sampling: the draw depends on the key and the seed, not on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtrace.functions.values import ticket


def hash_sample(df: DataFrame, key: str | Sequence[str], fraction: float, seed: int) -> DataFrame:
    """Bernoulli sample without replacement; a filter, so it runs below later joins.

    Rows with the same key (one column or several) are drawn together.
    """
    drawn = F.col(key) if isinstance(key, str) else F.concat_ws("|", *key)
    return df.filter(ticket(drawn, seed) < int(fraction * 2**32))


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` keys (or all): each task keeps its ``n`` lowest tickets, no full sort.

    All tasks' ``n`` rows meet in one, so this is for a small ``n``; use ``sample_many`` for large ones.
    """
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.orderBy(draw, key).limit(n)


def sample_many(df: DataFrame, key: str, n: int, seed: int, few: int = 10_000) -> DataFrame:
    """The rows of ``sample_n`` for any ``n``, as a filter: no task holds or sorts them.

    The ``n``-th lowest ticket is found by counting tickets by their first digits, then by the next digits of those that share the
    crossing ones, until at most ``few`` are left. Each step brings 4096 counts to the driver. ``key`` is unique.
    """
    draw = F.coalesce(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), F.lit(""))
    start, left, size = "", n, None
    while size is None or (size > few and len(start) < 32):
        same = df.filter(F.startswith(draw, F.lit(start))) if start else df
        counts = same.groupBy(F.substring(draw, 1, len(start) + 3).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
        for prefix, size in counts:
            if left <= size:
                break
            left -= size
        else:
            return df
        start = prefix
        if len(prefix) < 3:  # keys that are NULL have no ticket and come first
            break
    last = df.filter(F.startswith(draw, F.lit(start)) if start else draw == "").select(draw.alias("d"), F.col(key).alias("k"))
    last = last.orderBy("d", "k").limit(max(1, left)).collect()[-1]
    return df.filter((draw < last["d"]) | ((draw == last["d"]) & F.coalesce(F.col(key) <= F.lit(last["k"]), F.lit(True)))) if n else df.limit(0)
