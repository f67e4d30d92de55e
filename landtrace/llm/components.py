"""Connected components of a graph given as edges, in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtrace.llm.common import settle

LINKS = 100_000  # links in a task, about


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b) that isn't its own root.

    Large and small stars take turns: each node links its larger neighbours, then its smaller
    ones, to its smallest neighbour, until all components are stars. The edges are at no time
    more than at the start. Each round is written to the shared folder. Tasks are as many as
    the links need and not as ``spark.sql.shuffle.partitions`` says: few links in many partitions
    would leave a file of a block or more for every task of every round's exchanges.
    """
    links = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    tasks = -(-max(1, links.count()) // LINKS)
    links = links.coalesce(tasks)
    before = None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = settle(large.coalesce(tasks).distinct().coalesce(tasks))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = settle(small.unionByName(least.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct().coalesce(tasks))
