"""Parquet tables: scans, single files, tile-partitioned and bucketed writes."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from landtrace.sources import tilefiles


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Lazy scan of a Parquet table; partition columns come from the folder names.

    Nothing is cached: each query reads only its own columns and partitions. Pass
    ``schema`` to skip opening a footer for inference.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_tiles(spark: SparkSession, path: str, most: int = 2_000) -> DataFrame:
    """``read_table`` of many tiles, as a union of reads of ``most`` tiles each if groups are whole numbers.

    One read takes the square of its folders to tell their values, on the driver, and tries dates for each; the other
    reads have the types of the first. Folders are listed by a few tasks for each core, where Spark would start up to 10,000.
    """
    key, tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism
    before = spark.conf.get(key)
    spark.conf.set(key, str(tasks))
    try:
        tiles = _tile_folders(spark, path)
        if len(tiles) <= most or any(c in tile for tile in tiles for c in "{}[]*?\\"):
            return read_table(spark, path)
        reader = spark.read.option("basePath", path)
        parts = [[f"{path}/{tile}" for tile in tiles[i:i + most]] for i in range(0, len(tiles), most)]
        first = reader.parquet(*parts[0])
        groups = first.schema.fields[first.columns.index(tiles[0].split("=")[0]):]
        if not all(isinstance(f.dataType, (IntegerType, LongType)) for f in groups):
            return read_table(spark, path)
        try:
            return reduce(DataFrame.union, [first, *[reader.schema(first.schema).parquet(*part) for part in parts[1:]]])
        except (PySparkException, Py4JError):  # a value of another type than the first ones
            return read_table(spark, path)
    finally:
        spark.conf.set(key, before)


def _tile_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders of a partitioned table's first column."""
    if local := tilefiles.local_path(spark, path):
        names = os.listdir(local)
    else:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        names = [s.getPath().getName() for s in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]
    return sorted(n for n in names if "=" in n and n[0] not in "._")


def write_single(df: DataFrame, path: str) -> None:
    """Write a small table (tile metadata) as one file."""
    df.repartition(1).write.mode("overwrite").parquet(path)


def write_tiles(
    df: DataFrame, path: str, by: Sequence[str] = ("tile_id",), max_records: int = 20_000_000,
    mode: str = "overwrite",
) -> None:
    """Hive-partitioned write; a folder exists only for groups that have rows.

    Rows are dealt by ranges of the partition columns, so that a tile is not written in pieces by
    every task, into ``spark.sql.shuffle.partitions`` tasks whatever their bytes: small tiles cost by the
    folder. Equal tiles are told apart by a hash of the row, so a heavy one is split. On a local disk tasks make the files
    of plain columns themselves (``tilefiles``). Elsewhere files go to their staging folders as tasks end (version 2). Whole
    groups go to ``path`` when all are there. Overwriting replaces the groups that ``df`` has and leaves all others, so a
    tile can be run again by itself.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(tasks, *by, F.xxhash64(*df.columns))
    local = tilefiles.local_path(df.sparkSession, path)
    if local and mode in ("overwrite", "append") and tilefiles.writable(df, by):
        tilefiles.write_tiles(dealt, local, by, max_records, replace=mode == "overwrite")
        df.sparkSession.catalog.refreshByPath(path)
        return
    (
        dealt.write.mode(mode).option("maxRecordsPerFile", max_records)
        .option("partitionOverwriteMode", "dynamic")
        .option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        .partitionBy(*by).parquet(path)
    )


def table_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_bucketed(df: DataFrame, table: str, path: str, by: str = "cell_id", buckets: int = 200) -> None:
    """Bucketed, sorted table: joins and groupings on ``by`` then need no exchange."""
    (
        df.repartition(buckets, by)
        .write.mode("overwrite").option("path", path)
        .bucketBy(buckets, by).sortBy(by).format("parquet").saveAsTable(table)
    )


def attach_bucketed(spark: SparkSession, table: str, path: str, by: str = "cell_id", buckets: int = 200) -> DataFrame:
    """A table of ``write_bucketed``, named in this session's catalogue if it isn't yet; ``buckets`` as when it was written."""
    if not spark.catalog.tableExists(table):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"""create table {table} ({fields}) using parquet
            clustered by ({by}) sorted by ({by}) into {buckets} buckets location '{path}'""")
    return spark.table(table)


def append_observations(df: DataFrame, path: str) -> None:
    """Append interpreted samples; the length is end minus begin."""
    rows = df.select(
        "sample_id", "cell_id", "forest_year", "agri_year",
        (F.col("agri_year") - F.col("forest_year")).alias("c_length"),
    )
    rows.write.mode("append").parquet(path)


def write_layers(sample: DataFrame, path: str, metres: float = 1000.0) -> None:
    """Sample points and their buffers (centre and radius) as two tables."""
    sample.write.mode("overwrite").parquet(f"{path}/sample")
    sample.withColumn("radius_m", F.lit(float(metres))).write.mode("overwrite").parquet(f"{path}/buffer")
