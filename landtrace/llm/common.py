"""What the operators share: row keys, cut lineage, functions sent to executors."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(1 << 63)
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(module: str) -> None:
    """Send this module's functions by value, so executors need no installed copy."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def settle(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder and cut the lineage there.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset it lies
    beside the tables, in the warehouse.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the place that ``settle`` uses."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return f"{context.getCheckpointDir()}/{name}"


def row_id(id_col: str = "doc_id") -> Column:
    """The id as a long; NULL becomes the smallest long, so that it can be joined and ordered."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def outer_id(name: str = "_id") -> Column:
    """Back from ``row_id``."""
    return F.when(F.col(name) != NO_ID, F.col(name))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _v, _text): rows that repeat an id with another text differ in ``_v``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(row_id(id_col).alias("_id"), F.xxhash64(text).alias("_v"), text.alias("_text"))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keyed`` with the whole row, whatever its columns are called, as ``_row``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        row_id(id_col).alias("_id"), F.xxhash64(text).alias("_v"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda uses it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_words(text: Column) -> Column:
    """Words between the six ASCII blanks."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_RUN))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
