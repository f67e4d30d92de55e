"""The whole workflow over stored tables: mask, conversions and follow-up classes by tile.

Each tile's tables can be written again by themselves; summaries read what is stored and do not
find the conversions anew.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landtrace.operators.aggregates import histogram
from landtrace.operators.cycles import band_join
from landtrace.operators.refresh import merge_states, new_classes, state_cycles, summarize
from landtrace.plans.conversion import conversion_cycles, extract_mask
from landtrace.sources.scratch import scratch_path
from landtrace.sources.tables import attach_bucketed, read_table, read_tiles, table_exists, write_bucketed, write_tiles
from landtrace.spec import FOLLOW_UP_YEARS, ConversionSpec

MASK, LENGTH, CLASSES, STATE = "mask_cells", "c_length", "c_classes", "c_state"


def store_mask(mask_wide: DataFrame, edges: DataFrame, root: str, bucket: float = 1.0) -> None:
    """Mask cells with ids and municipalities, by tile. Ids run over all tiles, so all are given at once."""
    write_tiles(extract_mask(mask_wide, edges, bucket), f"{root}/{MASK}")


def store_conversions(panel: DataFrame, mask: DataFrame, spec: ConversionSpec, root: str) -> None:
    """Conversions and follow-up classes of the panel's cells, by tile and conversion.

    ``panel`` may hold some tiles only; the tables keep their other tiles. The conversions are
    found once and kept in a few files of scratch space, from which the tiles are written and which the classes are joined to.
    If there were tables before, the classes are joined to the stored conversions, which may be more.
    """
    spark, length, by = panel.sparkSession, f"{root}/{LENGTH}", ("tile_id", "agri_cycle")
    tile = mask.select("cell_id", "tile_id")
    first, kept = not table_exists(spark, length), scratch_path(spark, "found")
    conversion_cycles(panel, spec).join(tile, "cell_id").write.parquet(kept)
    cycles = read_table(spark, kept)
    write_tiles(cycles, length, by)
    if not first:
        cycles = read_tiles(spark, length).join(panel.select("cell_id").distinct(), "cell_id", "left_semi")
    write_tiles(band_join(panel, cycles, spec.after).join(tile, "cell_id"), f"{root}/{CLASSES}", by)


def read_stored(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(c_length, c_classes) as stored."""
    return read_tiles(spark, f"{root}/{LENGTH}"), read_tiles(spark, f"{root}/{CLASSES}")


def store_by_cell(frames: Mapping[str, DataFrame], root: str, prefix: str, buckets: int = 200) -> None:
    """Write tables that have a ``cell_id`` in the same buckets of cells, as catalogue tables ``<prefix>_<name>``."""
    for name, df in frames.items():
        write_bucketed(df, f"{prefix}_{name}", f"{root}/{name}", "cell_id", buckets)


def open_by_cell(spark: SparkSession, names: list[str], root: str, prefix: str, buckets: int = 200) -> list[DataFrame]:
    """Tables of ``store_by_cell``, also in a session that doesn't know them yet. Joins on the cell move nothing."""
    return [attach_bucketed(spark, f"{prefix}_{name}", f"{root}/{name}", "cell_id", buckets) for name in names]


def stored_followup_counts(c_length: DataFrame, c_classes: DataFrame, lag: int = FOLLOW_UP_YEARS) -> DataFrame:
    """``followup_counts`` of tables stored by cell: cells by crop and by the class found ``lag`` years after establishment.

    Only the cell is a join key, as only it is bucketed; the number of the conversion is compared in the matched rows, of which
    a cell has few.
    """
    first = c_length.filter("agri_cycle = 1").select("cell_id", "agri_cycle", "agri_year", "agri_code").alias("l")
    later = c_classes.select("cell_id", "agri_cycle", "year", "class_code").alias("r")
    same = F.col("l.agri_cycle") - F.col("r.agri_cycle") == 0
    found = first.join(later, (F.col("l.cell_id") == F.col("r.cell_id")) & same & (F.col("r.year") - F.col("l.agri_year") == lag))
    return histogram(found.select("l.agri_code", "r.class_code"), "agri_code", "class_code", name="count")


def start_state(panel: DataFrame, spec: ConversionSpec, root: str) -> None:
    """First run of the yearly form: the state of all cells and the follow-up classes up to now."""
    summarize(panel, spec).write.parquet(f"{root}/{STATE}/0")
    state = read_table(panel.sparkSession, f"{root}/{STATE}/0")
    band_join(panel, state_cycles(state), spec.after).write.parquet(f"{root}/{CLASSES}/0")


def add_years(new_years: DataFrame, spec: ConversionSpec, root: str, version: int) -> tuple[DataFrame, DataFrame]:
    """Merge years later than all before into state ``version - 1``; (c_length, c_classes) as of ``version``.

    Reads the state and the new years only. Classes are appended, states are kept by version, and a version that is
    written again replaces itself.
    """
    spark = new_years.sparkSession
    before = read_table(spark, f"{root}/{STATE}/{version - 1}")
    merge_states([before, summarize(new_years, spec)]).write.mode("overwrite").parquet(f"{root}/{STATE}/{version}")
    state = read_table(spark, f"{root}/{STATE}/{version}")
    new_classes(before, state, new_years, spec).write.mode("overwrite").parquet(f"{root}/{CLASSES}/{version}")
    return state_cycles(state), spark.read.parquet(*[f"{root}/{CLASSES}/{k}" for k in range(version + 1)])
