"""Sources and sinks (S-01 to S-12): written to scratch and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from landtrace.functions.text import point_text, point_xy
from landtrace.operators.panel import drop_empty_cells, null_sentinels
from landtrace.plans.summaries import followup_counts
from landtrace.plans.validation import draw_validation_sample
from landtrace.sources import catalog, csvfiles, tables
from landtrace.sources.scratch import scratch_path
from suite.flagship import SAMPLE
from suite.registry import query
from suite.sql import sql


def write_then(t, label, write, read=None):
    path = scratch_path(t.spark, label)
    write(path)
    return (read or tables.read_table)(t.spark, path)


@query("s01_partitioned_scan", sql("""
    select cell_id, agri_code, c_length, tile_id from tiled where agri_cycle = 2 and tile_id > 1""", "tiled"))
def _(t):
    back = write_then(t, "c_length", lambda p: tables.write_tiles(t.tiled, p, ("tile_id", "agri_cycle")))
    return back.filter("agri_cycle = 2 and tile_id > 1").select("cell_id", "agri_code", "c_length", "tile_id")


@query("s02_uncached_scan", """
    select l_linenumber, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity
    from lineitem group by 1""")
def _(t):
    rows = tables.read_table(t.spark, f"{t.sf_dir}/lineitem.parquet", "l_linenumber int, l_quantity double")
    return rows.groupBy("l_linenumber").agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity")
    )


@query("s03_single_file", sql("select tile_id, tile_code, x_min, y_max from meta", "meta"))
def _(t):
    back = write_then(t, "tiles_metadata", lambda p: tables.write_single(t.meta, p))
    return back.select("tile_id", "tile_code", "x_min", "y_max")


@query("s04_csv_read", sql("select * from clean", "clean"))
def _(t):
    clean = null_sentinels(t.observed, ("forest_year", "agri_year"), "c_length")
    text = [F.concat(F.coalesce(F.col(c).cast("string"), F.lit("NA")), F.lit(" ")).alias(c) for c in clean.columns]
    return write_then(
        t, "observations", lambda p: csvfiles.write_csv(clean.select(*text), p), csvfiles.read_observations
    )


@query("s04_class_dictionary", sql("""
    select c.class_name, c.class_code, c.class_type, c.class_color, count(*) as n
    from panel p join classes c using (class_code) group by 1, 2, 3, 4""", "panel", "classes"))
def _(t):
    back = write_then(t, "classes", lambda p: csvfiles.write_csv(t.classes, p), csvfiles.read_classes)
    return t.panel.join(back, "class_code").groupBy(*back.columns).agg(F.count("*").alias("n"))


@query("s05_csv_write", sql("select agri_code, class_code, count from followup", "followup"))
def _(t):
    counts = followup_counts(t.c_length, t.c_classes)
    schema = "agri_code int, class_code int, count bigint"
    return write_then(
        t, "table", lambda p: csvfiles.write_csv(counts, p), lambda s, p: csvfiles.read_csv(s, p, schema)
    )


@query("s06_append_observations", sql("select * from observed", "observed"))
def _(t):
    given = t.observed.drop("c_length")

    def write(path):
        tables.append_observations(given.filter("agri_year > 0"), path)
        tables.append_observations(given.filter("agri_year <= 0"), path)

    return write_then(t, "results", write)


@query("s07_tile_write", sql("select * from mask", "mask"))
def _(t):
    back = write_then(t, "mask_cells", lambda p: tables.write_tiles(t.mask, p))
    return back.select(*t.mask.columns)


@query("s08_tile_cycle_write", sql("""
    select k.*, m.tile_id from c_classes k join mask m using (cell_id)""", "c_classes", "mask"))
def _(t):
    rows = t.c_classes.join(t.mask.select("cell_id", "tile_id"), "cell_id")
    return write_then(
        t, "c_classes", lambda p: tables.write_tiles(rows, p, ("tile_id", "agri_cycle"))
    )


@query("s09_tile_catalog", sql("""
    select row_number() over (order by tile_code) as tile_id, tile_code
    from (select distinct cast(tile_id as varchar) as tile_code from mask) m""", "mask"))
def _(t):
    def listing(spark, path):
        return catalog.tile_catalog(catalog.list_files(spark, path, "*.parquet"), "tile_id=")

    back = write_then(t, "tiles", lambda p: tables.write_tiles(t.mask, p), listing)
    return back.select(F.col("tile_id").cast("bigint").alias("tile_id"), "tile_code")


@query("s10_dedupe_listing", """
    select name, min(path) as path from (
      select concat(p_name, '-', p_size) as name, p_partkey as path from part
      where concat(p_name, '-', p_size) not in ('red widget-1', 'small ring-2')) l group by 1""")
def _(t):
    listing = t.read("part").select(
        F.concat_ws("-", "p_name", "p_size").alias("name"), F.col("p_partkey").alias("path")
    )
    return catalog.dedupe_listing(*[listing] * 10, drop=("red widget-1", "small ring-2"))


@query("s11_bands_to_cells", sql("""
    select m.cell_id, cast(nullif(w.classification_1985, 0) as int) as first_year_class
    from mask m join wide w using (cell_id)""", "mask", "wide"))
def _(t):
    raster = t.mask.select("cell_id").join(t.wide, "cell_id", "left")
    raster = raster.withColumns({b: F.nullif(F.col(b), F.lit(0)) for b in t.bands})
    return drop_empty_cells(raster, t.bands).select("cell_id", F.col("classification_1985").alias("first_year_class"))


@query("s12_sample_layers", sql(f"""
    select cell_id, x, y, x as wkt_x, y as wkt_y, cast(1000 as double) as radius_m
    from mask order by {SAMPLE}, cell_id limit 100""", "mask"))
def _(t):
    sample = draw_validation_sample(t.mask)
    sample = sample.select("cell_id", "x", "y", point_text(F.col("x"), F.col("y")).alias("coords"))
    back = write_then(
        t, "layers", lambda p: tables.write_layers(sample, p), lambda s, p: tables.read_table(s, f"{p}/buffer")
    )
    wkt_x, wkt_y = point_xy(F.col("coords"))
    return back.select("cell_id", "x", "y", wkt_x.alias("wkt_x"), wkt_y.alias("wkt_y"), "radius_m")
