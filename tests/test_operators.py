"""Ties, missing values, sampling, numbering, grids and files."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from landtrace import CLASS_ROWS, ConversionSpec, class_table
from landtrace.functions.text import code_after, first_number, point_text, point_xy
from landtrace.operators import aggregates, composites, joins, panel, reshape, sampling, tiles
from landtrace.operators.ids import surrogate_ids
from landtrace.operators.sampling import hash_sample
from landtrace.plans import stored
from landtrace.plans.conversion import conversion_classes, conversion_cycles, select_candidate_cells
from landtrace.plans.validation import compare_measures, error_quantile_bands, validation_metrics
from landtrace.sources import catalog, csvfiles, tables
from landtrace.sources.scratch import scratch_path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_sentinels_cascade_to_length(spark):
    df = spark.createDataFrame(
        [(1, 2000, 2005, 5), (2, 0, 2005, 5), (3, 2000, 0, 5), (4, None, 2005, 5), (5, -1, -1, 0)],
        "id int, forest_year int, agri_year int, c_length int",
    )
    assert rows(panel.null_sentinels(df, ("forest_year", "agri_year"), "c_length")) == [
        (1, 2000, 2005, 5), (2, None, 2005, None), (3, 2000, None, None), (4, None, 2005, None), (5, None, None, None),
    ]


def test_metrics_ignore_missing_pairs(spark):
    est = spark.createDataFrame(
        [(1, 41, 1, 1, 1, 2000, 2004, 4), (2, 39, 1, 1, 1, 1990, 1999, 9), (2, 39, 2, 2, 2, 2005, 2010, 5)],
        "cell_id bigint, agri_code int, c_cycle int, forest_type int, agri_cycle int,"
        " forest_year int, agri_year int, c_length int",
    )
    obs = spark.createDataFrame(
        [(1, 1, 2001, 2002, 1), (2, 2, 0, 2000, 10), (3, 3, 1999, 2000, 1)],
        "sample_id int, cell_id bigint, forest_year int, agri_year int, c_length int",
    )
    pairs = compare_measures(est, obs)
    assert pairs.count() == 9
    metrics = {r["var"]: (r.mae, r.bias, round(r.pbias, 6)) for r in validation_metrics(pairs).collect()}
    assert metrics["Deforestation"] == (1.0, 1.0, round(100 / 2001, 6))
    assert metrics["Conversion Length"] == (3.0, -3.0, -300.0)
    assert metrics["Agriculture Establishment"][0] == pytest.approx((2 + 1 + 10) / 3)
    bands = error_quantile_bands(pairs).filter("estimated = 0 and var = 'Agriculture Establishment'")
    # differences -2, 1, -10
    assert rows(bands.select("group_id", F.round("min", 6), F.round("max", 6))) == [(1, -9.2, 0.7), (2, -6.0, -0.5)]


def test_majority_ties(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 7), (1, 7), (1, 9), (2, None), (2, 4)], "z int, v int")
    assert rows(aggregates.majority(df.dropna(), ["z"], "v")) == [(1, 5, 2), (1, 7, 2), (2, 4, 1)]
    assert rows(aggregates.majority(df.dropna(), ["z"], "v", ties="smallest")) == [(1, 5, 2), (2, 4, 1)]


def test_block_mode_and_missing_cells(spark):
    cells = [(r, c, v) for (r, c), v in {(0, 0): 2, (0, 1): 1, (1, 0): 2, (1, 1): 1, (0, 2): 7, (1, 2): None}.items()]
    df = spark.createDataFrame(cells, "row int, col int, v int")
    assert rows(tiles.block_mode(df, "row", "col", "v", 2)) == [(0, 0, 1)]
    assert rows(tiles.block_mode(df, "row", "col", "v", 2, na_rm=True)) == [(0, 0, 1), (0, 1, 7)]


def test_shares_and_crosstab(spark):
    counts = spark.createDataFrame([(39, 39, 6), (39, 15, 2), (41, 39, 8)], "agri_code int, class_code int, count bigint")
    parts = aggregates.shares(counts, ["agri_code"], "count")
    assert rows(parts.select("agri_code", "class_code", "perc", "total_perc")) == [
        (39, 15, 25.0, 50.0), (39, 39, 75.0, 50.0), (41, 39, 100.0, 50.0)]
    table = reshape.crosstab_percent(parts, ["agri_code"], "class_code", "perc", [39, 15])
    assert rows(table) == [(39, 75.0, 25.0), (41, 100.0, None)]


def test_category_order(spark):
    df = spark.createDataFrame([("Rice",), ("Soybean",), ("Coffee",), ("Pasture",)], "name string")
    ordered = reshape.in_category_order(df, ["name"], ["Soybean", "Pasture"])
    assert [r.name for r in ordered.collect()] == ["Soybean", "Pasture", "Coffee", "Rice"]


def test_subtotals(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("a", 2, None), ("b", 1, 1.0)], "k string, v int, m double")
    assert rows(aggregates.with_subtotals(df, ["k", "v"], ["k"], "m")) == [
        ("a", 1, 0, 5.0), ("a", 2, 0, 0.0), ("a", None, 1, 5.0), ("b", 1, 0, 1.0), ("b", None, 1, 1.0)]


def test_density_sums_to_one(spark):
    df = spark.createDataFrame([("a", 10)] * 5 + [("a", 20)], "g string, v int")
    grid = aggregates.grouped_density(df, ["g"], "v", low=-10.0, high=45.0, n=551)
    assert grid.agg(F.sum("density") * 0.1).first()[0] == pytest.approx(1.0, abs=1e-6)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(20_000).withColumnRenamed("id", "cell_id")
    few, many = (sampling.hash_sample(df.repartition(n), "cell_id", 0.05, 3) for n in (2, 31))
    assert rows(few) == rows(many) and 850 < few.count() < 1150
    a, b = (sampling.sample_n(df.repartition(n), "cell_id", 100, 3) for n in (3, 17))
    assert rows(a) == rows(b) and a.count() == 100
    assert rows(sampling.sample_n(df, "cell_id", 100, 4)) != rows(a)
    assert sampling.sample_n(df.limit(7), "cell_id", 100, 3).count() == 7


def test_surrogate_ids_with_a_crowded_tile(spark):
    rng = random.Random(1)
    cells = [(5, c) for c in rng.sample(range(1, 5000), 2000)]
    cells += [(t, c) for t in range(-3, 60) if t != 5 for c in rng.sample(range(1, 200), rng.randint(0, 20))]
    df = spark.createDataFrame(rng.sample(cells, len(cells)), "tile_id int, tile_cell_id int")
    numbered = surrogate_ids(df, chunk=100, fanout=8)
    assert sorted((r.cell_id, r.tile_id, r.tile_cell_id) for r in numbered.collect()) == [
        (i + 1, *c) for i, c in enumerate(sorted(cells))]


def test_hot_group_is_kept_whole(spark):
    hot = spark.range(30_000).select(F.lit(1).alias("k"), (F.col("id") % 50).cast("int").alias("v"))
    cold = spark.range(60_000).select((F.col("id") % 500 + 2).cast("int").alias("k"), F.lit(99).alias("v"))
    df = hot.unionByName(cold)
    kept = panel.keep_groups_having(df, ["k"], {"low": F.col("v") < 10, "high": (F.col("v") > 40) & (F.col("v") < 60)})
    assert kept.count() == 30_000 and kept.select("k").distinct().count() == 1
    first = aggregates.first_per_key(df, ["k"], ["v"]).filter("k = 1").collect()
    assert [tuple(r) for r in first] == [(1, 0)]


def test_dense_raster_and_overlapping_mosaic(spark):
    meta = spark.createDataFrame(
        [(1, "a", 0.0, 3.0, 0.0, 2.0, 3, 2, 6, "x"), (2, "b", 2.0, 5.0, 0.0, 2.0, 3, 2, 6, "x")],
        "tile_id int, tile_code string, x_min double, x_max double, y_min double, y_max double,"
        " n_col int, n_row int, n_cell int, crs string",
    )
    mask = spark.createDataFrame([(1, 1, 1), (2, 1, 3), (3, 2, 1), (4, 2, 6)], "cell_id bigint, tile_id int, tile_cell_id int")
    c_length = spark.createDataFrame(
        [(1, 1, 39, 10), (2, 1, 41, 20), (3, 1, 48, 30), (4, 2, 20, None)],
        "cell_id bigint, agri_cycle int, agri_code int, c_length int",
    )
    bands = ("agri_code", "c_length")
    grid = tiles.rasterize(c_length, mask, meta, bands)
    got = {(r.tile_id, r.agri_cycle, r.tile_cell_id): (r.agri_code, r.c_length) for r in grid.collect()}
    assert len(got) == 18 == grid.count()
    assert {k: v for k, v in got.items() if v != (None, None)} == {
        (1, 1, 1): (39, 10), (1, 1, 3): (41, 20), (2, 1, 1): (48, 30), (2, 2, 6): (20, None)}
    whole = tiles.mosaic(c_length, mask, meta, tiles.tile_offsets(meta), bands)
    cells = {(r.agri_cycle, r.row, r.col): (r.agri_code, r.c_length) for r in whole.collect()}
    assert len(cells) == 16  # 2 x 5 for cycle 1, 2 x 3 for cycle 2
    assert cells[1, 0, 0] == (39, 10) and cells[1, 0, 2] == (48, 30) and cells[2, 1, 4] == (20, None)


def test_composites(spark):
    scenes = spark.createDataFrame(
        [(1, 1985, 1, 5.0, 1.0), (1, 1985, 2, None, 2.0), (1, 2021, 1, 9.0, 9.0), (2, 1990, 1, None, None)],
        "cell int, year int, scene int, nir double, red double",
    )
    made = composites.yearly_composite(scenes, ["cell"], ["nir", "red"], ["scene"], 1985, 2020)
    assert rows(made) == [(1, 1985, 5.0, 2.0), (2, 1990, None, None)]
    scaled = composites.minmax_scale(scenes.select("nir", "red"), ["nir", "red"])
    assert rows(scaled)[0] == (0.0, 0.0) and max(max(r) for r in rows(scaled)) == 1.0


def test_text_functions(spark):
    df = spark.createDataFrame([("classification_1985", "raw/lulc-0000-0012.tif"), ("none", "x")], "band string, path string")
    out = df.select(first_number(F.col("band")), code_after(F.col("path"), "lulc-"))
    assert rows(out) == [(1985, "0000-0012"), (None, None)]
    xy = spark.createDataFrame([(-52.3262, 1e-7), (0.1 + 0.2, -12.0)], "x double, y double")
    back = xy.select("x", "y", *point_xy(point_text(F.col("x"), F.col("y"))))
    assert all(r[:2] == r[2:] for r in rows(back))


def test_columns_and_masks(spark):
    df = spark.createDataFrame([(1, 0, 3), (2, None, 0), (3, None, None)], "id int, a int, b int")
    assert panel.columns_between(df, "a", "b") == ["a", "b"]
    assert rows(panel.drop_empty_cells(df, ["a", "b"]).select("id")) == [(1,), (2,)]
    assert rows(panel.remap_bands(df, ["a", "b"], [3])) == [(1, 0, 1), (2, 0, 0), (3, 0, 0)]
    assert rows(df.select("id", panel.any_nonzero(["a", "b"]))) == [(1, True), (2, False), (3, False)]


def test_csv_blanks_and_na(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        "class_name,class_code,class_type,class_color\nFarming ,14,anthropic,#FFFFB2\nNon Observed,27,NA,#D5D5E5\n")
    back = csvfiles.read_classes(spark, str(tmp_path / "c.csv"))
    assert rows(back) == [("Farming", 14, "anthropic", "#FFFFB2"), ("Non Observed", 27, None, "#D5D5E5")]


def test_class_dictionary(spark):
    kinds = Counter(kind for _, _, kind, _ in CLASS_ROWS)
    assert kinds == {"anthropic": 18, "natural": 14, "mosaic": 3, None: 1}
    # a dictionary of any size is joined
    panel_rows = [(1, 1985, 3), (1, 1986, 5000), (1, 1987, 39), (1, 1988, 3), (1, 1989, 39), (2, 1985, 3), (2, 1986, 39)]
    table = spark.createDataFrame(panel_rows, "cell_id int, year int, class_code int")
    many = spark.range(4000, 6000).select(
        F.lit("x").alias("class_name"), F.col("id").cast("int").alias("class_code"), F.lit("anthropic").alias("class_type"))
    found = conversion_cycles(table, ConversionSpec(), classes=many).select("cell_id", "forest_year", "agri_year", "c_cycle")
    assert rows(found) == [(1, 1986, 1987, 1), (1, 1989, 1989, 2), (2, 1986, 1986, 1)]
    assert rows(conversion_cycles(table, ConversionSpec(), classes=class_table(spark))) == rows(
        conversion_cycles(table, ConversionSpec()))


def test_tile_write_prunes_partitions(spark):
    path = scratch_path(spark, "tiles")
    df = spark.range(100).select(
        F.col("id").alias("cell_id"), (F.col("id") % 4).cast("int").alias("tile_id"), F.lit(1).alias("agri_cycle"))
    tables.write_tiles(df, path, ("tile_id", "agri_cycle"))
    one = tables.read_table(spark, path).filter("tile_id = 2 and agri_cycle = 1")
    assert one.count() == 25
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tile_id" in plan and len(one.inputFiles()) >= 1
    names = catalog.list_files(spark, path, "*.parquet")
    assert rows(catalog.tile_catalog(names, "tile_id=").select("tile_id", "tile_code")) == [
        (1, "0"), (2, "1"), (3, "2"), (4, "3")]


def test_light_tiles_are_written_by_many_tasks(spark):
    """Folders cost time, not bytes: tiles of a few rows are not left to one task."""
    path = scratch_path(spark, "light")
    df = spark.range(400).select(
        F.col("id").alias("cell_id"), (F.col("id") % 80).cast("int").alias("tile_id"), F.lit(None).cast("int").alias("agri_cycle"))
    tables.write_tiles(df, path, ("tile_id", "agri_cycle"))
    names = catalog.list_files(spark, path, "*.parquet").select(F.regexp_extract("path", "part-([0-9]+)", 1).alias("t"))
    assert names.distinct().count() >= 6
    assert rows(tables.read_table(spark, path).select("cell_id", "tile_id", "agri_cycle")) == rows(df)


def test_one_tile_run_again_keeps_the_rest(spark):
    path = scratch_path(spark, "again")
    df = spark.range(40).select(F.col("id").alias("cell_id"), (F.col("id") % 4).cast("int").alias("tile_id"))
    tables.write_tiles(df, path)
    tables.write_tiles(df.filter("tile_id = 2 and cell_id > 20"), path)
    counts = {r.tile_id: r["count"] for r in tables.read_table(spark, path).groupBy("tile_id").count().collect()}
    assert counts == {0: 10, 1: 10, 2: 5, 3: 10}


def test_local_tiles_have_no_checksum_files_and_nothing_else_beside_them(spark, tmp_path):
    """On a local disk each file cost several processes, for its rights and for those of a checksum file."""
    df = spark.range(40).select(F.col("id").alias("cell_id"), (F.col("id") % 4).cast("int").alias("tile_id"))
    tables.write_tiles(df, f"{tmp_path}/mask")
    assert rows(tables.read_table(spark, f"{tmp_path}/mask")) == rows(df)
    assert sorted(p.name for p in (tmp_path / "mask").iterdir()) == [f"tile_id={k}" for k in range(4)]
    assert len(list(tmp_path.glob("mask/*/*.parquet"))) >= 4 and not list(tmp_path.glob("mask/**/*.crc"))


@pytest.mark.parametrize("extra", ["", ", timestamp'2020-02-03 04:05:06' as t, array(a, 1) as l"])
def test_tiles_hold_all_values_and_nulls(spark, extra, tmp_path):
    """By tasks' own files, and by Spark's where columns aren't plain."""
    df = spark.sql(f"""select a, cast(a as double) / 0.7 as d, cast(a as float) as f, cast(a * 1.5 as decimal(18, 4)) as dec,
        if(a % 2 = 0, concat('ä/', a), null) as s, a > 3 as b, date'2020-01-01' + cast(a as int) as day, cast(a as smallint) as sh,
        cast(if(a % 5 = 0, null, a % 3 - 1) as int) as tile_id, if(a % 7 = 0, null, a % 2) as agri_cycle {extra}
        from (select if(id = 11, null, id) as a from range(60) union all select id as a from range(3))""")
    for times in (1, 2):
        tables.write_tiles(df, f"{tmp_path}/t", ("tile_id", "agri_cycle"), max_records=2, mode="append")
        back = tables.read_table(spark, f"{tmp_path}/t").select(df.columns)
        assert rows(back) == sorted(rows(df) * times, key=str)
    assert [f.dataType for f in back.schema][:8] == [f.dataType for f in df.schema][:8]
    assert tables.read_table(spark, f"{tmp_path}/t").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] == 2
    tables.write_tiles(df.filter("tile_id is null"), f"{tmp_path}/t", ("tile_id", "agri_cycle"))
    counts = {r.tile_id: r["count"] for r in tables.read_table(spark, f"{tmp_path}/t").groupBy("tile_id").count().collect()}
    want = {r.tile_id: r["count"] for r in df.groupBy("tile_id").count().collect()}
    assert counts == {k: n if k is None else 2 * n for k, n in want.items()}


def test_conversions_are_stored_without_reading_their_tiles_again(spark, tmp_path, monkeypatch):
    """The first run reads none of its small files; a run of one tile keeps the other, and uses what is stored."""
    spec, root = ConversionSpec(), str(tmp_path)
    series = {1: [3, 15, 39, 3, 15, 39], 2: [3, 39, 15, 15], 3: [3, 3, 41], 4: [15, 15]}
    panel_ = spark.createDataFrame(
        [(c, 2000 + i, k) for c, codes in series.items() for i, k in enumerate(codes)], "cell_id long, year int, class_code int")
    mask = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 8), (5, 8)], "cell_id long, tile_id int")
    read = []
    for name in ("read_table", "read_tiles"):
        monkeypatch.setattr(stored, name, lambda s, p, f=getattr(tables, name): read.append(p) or f(s, p))
    stored.store_conversions(panel_, mask, spec, root)
    assert f"{root}/{stored.LENGTH}" not in read
    length, classes = (df.drop("tile_id") for df in stored.read_stored(spark, root))
    want = conversion_cycles(panel_, spec), conversion_classes(panel_, spec)
    assert rows(length) == rows(want[0].select(*length.columns)) and len(rows(length)) == 4
    assert rows(classes) == rows(want[1].select(*classes.columns))
    stored.store_conversions(panel_.filter("cell_id = 3"), mask, spec, root)
    length, classes = (df.drop("tile_id") for df in stored.read_stored(spark, root))
    assert rows(length) == rows(want[0].select(*length.columns))
    assert rows(classes) == rows(want[1].select(*classes.columns))


def test_many_tiles_are_listed_by_few_tasks(spark, tmp_path):
    df = spark.range(150).select(F.col("id").alias("cell_id"), F.col("id").cast("int").alias("tile_id"))
    tables.write_tiles(df, f"{tmp_path}/mask")
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, context = spark.conf.get(key), spark.sparkContext
    context.setJobGroup("listing", "listing")
    back = tables.read_tiles(spark, f"{tmp_path}/mask")
    status = context.statusTracker()
    tasks = [status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup("listing") for s in status.getJobInfo(j).stageIds]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= 4 * context.defaultParallelism and spark.conf.get(key) == before
    assert rows(back) == rows(df)


@pytest.mark.parametrize("odd", [0, None, 1 << 40, 9 << 40])
def test_tiles_are_read_in_parts(spark, tmp_path, odd):
    """Spark's time for one read grows with the square of its folders; parts have the same rows, types and pruning."""
    tile = F.when(F.col("id") == 17, F.lit(odd)).otherwise(F.col("id") % 20).cast("long")
    df = spark.range(60).select(F.col("id").alias("cell_id"), tile.alias("tile_id"), (F.col("id") % 3).cast("int").alias("agri_cycle"))
    tables.write_tiles(df, f"{tmp_path}/t", ("tile_id", "agri_cycle"))
    whole, parts = tables.read_table(spark, f"{tmp_path}/t"), tables.read_tiles(spark, f"{tmp_path}/t", most=6)
    assert parts.schema == whole.schema and rows(parts) == rows(whole) and len(rows(whole)) == 60
    plan = parts.filter("tile_id = 2 and agri_cycle = 1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(tile_id") == (1 if odd == 9 << 40 else 4)


def test_catalogue_has_a_tile_once_however_many_files(spark):
    path = scratch_path(spark, "files")
    df = spark.range(400).select(F.col("id").alias("cell_id"), (F.col("id") % 3 + 7).cast("int").alias("tile_id"))
    df.repartition(4).write.partitionBy("tile_id").parquet(path)
    names = catalog.list_files(spark, path, "*.parquet")
    assert names.count() == 12
    assert rows(catalog.tile_catalog(names, "tile_id=").select("tile_id", "tile_code")) == [(1, "7"), (2, "8"), (3, "9")]


def test_ragged_tiles(spark):
    """A full tile of 3 x 2 cells and one cut off to 2 x 1 at its right."""
    cells = spark.createDataFrame(
        [(1, 1, 0.5, 9.5), (1, 6, 2.5, 8.5), (2, 2, 4.5, 9.5)], "tile_id int, tile_cell_id int, x double, y double")
    numbers = spark.createDataFrame([(1, "a-1"), (2, "a-2")], "tile_id int, tile_code string")
    sizes = spark.createDataFrame([("a-1", 3, 2), ("a-2", 2, 1), ("a-3", 3, 2)], "tile_code string, n_col int, n_row int")
    meta = tiles.tile_metadata(cells, numbers, sizes, 1.0)
    got = rows(meta.select("tile_id", "tile_code", "x_min", "x_max", "y_min", "y_max", "n_cell"))
    assert got == [(1, "a-1", 0.0, 3.0, 8.0, 10.0, 6), (2, "a-2", 3.0, 5.0, 9.0, 10.0, 2)]


def test_middle_quantile_and_null_order(spark):
    df = spark.createDataFrame([(i,) for i in range(101)], "v int")
    bands = aggregates.quantile_bands(df, [], "v", (0.95, 0.5, 0.05))
    assert rows(bands) == [(1, 5.0, 95.0), (2, 50.0, 50.0)]
    keyed = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (1, 3, "c"), (2, None, "d")], "k int, o int, v string")
    assert rows(aggregates.first_per_key(keyed, ["k"], ["o"])) == [(1, 2, "b"), (2, None, "d")]
    assert rows(aggregates.first_per_key(keyed, ["k"], ["o"], last=True)) == [(1, 3, "c"), (2, None, "d")]


def test_density_leaves_out_what_lies_beyond(spark):
    df = spark.createDataFrame([("s", 0), ("s", 0), ("s", 5), ("s", 40)], "state string, c_length int")
    alone = spark.createDataFrame([("s", 5)], "state string, c_length int")
    dense, only = (aggregates.grouped_density(d, ["state"], "c_length", n=36).orderBy("grid_id").collect() for d in (df, alone))
    assert dense == only and len(dense) == 36


def test_category_order_of_rows(spark):
    df = spark.createDataFrame([("z",), ("b",), ("a",), ("c",)], "k string")
    assert [r.k for r in reshape.in_category_order(df, ["k"], ["c", "z"]).collect()] == ["c", "z", "a", "b"]


def test_rows_sampled_apart(spark):
    df = spark.range(2000).select((F.col("id") % 100).alias("cell"), F.col("id").alias("cycle"))
    kept = hash_sample(df, ["cell", "cycle"], 0.3, 1)
    share = kept.groupBy("cell").count().collect()
    assert len(share) > 90 and max(r["count"] for r in share) < 20


def test_mask_filter_reaches_the_partitions(spark):
    """37 bands, one filter over all of them, and a partition filter after it."""
    path = scratch_path(spark, "bands")
    bands = {f"classification_{y}": (F.col("id") % 7 * ((F.col("id") + y) % 2)).cast("int") for y in range(1985, 2022)}
    tables.write_tiles(spark.range(200).select(F.col("id").alias("cell_id"), (F.col("id") % 4).cast("int").alias("tile_id"),
                                              *[c.alias(n) for n, c in bands.items()]), path)
    found = select_candidate_cells(tables.read_table(spark, path), ConversionSpec(natural=(3,), agriculture=(5, 6)))
    plan = found.filter("tile_id = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tile_id" in plan


def test_no_exchange_above_the_fill(spark):
    """Dense rows of a mosaic or of filled tiles are never shuffled."""
    cells = spark.range(50).select(
        F.col("id").alias("cell_id"), F.lit(1).alias("agri_cycle"), F.col("id").cast("int").alias("agri_code"),
        F.lit(1).alias("tile_id"), (F.col("id") + 1).cast("int").alias("tile_cell_id"))
    meta = spark.createDataFrame(
        [(1, 10, 10, 0.0, 1.0, 0.0, 1.0)], "tile_id int, n_row int, n_col int, x_min double, x_max double, y_min double, y_max double")
    mask = cells.select("cell_id", "tile_id", "tile_cell_id")
    whole = tiles.mosaic(cells.select("cell_id", "agri_cycle", "agri_code"), mask, meta, tiles.tile_offsets(meta), ["agri_code"])
    dense = joins.densify(cells.drop("cell_id"), meta.select("tile_id", (F.col("n_row") * F.col("n_col")).alias("n")), ["tile_id"], "n", "tile_cell_id")
    for df, n in ((whole, 100), (dense, 100)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[:plan.index("Generate inline")] and df.count() == n


def test_bucketed_tables_join_without_exchange(spark):
    for name in ("bucketed_a", "bucketed_b"):
        df = spark.range(1000).select(F.col("id").alias("cell_id"), (F.col("id") * 2).alias(name[-1]))
        tables.write_bucketed(df, name, scratch_path(spark, name), buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed_a").join(spark.table("bucketed_b"), "cell_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_appended_observations(spark):
    path = scratch_path(spark, "observations")
    for i in (1, 2):
        df = spark.createDataFrame([(i, i * 10, 2000, 2000 + i)], "sample_id int, cell_id bigint, forest_year int, agri_year int")
        tables.append_observations(df, path)
    assert rows(tables.read_table(spark, path)) == [(1, 10, 2000, 2001, 1), (2, 20, 2000, 2002, 2)]


def test_listing_keeps_first_of_each_name(spark):
    a = spark.createDataFrame([("t1", "x"), ("folder", "f")], "name string, path string")
    b = spark.createDataFrame([("t1", "a"), ("t2", "y")], "name string, path string")
    assert rows(catalog.dedupe_listing(a, b, drop=("folder",))) == [("t1", "x"), ("t2", "y")]


def test_densify_and_unmatched(spark):
    skeleton = spark.createDataFrame([(1, 3)], "t int, n int")
    df = spark.createDataFrame([(1, 2, "x")], "t int, c int, v string")
    assert rows(joins.densify(df, skeleton, ["t"], "n", "c")) == [(1, 1, None), (1, 2, "x"), (1, 3, None)]
    left = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert rows(joins.unmatched_keys(left, left.filter("k = 2"), "k")) == [(1,)]


def test_heavy_tile_is_written_by_several_tasks(spark):
    path = scratch_path(spark, "heavy")
    df = spark.range(0, 400_000, 1, 8).select(
        F.col("id").alias("cell_id"), F.md5(F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 20 + 2).cast("int").alias("tile_id"))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "1MB")
    try:
        tables.write_tiles(df, path)
    finally:
        spark.conf.set(key, old)
    files = catalog.list_files(spark, path, "*.parquet").select(F.regexp_extract("path", "tile_id=([0-9]+)", 1).alias("t"))
    per_tile = {r.t: r["count"] for r in files.groupBy("t").count().collect()}
    assert per_tile["1"] > 1 and len(per_tile) == 21
    assert tables.read_table(spark, path).count() == 400_000
