"""Projection, filter, reshape, set operation and scalar function queries (F, O, U, T, X)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from landtrace.functions import geometry, text, values
from landtrace.operators import aggregates, joins, panel, reshape
from landtrace.plans import summaries
from landtrace.plans.validation import compare_measures, validation_metrics
from landtrace.spec import FOLLOW_UP_CLASSES, MEASURE_LABELS
from suite.flagship import BANDS
from suite.registry import query
from suite.sql import AGRI, sql
from suite.tables import IMAGE_BANDS, YEARS


@query("f01_column_range", sql(
    "select agri_code, forest_year, agri_year, c_length, c_cycle, forest_type from c_length", "c_length"))
def _(t):
    return t.c_length.select(*panel.columns_between(t.c_length, "agri_code", "forest_type"))


@query("f02_rename", sql("""
    select tile_cell_id, cell_id as id, code_muni as municipality from mask""", "mask"))
def _(t):
    renamed = t.mask.withColumnsRenamed({"cell_id": "id", "code_muni": "municipality"})
    return renamed.select("tile_cell_id", "id", "municipality")


@query("f03_derived_columns", sql("""
    select cell_id, agri_cycle, forest_year - 1 as last_natural, agri_year - (forest_year - 1) as span
    from c_length""", "c_length"))
def _(t):
    rows = t.c_length.withColumn("last_natural", F.col("forest_year") - 1)
    rows = rows.withColumn("span", F.col("agri_year") - F.col("last_natural"))
    return rows.select("cell_id", "agri_cycle", "last_natural", "span")


@query("f04_case_when", sql(f"""
    select cell_id, year, case when class_code in {AGRI} then 'agri' when class_code = 3 then 'forest' end as kind,
      case when year < first_agri then 'before' when year >= first_agri then 'after'
           when first_agri is null then 'before' end as period
    from panel left join (select cell_id, min(agri_year) as first_agri from c_length group by 1) f using (cell_id)""",
    "panel", "c_length"))
def _(t):
    first = t.c_length.groupBy("cell_id").agg(F.min("agri_year").alias("first_agri"))
    code, year, agri = F.col("class_code"), F.col("year"), F.col("first_agri")
    return t.panel.join(first, "cell_id", "left").select(
        "cell_id", "year",
        F.when(values.in_codes(code, t.spec.agriculture), "agri")
        .when(values.in_codes(code, t.spec.natural), "forest").alias("kind"),
        F.when(year < agri, "before").when(year >= agri, "after").when(agri.isNull(), "before").alias("period"),
    )


@query("f05_sentinel", sql("select * from clean", "clean"))
def _(t):
    return panel.null_sentinels(t.observed, ("forest_year", "agri_year"), "c_length")


@query("f06_predicates", sql("""
    select cell_id, tile_id, w.area, code_muni from mask_wide w join mask m using (tile_id, tile_cell_id)
    where not (w.area = 0) and code_muni <> 3 and m.x >= 1""", "mask_wide", "mask"))
def _(t):
    wide = t.mask_wide.filter(~(F.col("area") == 0)).select("tile_id", "tile_cell_id", "area")
    cells = t.mask.filter((F.col("code_muni") != 3) & (F.col("x") >= 1)).drop("area")
    return wide.join(cells, ["tile_id", "tile_cell_id"]).select("cell_id", "tile_id", "area", "code_muni")


@query("f07_in_list", sql(f"""
    select cell_id, year, class_code in {AGRI} as is_agri from panel where class_code not in (25, 33)""", "panel"))
def _(t):
    code = F.col("class_code")
    return t.panel.filter(~code.isin(25, 33)).select(
        "cell_id", "year", values.in_codes(code, t.spec.agriculture).alias("is_agri")
    )


@query("f08_drop_nulls", sql("""
    select * from clean where forest_year is not null and agri_year is not null and c_length is not null""", "clean"))
def _(t):
    return panel.null_sentinels(t.observed, ("forest_year", "agri_year"), "c_length").dropna("any")


@query("f09_groups_having", sql(f"""
    select * from panel where cell_id in (
      select cell_id from panel group by 1 having bool_or(class_code in {AGRI}) and bool_or(class_code = 3))""", "panel"))
def _(t):
    code = F.col("class_code")
    return panel.keep_groups_having(t.panel, ["cell_id"], {
        "agri": values.in_codes(code, t.spec.agriculture), "natural": values.in_codes(code, t.spec.natural),
    })


@query("f10_remap_bands", sql("select cell_id, " + ", ".join(
    f"cast(classification_{y} in (3) as int) as classification_{y}" for y in YEARS) + " from wide", "wide"))
def _(t):
    return panel.remap_bands(t.wide, t.bands, t.spec.natural)


@query("f11_shift_columns", sql("""
    select cell_id, agri_cycle, forest_year - 1984 as forest_year, agri_year - 1984 as agri_year from c_length""",
    "c_length"))
def _(t):
    shifted = panel.shift_columns(t.c_length, ["forest_year", "agri_year"], 1984)
    return shifted.select("cell_id", "agri_cycle", "forest_year", "agri_year")


@query("f12_fill_nulls", sql(
    "select x, y, " + ", ".join(f"coalesce({b}, 0) as {b}" for b in IMAGE_BANDS) + " from image", "image"))
def _(t):
    return t.image.fillna(0)


@query("f13_decode_codes", sql("""
    select c.cell_id, c.agri_cycle, k.class_name as crop from c_length c join classes k on k.class_code = c.agri_code""",
    "c_length", "classes"))
def _(t):
    decoded = joins.decode_codes(t.c_length, t.classes, "agri_code", "crop")
    return decoded.select("cell_id", "agri_cycle", "crop")


@query("f14_square_km", sql("""
    select tile_id, round(cast(sum(area) as double) / 1e6, 12) as km2 from mask group by 1""", "mask"))
def _(t):
    sums = t.mask.groupBy("tile_id").agg(F.sum("area").cast("double").alias("m2"))
    return sums.select("tile_id", F.round(values.square_km(F.col("m2")), 12).alias("km2"))


@query("o01_sort", sql("select * from c_length order by cell_id, agri_cycle", "c_length"))
def _(t):
    return t.c_length.orderBy("cell_id", "agri_cycle")


ORDERED = ", ".join(f"'{c}'" for c in FOLLOW_UP_CLASSES)


@query("o02_custom_order", sql(f"""
    select agri_code, class_code, cast(row_number() over (partition by agri_code order by
      coalesce(list_position([{ORDERED}], class_code), 10), class_code) as int) as position
    from parts""", "parts"))
def _(t):
    named = summaries.followup_shares(summaries.followup_counts(t.c_length, t.c_classes), t.classes)
    keys = [values.rank_of(F.col("class_code"), FOLLOW_UP_CLASSES), F.col("class_code")]
    position = F.row_number().over(Window.partitionBy("agri_code").orderBy(*keys))
    ordered = reshape.in_category_order(named, ["agri_code", "class_code"], FOLLOW_UP_CLASSES)
    return ordered.select("agri_code", "class_code", position.alias("position"))


@query("o03_first_columns", sql("select round(total_perc, 6) as total_perc, agri_code, " + ", ".join(
    f"round(max(perc) filter (class_code = '{c}'), 6) as \"{c}\"" for c in FOLLOW_UP_CLASSES[:4]
) + " from parts group by total_perc, agri_code", "parts"))
def _(t):
    table = summaries.followup_crosstab(summaries.followup_counts(t.c_length, t.c_classes), t.classes)
    first = table.select(*table.columns[:6])
    return first.withColumns({c: F.round(c, 6) for c in first.columns if c != "agri_code"})


@query("u01_bands_to_rows", sql("select * from panel", "panel"))
def _(t):
    return panel.bands_to_rows(t.wide, ["cell_id"])


MELT = """select cell_id, agri_cycle, k as measure,
      case k when 'forest_year' then forest_year when 'agri_year' then agri_year else c_length end as value
    from c_length cross join (values ('forest_year'), ('agri_year'), ('c_length')) v(k)"""


@query("u02_measures_to_rows", sql(MELT, "c_length"))
def _(t):
    wide = t.c_length.select("cell_id", "agri_cycle", *MEASURE_LABELS)
    return panel.measures_to_rows(wide, list(MEASURE_LABELS), "measure", "value")


@query("u03_years_to_rows", sql(f"select * from ({MELT}) m where measure <> 'c_length'", "c_length"))
def _(t):
    wide = t.c_length.select("cell_id", "agri_cycle", "forest_year", "agri_year")
    return panel.measures_to_rows(wide, ["forest_year", "agri_year"], "measure", "value")


@query("u04_pivot", sql("select agri_code, " + ", ".join(
    f"round(max(perc) filter (class_code = '{c}'), 9) as \"{c}\"" for c in FOLLOW_UP_CLASSES
) + " from parts group by agri_code", "parts"))
def _(t):
    parts = summaries.followup_shares(summaries.followup_counts(t.c_length, t.c_classes), t.classes)
    table = reshape.crosstab_percent(parts, ["agri_code"], "class_code", "perc", FOLLOW_UP_CLASSES)
    return table.withColumns({c: F.round(c, 9) for c in FOLLOW_UP_CLASSES})


@query("u05_bounds_to_columns", sql(BANDS, "pairs"))
def _(t):
    """Quantiles as rows, one for each bound, then the two bounds of a group as columns."""
    bands = aggregates.quantile_bands(compare_measures(t.c_length, t.observed), ["var"], "difference")
    rows = bands.unpivot(["var", "group_id"], ["min", "max"], "side", "value")
    wide = rows.groupBy("var", "group_id").pivot("side", ["min", "max"]).agg(F.first("value"))
    return wide.withColumns({c: F.round(c, 9) for c in ("min", "max")})


@query("t01_union_by_name", sql("""
    select cell_id, year, class_code from panel union all select cell_id, year, class_code from panel_events""",
    "panel", "panel_events"))
def _(t):
    return t.panel.unionByName(t.panel_events.select("class_code", "year", "cell_id"))


@query("t02_mirror_rows", sql("""
    select var, round(avg(abs(difference)) * s, 9) as mae from pairs cross join (values (1), (-1)) v(s)
    group by var, s""", "pairs"))
def _(t):
    metrics = validation_metrics(compare_measures(t.c_length, t.observed)).select("var", "mae")
    return reshape.mirror_rows(metrics, "mae").withColumn("mae", F.round("mae", 9))


@query("t03_except", sql("""
    select cell_id from observed except select cell_id from c_length""", "observed", "c_length"))
def _(t):
    return t.observed.select("cell_id").subtract(t.c_length.select("cell_id"))


@query("x01_first_number", """
    select p_partkey as id, cast(nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') as int) as brand,
      cast(null as int) as none from part""")
def _(t):
    return t.read("part").select(
        F.col("p_partkey").alias("id"), text.first_number(F.col("p_brand")).alias("brand"),
        text.first_number(F.col("p_type")).alias("none"),
    )


@query("x02_code_from_path", sql("""
    select cell_id, printf('%010d-%010d', tile_id, tile_cell_id) as tile_code, '2' as cycle,
      cast(null as varchar) as missing from mask""", "mask"))
def _(t):
    path = F.format_string("raw/lulc-%010d-%010d.tif", "tile_id", "tile_cell_id")
    stack = F.format_string("tiles/stack_%d_cycle_2.tif", "tile_id")
    return t.mask.select(
        "cell_id", text.code_after(path, "lulc-").alias("tile_code"),
        text.code_after(stack, "cycle_").alias("cycle"), text.code_after(stack, "lulc-").alias("missing"),
    )


@query("x03_path_template", sql("""
    select distinct concat('c_length/tile_id=', tile_id, '/agri_cycle=', agri_cycle) as path,
      concat('mask_cells/tile_id=', tile_id) as mask_path from tiled""", "tiled"))
def _(t):
    return t.tiled.select(
        text.tile_path("c_length", F.col("tile_id"), F.col("agri_cycle")).alias("path"),
        text.tile_path("mask_cells", F.col("tile_id")).alias("mask_path"),
    ).distinct()


@query("x04_casts", sql("""
    select cell_id, cast(agri_year as varchar) as as_text, cast(agri_year as double) as as_double,
      cast(cast(forest_type as varchar) as int) as as_int from c_length where agri_cycle = 1""", "c_length"))
def _(t):
    return t.c_length.filter("agri_cycle = 1").select(
        "cell_id", F.col("agri_year").cast("string").alias("as_text"),
        F.col("agri_year").cast("double").alias("as_double"),
        F.col("forest_type").cast("string").cast("int").alias("as_int"),
    )


@query("x05_year_dates", sql("""
    select cell_id, agri_cycle, cast(make_date(agri_year, 1, 1) as varchar) as day,
      cast(year(make_date(agri_year, 1, 1)) as int) as year from c_length""", "c_length"))
def _(t):
    day = values.year_start(F.col("agri_year"))
    return t.c_length.select("cell_id", "agri_cycle", day.cast("string").alias("day"), F.year(day).alias("year"))


@query("x06_arithmetic", sql("""
    select cell_id, agri_cycle, abs(forest_year - 2000) as gap, cast(round_even(
      cast(c_length as decimal(12, 4)) / 8 * 1.0, 2) as double) as eighth, c_length / 37 * 100 >= 5 as long
    from c_length""", "c_length"))
def _(t):
    length = F.col("c_length")
    return t.c_length.select(
        "cell_id", "agri_cycle", F.abs(F.col("forest_year") - 2000).alias("gap"),
        F.bround((length.cast("decimal(12,4)") / 8), 2).cast("double").alias("eighth"),
        (length / 37 * 100 >= 5).alias("long"),
    )


@query("x07_point_text", sql("""
    select cell_id, concat('POINT (', cast(cast(x as decimal(18, 6)) as varchar), ' ',
      cast(cast(y as decimal(18, 6)) as varchar), ')') as wkt,
      cast(cast(x as decimal(18, 6)) as double) as x, cast(cast(y as decimal(18, 6)) as double) as y from mask""", "mask"))
def _(t):
    points = t.mask.select("cell_id", text.point_text(F.col("x"), F.col("y"), 6).alias("wkt"))
    x, y = text.point_xy(F.col("wkt"))
    return points.select("cell_id", "wkt", x.alias("x"), y.alias("y"))


@query("x08_null_tests", sql("""
    select cell_id, forest_year is null as no_forest, agri_year is not null as has_agri from clean""", "clean"))
def _(t):
    clean = panel.null_sentinels(t.observed, ("forest_year", "agri_year"), "c_length")
    return clean.select(
        "cell_id", F.col("forest_year").isNull().alias("no_forest"), F.col("agri_year").isNotNull().alias("has_agri")
    )


@query("x09_labels", sql(f"""
    select var, count(*) as n from (select case measure when 'forest_year' then 'Deforestation'
      when 'agri_year' then 'Agriculture Establishment' else 'Conversion Length' end as var from ({MELT}) m) l
    group by 1""", "c_length"))
def _(t):
    rows = panel.measures_to_rows(t.c_length.select("cell_id", *MEASURE_LABELS), list(MEASURE_LABELS), "m", "v")
    return aggregates.histogram(rows.select(values.label_of(F.col("m"), MEASURE_LABELS).alias("var")), "var")


@query("x10_cell_to_xy", sql("""
    select cell_id, cast((tile_cell_id - 1) // 10 as int) as row, cast((tile_cell_id - 1) % 10 as int) as col,
      tile_cell_id as number, round(x, 9) as x, round(y, 9) as y from mask""", "mask"))
def _(t):
    cells = t.mask.select("cell_id", "tile_id", "tile_cell_id").join(t.meta, "tile_id")
    cells = cells.withColumns({
        "row": geometry.cell_row(F.col("tile_cell_id"), F.col("n_col")),
        "col": geometry.cell_col(F.col("tile_cell_id"), F.col("n_col")),
    })
    extent = [F.col(c) for c in ("x_min", "x_max", "n_col", "y_min", "y_max", "n_row")]
    return cells.select(
        "cell_id", "row", "col", geometry.cell_number(F.col("row"), F.col("col"), F.col("n_col")).alias("number"),
        F.round(geometry.centre_x(F.col("col"), *extent[:3]), 9).alias("x"),
        F.round(geometry.centre_y(F.col("row"), *extent[3:]), 9).alias("y"),
    )
