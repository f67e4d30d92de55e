"""Aggregate, window and sampling queries (A, W, M)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from landtrace.operators import aggregates, cycles, joins, sampling
from landtrace.operators.ids import surrogate_ids
from landtrace.operators.panel import any_nonzero
from landtrace.plans import summaries
from landtrace.plans.validation import compare_measures
from suite.flagship import AREA, BANDS, LENGTH, SAMPLE, ticket_sql
from suite.registry import query
from suite.sql import AGRI, ANTHROPIC, sql
from suite.tables import IMAGE_BANDS


@query("a01_grouped_min", sql(f"""
    select cell_id, f.first_year, min(year) filter (class_code = 3 and year > f.first_year) as next_natural
    from panel join (select cell_id, min(year) as first_year from panel where class_code in {ANTHROPIC} group by 1) f
    using (cell_id) group by 1, 2""", "panel"))
def _(t):
    code, year = F.col("class_code"), F.col("year")
    first = t.panel.filter(code.isin(*t.spec.anthropic)).groupBy("cell_id").agg(F.min("year").alias("first_year"))
    return t.panel.join(first, "cell_id").groupBy("cell_id", "first_year").agg(
        F.min(F.when(code.isin(*t.spec.natural) & (year > F.col("first_year")), year)).alias("next_natural")
    )


@query("a02_last_row", sql("""
    select cell_id, year, class_code from panel where class_code = 3
    qualify row_number() over (partition by cell_id order by year desc) = 1""", "panel"))
def _(t):
    return aggregates.first_per_key(t.panel.filter("class_code = 3"), ["cell_id"], ["year"], last=True)


@query("a03_count", sql("""
    select agri_code, forest_type, count(*) as n from c_length group by 1, 2""", "c_length"))
def _(t):
    return aggregates.histogram(t.c_length, "agri_code", "forest_type")


@query("a04_sum", sql(f"""
    select forest_type, c_length, cast(sum(total_area) as double) as total_area from ({AREA}) a
    where conversion = 'agri_year' group by 1, 2""", "c_length", "mask"))
def _(t):
    located = joins.with_area(t.c_length.filter("agri_cycle = 1"), t.mask)
    by_year = located.groupBy("forest_type", "c_length", "agri_year").agg(
        aggregates.total(F.col("area")).alias("area")
    )
    sums = by_year.groupBy("forest_type", "c_length").agg(F.sum("area").alias("total_area"))
    return sums.withColumn("total_area", F.col("total_area").cast("double"))


def metrics(t):
    return aggregates.error_metrics(compare_measures(t.c_length, t.observed), ["var", "forest_type"])


@query("a05_mae", sql("""
    select var, forest_type, round(avg(abs(difference)), 9) as mae from pairs group by 1, 2""", "pairs"))
def _(t):
    return metrics(t).select("var", "forest_type", F.round("mae", 9).alias("mae"))


@query("a06_bias", sql("""
    select var, forest_type, round(avg(difference), 9) as bias,
      round(sum(difference) / sum(abs(observed)) * 100, 9) as pbias from pairs group by 1, 2""", "pairs"))
def _(t):
    return metrics(t).select("var", "forest_type", F.round("bias", 9).alias("bias"), F.round("pbias", 9).alias("pbias"))


@query("a07_quantiles", sql(BANDS, "pairs"))
def _(t):
    bands = aggregates.quantile_bands(compare_measures(t.c_length, t.observed), ["var"], "difference")
    return bands.withColumns({"min": F.round("min", 9), "max": F.round("max", 9)})


@query("a07_exact_quantiles", """
    select l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.05), 6) as q05, round(quantile_cont(l_extendedprice, 0.25), 6) as q25,
      round(quantile_cont(l_extendedprice, 0.75), 6) as q75, round(quantile_cont(l_extendedprice, 0.95), 6) as q95
    from lineitem group by 1, 2""")
def _(t):
    by = ["l_returnflag", "l_linestatus"]
    found = aggregates.exact_quantiles(t.read("lineitem"), by, "l_extendedprice")
    names = ("q05", "q25", "q75", "q95")
    return found.select(*by, *[F.round(F.col("quantiles")[k], 6).alias(name) for k, name in enumerate(names)])


@query("a08_majority_ties", sql("""
    select * from (select tile_id, c_length, count(*) as n from tiled group by 1, 2) k
    qualify rank() over (partition by tile_id order by n desc) = 1""", "tiled"))
def _(t):
    return aggregates.majority(t.tiled, ["tile_id"], "c_length")


@query("a09_any_nonzero", sql("""
    select cell_id, p.cell_id is not null as seen
    from mask left join (select distinct cell_id from panel where class_code <> 0) p using (cell_id)""", "mask", "panel"))
def _(t):
    cells = t.mask.select("cell_id").join(t.wide, "cell_id", "left")
    return cells.select("cell_id", any_nonzero(t.bands).alias("seen"))


@query("a10_distinct", sql("select distinct tile_id, agri_cycle from tiled", "tiled"))
def _(t):
    return t.tiled.select("tile_id", "agri_cycle").distinct()


@query("a11_density", sql("""
    select name_state, agri_year, cast(g.i as int) as grid_id, round(1 + g.i * (35::double / 63), 9) as x,
      round(sum(exp(-pow((1 + g.i * (35::double / 63) - c_length) / 2, 2) / 2)) / (count(*) * 2 * sqrt(2 * pi())), 9) as density
    from (select * from c_length join mask using (cell_id) join municip using (code_muni)
          where agri_cycle = 1 and agri_year >= 1995 and c_length >= 1 and c_length <= 36) c
    cross join generate_series(0, 63) g(i) group by 1, 2, 3, 4""", "c_length", "mask", "municip"))
def _(t):
    first = joins.with_area(t.c_length.filter("agri_cycle = 1 and agri_year >= 1995"), t.mask, ["code_muni"])
    named = first.join(t.municip, "code_muni")
    density = aggregates.grouped_density(named, ["name_state", "agri_year"], "c_length", n=64)
    return density.withColumns({"x": F.round("x", 9), "density": F.round("density", 9)})


@query("a12_histogram", sql("select var, difference, count(*) as n from pairs group by 1, 2", "pairs"))
def _(t):
    return aggregates.histogram(compare_measures(t.c_length, t.observed), "var", "difference")


@query("a13_subtotals", sql("""
    select forest_type, agri_year, c_length, cast(grouping(c_length) as int) as is_total,
      cast(sum(area) as double) as area
    from c_length left join mask using (cell_id) where agri_cycle = 1
    group by grouping sets ((forest_type, agri_year, c_length), (forest_type, agri_year))""", "c_length", "mask"))
def _(t):
    located = joins.with_area(t.c_length.filter("agri_cycle = 1"), t.mask)
    sums = aggregates.with_subtotals(
        located, ["forest_type", "agri_year", "c_length"], ["forest_type", "agri_year"], "area"
    )
    return sums.withColumn("area", F.col("area").cast("double"))


@query("a14_value_range", sql(f"""
    select min(least({', '.join(IMAGE_BANDS)})) as low, max(greatest({', '.join(IMAGE_BANDS)})) as high
    from image""", "image"))
def _(t):
    return aggregates.value_range(t.image, IMAGE_BANDS)


@query("w01_segmentation", sql("""
    select p.cell_id, p.year, p.class_code, b.c_cycle from panel p join spans b
    on b.cell_id = p.cell_id and p.year >= b.start and (nxt is null or p.year < nxt)""", "spans"))
def _(t):
    return cycles.segment_cycles(t.panel, t.spec)


@query("w02_cycle_bounds", sql("""
    select cell_id, agri_code, forest_year, agri_year, c_length, c_cycle from c_length""", "c_length"))
def _(t):
    return cycles.cycle_bounds(cycles.segment_cycles(t.panel, t.spec), t.spec)


@query("w03_agri_cycle", sql(f"select {LENGTH} from ev_length", "ev_length"))
def _(t):
    bounds = cycles.cycle_bounds(cycles.segment_cycles(t.panel_events, t.spec), t.spec)
    return cycles.number_cycles(bounds)


@query("w04_surrogate_ids", sql("""
    select row_number() over (order by tile_id, tile_cell_id) as new_id, cell_id from mask""", "mask"))
def _(t):
    cells = t.mask.select("tile_id", "tile_cell_id", "cell_id")
    return surrogate_ids(cells, name="new_id", chunk=32, fanout=4).select("new_id", "cell_id")


@query("w05_shares", sql("""
    select agri_code, class_code, count, round(count / sum(count) over (partition by agri_code) * 100, 9) as perc,
      round(sum(count) over (partition by agri_code) / sum(count) over () * 100, 9) as total_perc from followup""",
    "followup"))
def _(t):
    parts = aggregates.shares(summaries.followup_counts(t.c_length, t.c_classes), ["agri_code"], "count")
    return parts.withColumns({c: F.round(c, 9) for c in ("perc", "total_perc")})


@query("w06_group_max_rows", sql("""
    select cell_id, agri_cycle, c_length from c_length
    qualify c_length = max(c_length) over (partition by cell_id)""", "c_length"))
def _(t):
    # a cell has at most one conversion per two years
    top = F.max("c_length").over(Window.partitionBy("cell_id"))
    rows = t.c_length.select("cell_id", "agri_cycle", "c_length").withColumn("top", top)
    return rows.filter("c_length = top").drop("top")


@query("w07_lag_slice", sql("""
    select c.cell_id, c.agri_cycle, c.agri_code, k.class_code, k.year - c.agri_year as year
    from c_length c join c_classes k using (cell_id, agri_cycle) where agri_cycle = 1 and k.year - c.agri_year = 5""",
    "c_length", "c_classes"))
def _(t):
    return joins.at_lag(t.c_length, t.c_classes, 5, ["cell_id"])


@query("w08_first_row", sql(f"""
    select cell_id, year, class_code from panel where class_code in {AGRI}
    qualify row_number() over (partition by cell_id order by year) = 1""", "panel"))
def _(t):
    return aggregates.first_per_key(t.panel.filter(F.col("class_code").isin(*t.spec.agriculture)), ["cell_id"], ["year"])


@query("m01_bernoulli", sql(f"""
    select cell_id, agri_cycle, c_length from c_length where {ticket_sql('cell_id', 1, 0.01)}""", "c_length"))
def _(t):
    return sampling.hash_sample(t.c_length.select("cell_id", "agri_cycle", "c_length"), "cell_id", 0.01, seed=1)


@query("m02_fixed_sample", sql(f"select cell_id, area from mask order by {SAMPLE}, cell_id limit 100", "mask"))
def _(t):
    return sampling.sample_n(t.mask.select("cell_id", "area"), "cell_id", 100, seed=123)


@query("m02_half_sample", sql(f"""
    select cell_id, area from mask qualify row_number() over (order by {SAMPLE}, cell_id) <= (select count(*) // 2 from mask)""", "mask"))
def _(t):
    return sampling.sample_many(t.mask.select("cell_id", "area"), "cell_id", t.mask.count() // 2, seed=123)
