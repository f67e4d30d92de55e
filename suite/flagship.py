"""The whole analyses (P-01 to P-14)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from landtrace.plans import conversion, raster, stored, summaries, validation
from landtrace.sources.scratch import scratch_path
from landtrace.spec import FOLLOW_UP_CLASSES
from suite.registry import query
from suite.sql import AGRI, sql
from suite.tables import STEP

LENGTH = "cell_id, agri_code, forest_year, agri_year, c_length, c_cycle, forest_type, agri_cycle"
SAMPLE = "md5(concat(cell_id, ':123'))"


def ticket_sql(key: str, seed: int, fraction: float) -> str:
    return f"cast(concat('0x', substr(md5(concat({key}, ':{seed}')), 1, 8)) as bigint) < {int(fraction * 2**32)}"


@query("p01_conversion_cycles", sql(f"select {LENGTH} from c_length", "c_length"))
def _(t):
    return conversion.conversion_cycles(t.panel, t.spec)


@query("p01_conversion_cycles_wide", sql(f"select {LENGTH} from c_length", "c_length"))
def _(t):
    return conversion.wide_conversion_cycles(t.wide, t.spec)


@query("p01_conversion_cycles_tiles", sql("select * from tiled", "tiled"))
def _(t):
    place = t.mask.select("cell_id", "tile_id", "tile_cell_id")
    bands = t.wide.join(place, "cell_id").drop("cell_id")
    cycles = conversion.wide_conversion_cycles(bands, t.spec, keys=("tile_id", "tile_cell_id"))
    return conversion.with_cell_ids(cycles, t.mask)


@query("p01_conversion_cycles_events", sql(f"select {LENGTH} from ev_length", "ev_length"))
def _(t):
    return conversion.conversion_cycles(t.panel_events, t.spec)


@query("p01_spec_from_dictionary", sql(f"select {LENGTH} from c_length", "c_length"))
def _(t):
    return conversion.conversion_cycles(t.panel, t.spec, classes=t.classes)


@query("p01_cycle_summary", sql("""
    select agri_code, c_length, count(*) as n, cast(min(forest_year) as int) as first_year
    from c_length group by 1, 2""", "c_length"))
def cycle_summary(t):
    cycles = conversion.wide_conversion_cycles(t.wide, t.spec)
    return cycles.groupBy("agri_code", "c_length").agg(
        F.count("*").alias("n"), F.min("forest_year").alias("first_year")
    )


@query("p02_conversion_classes", sql("select * from c_classes", "c_classes"))
def _(t):
    return conversion.conversion_classes(t.panel, t.spec)


@query("p02_conversion_classes_wide", sql("select * from c_classes", "c_classes"))
def _(t):
    return conversion.wide_conversion_classes(t.wide, t.spec)


@query("p03_extract_mask", sql("""
    select row_number() over (order by w.tile_id, w.tile_cell_id) as cell_id, w.tile_id, w.tile_cell_id, w.area,
      n.poly_id as code_muni, w.x, w.y,
      concat('POINT (', cast(cast(w.x as decimal(18, 6)) as varchar), ' ',
             cast(cast(w.y as decimal(18, 6)) as varchar), ')') as coords
    from mask_wide w join mask m using (tile_id, tile_cell_id) join nearest n on n.cell_id = m.cell_id
    where w.area <> 0""", "mask_wide", "nearest"))
def _(t):
    return conversion.extract_mask(t.mask_wide, t.edges, bucket=0.25, decimals=6)


@query("p03_extract_mask_sphere", sql("""
    select row_number() over (order by w.tile_id, w.tile_cell_id) as cell_id, w.tile_id, w.tile_cell_id, w.area,
      n.poly_id as code_muni, w.x, w.y,
      concat('POINT (', cast(cast(w.x as decimal(18, 6)) as varchar), ' ',
             cast(cast(w.y as decimal(18, 6)) as varchar), ')') as coords
    from mask_wide w join mask m using (tile_id, tile_cell_id) join nearest_sphere n on n.cell_id = m.cell_id
    where w.area <> 0""", "mask_wide", "nearest_sphere"))
def _(t):
    return conversion.extract_mask(t.mask_wide, t.edges, bucket=0.25, decimals=6, spherical=True)


@query("p04_candidate_cells", sql(f"""
    select cell_id from panel group by 1
    having bool_or(class_code = 3) and bool_or(class_code in {AGRI})""", "panel"))
def _(t):
    return conversion.select_candidate_cells(t.wide, t.spec).select("cell_id")


GRID = """select g.tile_id, g.agri_cycle, cast(s.i as int) as tile_cell_id,
      cast((s.i - 1) // 10 as int) as row, cast((s.i - 1) % 10 as int) as col,
      v.agri_code, v.forest_year, v.agri_year, v.c_length, v.c_cycle, v.forest_type
    from (select distinct tile_id, agri_cycle from tiled) g cross join generate_series(1, 100) s(i)
    left join (select t.*, m.tile_cell_id from tiled t join mask m using (cell_id)) v
      on v.tile_id = g.tile_id and v.agri_cycle = g.agri_cycle and v.tile_cell_id = s.i"""


@query("p05_rasterize", sql(GRID, "tiled"))
def _(t):
    return raster.rasterize_conversions(t.c_length, t.mask, t.meta)


@query("p06_mosaic", sql(f"""
    select agri_cycle, cast(top + row as int) as row, cast((tile_id - 1) % 5 * 10 + col as int) as col,
      agri_code, forest_year, agri_year, c_length, c_cycle, forest_type
    from (select g.*, ((select max(tile_id - 1) from mask) // 5 - (tile_id - 1) // 5) * 10 as top from ({GRID}) g) p
    """, "tiled"))
def _(t):
    return raster.mosaic_tiles(t.c_length, t.mask, t.meta)


@query("p07_validation_sample", sql(f"""
    select cell_id, tile_id, tile_cell_id, x, y from mask order by {SAMPLE}, cell_id limit 100""", "mask"))
def _(t):
    return validation.draw_validation_sample(t.mask)


HEX = """(select *, floor(q + 0.5) as rq, floor(r + 0.5) as rr, floor(-q - r + 0.5) as rs from (
      select *, (x * (sqrt(3.0::double) / 3) - y / 3) / (cast({size} as double) / sqrt(3.0::double)) as q,
             (y * (2::double / 3)) / (cast({size} as double) / sqrt(3.0::double)) as r from {source}) a) c"""
HEX_ROUND = """cast(case when abs(rq - q) > abs(rr - r) and abs(rq - q) > abs(rs + q + r) then -rr - rs else rq end as bigint) as hex_q,
    cast(case when not (abs(rq - q) > abs(rr - r) and abs(rq - q) > abs(rs + q + r)) and abs(rr - r) > abs(rs + q + r)
              then -rq - rs else rr end as bigint) as hex_r"""
def hexagons(na_rm: bool) -> str:
    """Blocks of 2 x 2 pixels; without ``na_rm`` only whole ones."""
    whole = "true" if na_rm else "cells = 4"
    blocks = f"""(select block_row, block_col, c_length, (block_col + 0.5::double) * 0.2::double as x,
      (block_row + 0.5::double) * 0.2::double as y
    from (select *, sum(n) over (partition by block_row, block_col) as cells
          from (select block_row, block_col, c_length, count(*) as n
                from (select cast(row // 2 as int) as block_row, cast(col // 2 as int) as block_col, c_length from grid) g
                group by 1, 2, 3) k) w
    where {whole}
    qualify row_number() over (partition by block_row, block_col order by n desc, c_length) = 1)"""
    return sql(f"""
    select hex_q, hex_r, c_length, n, round(x, 9) as x, round(y, 9) as y, poly_id from (
      select hex_q, hex_r, c_length, n, x, y, poly_id,
        count(*) filter ((y1 > y) <> (y2 > y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x) % 2 as odd
      from (select *, (hex_q + hex_r::double / 2) * 0.7::double as x,
                   hex_r * (0.7::double / sqrt(3.0::double) * 1.5) as y
            from (select * from (
                    select hex_q, hex_r, c_length, count(*) as n
                    from (select {HEX_ROUND}, c_length from {HEX.format(source=blocks, size=0.7)}) h
                    group by 1, 2, 3) f
                  qualify rank() over (partition by hex_q, hex_r order by n desc) = 1) z
            where n > 2) k
      cross join edges group by 1, 2, 3, 4, 5, 6, 7) i
    where odd = 1""", "grid", "edges")


def majority_hexagons(t, na_rm):
    zones = raster.hex_majority_length(t.grid, t.edges, step=STEP, size=0.7, factor=2, min_n=2, na_rm=na_rm)
    return zones.withColumns({"x": F.round("x", 9), "y": F.round("y", 9)})


@query("p08_hex_majority", hexagons(True))
def _(t):
    return majority_hexagons(t, True)


@query("p08_hex_majority_whole", hexagons(False))
def _(t):
    return majority_hexagons(t, False)


# a hexagon and a polygon share an area if a corner of one lies in the other, or if their sides cross
SIDE_07 = "0.7::double / sqrt(3.0::double)"
def shapes(na_rm: bool) -> str:
    majority = hexagons(na_rm)
    head, zones = majority.split("select hex_q, hex_r, c_length, n, round(x, 9)", 1)
    zones = zones[zones.index("from (select *, (hex_q"):zones.index("cross join edges")].rstrip()
    return f"""{head.rstrip()}, zones as materialized (select hex_q, hex_r, c_length, n, x as hx, y as hy {zones}),
    corners as (select hex_q, hex_r, hx, hy, k, hx + {SIDE_07} * cos(radians(30 + 60 * k)) as ax, hy + {SIDE_07} * sin(radians(30 + 60 * k)) as ay,
        hx + {SIDE_07} * cos(radians(90 + 60 * k)) as bx, hy + {SIDE_07} * sin(radians(90 + 60 * k)) as b_y
      from (select distinct hex_q, hex_r, hx, hy from zones) cross join (select unnest(range(6)) as k)),
    met as (
      select hex_q, hex_r, poly_id from corners join edges on
        ((bx - ax) * (y1 - ay) - (b_y - ay) * (x1 - ax)) * ((bx - ax) * (y2 - ay) - (b_y - ay) * (x2 - ax)) < 0
        and ((x2 - x1) * (ay - y1) - (y2 - y1) * (ax - x1)) * ((x2 - x1) * (b_y - y1) - (y2 - y1) * (bx - x1)) < 0
      union
      select hex_q, hex_r, poly_id from (
        select hex_q, hex_r, k, poly_id, count(*) filter ((y1 > ay) <> (y2 > ay)
          and x1 + (ay - y1) * (x2 - x1) / (y2 - y1) > ax) % 2 as odd from corners cross join edges group by 1, 2, 3, 4) c where odd = 1
      union
      select hex_q, hex_r, poly_id from (
        select hex_q, hex_r, poly_id, x1, y1, bool_and((bx - ax) * (y1 - ay) - (b_y - ay) * (x1 - ax) > 0) as held
        from corners cross join edges group by 1, 2, 3, 4, 5) v where held)
    select hex_q, hex_r, c_length, n, poly_id from zones join met using (hex_q, hex_r)"""


@query("p08_hex_majority_shapes", shapes(True))
def _(t):
    found = raster.hex_majority_shapes(t.grid, t.rings, step=STEP, size=0.7, factor=2, min_n=2, na_rm=True)
    return found.filter("area > 1e-12").select("hex_q", "hex_r", "c_length", "n", "poly_id")


@query("p09_length_frequency", sql(f"""
    select c_length, count(*) as n from c_length where {ticket_sql("concat(cell_id, '|', agri_cycle)", 2, 0.1)} group by 1""", "c_length"))
def _(t):
    return summaries.length_frequency(t.c_length, fraction=0.1)


AREA = """select k.conversion, c.forest_type, c.c_length,
      case k.conversion when 'agri_year' then agri_year else forest_year end as year,
      coalesce(sum(area), 0) as total_area
    from c_length c left join mask m using (cell_id) cross join (values ('agri_year'), ('forest_year')) k(conversion)
    where agri_cycle = 1 group by 1, 2, 3, 4"""


AREA_BY_YEAR = sql(f"""
    select conversion, forest_type, c_length, concat(year, '-01-01') as year,
      round(cast(total_area as double) / 1e6, 9) as total_area from ({AREA}) a""", "c_length", "mask")


def area_by_year(c_length, mask):
    return summaries.area_by_year(c_length, mask).withColumns({
        "year": F.col("year").cast("string"), "total_area": F.round("total_area", 9),
    })


@query("p10_area_by_year", AREA_BY_YEAR)
def _(t):
    return area_by_year(t.c_length, t.mask)


@query("p11_length_ridges", sql(f"""
    select concat(agri_year, '-01-01') as agri_year, c_length, name_state
    from c_length c left join mask m using (cell_id) left join municip u using (code_muni)
    where agri_cycle = 1 and agri_year >= 1995 and name_state is not null and {ticket_sql('cell_id', 1, 0.2)}""",
    "c_length", "mask", "municip"))
def _(t):
    ridges = summaries.length_ridges(t.c_length, t.mask, t.municip, fraction=0.2)
    return ridges.withColumn("agri_year", F.col("agri_year").cast("string"))


@query("p12_validation_metrics", sql("""
    select var, round(avg(abs(difference)), 9) as mae, round(avg(difference), 9) as bias,
      round(sum(difference) / sum(abs(observed)) * 100, 9) as pbias
    from pairs group by 1""", "pairs"))
def _(t):
    metrics = validation.validation_metrics(validation.compare_measures(t.c_length, t.observed))
    return metrics.select("var", *[F.round(c, 9).alias(c) for c in ("mae", "bias", "pbias")])


BANDS = """select var, 1 as group_id, round(quantile_cont(difference, 0.05), 9) as min,
      round(quantile_cont(difference, 0.95), 9) as max from pairs group by 1
    union all select var, 2, round(quantile_cont(difference, 0.25), 9), round(quantile_cont(difference, 0.75), 9)
    from pairs group by 1"""


@query("p13_quantile_bands", sql(f"""
    select b.*, cast(s.i as int) as estimated, cast(s.i as int) as observed
    from ({BANDS}) b cross join generate_series(-1, 36) s(i)""", "pairs"))
def _(t):
    pairs = validation.compare_measures(t.c_length, t.observed, base_year=1984)
    bands = validation.error_quantile_bands(pairs)
    return bands.withColumns({"min": F.round("min", 9), "max": F.round("max", 9)})


CROSSTAB = sql("select round(total_perc, 9) as total_perc, agri_code, " + ", ".join(
    f"round(max(perc) filter (class_code = '{c}'), 9) as \"{c}\"" for c in FOLLOW_UP_CLASSES
) + " from parts group by total_perc, agri_code", "parts")


def crosstab(t, c_length, c_classes, count=summaries.followup_counts):
    table = summaries.followup_crosstab(count(c_length, c_classes), t.classes)
    return table.withColumns({c: F.round(c, 9) for c in ["total_perc", *FOLLOW_UP_CLASSES]})


@query("p14_followup_crosstab", CROSSTAB)
def _(t):
    return crosstab(t, t.c_length, t.c_classes)


@query("p14_followup_stored", CROSSTAB)
def _(t):
    """Conversions are stored by tile and cycle; the summary reads each stored table once."""
    root = scratch_path(t.spark, "stored")
    stored.store_conversions(t.panel, t.mask, t.spec, root)
    return crosstab(t, *stored.read_stored(t.spark, root))


def by_cell(t):
    """(c_length, c_classes, mask) written in the same buckets of cells."""
    root, prefix = scratch_path(t.spark, "buckets"), f"b{uuid.uuid4().hex}"
    frames = {stored.LENGTH: t.c_length, stored.CLASSES: t.c_classes, stored.MASK: t.mask}
    stored.store_by_cell(frames, root, prefix, buckets=8)
    return stored.open_by_cell(t.spark, list(frames), root, prefix, buckets=8)


@query("p14_followup_bucketed", CROSSTAB)
def _(t):
    length, classes, _ = by_cell(t)
    return crosstab(t, length, classes, stored.stored_followup_counts)


@query("p10_area_bucketed", AREA_BY_YEAR)
def _(t):
    length, _, mask = by_cell(t)
    return area_by_year(length, mask)


SPLIT = 1997  # years from here on come as a refresh, the last one separately


def refreshed(t):
    root = scratch_path(t.spark, "state")
    stored.start_state(t.panel.filter(F.col("year") < SPLIT), t.spec, root)
    stored.add_years(t.panel.filter(F.col("year").between(SPLIT, SPLIT + 1)), t.spec, root, 1)
    return stored.add_years(t.panel.filter(F.col("year") > SPLIT + 1), t.spec, root, 2)


@query("p01_refreshed", sql(f"select {LENGTH} from c_length", "c_length"))
def _(t):
    return refreshed(t)[0]


@query("p02_refreshed", sql("select * from c_classes", "c_classes"))
def _(t):
    return refreshed(t)[1]
