"""Join queries (J-01 to J-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from landtrace.operators import joins, overlay, polygons, sphere
from landtrace.operators.cycles import band_join
from landtrace.plans.conversion import conversion_cycles
from landtrace.plans.validation import compare_measures
from landtrace.spec import FOLLOW_UP_YEARS
from suite.registry import query
from suite.sql import sql


@query("j01_left_join", sql("""
    select c.cell_id, c.agri_cycle, m.area, m.code_muni, u.name_state
    from c_length c left join mask m using (cell_id) left join municip u using (code_muni)""",
    "c_length", "mask", "municip"))
def _(t):
    located = joins.with_area(t.c_length.select("cell_id", "agri_cycle"), t.mask, ["area", "code_muni"])
    named = located.join(t.municip, "code_muni", "left")
    return named.select("cell_id", "agri_cycle", "area", "code_muni", "name_state")


@query("j02_band_join", sql("select * from c_classes", "c_classes"))
def _(t):
    return band_join(t.panel, t.c_length, FOLLOW_UP_YEARS)


@query("j03_composite_join", sql("""
    select c.cell_id, c.agri_cycle, m.tile_id, c.agri_code, k.year, k.class_code
    from c_length c join mask m using (cell_id) join c_classes k using (cell_id, agri_cycle)""",
    "c_length", "c_classes", "mask"))
def _(t):
    tile = t.mask.select("cell_id", "tile_id")
    left = t.c_length.select("cell_id", "agri_cycle", "agri_code").join(tile, "cell_id")
    right = t.c_classes.join(tile, "cell_id")
    return left.join(right, ["agri_cycle", "cell_id", "tile_id"], "inner")


@query("j04_paired_measures", sql("select * from pairs", "pairs"))
def _(t):
    return compare_measures(t.c_length, t.observed)


@query("j05_two_roles", sql("""
    select f.count, a.class_name as crop, b.class_name as found from followup f
    join classes a on a.class_code = f.agri_code join classes b on b.class_code = f.class_code""",
    "followup", "classes"))
def _(t):
    found = joins.at_lag(t.c_length, t.c_classes, FOLLOW_UP_YEARS, ["cell_id"])
    counts = found.groupBy("agri_code", "class_code").agg(F.count("*").alias("count"))
    named = joins.decode_codes(counts, t.classes, "agri_code", "crop")
    return joins.decode_codes(named, t.classes, "class_code", "found").select("count", "crop", "found")


@query("j06_full_join", sql("""
    select cell_id, e.agri_year, m.code_muni from ev_length e full join mask m using (cell_id)""", "ev_length", "mask"))
def _(t):
    seen = conversion_cycles(t.panel_events, t.spec).select("cell_id", "agri_year")
    return seen.join(t.mask.select("cell_id", "code_muni"), "cell_id", "full")


@query("j07_densify", sql("""
    select g.tile_id, cast(s.i as int) as tile_cell_id, v.agri_code, v.c_length
    from (select distinct tile_id from mask) g cross join generate_series(1, 100) s(i)
    left join (select t.*, m.tile_cell_id from tiled t join mask m using (cell_id) where agri_cycle = 1) v
      on v.tile_id = g.tile_id and v.tile_cell_id = s.i""", "tiled"))
def _(t):
    place = t.mask.select("cell_id", "tile_id", "tile_cell_id")
    first = t.c_length.filter("agri_cycle = 1").select("cell_id", "agri_code", "c_length").join(place, "cell_id")
    return joins.densify(first.drop("cell_id"), t.meta.select("tile_id", "n_cell"), ["tile_id"], "n_cell", "tile_cell_id")


@query("j08_semi_join", sql("""
    select * from observed where cell_id in (select cell_id from c_length)""", "c_length", "observed"))
def _(t):
    return joins.matched_rows(t.observed, t.c_length, "cell_id")


@query("j09_cross_sequence", sql("""
    select agri_code, n, cast(s.i as int) as estimated, cast(s.i as int) as observed
    from (select agri_code, count(*) as n from c_length group by 1) c cross join generate_series(-1, 36) s(i)""",
    "c_length"))
def _(t):
    counts = t.c_length.groupBy("agri_code").agg(F.count("*").alias("n"))
    return joins.cross_sequence(counts, -1, 36, ["estimated", "observed"])


@query("j10_polygons_touching", sql("""
    select p.poly_id, e.poly_id as other_id from plots p join edges e
      on least(p.x1, p.x2) <= greatest(e.x1, e.x2) and least(e.x1, e.x2) <= greatest(p.x1, p.x2)
      and least(p.y1, p.y2) <= greatest(e.y1, e.y2) and least(e.y1, e.y2) <= greatest(p.y1, p.y2)
      and ((p.x2-p.x1)*(e.y1-p.y1)-(p.y2-p.y1)*(e.x1-p.x1)) * ((p.x2-p.x1)*(e.y2-p.y1)-(p.y2-p.y1)*(e.x2-p.x1)) <= 0
      and ((e.x2-e.x1)*(p.y1-e.y1)-(e.y2-e.y1)*(p.x1-e.x1)) * ((e.x2-e.x1)*(p.y2-e.y1)-(e.y2-e.y1)*(p.x2-e.x1)) <= 0
    union
    select poly_id, other_id from (
      select p.poly_id, e.poly_id as other_id, p.x1, p.y1, count(*) filter ((e.y1 > p.y1) <> (e.y2 > p.y1)
        and e.x1 + (p.y1 - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) > p.x1) % 2 as odd
      from plots p cross join edges e group by 1, 2, 3, 4) i where odd = 1
    union
    select poly_id, other_id from (
      select p.poly_id, e.poly_id as other_id, e.x1, e.y1, count(*) filter ((p.y1 > e.y1) <> (p.y2 > e.y1)
        and p.x1 + (e.y1 - p.y1) * (p.x2 - p.x1) / (p.y2 - p.y1) > e.x1) % 2 as odd
      from plots p cross join edges e group by 1, 2, 3, 4) o where odd = 1""", "plots", "edges"))
def _(t):
    return polygons.polygons_touching(t.plots, t.edges, bucket=0.5)


@query("j11_nearest", sql("""
    select cell_id, poly_id, round(distance, 9) as distance from nearest""", "nearest"))
def _(t):
    near = polygons.nearest_polygon(t.mask.select("cell_id", "x", "y"), t.edges, bucket=0.25)
    return near.select("cell_id", "poly_id", F.round("distance", 9).alias("distance"))


@query("j11_nearest_sphere", sql("""
    select cell_id, poly_id, round(metres, 3) as distance from nearest_sphere""", "nearest_sphere"))
def _(t):
    near = sphere.nearest_on_sphere(t.mask.select("cell_id", "x", "y"), t.edges, bucket=0.25)
    return near.select("cell_id", "poly_id", F.round("distance", 3).alias("distance"))


@query("j12_inside", sql("select cell_id, poly_id from located where inside", "located"))
def _(t):
    return polygons.points_inside(t.mask, t.edges, bucket=0.25).select("cell_id", "poly_id")


# the clipped parts of a polygon add up to it, hole and all
@query("j12_clip_hexagons", sql("""
    select poly_id, round(sum(case when ring = 0 then abs(a) else -abs(a) end), 9) as area
    from (select poly_id, ring, sum(x1 * y2 - x2 * y1) / 2 as a from edges group by 1, 2) r group by 1""", "edges"))
def _(t):
    parts = overlay.clip_to_hexagons(overlay.mark_holes(t.rings), 0.13, origin=(0.02, -0.01))
    areas = overlay.clipped_areas(parts, ["hex_q", "hex_r"])
    return areas.groupBy("poly_id").agg(F.round(F.sum("area"), 9).alias("area"))


# by a line integral of the edges' heights, held within the tile
def _above(y: str) -> str:
    return f"""case when {y} <= y0 then 0 when {y} <= y0 + 0.3::double then ({y} - y0) * ({y} - y0) / 2
      else 0.045::double + 0.3::double * ({y} - y0 - 0.3::double) end"""


@query("j12_clip_tiles", sql(f"""
    select tile_x, tile_y, poly_id, round(area, 9) as area from (
      select tile_x, tile_y, poly_id, sum(case when ring = 0 then abs(a) else -abs(a) end) as area from (
        select tile_x, tile_y, poly_id, ring, sum(case when yb = ya then (xb - xa) * greatest(0, least(0.3::double, ya - y0))
            else (xb - xa) / (yb - ya) * (({_above('yb')}) - ({_above('ya')})) end) as a from (
          select *, tile_y * 0.3::double as y0, y1 + (xa - x1) * (y2 - y1) / (x2 - x1) as ya,
            y1 + (xb - x1) * (y2 - y1) / (x2 - x1) as yb from (
            select *, greatest(least(x1, tile_x * 0.3::double + 0.3::double), tile_x * 0.3::double) as xa,
              greatest(least(x2, tile_x * 0.3::double + 0.3::double), tile_x * 0.3::double) as xb
            from edges cross join (select unnest(range(-1, 18)) as tile_x) cross join (select unnest(range(-1, 18)) as tile_y)
            where x1 <> x2) e) i group by 1, 2, 3, 4) r group by 1, 2, 3) s
    where round(area, 9) > 0""", "edges"))
def _(t):
    areas = overlay.clipped_areas(overlay.clip_to_tiles(overlay.mark_holes(t.rings), 0.3), ["tile_x", "tile_y"])
    rows = areas.select(F.col("tile_x"), F.col("tile_y"), "poly_id", F.round("area", 9).alias("area"))
    return rows.filter("area > 0")


@query("j13_unmatched_keys", sql("""
    select cell_id from observed where cell_id not in (select cell_id from c_length)""", "observed", "c_length"))
def _(t):
    return joins.unmatched_keys(t.observed, t.c_length, "cell_id")
