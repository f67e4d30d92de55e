"""Raster and spatial grid queries (R-01 to R-15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from landtrace.functions.geometry import pixel_area
from landtrace.operators import blocks, buffers, composites, hexgrid, overlay, panel, tiles
from landtrace.plans.conversion import select_candidate_cells
from landtrace.plans.validation import draw_validation_sample, sample_surroundings
from suite.flagship import GRID, HEX, HEX_ROUND, SAMPLE
from suite.registry import query
from suite.sql import AGRI, sql
from suite.tables import IMAGE_BANDS, STEP


@query("r01_ever_class_masks", sql(f"""
    select * from panel where cell_id in (select cell_id from panel group by 1
      having bool_or(class_code = 3) and bool_or(class_code in {AGRI}))""", "panel"))
def _(t):
    return panel.bands_to_rows(select_candidate_cells(t.wide, t.spec), ["cell_id"])


ECC2 = "0.0066943799901413165::double"
AUTHALIC = """(sin(radians({lat})) / (1 - {e2} * sin(radians({lat})) * sin(radians({lat})))
      + ln((1 + sqrt({e2}) * sin(radians({lat}))) / (1 - sqrt({e2}) * sin(radians({lat})))) / (2 * sqrt({e2})))"""


@query("r02_pixel_area", sql(f"""
    select cell_id, round(radians(0.1::double) * 6356752.314245179::double * 6356752.314245179::double / 2
      * ({AUTHALIC.format(lat='(y + 0.05::double)', e2=ECC2)} - {AUTHALIC.format(lat='(y - 0.05::double)', e2=ECC2)}), 1) as m2
    from mask""", "mask"))
def _(t):
    return t.mask.select("cell_id", F.round(pixel_area(F.col("y"), STEP), 1).alias("m2"))


def modal(factor: int, na_rm: bool) -> str:
    whole = "" if na_rm else f"where cells = {factor * factor}"
    return sql(f"""
      select block_row, block_col, c_length from (
        select *, sum(n) over (partition by block_row, block_col) as cells,
          row_number() over (partition by block_row, block_col order by n desc, c_length) as pos
        from (select cast(row // {factor} as int) as block_row, cast(col // {factor} as int) as block_col, c_length,
                count(*) as n from grid group by 1, 2, 3) k) p
      {whole + ' and' if whole else 'where'} pos = 1""", "grid")


@query("r03_modal_downscale", modal(3, True))
def _(t):
    return tiles.block_mode(t.grid, "row", "col", "c_length", 3, na_rm=True)


@query("r04_tiling", sql("""
    select cell_id, cast(cell_id // 50 // 7 as int) as tile_row, cast(cell_id % 50 // 7 as int) as tile_col,
      cast((cell_id // 50 % 7) * 7 + cell_id % 50 % 7 + 1 as int) as tile_cell_id from mask""", "mask"))
def _(t):
    key = F.col("cell_id")
    cells = t.mask.select("cell_id", F.floor(key / 50).alias("row"), (key % 50).alias("col"))
    return tiles.assign_tiles(cells, "row", "col", 7).drop("row", "col")


@query("r05_tile_metadata", sql("""
    select *, 10 as n_col, 10 as n_row, 100 as n_cell, 'EPSG:4326' as crs from meta""", "meta"))
def _(t):
    return tiles.tile_metadata(t.mask, t.tiles, t.sizes, STEP)


@query("r06_rasterize", sql(GRID, "tiled"))
def _(t):
    return tiles.rasterize(t.c_length, t.mask, t.meta)


@query("r06_blocks", sql(GRID, "tiled"))
def _(t):
    return blocks.raster_cells(blocks.block_raster(t.c_length, t.mask, t.meta, side=4), t.meta, side=4)


# tiles overlap by two columns: each is placed 8 columns after the one before
@query("r07_mosaic", sql(f"""
    select agri_cycle, row, col, arg_max(agri_code, tile_id) filter (agri_code is not null) as agri_code,
      arg_max(c_length, tile_id) filter (c_length is not null) as c_length
    from (select agri_cycle, tile_id, cast((tile_id - 1) // 5 * 10 + row as int) as row,
            cast((tile_id - 1) % 5 * 8 + col as int) as col, agri_code, c_length from ({GRID}) g) p
    group by 1, 2, 3""", "tiled"))
def _(t):
    number = F.col("tile_id") - 1
    offsets = t.meta.select(
        "tile_id", (F.floor(number / 5) * 10).cast("int").alias("row_offset"),
        (number % 5 * 8).cast("int").alias("col_offset"), F.col("tile_id").alias("tile_order"),
    )
    bands = ("agri_code", "c_length")
    return tiles.mosaic(t.c_length, t.mask, t.meta, offsets, bands)


@query("r07_blocks", sql(f"""
    select agri_cycle, row, col, arg_max(agri_code, tile_id) filter (agri_code is not null) as agri_code,
      arg_max(c_length, tile_id) filter (c_length is not null) as c_length
    from (select agri_cycle, tile_id, cast((tile_id - 1) // 5 * 10 + row as int) as row,
            cast((tile_id - 1) % 5 * 8 + col as int) as col, agri_code, c_length from ({GRID}) g) p
    group by 1, 2, 3""", "tiled"))
def _(t):
    number = F.col("tile_id") - 1
    offsets = t.meta.select(
        "tile_id", (F.floor(number / 5) * 10).cast("int").alias("row_offset"),
        (number % 5 * 8).cast("int").alias("col_offset"), F.col("tile_id").alias("tile_order"),
    )
    bands = ("agri_code", "c_length")
    return blocks.mosaic_cells(blocks.block_mosaic(t.c_length, t.mask, t.meta, offsets, bands, side=16), bands, side=16)


@query("r07_mosaic_apart", sql(f"""
    select agri_cycle, cast((tile_id - 1) // 5 * 10 + row as int) as row,
      cast((tile_id - 1) % 5 * 10 + col as int) as col, c_length from ({GRID}) g""", "tiled"))
def _(t):
    number = F.col("tile_id") - 1
    offsets = t.meta.select(
        "tile_id", (F.floor(number / 5) * 10).cast("int").alias("row_offset"),
        (number % 5 * 10).cast("int").alias("col_offset"), F.col("tile_id").alias("tile_order"),
    )
    return tiles.mosaic(t.c_length, t.mask, t.meta, offsets, ["c_length"])


@query("r08_block_modal", modal(2, False))
def _(t):
    return tiles.block_mode(t.grid, "row", "col", "c_length", 2)


@query("r09_hex", sql(f"select cell_id, {HEX_ROUND} from {HEX.format(source='mask', size=0.7)}", "mask"))
def _(t):
    return hexgrid.hex_bin(t.mask, "x", "y", 0.7).select("cell_id", "hex_q", "hex_r")


@query("r09_hex_origin", sql(f"""select cell_id, {HEX_ROUND}
    from {HEX.format(source='(select cell_id, x - 0.31::double as x, y + 0.12::double as y from mask)', size=0.7)}""", "mask"))
def _(t):
    return hexgrid.hex_bin(t.mask, "x", "y", 0.7, origin=(0.31, -0.12)).select("cell_id", "hex_q", "hex_r")


@query("r10_zonal_majority", sql(f"""
    select * from (select * from (
      select hex_q, hex_r, c_length, count(*) as n from (
        select {HEX_ROUND}, c_length from {HEX.format(source='(select * from c_length join mask using (cell_id))', size=0.7)}) h
      group by 1, 2, 3) k qualify rank() over (partition by hex_q, hex_r order by n desc) = 1) z
    where n > 5""", "c_length", "mask"))
def _(t):
    cells = t.c_length.select("cell_id", "c_length").join(t.mask.select("cell_id", "x", "y"), "cell_id")
    return hexgrid.zonal_majority(hexgrid.hex_bin(cells, "x", "y", 0.7), ["hex_q", "hex_r"], "c_length", 5)


@query("r11_crop", sql("""
    select cell_id, x, y, c_length from c_length join mask using (cell_id)
    where agri_cycle = 1 and x between 1.0 and 2.5 and y between 0.5 and 2.0""", "c_length", "mask"))
def _(t):
    box = tiles.crop(t.mask.select("cell_id", "x", "y"), 1.0, 2.5, 0.5, 2.0)
    return box.join(t.c_length.filter("agri_cycle = 1").select("cell_id", "c_length"), "cell_id")


@query("r12_buffer", sql(f"""
    select cell_id, sample_cell, round(distance, 3) as distance from (
      select m.cell_id, s.cell_id as sample_cell, 2 * 6371008.8::double * asin(least(1.0, sqrt(
        pow(sin(radians(m.y - s.y) / 2), 2)
        + cos(radians(s.y)) * cos(radians(m.y)) * pow(sin(radians(m.x - s.x) / 2), 2)))) as distance
      from mask m cross join (select * from mask order by {SAMPLE}, cell_id limit 100) s) d
    where distance <= 20000""", "mask"))
def _(t):
    near = sample_surroundings(t.mask, draw_validation_sample(t.mask), metres=20_000.0)
    return near.select("cell_id", "sample_cell", F.round("distance", 3).alias("distance"))


SAMPLED = f"(select * from mask order by {SAMPLE}, cell_id limit 100)"
RADIUS = 20_000.0
ANGLE = f"({RADIUS}::double / 6371008.8::double)"
CIRCLES = f"""circles as materialized (
      select poly_id, k, cx + degrees(atan2(-sin(a) * sin({ANGLE}) * cos(radians(cy)), cos({ANGLE}) - sin(radians(cy)) * s)) as x, degrees(asin(s)) as y
      from (select cell_id as poly_id, x as cx, y as cy, k, radians(360 * k / 64.0::double) as a,
              sin(radians(y)) * cos({ANGLE}) + cos(radians(y)) * sin({ANGLE}) * cos(radians(360 * k / 64.0::double)) as s
            from {SAMPLED} cross join (select unnest(range(64)) as k)) c)"""


def sample_rings(t):
    return buffers.buffer_rings(draw_validation_sample(t.mask), "cell_id", RADIUS)


@query("r12_buffer_rings", sql("select * from mask", "mask").rsplit("\n", 1)[0] + f""", {CIRCLES}
    select poly_id, round(min(x), 9) as x_min, round(max(x), 9) as x_max, round(min(y), 9) as y_min, round(max(y), 9) as y_max,
      round(sum(x), 6) as x_sum, round(sum(y), 6) as y_sum from circles group by 1""")
def _(t):
    rings = sample_rings(t)
    sums = rings.select("poly_id", F.inline("points")).groupBy("poly_id").agg(
        F.round(F.sum("x"), 6).alias("x_sum"), F.round(F.sum("y"), 6).alias("y_sum"))
    boxes = buffers.boxes_of(rings).select("poly_id", *[F.round(c, 9).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")])
    return boxes.join(sums, "poly_id")


@query("r12_buffer_union", sql("select * from mask", "mask").rsplit("\n", 1)[0] + f""", {CIRCLES},
    sides as (select a.poly_id, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from circles a join circles b
      on a.poly_id = b.poly_id and b.k = (a.k + 1) % 64),
    spans as (select line, poly_id, xa, lead(xa) over w as xb, row_number() over w as n from (
        select line, poly_id, x1 + ((line + 0.5::double) * 0.02::double - y1) * (x2 - x1) / (y2 - y1) as xa
        from sides cross join (select unnest(range(-40, 3000)) as line)
        where (y1 > (line + 0.5::double) * 0.02::double) <> (y2 > (line + 0.5::double) * 0.02::double)) c
      window w as (partition by poly_id, line order by xa)),
    runs as (select line, xa, xb, sum(fresh) over (partition by line order by xa, xb rows unbounded preceding) as run from (
        select *, case when xa <= max(xb) over (partition by line order by xa, xb rows between unbounded preceding and 1 preceding)
          then 0 else 1 end as fresh from spans where n % 2 = 1) f)
    select line, count(*) as n_spans, round(sum(xb - xa), 9) as length
    from (select line, run, min(xa) as xa, max(xb) as xb from runs group by 1, 2) r group by 1""")
def _(t):
    spans = buffers.union_spans(buffers.scan_spans(overlay.ring_edges(sample_rings(t)), 0.02))
    return spans.groupBy("line").agg(F.count("*").alias("n_spans"), F.round(F.sum(F.col("xb") - F.col("xa")), 9).alias("length"))


FOOTPRINTS = f"""boxes as (select scene, year, min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max
      from scenes join mask on mask.cell_id = scenes.cell group by 1, 2),
    areas as (select cell_id as sample_cell, x - 0.35::double as x0, x + 0.35::double as x1, y - 0.35::double as y0, y + 0.35::double as y1 from {SAMPLED}),
    met as (select sample_cell, scene, year, x0, x1, y0, y1 from areas join boxes on x0 <= x_max and x_min <= x1 and y0 <= y_max and y_min <= y1
      where year between 1994 and 1996)"""


def footprints(t):
    """(scenes with their boxes, boxes around sampled cells)"""
    placed = t.scenes.join(t.mask.select(F.col("cell_id").alias("cell"), "x", "y"), "cell")
    boxes = placed.groupBy("scene", "year").agg(*[f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])
    sample = draw_validation_sample(t.mask)
    areas = sample.select(F.col("cell_id").alias("sample_cell"), *[
        (F.col(c) + d).alias(f"{c}_{n}") for c in "xy" for n, d in (("min", -0.35), ("max", 0.35))])
    return placed, boxes, areas


@query("r13_scenes_by_footprint", sql("select 1", "scenes", "mask").rsplit("\n", 1)[0] + f""", {FOOTPRINTS}
    select sample_cell, year, count(*) as n_scenes, min(scene) as first_scene, max(scene) as last_scene from met group by 1, 2""")
def _(t):
    _, boxes, areas = footprints(t)
    met = composites.scenes_by_footprint(boxes, areas, 1994, 1996, bucket=2.0)
    return met.groupBy("sample_cell", "year").agg(
        F.count("*").alias("n_scenes"), F.min("scene").alias("first_scene"), F.max("scene").alias("last_scene"))


@query("r13_area_composite", sql("select 1", "scenes", "mask").rsplit("\n", 1)[0] + f""", {FOOTPRINTS}
    select sample_cell, cell, year, arg_max(nir, (scene, part, nir)) filter (nir is not null) as nir,
      arg_max(red, (scene, part, red)) filter (red is not null) as red
    from met join scenes using (scene, year) join mask on mask.cell_id = scenes.cell
    where mask.x between x0 and x1 and mask.y between y0 and y1 group by 1, 2, 3""")
def _(t):
    placed, boxes, areas = footprints(t)
    return composites.area_composite(
        placed, boxes, areas, "sample_cell", "scene", ["cell"], ["nir", "red"], ["scene", "part"], 1994, 1996, bucket=2.0)


@query("r13_yearly_composite", sql("""
    select cell, year, arg_max(nir, (scene, part, nir)) filter (nir is not null) as nir,
      arg_max(red, (scene, part, red)) filter (red is not null) as red
    from scenes where year between 1985 and 2020 group by 1, 2""", "scenes"))
def _(t):
    return composites.yearly_composite(t.scenes, ["cell"], ["nir", "red"], ["scene", "part"], 1985, 2020)


FILLED = ", ".join(f"coalesce({b}, 0)" for b in IMAGE_BANDS)


@query("r14_minmax", sql("select x, y, " + ", ".join(
    f"round((coalesce({b}, 0) - low) / (high - low), 9) as {b}" for b in IMAGE_BANDS) + f"""
    from image cross join (select min(least({FILLED})) as low, max(greatest({FILLED})) as high from image) r""", "image"))
def _(t):
    scaled = composites.minmax_scale(t.image, IMAGE_BANDS)
    return scaled.select("x", "y", *[F.round(b, 9).alias(b) for b in IMAGE_BANDS])


@query("r15_band_select", sql("""
    select x, y, 'natural' as kind, red_median_dry as red, green_median_dry as green, blue_median_dry as blue from image
    union all select x, y, 'infrared', swir1_median_wet, nir_median_wet, blue_median_wet from image
    union all select x, y, 'ndvi', ndvi_amp, ndvi_amp, ndvi_amp from image""", "image"))
def _(t):
    natural = composites.composite_bands(t.image, "natural", "dry")
    infrared = composites.composite_bands(t.image, "infrared", "wet")
    ndvi = composites.composite_bands(t.image, "ndvi", "dry")
    ndvi = ndvi.select("x", "y", *[F.col("ndvi_amp").alias(c) for c in ("red", "green", "blue")])
    tagged = [df.withColumn("kind", F.lit(k)) for k, df in (("natural", natural), ("infrared", infrared), ("ndvi", ndvi))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
