"""The same views in SQL. Conversions come from a recursive query, cycle by cycle, so
they share nothing with the window and array forms used in the library."""

from __future__ import annotations

from landtrace.spec import AGRICULTURE_CODES, ANTHROPIC_CODES, CLASS_ROWS
from suite.tables import PLOT, SEGMENTS, YEARS


def _values(rows) -> str:
    def show(v):
        return "null" if v is None else "'" + v + "'" if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows)


def codes(values) -> str:
    return "(" + ", ".join(str(v) for v in values) + ")"


ANTHROPIC = codes(ANTHROPIC_CODES)
AGRI = codes(AGRICULTURE_CODES)
_D = "cast({} as double)"


def _layer(source: str, key: str, x: str, y: str, segments) -> str:
    rows = _values([(r, *s) for r, *s in segments])
    return f"""select cast({key} as int) as poly_id, ring, {x} + a as x1, {y} + b as y1, {x} + c as x2, {y} + d as y2
      from {source} cross join (select ring, cast(a as double) a, cast(b as double) b, cast(c as double) c, cast(d as double) d
                                from (values {rows}) v(ring, a, b, c, d)) s"""


def _recursion(panel: str) -> tuple[str, str, str]:
    opened = f"""select cell_id, min(year) as start, 1 as c_cycle from {panel} group by 1
      union all
      select r.cell_id,
             (select min(f.year) from {panel} f where f.cell_id = r.cell_id and f.class_code = 3
                and f.year > (select min(a.year) from {panel} a where a.cell_id = r.cell_id
                              and a.year >= r.start and a.class_code in {ANTHROPIC})),
             r.c_cycle + 1
      from {{name}} r where r.start is not null"""
    spans = """select cell_id, start, c_cycle, lead(start) over (partition by cell_id order by c_cycle) as nxt
      from {name} where start is not null"""
    length = f"""select q.cell_id, p.class_code as agri_code, q.forest_year, q.agri_year,
             q.agri_year - q.forest_year as c_length, q.c_cycle,
             case when q.c_cycle = 1 then 1 else 2 end as forest_type,
             cast(row_number() over (partition by q.cell_id order by q.c_cycle) as int) as agri_cycle
      from (select b.cell_id, b.c_cycle, max(p.year) filter (p.class_code = 3) + 1 as forest_year,
                   min(p.year) filter (p.class_code in {AGRI}) as agri_year
            from {{name}} b join {panel} p on p.cell_id = b.cell_id and p.year >= b.start and (nxt is null or p.year < nxt)
            group by 1, 2) q
      join {panel} p on p.cell_id = q.cell_id and p.year = q.agri_year
      where q.forest_year is not null"""
    return opened, spans, length


_HAVERSINE = """2 * asin(least(1.0, sqrt(pow(sin(radians({y} - y) / 2), 2)
          + cos(radians(y)) * cos(radians({y})) * pow(sin(radians({x} - x) / 2), 2))))"""
_o, _s, _l = _recursion("panel")
_eo, _es, _el = _recursion("panel_events")

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "panel": ((), """select l_partkey as cell_id,
        cast(1985 + (year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 as int) as year,
        min(case when l_linenumber in (1, 2) then 3 when l_linenumber in (3, 4) then 15
                 when l_linenumber = 5 then 39 when l_linenumber = 6 then 48 else 33 end) as class_code
      from lineitem group by 1, 2"""),
    "panel_events": ((), """select user_id as cell_id,
        cast(1985 + date_diff('day', date '2024-01-01', cast(ts as date)) as int) as year,
        min(case event_type when 'view' then 3 when 'click' then 15 when 'purchase' then 39
                 when 'signup' then 41 else 25 end) as class_code
      from events group by 1, 2"""),
    "wide": (("panel",), "select cell_id, " + ", ".join(
        f"coalesce(min(class_code) filter (year = {y}), 0) as classification_{y}" for y in YEARS
    ) + " from panel group by 1"),
    "opened": (("panel",), _o.format(name="opened")),
    "spans": (("opened",), _s.format(name="opened")),
    "c_length": (("spans",), _l.format(name="spans")),
    "ev_opened": (("panel_events",), _eo.format(name="ev_opened")),
    "ev_spans": (("ev_opened",), _es.format(name="ev_opened")),
    "ev_length": (("ev_spans",), _el.format(name="ev_spans")),
    "c_classes": (("c_length",), """select c.cell_id, c.agri_cycle, p.year, p.class_code
      from c_length c join panel p on p.cell_id = c.cell_id and p.year > c.forest_year and p.year <= c.agri_year + 5"""),
    "mask": ((), """select p_partkey as cell_id,
        cast(((p_partkey % 50) // 10) + 5 * ((p_partkey // 50) // 10) + 1 as int) as tile_id,
        cast((9 - (p_partkey // 50) % 10) * 10 + (p_partkey % 10) + 1 as int) as tile_cell_id,
        cast(p_retailprice as decimal(18, 4)) as area, cast(p_partkey % 25 as int) as code_muni,
        cast(p_partkey % 50 as double) / 10 + cast(0.05 as double) as x,
        cast(p_partkey // 50 as double) / 10 + cast(0.05 as double) as y
      from part"""),
    "mask_wide": (("mask",), """select tile_id, tile_cell_id, x, y,
        case when cell_id % 13 = 0 then cast(0 as double) else cast(area as double) end as area from mask"""),
    "tiled": (("c_length", "mask"), "select c.*, m.tile_id from c_length c join mask m using (cell_id)"),
    "meta": (("mask",), """select tile_id, printf('%010d', tile_id) as tile_code,
        round(((tile_id - 1) % 5) * 1.0, 9) as x_min, round(((tile_id - 1) % 5) + 1.0, 9) as x_max,
        round(((tile_id - 1) // 5) * 1.0, 9) as y_min, round(((tile_id - 1) // 5) + 1.0, 9) as y_max
      from (select distinct tile_id from mask) t"""),
    "municip": ((), "select n_nationkey as code_muni, n_name as name_state from nation"),
    "classes": ((), "select * from (values " + _values(CLASS_ROWS)
                + ") v(class_name, class_code, class_type, class_color)"),
    "edges": ((), _layer("nation", "n_nationkey", _D.format("n_nationkey % 5"), _D.format("n_nationkey // 5"), SEGMENTS)),
    "plots": ((), _layer("supplier", "s_suppkey", _D.format("s_suppkey % 37") + " / 7",
                         _D.format("s_suppkey // 37") + " / 3", PLOT)),
    # every point against every polygon: crossings of the ray to the right, nearest edge
    "located": (("mask", "edges"), """select cell_id, poly_id, crossings % 2 = 1 as inside,
        case when crossings % 2 = 1 then 0 else d2 end as d2
      from (select cell_id, poly_id,
              count(*) filter ((y1 > y) <> (y2 > y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x) as crossings,
              min((x - (x1 + t * (x2 - x1))) * (x - (x1 + t * (x2 - x1)))
                  + (y - (y1 + t * (y2 - y1))) * (y - (y1 + t * (y2 - y1)))) as d2
            from (select m.cell_id, m.x, m.y, e.*,
                    greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1))
                                             / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) as t
                  from mask m cross join edges e) s
            group by 1, 2) c"""),
    "nearest": (("located",), """select cell_id, poly_id, sqrt(d2) as distance from located
      qualify row_number() over (partition by cell_id order by d2, poly_id) = 1"""),
    # great circles: haversine to the ends, the angle to the edge's plane where the foot lies between them
    "arcs": (("edges",), """select poly_id, x1, y1, x2, y2, ux, uy, uz, vx, vy, vz,
        uy * vz - uz * vy as nx, uz * vx - ux * vz as ny, ux * vy - uy * vx as nz
      from (select *, cos(radians(y1)) * cos(radians(x1)) as ux, cos(radians(y1)) * sin(radians(x1)) as uy, sin(radians(y1)) as uz,
              cos(radians(y2)) * cos(radians(x2)) as vx, cos(radians(y2)) * sin(radians(x2)) as vy, sin(radians(y2)) as vz from edges) e"""),
    "located_sphere": (("mask", "arcs", "located"), f"""select cell_id, poly_id, min(case when
          (ny * uz - nz * uy) * px + (nz * ux - nx * uz) * py + (nx * uy - ny * ux) * pz >= 0
          and (vy * nz - vz * ny) * px + (vz * nx - vx * nz) * py + (vx * ny - vy * nx) * pz >= 0
        then asin(least(1.0, abs(nx * px + ny * py + nz * pz) / sqrt(nx * nx + ny * ny + nz * nz)))
        else least({_HAVERSINE.format(x='x1', y='y1')}, {_HAVERSINE.format(x='x2', y='y2')}) end) * 6371008.8::double as metres
      from (select cell_id, x, y, cos(radians(y)) * cos(radians(x)) as px, cos(radians(y)) * sin(radians(x)) as py, sin(radians(y)) as pz
            from mask) m cross join arcs group by 1, 2"""),
    "nearest_sphere": (("located_sphere", "located"), """select cell_id, poly_id, case when inside then 0 else metres end as metres
      from located_sphere join located using (cell_id, poly_id)
      qualify row_number() over (partition by cell_id order by case when inside then 0 else metres end, poly_id) = 1"""),
    "observed": (("mask", "c_length"), """select *, agri_year - forest_year as c_length from (
        select m.cell_id as sample_id, m.cell_id,
          cast(case when m.cell_id % 11 = 0 then 0 else coalesce(forest_year, 1999) + m.cell_id % 7 - 3 end as int) as forest_year,
          cast(case when m.cell_id % 17 = 0 then 0 else coalesce(agri_year, 2003) + m.cell_id % 5 - 2 end as int) as agri_year
        from mask m left join (select * from c_length where agri_cycle = 1) c using (cell_id)) o"""),
    "clean": (("observed",), """select sample_id, cell_id, case when forest_year > 0 then forest_year end as forest_year,
        case when agri_year > 0 then agri_year end as agri_year,
        case when forest_year > 0 and agri_year > 0 then c_length end as c_length from observed"""),
    "pairs": (("clean", "c_length"), """select e.cell_id, e.agri_code, e.c_cycle, e.forest_type, e.agri_cycle,
          v.label as var, o.sample_id,
          case v.k when 1 then e.forest_year when 2 then e.agri_year else e.c_length end as estimated,
          case v.k when 1 then o.forest_year when 2 then o.agri_year else o.c_length end as observed,
          case v.k when 1 then o.forest_year - e.forest_year when 2 then o.agri_year - e.agri_year
                   else o.c_length - e.c_length end as difference
        from c_length e join clean o using (cell_id)
        cross join (values (1, 'Deforestation'), (2, 'Agriculture Establishment'), (3, 'Conversion Length')) v(k, label)"""),
    "followup": (("c_length", "c_classes"), """select c.agri_code, k.class_code, count(*) as count
      from c_length c join c_classes k using (cell_id, agri_cycle)
      where agri_cycle = 1 and k.year - c.agri_year = 5 group by 1, 2"""),
    "parts": (("followup", "classes"), """select a.class_name as agri_code, b.class_name as class_code,
        f.count / sum(f.count) over (partition by f.agri_code) * 100 as perc,
        sum(f.count) over (partition by f.agri_code) / sum(f.count) over () * 100 as total_perc
      from followup f join classes a on a.class_code = f.agri_code join classes b on b.class_code = f.class_code"""),
    "grid": (("c_length",), """select cast(cell_id // 50 as int) as row, cast(cell_id % 50 as int) as col, c_length
      from c_length where agri_cycle = 1"""),
    "scenes": ((), """select l_partkey as cell, cast(year(l_shipdate) as int) as year, l_orderkey as scene,
        l_linenumber as part, case when l_linenumber <> 4 then l_extendedprice end as nir, l_quantity as red
      from lineitem"""),
    "image": ((), "select cast(p_partkey % 50 as double) / 10 + cast(0.05 as double) as x, "
              "cast(p_partkey // 50 as double) / 10 + cast(0.05 as double) as y, " + ", ".join(
                  f"case when p_partkey % {7 + i + j} <> 0 then p_retailprice * {i + 1} + cast(p_size as double) * {j + 1} end"
                  f" as {band}_median_{season}"
                  for i, band in enumerate(("blue", "green", "red", "nir", "swir1"))
                  for j, season in enumerate(("dry", "wet"))
              ) + ", cast(p_size as double) / 50 as ndvi_amp from part"),
}


def sql(body: str, *views: str) -> str:
    """``body`` with the named views (and what they build on) in front of it."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for dep in VIEWS[name][0]:
            need(dep)
        if name not in ordered:
            ordered.append(name)

    for v in views:
        need(v)
    if not ordered:
        return body
    ctes = ",\n".join(
        f"{v} as {'' if v in ('opened', 'ev_opened') else 'materialized '}({VIEWS[v][1]})" for v in ordered
    )
    return f"with recursive {ctes}\n{body}"
