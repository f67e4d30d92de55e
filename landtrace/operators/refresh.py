"""Conversion cycles from mergeable summaries: new years are added to a stored state, old ones aren't read again.

The summary of a stretch of a cell's years holds its first and last mark (natural or anthropic), one piece per
cycle (last natural year, first agriculture year and its class), and the years since the last natural one while no agriculture followed.
Two stretches combine by their ends: the later one opens a new cycle if it begins natural and the earlier one ended
anthropic, else its first piece goes on with the earlier one's last. Combining is associative, so stretches may be summarised
where they are stored and merged in any grouping. A summary has at most a piece for two years and an entry for each year.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landtrace.functions.values import in_codes
from landtrace.operators.cycles import CELL, LENGTH_COLUMNS, band_join
from landtrace.spec import ConversionSpec

PIECE = "struct<forest:int,agri:int,code:int>"
STATE = f"struct<first_mark:string,last_mark:string,pieces:array<{PIECE}>,pending:array<struct<year:int,class_code:int>>>"
FIELDS = ["first_year", "last_year", "first_mark", "last_mark", "pieces", "pending"]


def _nothing() -> Column:
    """The state of no year: combining with it changes nothing."""
    none = F.lit(None)
    piece = F.struct(none.alias("forest"), none.alias("agri"), none.alias("code"))
    return F.struct(none.alias("first_mark"), none.alias("last_mark"), F.array(piece).alias("pieces"), F.array().alias("pending")).cast(STATE)


def _of_year(v: Column, spec: ConversionSpec) -> Column:
    year, code = v["year"], v["class_code"]
    natural, agriculture = in_codes(code, spec.natural), in_codes(code, spec.agriculture)
    mark = F.when(natural, "n").when(in_codes(code, spec.anthropic), "a")
    piece = F.struct(F.when(natural, year).alias("forest"), F.when(agriculture, year).alias("agri"), F.when(agriculture, code).alias("code"))
    waits = F.when(natural | agriculture, F.array()).otherwise(F.array(F.struct(year.alias("year"), code.alias("class_code"))))
    return F.struct(mark.alias("first_mark"), mark.alias("last_mark"), F.array(piece).alias("pieces"), waits.alias("pending")).cast(STATE)


def combine(s: Column, t: Column) -> Column:
    """The state of two stretches of years, ``s`` before ``t``."""
    opens = F.coalesce((t["first_mark"] == "n") & (s["last_mark"] == "a"), F.lit(False))
    before, after = F.element_at(s["pieces"], -1), F.element_at(t["pieces"], 1)
    both = F.struct(
        F.coalesce(after["forest"], before["forest"]).alias("forest"), F.coalesce(before["agri"], after["agri"]).alias("agri"),
        F.coalesce(before["code"], after["code"]).alias("code"))
    n, m = F.size(s["pieces"]), F.size(t["pieces"])
    joined = F.concat(F.slice(s["pieces"], 1, n - 1), F.array(both), F.slice(t["pieces"], 2, m))
    pieces = F.when(opens, F.concat(s["pieces"], t["pieces"])).otherwise(joined)
    waiting = F.when(opens | (m > 1) | after["forest"].isNotNull(), t["pending"]).when(
        both["agri"].isNotNull(), F.array()).otherwise(F.concat(s["pending"], t["pending"]))
    return F.struct(
        F.coalesce(s["first_mark"], t["first_mark"]).alias("first_mark"), F.coalesce(t["last_mark"], s["last_mark"]).alias("last_mark"),
        pieces.alias("pieces"), waiting.alias("pending")).cast(STATE)


def summarize(panel: DataFrame, spec: ConversionSpec, keys: Sequence[str] = CELL) -> DataFrame:
    """A state per cell of ``panel``, whose rows are unique by cell and year."""
    series = F.array_sort(F.collect_list(F.struct(F.col("year").cast("int").alias("year"), F.col("class_code").cast("int").alias("class_code"))))
    rows = panel.groupBy(*keys).agg(series.alias("_s"))
    state = F.aggregate("_s", _nothing(), lambda s, v: combine(s, _of_year(v, spec)))
    return rows.select(
        *keys, F.col("_s")[0]["year"].alias("first_year"), F.element_at("_s", -1)["year"].alias("last_year"), state.alias("_t")).select(
        *keys, "first_year", "last_year", "_t.*")


def merge_states(states: Sequence[DataFrame], keys: Sequence[str] = CELL) -> DataFrame:
    """One state per cell from states of separate stretches of years, in whatever order; overlapping stretches are an error."""
    rows = states[0].select(*keys, *FIELDS)
    for more in states[1:]:
        rows = rows.unionByName(more.select(*keys, *FIELDS))
    parts = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("_p"))
    apart = F.forall(F.sequence(F.lit(1), F.size("_p")), lambda i: F.coalesce(
        F.get("_p", i - 1)["last_year"] < F.get("_p", i)["first_year"], F.lit(True)))
    state = F.aggregate("_p", _nothing(), combine)
    checked = parts.filter(apart | F.assert_true(apart, F.lit("stretches of years overlap")).isNull())
    return checked.select(
        *keys, F.col("_p")[0]["first_year"].alias("first_year"), F.element_at("_p", -1)["last_year"].alias("last_year"),
        state.alias("_t")).select(*keys, "first_year", "last_year", "_t.*")


def state_cycles(states: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """The conversion table that belongs to the states."""
    each = F.transform("pieces", lambda p, i: F.struct(
        p["code"].alias("agri_code"), (p["forest"] + 1).alias("forest_year"), p["agri"].alias("agri_year"),
        (p["agri"] - p["forest"] - 1).alias("c_length"), (i + 1).alias("c_cycle"), F.when(i == 0, 1).otherwise(2).alias("forest_type")))
    whole = F.filter(each, lambda c: c["forest_year"].isNotNull() & c["agri_year"].isNotNull())
    return states.select(*keys, F.posexplode(whole).alias("_at", "c")).select(
        *keys, *[f"c.{c}" for c in LENGTH_COLUMNS], (F.col("_at") + 1).alias("agri_cycle"))


def new_classes(before: DataFrame, merged: DataFrame, new_years: DataFrame, spec: ConversionSpec, keys: Sequence[str] = CELL) -> DataFrame:
    """Rows to add to the stored follow-up classes when ``new_years`` were merged into the state ``before``.

    Years up to now come from the state: those since the last natural year, for conversions that the new years completed.
    """
    cycles = state_cycles(merged, keys)
    latest = before.filter(F.size("pending") > 0).select(*keys, F.col("last_year").alias("_last"), "pending")
    done = cycles.join(latest, list(keys)).filter(F.col("agri_year") > F.col("_last")).select(
        *keys, "agri_cycle", "forest_year", "agri_year", F.inline("pending"))
    waited = done.filter((F.col("year") > F.col("forest_year")) & (F.col("year") <= F.col("agri_year") + spec.after)).select(
        *keys, "agri_cycle", "year", "class_code")
    return waited.unionByName(band_join(new_years, cycles, spec.after, keys))
