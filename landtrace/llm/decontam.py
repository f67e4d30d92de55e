"""Benchmark passages in documents, found by a prefix-filtered set join.

An item is cut into windows of ``WINDOW`` words (a shorter item is one window), a window into
shingles of five words. A first pass over the corpus keeps the places of shingles that any
window has, which also gives each shingle's frequency. Shingles are ordered by rarity, and only
a window's rarest one - the necessary prefix of a containment of one - is joined: its place
says where the window would have to start, and starts that don't fit into the document fall
away. The words at the remaining starts are then compared with the window's own.

Words are what lies between ASCII non-alphanumerics after lower-casing A-Z. NULL and empty texts
have none. Items that repeat a text share its windows, each counts; repeated item ids count once;
an item without id marks words but is not listed. Repeated document rows come out alike. Other
columns are not read. Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landtrace.llm.common import ascii_lower, keyed, let, outer_id, packed, settle

WINDOW = 10
SHINGLE = 5
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["_id", "_v"]
#: Shingle keys are 20 bytes each: up to this number they are sent to every executor.
MOST_BROADCAST = 500_000


def plain_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), NOT_WORD), lambda w: w != "")


def _slices(words: Column, n: int) -> Column:
    """Runs of ``n`` words, from each place on."""
    return F.when(F.size(words) >= n, F.transform(
        F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.slice(words, i, n)))


def _windows(items: DataFrame, item_id: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(wid, words, n) for each different window, and (wid, item)."""
    rows = items.select(
        F.col(item_id).cast("string").alias("_item"),
        plain_words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_w"))
    n = F.size("_w")
    pieces = F.when(n >= window, let(F.col("_w"), lambda w: _slices(w, window))).when(n > 0, F.array("_w"))
    rows = settle(rows.select("_item", F.explode(pieces).alias("_words")).select(
        "_item", "_words", F.xxhash64("_words").alias("_wid")).distinct())
    different = rows.select("_wid", "_words", F.size("_words").alias("_n")).distinct()
    return different, rows.select("_wid", "_words", "_item")


def _window_shingles(windows: DataFrame) -> DataFrame:
    """(wid, n, off, s, h): the shingles of each window."""
    size = F.least(F.col("_n"), F.lit(SHINGLE))
    at = F.explode(F.sequence(F.lit(0), F.col("_n") - size))
    return windows.select("_wid", "_words", "_n", size.alias("_s"), at.alias("_off")).select(
        "_wid", "_words", "_n", "_s", "_off", F.xxhash64(F.expr("slice(_words, _off + 1, _s)")).alias("_h"))


def _matches(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Places in documents of the shingles in ``keys`` (s, h)."""
    few = keys.count() <= MOST_BROADCAST
    found = None
    for (s,) in sorted(keys.select("_s").distinct().collect()):  # five values at most
        own = keys.filter(F.col("_s") == s).select("_h")
        rows = keyed(docs, id_col, text_col).select(*KEY, let(plain_words(F.col("_text")), lambda w: F.when(
            F.size(w) >= s, F.transform(
                F.sequence(F.lit(1), F.size(w) - s + 1), lambda i: F.xxhash64(F.slice(w, i, s))))).alias("_hs"))
        rows = rows.select(*KEY, F.size("_hs").alias("_n_hs"), "_hs").select(
            *KEY, "_n_hs", F.posexplode("_hs").alias("_pos", "_h"))
        rows = rows.join(F.broadcast(own) if few else own, "_h").select(
            *KEY, (F.col("_n_hs") + s - 1).alias("_n_words"), "_pos", F.lit(s).alias("_s"), "_h")
        found = rows if found is None else found.unionByName(rows)
    return found


def _hits(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """(id, v, start, n, wid): every occurrence of every window."""
    shingles = settle(_window_shingles(windows))
    keys = settle(shingles.select("_s", "_h").distinct())
    found = _matches(docs, keys, id_col, text_col)
    if found is None:
        return None
    found = settle(found)
    rarity = found.groupBy("_s", "_h").agg(F.count("*").alias("_df"))
    ranked = shingles.join(rarity, ["_s", "_h"], "left").select(
        "_wid", "_words", "_n", F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "_s", "_h", "_off").alias("_rank"))
    prefix = ranked.groupBy("_wid", "_words", "_n").agg(F.min("_rank").alias("_rank")).filter("_rank.df > 0").select(
        "_wid", "_words", "_n", F.col("_rank._s").alias("_s"), F.col("_rank._h").alias("_h"), F.col("_rank._off").alias("_off"))
    prefix = settle(prefix)
    starts = found.join(prefix.select("_n", "_s", "_h", "_off").distinct(), ["_s", "_h"]).withColumn(
        "_start", F.col("_pos") - F.col("_off")).filter("_start >= 0 and _start + _n <= _n_words")
    wanted = starts.groupBy(*KEY).agg(F.collect_set(F.struct("_start", "_n")).alias("_at"))
    texts = keyed(docs, id_col, text_col).join(wanted, KEY).select(*KEY, "_at", plain_words(F.col("_text")).alias("_w"))
    words = F.col("_w")
    there = texts.select(*KEY, F.explode(F.transform("_at", lambda a: F.struct(
        a["_start"].alias("start"), a["_n"].alias("n"), F.slice(words, a["_start"] + 1, a["_n"]).alias("words")
    ))).alias("_a")).select(
        *KEY, F.col("_a.start").alias("_start"), F.col("_a.n").alias("_n"), F.col("_a.words").alias("_words"))
    there = there.withColumn("_wid", F.xxhash64("_words"))
    return there.join(windows.select("_wid", "_words"), ["_wid", "_words"]).select(*KEY, "_start", "_n", "_wid", "_words")


def _covered(spans: Column) -> Column:
    """Words below the spans (start, n), overlaps once."""
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, x: Column) -> Column:
        end = (x["start"] + x["n"]).cast("long")
        new = F.greatest(F.lit(0).cast("long"), end - F.greatest(x["start"].cast("long"), acc["upto"]))
        return F.struct(F.greatest(acc["upto"], end).alias("upto"), (acc["n"] + new).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, add)["n"]


def _per_document(docs, items, id_col, text_col, item_id, item_text, window) -> DataFrame:
    """(id, v, n_hit, items) of the documents with hits."""
    windows, owners = _windows(items, item_id, item_text, window)
    hits = _hits(docs, settle(windows), id_col, text_col)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "_id long, _v long, n_hit long, _items array<string>")
    hits = settle(hits)
    hit = hits.select(*KEY, "_start", "_n").distinct().groupBy(*KEY).agg(
        _covered(F.collect_list(F.struct(F.col("_start").alias("start"), F.col("_n").alias("n")))).alias("n_hit"))
    named = hits.select(*KEY, "_wid", "_words").distinct().join(owners, ["_wid", "_words"]).select(
        *KEY, "_item").distinct().groupBy(*KEY).agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    return hit.join(named, KEY, "left")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """One row per document: its words, the words hit, and the items found in it."""
    per = _per_document(docs, items, id_col, text_col, item_id, item_text, window)
    rows = keyed(docs, id_col, text_col).select(*KEY, F.size(plain_words(F.col("_text"))).cast("long").alias("n_words"))
    found = F.coalesce("_items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(per, KEY, "left").select(
        outer_id().alias(id_col), "n_words", hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"),
        found.alias("items"), (hit > 0).alias("contaminated"))


def keep_clean(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window occurs."""
    per = _per_document(docs, items, id_col, text_col, item_id, item_text, window).select(*KEY)
    return packed(docs, id_col, text_col).join(per, KEY, "left_anti").select("_row.*")
