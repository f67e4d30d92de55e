"""Removal of multi-line chunks that documents repeat.

A text is cut into lines; a unit is a line with words and the blank lines behind it (blank lines at
the start belong to the first unit). A rolling hash over the hashes of two neighbouring units chooses
boundaries: three of four places are one. A chunk begins at every unit and ends at the first boundary
from its second unit on, after ``MOST`` units at the latest, or with the text. So a chunk depends on
nothing before it: lines that are inserted elsewhere move no chunk, a passage is found wherever it begins,
and a whole copy of two units or more is covered by chunks. A chunk that also stands earlier - in
a document with a smaller id, or further up in the same one - is removed, and all its units go. Chunks
are judged on the input, so of each one the first place has what no still earlier place has.

Chunks are found by a 128-bit hash of their lines with words, and removed only after the bytes were
compared: a line's hash must stand for one line only, a chunk's hash for one sequence of lines. Where
it doesn't, those chunks are compared by their whole text instead.

NULL stays NULL and an empty text stays empty; a text of which nothing is left becomes empty. Texts
with fewer than two units are left alone. Rows that repeat an id and a text count as one document and
come out alike; rows that share only the id are ordered by their text's hash. A NULL id comes first.
An empty table gives an empty result. All other columns are passed on, whatever their names. To
find chunks a row of hashes per unit is shuffled; texts move twice, by id: once to compare the bytes and once to write what
is kept. A very long text is one row; its work grows with its number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landtrace.llm.common import BLANKS, keyed, let, outer_id, packed, settle

BOUNDARY = 4  # one place in so many is no boundary
MOST = 8
KEY = ["_id", "_v"]
HASH = ["_h1", "_h2"]


def _worded(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def _ends(units: Column) -> Column:
    """For each of the lines ``units``, the last unit of the chunk that begins there."""
    hashes = F.transform(units, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))

    def boundaries(h: Column) -> Column:
        return F.transform(h, lambda x, i: (x + 31 * F.coalesce(F.get(h, i - 1), F.lit(0))) % BOUNDARY != 0)

    def first(b: Column) -> Column:
        def end(_: Column, k: Column) -> Column:
            step = F.array_position(F.slice(b, k + 2, MOST - 1), True).cast("int")
            return F.least(k + F.when(step > 0, step).otherwise(MOST - 1), F.size(b) - 1)

        return F.transform(b, end)

    return let(let(hashes, boundaries), first)


def _hashes(lines: Column) -> tuple[Column, Column]:
    return F.xxhash64(lines), F.xxhash64(F.lit(1), lines)


def _line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Hash and place of every chunk: the number of its first unit."""

    def described(units: Column) -> Column:
        def one(end: Column, k: Column) -> Column:
            return let(F.slice(units, k + 1, end - k + 1), lambda x: F.struct(
                k.cast("int").alias("no"), _hashes(x)[0].alias("h1"), _hashes(x)[1].alias("h2")))

        return let(_ends(units), lambda ends: F.slice(F.transform(ends, one), 1, F.greatest(F.size(ends) - 1, F.lit(0))))

    units = F.filter(F.split("_text", "\n"), _worded)
    rows = keyed(docs, id_col, text_col).select(*KEY, F.explode(let(units, described)).alias("_c"))
    return rows.select(*KEY, F.col("_c.no").alias("_no"), F.col("_c.h1").alias("_h1"), F.col("_c.h2").alias("_h2"))


def _wanted_chunks(docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each document of ``places`` with its units, and (no, lines) of the chunks found in it."""
    wanted = places.groupBy(*KEY).agg(F.collect_set("_no").alias("_nos"))
    nos = F.col("_nos")
    units = F.filter(F.split("_text", "\n"), _worded)
    chunks = let(units, lambda u: let(_ends(u), lambda ends: F.transform(nos, lambda no: F.struct(
        no.alias("no"), F.slice(u, no + 1, F.get(ends, no) - no + 1).alias("lines")))))
    return keyed(docs, id_col, text_col).join(wanted, KEY).select(*KEY, chunks.alias("_chunks"))


def _clashes(chunks: DataFrame) -> DataFrame:
    """(line, h1, h2): hashes of lines (``line`` true, in h1) or of chunks that stand for different ones."""
    lines = F.transform(
        F.array_distinct(F.flatten(F.transform("_chunks", lambda c: c["lines"]))),
        lambda x: F.struct(
            F.lit(True).alias("line"), _line_hash(x).alias("h1"), F.lit(0).cast("long").alias("h2"),
            x.alias("text"), F.array().cast("array<bigint>").alias("sequence")))
    sequences = F.transform("_chunks", lambda c: F.struct(
        F.lit(False).alias("line"), _hashes(c["lines"])[0].alias("h1"), _hashes(c["lines"])[1].alias("h2"),
        F.lit("").alias("text"), F.transform(c["lines"], _line_hash).alias("sequence")))
    seen = chunks.select(F.explode(F.concat(lines, sequences)).alias("_s")).select("_s.*")
    return seen.groupBy("line", "h1", "h2", "text", "sequence").agg(F.count("*").alias("n")).groupBy("line", "h1", "h2").agg(
        F.count("*").alias("n")).filter("n > 1").drop("n")


def _repeats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _v, _no) of the chunks to remove."""
    found = settle(_occurrences(docs, id_col, text_col))
    twice = found.groupBy(*HASH).agg(
        F.count("*").alias("_n"), F.min(F.struct(*KEY, "_no")).alias("_first")).filter("_n > 1").drop("_n")
    places = settle(found.join(twice, HASH).select(
        *KEY, "_no", *HASH, (F.struct(*KEY, "_no") != F.col("_first")).alias("_later")))
    chunks = _wanted_chunks(docs, places, id_col, text_col)
    clashes = settle(_clashes(chunks))
    later = places.filter("_later")
    if clashes.isEmpty():
        return later.select(*KEY, "_no")
    # chunks with such a hash, or with a line that has one, by their text
    whole = chunks.select(*KEY, F.explode("_chunks").alias("_c")).select(
        *KEY, F.col("_c.no").alias("_no"), F.col("_c.lines").alias("_lines"),
        _hashes(F.col("_c.lines"))[0].alias("_h1"), _hashes(F.col("_c.lines"))[1].alias("_h2"))
    by_line = whole.select(*HASH, F.explode(F.transform("_lines", _line_hash)).alias("h1")).join(
        clashes.filter("line").select("h1"), "h1", "left_semi").select(*HASH)
    unsure = settle(by_line.unionByName(
        clashes.filter("not line").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))).distinct())
    whole = settle(whole.join(unsure, HASH, "left_semi").drop(*HASH))
    first = whole.groupBy("_lines").agg(F.min(F.struct(*KEY, "_no")).alias("_first"))
    exact = whole.join(first, "_lines").filter(F.struct(*KEY, "_no") != F.col("_first")).select(*KEY, "_no")
    return later.join(unsure, HASH, "left_anti").select(*KEY, "_no").unionByName(exact)


def _without(lines: Column, gone: Column) -> Column:
    """(text, n): what is left of a text without the chunks that begin at the units ``gone``, and how many lines went."""

    def cut(starts: Column) -> Column:
        units = F.transform(starts, lambda i: F.get(lines, i))
        # a unit's first line; blank lines at the start belong to the first unit
        begin = F.transform(starts, lambda s, k: F.when(k == 0, F.lit(0)).otherwise(s))

        def of(ends: Column, at: Column) -> Column:
            removed = F.array_distinct(F.flatten(F.transform(gone, lambda k: F.sequence(k, F.get(ends, k)))))
            size = lambda k: F.coalesce(F.get(at, k + 1), F.size(lines)) - F.get(at, k)
            return let(removed, lambda r: F.struct(
                F.array_join(F.transform(
                    F.array_except(F.sequence(F.lit(0), F.size(at) - 1), r),
                    lambda k: F.array_join(F.slice(lines, F.get(at, k) + 1, size(k)), "\n")), "\n").alias("text"),
                F.aggregate(r, F.lit(0).cast("long"), lambda n, k: n + size(k)).alias("n")))

        return let(F.struct(let(units, _ends).alias("ends"), begin.alias("at")), lambda x: of(x["ends"], x["at"]))

    starts = F.filter(F.transform(lines, lambda x, i: F.when(_worded(x), i)), lambda i: i.isNotNull())
    return let(starts, cut)


def _cleaned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    gone = _repeats(docs, id_col, text_col).groupBy(*KEY).agg(F.collect_set("_no").alias("_gone"))
    rows = packed(docs, id_col, text_col).join(gone, KEY, "left")
    text, gone = F.col("_row")[text_col].cast("string"), F.col("_gone")
    rest = F.when(gone.isNotNull(), let(F.split(text, "\n"), lambda lines: _without(lines, gone)))
    rows = rows.select("_id", "_row", text.alias("_text"), rest.alias("_rest"))
    n_lines = F.length("_text") - F.length(F.translate("_text", "\n", "")) + 1
    return rows.select(
        "_id", "_row", F.when(F.col("_rest").isNull(), F.col("_text")).otherwise(F.col("_rest.text")).alias("_text"),
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("_n_lines"),
        F.coalesce("_rest.n", F.lit(0)).cast("long").alias("_n_removed"),
    )


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, number of lines, number of lines removed, and the text that is kept."""
    return _cleaned(docs, id_col, text_col).select(
        outer_id().alias(id_col), F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed_lines"),
        F.col("_text").alias(text_col))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
) -> DataFrame:
    """``docs`` with the text replaced, and its length in ``length_col`` if that is given."""
    rows = _cleaned(docs, id_col, text_col)
    new = {text_col: F.col("_text")}
    if length_col:
        new[length_col] = F.length("_text").cast(docs.schema[length_col].dataType)
    return rows.select(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])
