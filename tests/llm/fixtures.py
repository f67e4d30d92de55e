"""Small tables with everything that is odd."""

from __future__ import annotations

PASSAGE = " ".join(f"passage{i} ström {i * 7}" for i in range(40))
LINES = "\n".join(f"line {i} has its own words {i * i}" for i in range(12))

TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One two  three\n\nfour\x0bfive"),
    (6, f"start of six. {PASSAGE} end of six, which differs"), (7, f"seven begins elsewhere {PASSAGE}"),
    (8, f"start of six. {PASSAGE} end of six, which differs"), (9, "ab" * 400), (10, "ba" * 300 + "q"),
    (11, LINES), (12, f"another first line\n{LINES}\nand a last one"), (13, LINES),
    (14, "word " * 5000), (15, "ñandú çé ÀÉ ŽLUŤOUČKÝ 中文 文字 İ ΣΑΣ emoji 😀😀   é \x1f x \x85 y"),
    (16, "#### $$$ <> && || %%"), (17, "0\x00\x00" * 70), (17, "0\x00\x00" * 70), (18, "same id, first text " * 9),
    (18, "same id, second text " * 9), (None, "a text without an id " * 8), (None, None), (-5, "a text without an id " * 8),
]


def documents(spark, texts=None):
    """(doc_id, text, lang, source, n_chars) and columns named like internal ones."""
    rows = [
        (i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else "src0", None if t is None else len(t),
         k, "x", k, True, "z", "w")
        for k, (i, t) in enumerate(TEXTS if texts is None else texts)
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, _id int, _row string, shard int,"
        " kept boolean, _text string, component_id string")


def empty(spark):
    return documents(spark, [])


def sample(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def order(row):
    """Documents by id, NULL first."""
    return (row[0] is not None, row[0] or 0)
