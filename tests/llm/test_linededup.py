from __future__ import annotations

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from fixtures import LINES, documents, empty, order
from landtrace.llm import linededup
from landtrace.llm.linededup import dedup_lines, line_report

BLANKS = " \t\n\x0b\x0c\r"


def units_of(text):
    """Lines with words, each with the blank lines behind it."""
    units, ahead = [], []
    for x in text.split("\n"):
        if x.strip(BLANKS):
            units.append([*ahead, x])
            ahead = []
        elif units:
            units[-1].append(x)
        else:
            ahead.append(x)
    return units


def chunks(words):
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in words]
    for k in range(len(words) - 1):
        e = k + 1
        while e < len(words) - 1 and e < k + 7 and (h[e] + 31 * h[e - 1]) % 4 == 0:
            e += 1
        yield k, e


def brute(rows):
    first, out = {}, Counter()
    for i, text, v in sorted(rows, key=lambda r: (order(r), r[2])):
        if text is None:
            out[(i, 0, 0, None)] += 1
            continue
        units = units_of(text)
        words = [next(x for x in u if x.strip(BLANKS)) for u in units]
        gone = set()
        for k, e in chunks(words):
            if first.setdefault(tuple(words[k:e + 1]), (i, v, k)) != (i, v, k):
                gone.update(range(k, e + 1))
        kept = [x for k, u in enumerate(units) if k not in gone for x in u]
        n = len(text.split("\n"))
        out[(i, n, n - len(kept) if gone else 0, "\n".join(kept) if gone else text)] += 1
    return out


def rows_of(docs):
    return [tuple(r) for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as v").collect()]


BLANK_LINES = [
    (30, f"\n \n{LINES}\n\n"), (31, f"alone\n\n{LINES}\n \t\n\nafter"), (32, "same\n" * 40), (33, "same\n" * 3 + "other"),
    (34, "a\nb\na\nb\na\nb"), (35, "\n\n\n"), (36, "alone"), (37, "alone"),
]


def test_against_plain_chunks(spark):
    docs = documents(spark).unionByName(documents(spark, BLANK_LINES))
    got = Counter(map(tuple, line_report(docs).collect()))
    assert got == brute(rows_of(docs))
    assert sum(n * k[2] for k, n in got.items()) > 0


def test_shared_hashes_are_settled_by_the_text(spark, monkeypatch):
    docs = documents(spark).unionByName(documents(spark, BLANK_LINES))
    want = brute(rows_of(docs))
    weak = lambda x: F.pmod(F.xxhash64(x), F.lit(5))
    monkeypatch.setattr(linededup, "_hashes", lambda lines: (weak(lines), F.lit(0).cast("long")))
    assert Counter(map(tuple, line_report(docs).collect())) == want
    monkeypatch.undo()
    monkeypatch.setattr(linededup, "_line_hash", weak)
    assert Counter(map(tuple, line_report(docs).collect())) == want


def test_copies_and_passages(spark):
    """Held against what was planted, not against chunks."""
    rng = random.Random(7)
    serial = iter(range(10**6))

    def lines(n):
        return [" ".join(rng.choices(["river", "stone", "cloud", "grass", "light"], k=6)) + f" {next(serial)}" for _ in range(n)]

    texts, passages, copies, clean = [], {}, [], {}
    for i in range(200):
        body = lines(4)
        for doc in (1000 + i, 3000 + i):
            text = lines(rng.randrange(1, 6)) + body + lines(rng.randrange(1, 6))
            texts.append((doc, "\n".join(text)))
        passages[3000 + i] = (body, [x for x in text if x not in body])
    for i in range(60):
        whole = "\n".join(lines(rng.randrange(2, 9)))
        texts += [(5000 + i, whole), (6000 + i, whole)]
        copies.append(6000 + i)
    for i in range(60):
        clean[8000 + i] = "\n".join(lines(rng.randrange(1, 9)))
    texts += clean.items()
    before = dict(texts)
    after = {r["doc_id"]: r["text"] for r in line_report(documents(spark, texts)).collect()}
    assert all(after[i] == "" for i in copies) and all(after[i] == t for i, t in clean.items())
    assert all(after[i] == before[i] for i in before if i < 3000 or 5000 <= i < 6000)
    hit = sum(any(x not in after[i].split("\n") for x in body) for i, (body, _) in passages.items())
    gone = sum(x not in after[i].split("\n") for i, (body, _) in passages.items() for x in body)
    assert hit >= 0.95 * len(passages) and gone >= 0.85 * 4 * len(passages)
    assert all(set(rest) <= set(after[i].split("\n")) for i, (_, rest) in passages.items())


def test_inserted_line_moves_few_boundaries(spark):
    rng = random.Random(1)
    lines = [" ".join(rng.choices("abcdefgh", k=6)) + str(i) for i in range(200)]
    texts = [(1, "\n".join(lines)), (2, "\n".join(lines[:90] + ["something new"] + lines[90:]))]
    removed = {r["doc_id"]: r["n_removed_lines"] for r in line_report(documents(spark, texts)).collect()}
    assert removed[1] == 0 and removed[2] > 190


def test_a_long_text(spark):
    """Tens of thousands of lines in one row, all of which stand elsewhere."""
    text = "\n".join(f"line {i} of a long text" for i in range(40_000))
    rows = {r["doc_id"]: r for r in line_report(documents(spark, [(1, text), (2, text + "\nend")])).collect()}
    assert rows[1]["n_removed_lines"] == 0 and rows[2]["n_removed_lines"] >= 39_999


def test_columns_stay(spark):
    docs = documents(spark)
    out = dedup_lines(docs, length_col="n_chars")
    assert out.schema.names == docs.schema.names and dict(out.dtypes) == dict(docs.dtypes)
    rows = {r["doc_id"]: r for r in out.collect() if r["doc_id"] in (11, 13)}
    assert rows[11]["text"] == LINES and rows[13]["text"] == ""
    assert rows[13]["n_chars"] == len(rows[13]["text"]) and rows[13]["_row"] == "x"
    assert dedup_lines(empty(spark)).count() == 0
