from __future__ import annotations

import random
from collections import Counter

import numpy as np

from fixtures import documents, empty, order
from landtrace.llm.chunkdedup import LONGEST, chunk_ends, dedup_passages, passages


def brute(rows):
    first, out = {}, Counter()
    for i, text, v in sorted(rows, key=lambda r: (order(r), r[2])):
        raw = (text or "").encode()
        ends = chunk_ends(np.frombuffer(raw, np.uint8))
        again = [(a, b - a) for a, b in zip([0, *ends], ends) if first.setdefault(raw[a:b], (i, v, a)) != (i, v, a)]
        spans = passages([a for a, _ in again], [n for _, n in again])
        kept = bytes(c for k, c in enumerate(raw) if not any(a <= k < b for a, b in spans)).decode()
        out[(i, len(raw), sum(b - a for a, b in spans), len(spans), kept)] += 1
    return out


def result(docs):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["text"]) for r in dedup_passages(docs).collect())


def rows_of(docs):
    return [tuple(r) for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as v").collect()]


def test_against_plain_chunks(spark):
    docs = documents(spark)
    assert result(docs) == brute(rows_of(docs))
    assert dedup_passages(empty(spark)).count() == 0


def test_chunks_follow_content():
    rng = random.Random(1)
    raw = "".join(rng.choices("abcdé fghi", k=20_000)).encode()
    ends = chunk_ends(np.frombuffer(raw, np.uint8))
    assert ends[-1] == len(raw) and all(0 < b - a <= LONGEST for a, b in zip([0, *ends], ends))
    assert all(raw[a:b].decode() for a, b in zip([0, *ends], ends))
    moved = chunk_ends(np.frombuffer(b"inserted " + raw, np.uint8))
    assert len({raw[a:b] for a, b in zip([0, *ends], ends)} - {(b"inserted " + raw)[a:b] for a, b in zip([0, *moved], moved)}) < 5
    assert chunk_ends(np.frombuffer(b"\xc3\xa9" * 3000, np.uint8))[-1] == 6000


def test_planted_passages(spark):
    rng = random.Random(7)

    def prose(n):
        return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))

    planted = [prose(60) for _ in range(10)]
    texts = [(i, prose(100) + " " + planted[i % 10] + " " + prose(80)) for i in range(60)]
    clean = [(100 + i, prose(200)) for i in range(40)]
    rows = {r["doc_id"]: r for r in dedup_passages(documents(spark, texts + clean)).collect()}
    assert all(rows[i]["n_removed"] == 0 for i in [*range(10), *range(100, 140)])
    for i in range(10, 60):
        assert rows[i]["n_removed"] > 0.5 * len(planted[i % 10])
        assert rows[i]["n_removed"] <= len(planted[i % 10]) + 2


def test_short_copies_go_as_a_whole(spark):
    short = "a short text, é"
    texts = [(1, short), (2, short), (3, short), (4, f"{short} and more"), (5, "x" * 99), (6, "x" * 99), (7, ""), (None, "z" * 20), (8, "z" * 20)]
    rows = {r["doc_id"]: (r["n_removed"], r["text"]) for r in dedup_passages(documents(spark, texts)).collect()}
    n = len(short.encode())
    assert rows == {1: (0, short), 2: (n, ""), 3: (n, ""), 4: (0, f"{short} and more"), 5: (0, "x" * 99), 6: (99, ""), 7: (0, ""),
                    None: (0, "z" * 20), 8: (20, "")}


def test_a_passage_of_one_hundred_bytes_goes(spark):
    rng = random.Random(3)
    ends, raw = [], ""
    while not any(100 <= b - a < 150 for k, a in enumerate(ends) for b in ends[k + 1:]):
        raw = "".join(rng.choices("abcdefghij ", k=260))
        ends = chunk_ends(np.frombuffer(raw.encode(), np.uint8))[:-1]
    a, b = next((a, b) for k, a in enumerate(ends) for b in ends[k + 1:] if 100 <= b - a < 150)
    texts = [(1, raw), (2, "Q" * 300 + raw[a - 16:b] + "R" * 40)]
    rows = {r["doc_id"]: r["n_removed"] for r in dedup_passages(documents(spark, texts)).collect()}
    assert rows[1] == 0 and b - a <= rows[2] < 150
