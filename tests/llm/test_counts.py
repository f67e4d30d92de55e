from __future__ import annotations

import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fixtures import documents, empty, pairs, sample
from landtrace.llm.common import shared_folder
from landtrace.llm.counts import TokenLedger, copies, token_counts
from landtrace.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
CHANGES = "_id long, tokenizer string, op string, source string, lang string, n_tokens long, seq int"


def totals(ledger):
    return {tuple(r)[:3]: tuple(r)[3:] for r in ledger.totals().collect()}


def test_random_batches_against_a_dictionary(spark):
    rng = random.Random(3)
    ledger = TokenLedger(spark, shared_folder(spark, "test-ledger"))
    state = {}
    for batch in (1, 2, 3, 5):
        rows, best = [], {}
        for _ in range(60):
            c = (rng.choice([None, *range(15)]), rng.choice(["t1", "t2"]), rng.choice(["insert", "delete", "revise"]),
                 rng.choice([None, "a", "b"]), rng.choice([None, "en"]), rng.choice([None, 5, 9]), len(rows))
            rows.append(c)
            best[c[:2]] = c
        rows.append(rows[-1])  # a repeated change
        changes = spark.createDataFrame(rows, CHANGES)
        for key, c in best.items():
            state.pop(key, None)
            if c[2] != "delete":
                state[key] = (c[3], c[4], c[1], c[5] or 0)
        assert ledger.commit(batch, changes) is True
        want = {}
        for s, l, t, n in state.values():
            d, k = want.get((s, l, t), (0, 0))
            want[s, l, t] = (d + 1, k + n)
        assert totals(ledger) == want
        assert ledger.commit(batch, changes) is False and totals(ledger) == want
    with pytest.raises(ValueError):
        ledger.commit(4, changes)


def test_a_batch_that_broke_off_is_written_anew(spark):
    ledger = TokenLedger(spark, shared_folder(spark, "test-broken"))
    changes = spark.createDataFrame([(1, "t", "insert", "a", "en", 4, 0)], CHANGES)
    changes.select("_id").write.parquet(f"{ledger.folder}/events/batch=1")  # no deltas followed
    assert ledger.committed() == [] and ledger.commit(1, changes)
    assert totals(ledger) == {("a", "en", "t"): (1, 4)}
    assert ledger.commit(2, spark.createDataFrame([], CHANGES)) and totals(ledger) == {("a", "en", "t"): (1, 4)}


def test_counts_of_odd_texts(spark):
    whole = Tokenizer.from_file(PATH)
    docs = documents(spark)
    got = Counter((r["_id"], r["n_tokens"]) for r in token_counts(docs, PATH).collect())
    want = Counter((-(1 << 63) if i is None else i, len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in pairs(docs))
    assert got == want
    assert token_counts(empty(spark), PATH).count() == 0
    assert {r["_id"] for r in copies(token_counts(docs, PATH)).collect()} >= {8, 13}


def test_query_against_plain_sums(spark, sf_dir):
    whole = Tokenizer.from_file(PATH)
    rows = sample(spark, sf_dir).orderBy("doc_id").collect()
    seen, want = set(), {}

    def add(batch, r, n):
        key = (batch, r["source"], r["lang"], "word_bpe_49k")
        d, k = want.get(key, (0, 0))
        want[key] = (d + 1, k + n)

    for r in rows:
        n = len(whole.encode(r["text"], add_special_tokens=False).ids)
        add(1, r, n)
        if r["text"] not in seen:
            seen.add(r["text"])
            add(2, r, n + 1)
    got = {tuple(r)[:4]: tuple(r)[4:] for r in QUERIES["op6_token_counts"](spark, sf_dir).collect()}
    assert got == want


def test_shared_ids_count_each_text(spark):
    whole = Tokenizer.from_file(PATH)
    texts = [(None, f"text {i % 400} without an id") for i in range(500)] + [(5, "one"), (5, "another two"), (5, "one"), (6, "one")]
    counted = token_counts(documents(spark, texts), PATH)
    assert {r["_id"]: r["_part"] for r in counted.collect()}[6] == 0
    ledger = TokenLedger(spark, shared_folder(spark, "test-shared"))
    ledger.commit(1, counted.withColumns({"tokenizer": F.lit("t"), "op": F.lit("insert"), "seq": F.lit(0)}))
    sums = [sum(x) for x in zip(*totals(ledger).values())]
    assert sums == [403, sum(len(whole.encode(t, add_special_tokens=False).ids) for _, t in set(texts))]


def test_a_commit_reads_the_last_standing_only(spark, monkeypatch):
    ledger = TokenLedger(spark, shared_folder(spark, "test-standing"))
    for b in range(1, 5):
        read = []
        plain = TokenLedger._read
        monkeypatch.setattr(ledger, "_read", lambda kind, schema, batches: read.append((kind, batches)) or plain(ledger, kind, schema, batches))
        ledger.commit(b, spark.createDataFrame([(b, "t", "insert", "a", "en", 4, 0), (1, "t", "revise", "a", "en", b, 0)], CHANGES))
        assert read == [("events", [b]), ("standing", [b - 1] if b > 1 else [])]
    got = {r["batch"]: (r["n_docs"], r["n_tokens"]) for r in ledger.history().collect()}
    assert got[4] == (4, 4 + 12) and got[2] == (2, 2 + 4) and totals(ledger) == {("a", "en", "t"): got[4]}
