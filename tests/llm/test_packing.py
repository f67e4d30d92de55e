from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fixtures import documents, empty, sample
from landtrace.llm.packing import best_fit_decreasing, pack
from landtrace.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
WORDS = WordTokenizer(PATH, most_words=50)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([
    "don't", "'S", "I'LL", "<|endoftext|>", "<|startoftext|>x", "a<|b", "ÀÉ", "ß", "Σ", "İx", " ", "\x1f", "\x85", "é", " ",
    "x́ ́y", "</w>", "12ab3", "日本", "🙂", "²", "ª", "µ", "×÷", "!!", "\t\n"])), max_size=8))
def test_cached_words_give_the_whole_texts_ids(parts):
    for text in ("".join(parts), " ".join(parts)):
        assert np.frombuffer(WORDS([text])[0], "<u4").tolist() == ids_of(text)


def test_best_fit_against_a_plain_search():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([7, 8, 100, 4096])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        sequence, offset = best_fit_decreasing(lengths, capacity)
        room: list[int] = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [r for r in room if r >= lengths[i]]
            got = capacity - offset[i]
            assert got == (min(fits) if fits else capacity)
            if fits:
                room.remove(got)
            room.append(got - lengths[i])
        ends = defaultdict(int)
        for s, o, n in sorted(zip(sequence, offset, lengths)):
            assert ends[s] == o
            ends[s] = o + n


def check(docs, rows, capacity):
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r["doc_id"]].append([*ids_of(r["text"]), 2])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for key, pieces in by_doc.items():
        want = sorted(
            (a, len(ids[a:a + capacity]), zlib.crc32(np.array(ids[a:a + capacity], "<u4").tobytes()), len(ids))
            for ids in texts[key] for a in range(0, len(ids), capacity))
        assert sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces) == want
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return sum(r["length"] for r in rows) / (capacity * len(by_sequence))


def test_every_id_in_one_piece(spark, sf_dir):
    docs = sample(spark, sf_dir)
    assert check(docs, pack(docs, PATH).collect(), 4096) > 0.97
    odd = documents(spark)
    check(odd, pack(odd, PATH, group=5).collect(), 4096)
    check(odd, pack(odd, PATH, capacity=100, group=7).collect(), 100)
    assert pack(empty(spark), PATH).count() == 0


def test_ids_on_request(spark):
    docs = documents(spark, [(1, "some words " * 40)])
    rows = pack(docs, PATH, capacity=32, keep_ids=True).orderBy("start").collect()
    assert [x for r in rows for x in r["ids"]] == [*ids_of("some words " * 40), 2]


def test_rows_without_id_and_equal_rows_are_dealt(spark):
    """Neither a NULL id of different texts nor one row many times fills a group."""
    words = [f"word {k} of its text" for k in range(600)]
    for texts in ([(None, w) for w in words], [(7, "the same row")] * 600):
        rows = pack(documents(spark, texts), PATH, group=20).collect()
        groups, room = defaultdict(int), defaultdict(int)
        for r in rows:
            groups[r["sequence_id"] >> 32] += 1
            room[r["sequence_id"]] += r["length"]
        assert len(rows) == 600 and len(groups) > 20 and max(groups.values()) <= 60
        assert max(room.values()) <= 4096
