"""Suffix-array and substring dedup against a brute-force search, and their parts against plain definitions."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import substring_dedup, suffix_dedup
from tidemark.llm.common import word_hashes, words

L = 50
SCHEMA = "doc_id long, text string, h string, pos int"
OPERATORS = [suffix_dedup.repeated_passages, substring_dedup.repeated_passages]


def brute(rows):
    places, texts = defaultdict(set), {}
    for i, t, *_ in rows:
        if i is None or t is None:
            continue
        w = [x for x in re.split("[\t-\r\x1c- ]+", t) if x]
        texts[i] = w
        for j in range(len(w) - L + 1):
            places[tuple(w[j : j + L])].add((i, j))
    covered = defaultdict(set)
    for p in places.values():
        if len(p) > 1:
            for i, j in p:
                covered[i] |= set(range(j, j + L))
    return covered, texts


def found(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.doc_id] |= set(range(r.start_word, r.end_word))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["the"] * 40 + ["é", "naïve", "a b"]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    shared = [text(n) for n in (49, 50, 51, 80, 200)]
    rows = [(i, " ".join([text(rng.randrange(0, 120)), rng.choice([*shared, ""]), text(rng.randrange(0, 90)), rng.choice([*shared, ""])])) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "same " * 130), (103, "same " * 70), (104, "a b " * 80)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (None, rows[5][1]), (203, "one"), (7, rows[7][1])]
    rows += [(300 + k, " ".join(w if rng.random() > 0.03 else "edit" for w in rows[11][1].split())) for k in range(5)]
    return [(i, t, "clash", 1) for i, t in rows]


@pytest.mark.parametrize("operator", OPERATORS)
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, operator, seed):
    rows = corpus(seed)
    out = operator(spark.createDataFrame(rows, SCHEMA)).collect()
    covered, texts = brute(rows)
    assert found(out) == covered
    # each repeated passage has one first occurrence, and the others are in spans that go
    gone, kept = found([r for r in out if not r.keep]), found([r for r in out if r.keep])
    places = defaultdict(list)
    for i in sorted(texts):
        for j in range(len(texts[i]) - L + 1):
            places[tuple(texts[i][j : j + L])].append((i, set(range(j, j + L))))
    for (i, span), *others in (p for p in places.values() if len(p) > 1):
        assert span <= kept[i] and all(s <= gone[k] or s <= kept[k] | gone[k] for k, s in others)
    firsts = [r for r in out if r.keep]
    assert firsts and all(r.end_word - r.start_word >= L for r in out)


@pytest.mark.parametrize("operator", OPERATORS)
def test_empty_and_tables(spark, operator, sf):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(operator(docs).collect()) == brute([(r.doc_id, r.text) for r in docs.collect()])[0]


def test_both_give_the_same_spans(spark):
    docs = spark.createDataFrame(corpus(5), SCHEMA)
    a, b = (sorted(map(tuple, f(docs).collect())) for f in OPERATORS)
    assert a == b


def test_cover_meets_every_shift():
    p, d = substring_dedup.PERIOD, set(substring_dedup.COVER)
    assert all(any((i + s) % p in d and (j + s) % p in d for s in range(p)) for i in range(p) for j in range(p))


def test_long_text(spark):
    rng = random.Random(3)
    long = " ".join(f"t{rng.randrange(10**6)}" for _ in range(300_000))
    part = " ".join(long.split(" ")[200_000:200_060])
    out = [suffix_dedup.repeated_passages, substring_dedup.repeated_passages]
    for f in out:
        rows = f(spark.createDataFrame([(1, long), (2, "x " + part)], "doc_id long, text string")).collect()
        assert {(r.doc_id, r.start_word, r.end_word) for r in rows} == {(1, 200_000, 200_060), (2, 1, 61)}


def test_corpus_order_is_lexicographic():
    rng = np.random.default_rng(4)
    for alphabet in (2, 5, 1000):
        sizes = rng.integers(5, 120, 30)
        first = np.concatenate([[0], np.cumsum(sizes)])
        text = rng.integers(0, alphabet, first[-1]).astype(np.uint32)
        text[first[3] : first[4]] = text[first[3]]
        of = np.repeat(np.arange(30), sizes)
        wanted = np.flatnonzero(np.arange(len(text)) + suffix_dedup.TRIGGER < first[of + 1])
        order = suffix_dedup.corpus_order(text, first, wanted)
        suffix = [tuple(text[p : first[of[p] + 1]]) for p in order]
        assert suffix == sorted(suffix) and sorted(order) == list(wanted)


def test_every_window_is_named_alike():
    rng = random.Random(8)
    for vocab in (2, 30, 5000):
        passage = [f"q{rng.randrange(vocab)}" for _ in range(L)]
        seen = set()
        for _ in range(20):
            w = [f"q{rng.randrange(vocab)}" for _ in range(rng.randrange(90))]
            data = np.frombuffer(" ".join(w + passage + w[::-1]).encode(), np.uint8)
            start, end, first = words(data, np.array([0, len(data)]))
            win, _, pos, at, h = suffix_dedup.names(word_hashes(data, start, end), first)
            k = int(np.flatnonzero(pos == len(w))[0])
            seen.add((int(h[k]), int(at[k] - pos[k])))
        assert len(seen) == 1


def test_scripts_without_spaces(spark):
    rng = random.Random(6)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    shared = han(60)
    rows = [(1, han(30) + shared + han(10)), (2, "abc " + han(5) + " " + shared), (3, "ไทย" + han(80)), (4, "\U00020001" * 3 + han(70))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for f in OPERATORS:
        assert {(r.doc_id, r.start_word, r.end_word) for r in f(docs).collect()} == {(1, 30, 90), (2, 6, 66)}
    data = np.frombuffer("a中b ทค\U00020001x é中".encode(), np.uint8)
    start, end, _ = words(data, np.array([0, len(data)]), lone=True)
    assert [data[a:b].tobytes().decode() for a, b in zip(start, end)] == ["a", "中", "b", "ท", "ค", "\U00020001", "x", "é", "中"]
