from __future__ import annotations

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import jaccard_join as jj
from factloom.llm import shingles

SMALL = "/root/testdata/sf0.01"


def word_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if 0 < len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_force(texts, num=80, den=100):
    """Row number to (set size, component as the smallest row number)."""
    sets = [word_set(t) for t in texts]
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in index[x]:
                if j < i:
                    common[j] += 1
        for j, c in common.items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def check(spark, texts, **how):
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in enumerate(texts)], "doc_id long, text string, n int, cid string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.similar_components(docs, **how).collect()}
    assert got == dict(enumerate(brute_force(texts, how.get("num", 80), how.get("den", 100))))


def families(seed, sizes, length=120, edits=12):
    """Groups of near copies with 0 to ``edits`` changed words each, so that many pairs lie around the threshold."""
    pick = random.Random(seed)
    out = []
    for size in sizes:
        base = [f"w{pick.randrange(3000)}" for _ in range(length)]
        for _ in range(size):
            copy = list(base)
            for _ in range(pick.randrange(edits)):
                copy[pick.randrange(length)] = f"x{pick.randrange(10**6)}"
            out.append(" ".join(copy))
    pick.shuffle(out)
    return out


EDGES = [None, "", " \n\t", "one", "ONE", "one two", "one two three four five", "One TWO three four five", "a b c d e f", "a b c d e f g", "É é", "é é", "x y", "a " * 400, "A " * 399, "same same same same same same"]


def test_edges_and_ties(spark):
    check(spark, EDGES + EDGES)


def test_near_copies_around_the_threshold(spark):
    check(spark, families(1, [60, 2, 3, 9, 30, 1, 1]) + EDGES)


def test_shared_passages_do_not_link(spark):
    pick = random.Random(5)
    shared = " ".join(f"s{k}" for k in range(60))
    texts = [" ".join(f"u{pick.randrange(10**6)}" for _ in range(pick.randrange(5, 200))) + " " + shared for _ in range(150)]
    check(spark, texts)


@pytest.mark.parametrize("seed", [2, 3])
def test_small_groups_frequent_blocks_and_tiles_lose_nothing(spark, monkeypatch, seed):
    # thresholds travel to the workers through the operator's own functions, so only driver-side ones are set here
    monkeypatch.setattr(jj, "TILE_ROWS", 7)
    monkeypatch.setattr(jj, "FREQUENT", 2)
    check(spark, families(seed, [80, 25, 5], length=60, edits=7) + families(seed + 9, [20], length=9, edits=3))


def test_other_similarity(spark):
    check(spark, families(4, [40, 10], length=40, edits=8), num=60, den=100)


def test_repeated_null_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "something else entirely here now"), (None, "a b c d e f g"), (None, "alone in the whole wide world"), (3, "A b c d e f g")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jj.similar_components(docs).collect())
    assert got == sorted([("1", 3, "1"), ("1", 1, "1"), ("None", 3, "1"), ("None", 2, "None"), ("3", 3, "1")])
    assert jj.similar_components(docs.limit(0)).count() == 0


def test_pigeonhole_never_misses():
    """Any similar pair offers a common key, whatever blocks count as frequent."""
    pick = np.random.default_rng(0)
    for _ in range(1500):
        n = int(pick.integers(1, 90))
        a = np.unique(pick.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[pick.random(len(a)) > pick.random() * 0.2], pick.integers(0, 2**64, int(pick.integers(0, 1 + n // 5)), dtype=np.uint64))))
        if not len(b):
            continue
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common):
            continue
        frequent = pick.integers(0, 2**64, 1 << 10, dtype=np.uint64) & pick.integers(0, 2**64, 1 << 10, dtype=np.uint64)
        assert set(jj.offered(a, 80, 100, frequent)[0].tolist()) & set(jj.offered(b, 80, 100, frequent)[0].tolist())
        assert jj.hamming(jj.folded(a), jj.folded(b)) <= len(a) + len(b) - 2 * common <= jj.max_difference(len(a), len(b), 80, 100)


def test_words_equal_the_definition(monkeypatch):
    texts = [None, "", "Aa  bB c\tÉ", "x" * 50, " lead", "trail ", "a\x0bb\x0cc\rd\ne", "ÀB àb", "a b " * 30]

    def hashes():
        return [w.tolist() for w in shingles.words_of(pa.array(texts + texts)[3:])]

    seen: dict[str, int] = {}
    for text, got in zip((texts + texts)[3:], hashes(), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        assert len(words) == len(got)
        for w, h in zip(words, got, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    whole = hashes()
    monkeypatch.setattr(shingles, "STEP", 7)
    assert hashes() == whole


def test_query_on_the_documents(spark):
    from factloom.llm import catalog

    texts = duckdb.connect().execute(f"select doc_id, text from '{SMALL}/documents.parquet' order by doc_id").fetchall()
    assert [d for d, _ in texts] == list(range(len(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in catalog.op5_jaccard_join(spark, SMALL).collect()}
    assert got == dict(enumerate(brute_force([t for _, t in texts])))
