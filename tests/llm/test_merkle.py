from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from factloom.llm import catalog, merkle, oracles
from tests.oracle import assert_same

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, tree int, idx string, n int, node string, at long, run string, path int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], text)))


def tree(nodes):
    """All levels of a tree, the last with one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    for nodes in levels[:-1]:
        s = i // 16 * 16
        yield nodes[s:i], nodes[i + 1 : s + 16]
        i //= 16


def brute_force(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[name] = tree([leaf(r, r[4]) for r in groups[name]])
    over = tree([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, row in enumerate(groups[name]):
            path = [*siblings(trees[name], i), *siblings(over, k)]
            tampered = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4]) if tampered else row[4]
            node = leaf(row, lowered)
            for left, right in path:
                node = digest(*left, node, *right)
            proof = digest(*(h for left, right in path for h in [*left, *right]))
            out.append((row[0], trees[name][0][i], trees[name][-1][0], over[-1][0], proof, node, node == over[-1][0]))
    return out


def check(spark, rows, seed=1):
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "x", 2, "y", 3, "z", 4) for r in rows], COLUMNS).repartition(3)
    got = [tuple(r) for r in merkle.document_manifest(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_force(rows), key=repr)
    return got


def test_trees_of_many_shapes(spark):
    pick = random.Random(3)
    text = lambda i: pick.choice([None, "", "A b C", f"é🙂 Zed {i}", "plain", "LONG " * 50])
    sizes = {"hot": 700, None: 40, "": 17, "é": 16, "Z": 1, "a": 1, "s2": 257}
    sizes |= {f"one{k}": 1 for k in range(40)}
    rows = [(pick.randrange(10**6), s, pick.choice(["en", None]), pick.choice([None, i]), text(i)) for s, n in sizes.items() for i in range(n)]
    rows += [(None, "hot", None, None, None), (None, None, "en", 1, "A"), (7, "hot", "en", 1, "one"), (7, "hot", "en", 1, "two")]
    rows += [(9, "hot", "en", 3, "Same")] * 20
    got = check(spark, rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 16, 17])
def test_one_group(spark, n):
    check(spark, [(i, "s", "en", i, f"T{i}") for i in range(n)])


def test_empty_and_long(spark):
    assert check(spark, []) == []
    check(spark, [(5, "s", "en", 1, "Word " * 400_000), (6, None, None, None, "X" * 3_000_000)])


def test_upper_runs_by_shuffle_and_by_broadcast(spark, monkeypatch):
    rows = [(i, f"s{i % 3}", "en", i, f"T{i}") for i in range(900)]
    monkeypatch.setattr(merkle, "TOP_RUNS", 0)
    check(spark, list(rows))
    monkeypatch.setattr(merkle, "TOP_RUNS", 4)
    check(spark, list(rows))


def test_query_equals_sql(spark):
    assert assert_same(catalog.op13_merkle(spark, SMALL), SMALL, oracles.OP13) == 200
