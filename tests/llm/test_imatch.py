from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
import math

import pytest
from pyspark.sql import functions as F

from factloom.llm import catalog, imatch

SMALL = "/root/testdata/sf0.001"


def followers(rows):
    """Row to the row after it, by id (nulls first), wrapping around; ties may come in either order."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    return {order[k]: order[(k + 1) % len(order)] for k in range(len(order))}


def edited(rows):
    nxt = followers(rows)
    out = {}
    for i, (_, text) in enumerate(rows):
        text, other = text or "", rows[nxt[i]][1] or ""
        half = len(text) // 2
        out[i] = text[: len(text) - half] + other[:half]
    return out


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_chars int, tie string")
    return imatch.edited_fingerprints(docs).collect()


def test_edits_lengths_and_equal_texts(spark):
    pick = random.Random(3)
    text = lambda: " ".join(f"w{int(pick.paretovariate(0.7))}" for _ in range(pick.randrange(0, 80))) + pick.choice(["", "é", "🙂x", "中"])
    rows = [(3 * k, text()) for k in range(120)]
    rows += [(1, rows[5][1]), (4, rows[9][1]), (7, None), (10, ""), (-5, "🙂" * 7), (None, "first of all")]
    got = {r.doc_id: r for r in run(spark, rows)}
    want = edited(rows)
    assert len(got) == len(rows)
    by_text = {}
    for i, (doc, t) in enumerate(rows):
        r = got[doc]
        assert r.n_chars == len(t or "")
        assert r.edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(t or "", r.fingerprint) == r.fingerprint
        assert (want[i] != (t or "")) or (r.near_edited == 1 and r.edited_fingerprint == r.fingerprint)


def test_few_rows(spark):
    assert run(spark, []) == []
    one = run(spark, [(7, "abcd")])[0]
    assert (one.edited_sha256, one.near_next) == (hashlib.sha256(b"abab").hexdigest(), 1.0)
    same = run(spark, [(1, "a b"), (1, "a b"), (None, None)])
    assert len(same) == 3


def test_lexicon_equals_brute_force(spark):
    pick = random.Random(1)
    texts = [" ".join(f"W{int(pick.paretovariate(0.6))}" for _ in range(30)) for _ in range(200)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    n = Counter(w for t in texts for w in set(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())))
    low, high = imatch.IDF_BAND
    inside = {w for w, c in n.items() if low - 1e-9 <= math.log(len(texts) / c) <= high + 1e-9}
    hashes = {r.h: r.w for r in spark.createDataFrame([(w,) for w in n], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    table = imatch.lexicon(docs).first().table
    got = [hashes[h] for slot in table for h in slot]
    assert set(got) == inside and len(got) == len(inside) > 50
    assert all(h & (len(table) - 1) == k for k, slot in enumerate(table) for h in slot)


def test_ranges_of_any_number_give_the_same_followers(spark):
    pick = random.Random(5)
    ids = [i * i % 101 for i in range(90)] + [7] * 300 + [None] * 120
    rows = spark.createDataFrame([(i, pick.randrange(-(2**63), 2**63), str(k)) for k, i in enumerate(ids)], "id long, tie long, text string").repartition(4)
    base = {tuple(r) for r in imatch.followed(rows, ["text"], buckets=1).select("id", "text", "next_text").collect()}
    assert len(base) == len(ids)
    order = sorted(rows.collect(), key=lambda r: (r.id is not None, r.id or 0, r.tie))
    assert base == {(r.id, r.text, order[(k + 1) % len(order)].text) for k, r in enumerate(order)}
    for buckets in (2, 7, 64):
        out = imatch.followed(rows, ["text"], buckets=buckets)
        assert {tuple(r) for r in out.select("id", "text", "next_text").collect()} == base
    # an id with a hundred times the rows of others is dealt to several buckets
    sizes = rows.withColumn("b", imatch._places(rows, 64)).groupBy("b").count().collect()
    assert max(r["count"] for r in sizes) < 60


def test_likeness_equals_the_share_of_equal_subset_hashes(spark):
    blank = spark.range(1).select(imatch._blank().alias("b")).first().b
    texts = {}
    checked = 0
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts)
    rows = {r.doc_id: r for r in catalog.op8_imatch(spark, SMALL).collect()}
    split = lambda f: [f[k : k + imatch.DIGITS] for k in range(0, len(f), imatch.DIGITS)] if len(f) == imatch.DIGITS * imatch.PER_DENSITY * len(imatch.DENSITIES) else None
    for k, d in enumerate(order):
        r, after = rows[d], rows[order[(k + 1) % len(order)]]
        for mine, theirs, near in ((r.fingerprint, r.edited_fingerprint, r.near_edited), (r.fingerprint, after.fingerprint, r.near_next)):
            x, y = split(mine), split(theirs)
            if x is None or y is None:
                continue
            used = [(p, q) for p, q in zip(x, y, strict=True) if (p, q) != (blank, blank)]
            assert abs(near - sum(p == q for p, q in used) / len(used)) < 1e-12
            checked += 1
    assert checked > 200


def test_fingerprints_equal_brute_force(spark):
    """Hashes of the sorted lexicon terms of each subset, recomputed from what Spark hashes single terms to."""
    pick = random.Random(2)
    texts = [" ".join(f"w{int(pick.paretovariate(0.6))}" for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    inside = {h for slot in imatch.lexicon(docs).first().table for h in slot}
    words = sorted({w for t in texts for w in t.split()})
    x = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h"))
    x = x.select("w", "h", *[F.pmod(F.xxhash64("h", F.lit(d)), F.lit(d)).alias(f"s{d}") for d in imatch.DENSITIES])
    known = {r.w: r for r in x.collect() if r.h in inside}
    lists = []
    for t in texts:
        mine = [known[w] for w in set(t.split()) if w in known]
        lists.append([sorted(r.h for r in mine if r[f"s{d}"] == k) for d in imatch.DENSITIES for k in range(imatch.PER_DENSITY)])
    flat = spark.createDataFrame([(i, j, hs) for i, each in enumerate(lists) for j, hs in enumerate(each)], "i int, j int, hs array<long>").select("i", "j", imatch._short(F.col("hs")).alias("f"))
    want: dict = {}
    for r in sorted(flat.collect(), key=lambda r: (r.i, r.j)):
        want[r.i] = want.get(r.i, "") + r.f
    got = {r.doc_id: r.fingerprint for r in imatch.fingerprints(docs).collect()}
    assert sum(got[i] == want[i] for i in want) >= 58 and all(got[i] in (want[i], hashlib.sha256(texts[i].encode()).hexdigest()) for i in want)


def test_other_ids(spark):
    rows = [(i, f"text {i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    for kind in ("tinyint", "smallint", "int", "bigint"):
        assert imatch.edited_fingerprints(docs.selectExpr(f"cast(doc_id as {kind}) doc_id", "text", "1 as bucket", "2 as _table0")).count() == 5
    with pytest.raises(ValueError):
        imatch.edited_fingerprints(docs.selectExpr("cast(doc_id as string) doc_id", "text"))


def test_likeness_separates_edits_from_strangers(spark):
    got = catalog.op8_imatch(spark, SMALL).where("n_chars > 300").select(F.avg("near_edited"), F.avg("near_next"), F.avg((F.col("near_edited") > F.col("near_next")).cast("double"))).first()
    assert got[0] > 3 * got[1] and got[2] > 0.85, got
