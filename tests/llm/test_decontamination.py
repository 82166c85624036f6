from __future__ import annotations

import hashlib
import random
import re

from factloom.llm import catalog, oracles
from factloom.llm import decontamination as dc
from tests.oracle import assert_same

SMALL = "/root/testdata/sf0.001"


def split(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_force(docs, items, window=13):
    phrases = {}
    for item, text in items:
        w = split(text)
        for k in range(max(len(w) - window, 0) + 1) if w else []:
            phrases.setdefault(tuple(w[k : k + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, names = split(text), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in phrases:
                    hit |= set(range(k, k + n))
                    names |= phrases[tuple(w[k : k + n])]
        listed = sorted(str(x) for x in names if x is not None)
        out.append((doc, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run(spark, docs, items, window=13):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, row int, term string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dc.decontaminate(d, b, window=window).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    return sorted(map(tuple, got), key=repr)


def test_equals_brute_force_on_few_words(spark):
    """A tiny vocabulary makes phrases overlap, repeat and share their rarest terms."""
    pick = random.Random(7)
    text = lambda n: " ".join(pick.choice("aa BB cc dd ée 9".split()) for _ in range(n))
    items = [(k, text(pick.randrange(1, 9))) for k in range(8)] + [(3, text(6)), (100, None), (101, "..."), (None, text(5)), (102, "zzz"), (103, "ZZZ yyy")]
    docs = [(k, text(pick.randrange(0, 60))) for k in range(60)] + [(1, text(9)), (1, text(9)), (None, text(9)), (200, None), (201, ""), (202, "zzz; ZZZ-yyy")]
    for window in (3, 13):
        assert run(spark, docs, items, window) == brute_force(docs, items, window)


def test_whole_contract_window(spark):
    base = [f"t{k}" for k in range(40)]
    items = [(5, " ".join(base)), (11, "only three words")]
    filler = " ".join(f"f{k}" for k in range(500))
    docs = [(1, " ".join(base[3:16])), (2, " ".join(base[3:15])), (3, filler + " ".join(base)), (4, filler + " " + " ".join(base[:13]) + "! Only, THREE words"), (5, " ".join(base[:13] + ["x"] + base[13:]))]
    assert run(spark, docs, items) == brute_force(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "a b c")], []) == brute_force([(1, "a b c")], [])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red q q blue q green"), (2, "red q q q q q q blue green"), (3, "green blue red")], "doc_id long, text string")
    wanted = dc.phrases(spark.createDataFrame([(9, "red blue green")], "item_id long, text string"))
    terms = wanted.selectExpr("explode(terms) as term").distinct()
    lookups = dc.plan_lookups(wanted, dc.term_counts(docs, terms))
    index = dc.build_index(docs, dc.looked_up(lookups), 12)
    near = dc.proximity_matches(index, lookups, 5).join(index.where("head").select("row", "id"), "row")
    assert sorted(r.id for r in near.collect()) == [1, 3]


def test_query_equals_sql(spark):
    assert assert_same(catalog.op6_decontamination(spark, SMALL), SMALL, oracles.OP6) == 200


def test_join_query_equals_sql(spark):
    assert assert_same(catalog.op5_jaccard_join(spark, SMALL), SMALL, oracles.OP5) == 200


def test_rows_are_dropped_by_their_text(spark):
    """Ids that repeat, or are null, do not take clean rows with them; other columns may have any name."""
    phrase = " ".join(f"t{k}" for k in range(13))
    rows = [(1, phrase), (1, "clean text"), (None, phrase), (None, "clean text"), (2, phrase + " and " + "more words here " * 100), (3, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "doc_id long, text string, _id string, _slots0 string, _key0 string")
    items = spark.createDataFrame([(1, phrase), (1, None), (1, phrase)], "item_id long, text string")
    kept = dc.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(i, t) for i, t in rows if t != phrase], key=repr)
    assert dc.clean(docs.limit(0), items).count() == 0 and dc.clean(docs, items.limit(0)).count() == len(rows)
