"""Attribute resolution and review channels, row by row of the decision table."""

from __future__ import annotations

from datetime import date

import random

import pytest

from factloom.operators import attributes, detect
from factloom.rules import RuleContext

DOC = "doc_id long, group_id long, prev_id long, filename string, source_type string, authority double, parsed_at date"
FACT = "fact_id string, subject_id long, predicate string, pred_fold string, object_type string, object_string string, object_number double, canon_object string, measure_unit string, currency string, tax_basis string, doc_id long, valid_from date, valid_to date, valid_to_anchor string, observed_at date"
CLUSTER = "subject_id long, cluster int, canonical_name string, value_kind string, ord int, alias string, span string"
TEXT = "subject_id long, cluster int, value_kind string, a string, b string"
CTX = RuleContext(as_of=date(2026, 6, 1))


@pytest.fixture
def make(spark):
    def docs():
        return spark.createDataFrame([(1, None, None, "a", "pricing", 0.9, None), (2, None, None, "b", "pricing", 0.9, None), (3, None, None, "c", "general", 0.9, None), (10, 7, None, "old", "pricing", 0.9, None), (11, 7, 10, "new", "pricing", 0.9, None)], DOC)

    def facts(*rows):
        out = []
        for r in rows:
            f = {"subject": 1, "unit": None, "currency": None, "tax": None, "doc": 1, "start": None, "end": None, **r}
            number = isinstance(f["value"], (int, float))
            kind = "number" if number else "string"
            text = (str(int(f["value"])) if f["value"] == int(f["value"]) else str(f["value"])) if number else f["value"].strip()
            out.append((f["id"], f["subject"], f["p"], f["p"].strip().lower(), kind, None if number else f["value"], float(f["value"]) if number else None, f"scalar|{kind}|{text}", f["unit"], f["currency"], f["tax"], f["doc"], f["start"], f["end"], None, None))
        return spark.createDataFrame(out, FACT)

    def clusters(*rows):
        return spark.createDataFrame([(1, c, name, kind, k, alias, span) for c, name, kind, aliases in rows for k, (alias, span) in enumerate(aliases)], CLUSTER)

    return docs(), facts, clusters, lambda *rows: spark.createDataFrame([(1, 0, *r) for r in rows], TEXT)


def items(frame):
    return {tuple(sorted((r.fact_a, r.fact_b))): (r.kind, r.reason) for r in frame.collect()}


def test_same_predicate(make):
    docs, facts, clusters, texts = make
    two = lambda name, x, y, **more: [{"id": f"{name}1", "p": name, "doc": 1, **more, **x}, {"id": f"{name}2", "p": name, "doc": 2, **more, **y}]
    rows = [
        *two("same", {"value": 5}, {"value": 5.0}, unit="kg"),
        *two("differs", {"value": 5}, {"value": 6}, unit="kg"),
        *two("nounit", {"value": 5, "unit": "kg"}, {"value": 5}),
        *two("unknowntax", {"value": 5, "tax": "unknown"}, {"value": 5, "tax": "inclusive"}, unit="kg"),
        *two("units", {"value": 5, "unit": "kg"}, {"value": 5, "unit": "g"}),
        *two("fullwidth", {"value": 5, "unit": "ｋｇ"}, {"value": 5, "unit": " KG"}),
        *two("taxes", {"value": 5, "tax": "exclusive"}, {"value": 5, "tax": "inclusive"}, unit="kg"),
        *two("money", {"value": 5, "currency": "EUR"}, {"value": 5, "currency": " usd"}, unit="kg"),
        *two("bare", {"value": 5}, {"value": 5}),
        *two("barediffers", {"value": 5}, {"value": 6}),
        *two("words", {"value": "7 x 24"}, {"value": "7x24 h"}),
        *two("otherwords", {"value": "red"}, {"value": "blue"}),
        *two("prose", {"value": "a sentence that is rather long"}, {"value": "another"}),
        {"id": "general1", "p": "general", "value": 5, "unit": "kg", "doc": 1}, {"id": "general2", "p": "general", "value": 5, "unit": "g", "doc": 3},
    ]
    f = facts(*rows)
    r = attributes.resolve(f, docs, clusters(), texts(("text", " 7X24 H", "7x24")))
    assert items(attributes.same_predicate_channels(f, docs, CTX, r)) == {
        ("nounit1", "nounit2"): ("pending_review", "measure_anchor_missing"),
        ("unknowntax1", "unknowntax2"): ("pending_review", "measure_anchor_missing"),
        ("units1", "units2"): ("cross_attribute_review", "measure_anchor_conflict"),
        ("taxes1", "taxes2"): ("cross_attribute_review", "measure_anchor_conflict"),
        ("money1", "money2"): ("cross_attribute_review", "measure_anchor_conflict"),
        ("words1", "words2"): ("normalized_equivalent", "same_predicate_text_equivalence"),
        ("prose1", "prose2"): ("pending_review", "literal_text_difference"),
    }
    found = {x.predicate for x in attributes.conflicts(f, docs, CTX, r).collect()}
    assert found == {"differs", "barediffers", "otherwords"}
    assert {x.predicate for x in detect.conflicts(f, docs, CTX).collect()} == {"differs", "barediffers", "otherwords", "words", "prose"}


def test_what_is_kept_of_proposals(make):
    docs, facts, clusters, texts = make
    f = facts(
        {"id": "a", "p": "List Price", "value": 5, "unit": "EUR/m"}, {"id": "b", "p": "fee", "value": 6, "unit": "eur/M"}, {"id": "c", "p": "charge", "value": 7, "unit": "EUR/day"}, {"id": "d", "p": "cost", "value": 8},
        {"id": "e", "p": "color", "value": "dark red"}, {"id": "f", "p": "shade", "value": "red"}, {"id": "g", "p": "hue", "value": "x"}, {"id": "h", "p": "alone", "value": 9, "doc": 3},
    )
    r = attributes.resolve(
        f,
        docs,
        clusters(
            (0, "Price", "measure", [("list price", "5 eur"), (" FEE ", "nope"), ("charge", "7"), ("cost", "8"), ("alone", "9"), ("list price", "5")]),
            (1, "Colour", "text", [("color", "DARK"), ("shade", None), ("fee", "6")]),
            (2, "Single", "text", [("hue", "x")]),
        ),
        texts(("text", "Dark Red", "red"), ("text", "red", "green"), ("measure", "x", "red"), ("text", "x", " X ")),
    )
    got = {b.pred_fold: (b.canonical_key, b.dimension, b.trusted) for b in r.bindings.collect()}
    price = "measure|eur/m|price"
    assert got == {"list price": (price, "eur/m", True), "fee": (price, "eur/m", False), "cost": (price, "eur/m", False), "color": ("text|-|colour", None, True), "shade": ("text|-|colour", None, False)}
    assert {(x.a, x.b) for x in r.rejected.collect()} == {("charge", "list price"), ("charge", "fee")}
    assert {(x.a, x.b) for x in r.texts.collect()} == {("darkred", "red")}
    assert {(x.what.strip().lower(), x.reason) for x in r.discarded.collect()} == {("alone", "unknown_predicate"), ("list price", "used_before"), ("fee", "used_before"), ("green = red", "value_not_found")}
    pairs = f.sparkSession.createDataFrame([(1, "fee", "fee"), (1, "fee", "list price"), (1, "fee", "charge"), (1, "color", "shade")], "subject_id long, pred_a string, pred_b string")
    kinds = {(x.pred_a, x.pred_b): (x.identity, x.canonical_name) for x in attributes.pair_identity(pairs, r.bindings).collect()}
    assert kinds == {("fee", "fee"): ("A", None), ("fee", "list price"): ("B", "Price"), ("fee", "charge"): (None, None), ("color", "shade"): ("B", "Colour")}


def test_a_cluster_without_units_stays_one_group(make):
    docs, facts, clusters, texts = make
    f = facts({"id": "a", "p": "x", "value": 5}, {"id": "b", "p": "y", "value": 5})
    r = attributes.resolve(f, docs, clusters((0, "N", "measure", [("x", "5"), ("y", "5")])), texts())
    assert {(b.pred_fold, b.canonical_key, b.dimension) for b in r.bindings.collect()} == {("x", "measure|-|n", None), ("y", "measure|-|n", None)}


def test_merged_and_unmerged_predicates(make):
    docs, facts, clusters, texts = make
    f = facts(
        {"id": "p1", "p": "price", "value": 5, "unit": "kg", "doc": 1}, {"id": "p2", "p": "fee", "value": 5, "unit": "kg", "doc": 2}, {"id": "p3", "p": "fee", "value": 6, "unit": "kg", "doc": 2}, {"id": "p4", "p": "fee", "value": 9, "unit": "kg", "doc": 1},
        {"id": "c1", "p": "color", "value": "red", "doc": 1}, {"id": "c2", "p": "shade", "value": "red ", "doc": 2}, {"id": "c3", "p": "shade", "value": "crimson", "doc": 2}, {"id": "c4", "p": "shade", "value": "blue", "doc": 2},
        {"id": "w1", "p": "weight", "value": 5, "unit": "t", "doc": 1}, {"id": "w2", "p": "load", "value": 7, "unit": "t", "doc": 2}, {"id": "w3", "p": "mass", "value": 5, "unit": "g", "doc": 2},
        {"id": "n1", "p": "net", "value": 5, "unit": "m", "doc": 1}, {"id": "n2", "p": "gross", "value": 5, "unit": "cm", "doc": 2},
    )
    r = attributes.resolve(
        f, docs,
        clusters((0, "Price", "measure", [("price", "5 kg"), ("fee", "6")]), (1, "Colour", "enumeration", [("color", "red"), ("shade", "blue")]), (2, "Size", "measure", [("net", "5"), ("gross", "5")])),
        texts(("text", "red", "crimson")),
    )
    assert items(attributes.merged_channels(f, docs, CTX, r)) == {
        ("p1", "p2"): ("normalized_equivalent", "merged_measure_equal_value"),
        ("p1", "p3"): ("pending_review", "model_merged_unconfirmed"),
        ("c1", "c2"): ("normalized_equivalent", "merged_attribute_equal_value"),
        ("c1", "c3"): ("normalized_equivalent", "model_text_equivalence"),
        ("c1", "c4"): ("pending_review", "merged_attribute_value_differs"),
    }
    cross = items(attributes.cross_channels(f, docs, CTX, r))
    assert cross[("w1", "w2")] == ("cross_attribute_review", "same_unit_different_value_not_comerged")
    assert cross[("n1", "n2")] == ("cross_attribute_review", "measure_anchor_conflict_split")
    assert not {("p1", "p2"), ("p1", "p3"), ("w1", "w3")} & set(cross)
    every = attributes.channels(f, docs, CTX, r)
    assert every.count() == every.dropDuplicates(["fact_a", "fact_b"]).count()
    assert {x.kind for x in attributes.channel_counts(every).collect()} == {"pending_review", "cross_attribute_review", "normalized_equivalent"}
    # a multi-valued predicate silences its attribute
    several = RuleContext(as_of=CTX.as_of, multi_valued=frozenset({"fee"}))
    assert not {("p1", "p2"), ("p1", "p3")} & set(items(attributes.merged_channels(f, docs, several, r)))


def test_what_the_new_edition_says_in_other_words_is_not_stale(make):
    docs, facts, clusters, texts = make
    f = facts({"id": "old", "p": "color", "value": "red", "doc": 10}, {"id": "new", "p": "shade", "value": "red", "doc": 11}, {"id": "gone", "p": "mood", "value": "calm", "doc": 10}, {"id": "ended", "p": "color", "value": "red", "doc": 10, "end": date(2026, 1, 1)})
    r = attributes.resolve(f, docs, clusters((0, "Colour", "text", [("color", "red"), ("shade", "red")])), texts())
    again = attributes.restated_synonyms(f, docs, r)
    assert {x.fact_id for x in again.collect()} == {"old", "ended"}
    assert {(x.fact_id, x.reason) for x in detect.stale(f, docs, CTX, again).collect()} == {("gone", "superseding_source"), ("ended", "valid_to_expired+superseding_source")}
    assert {x.fact_id for x in detect.stale(f, docs, CTX).collect()} == {"old", "gone", "ended"}


def test_requests_hold_up_to_a_budget(make, spark):
    docs, facts, _, _ = make
    rows = [{"id": f"{s}-{k}", "subject": s, "p": f"p{k}", "value": k, "doc": 1 + k % 2} for s, n in ((1, 2), (2, 3), (3, 1), (4, 9), (5, 2)) for k in range(n)]
    f = facts(*rows)
    d = attributes.shard_descriptors(attributes.eligible(f, docs), docs)
    assert {(x.pred_fold, x.samples[0], x.source_docs[0]) for x in d.where("subject_id = 2").collect()} == {("p0", "0", "a"), ("p1", "1", "b"), ("p2", "2", "a")}
    names = spark.createDataFrame([(k, f"n{k}") for k in range(1, 6)], "subject_id long, name string")
    packs: dict = {}
    for x in attributes.pack_shards(d, names, 5).collect():
        packs.setdefault(x.pack, []).append((x.subject_id, x.pred_fold, x.split))
    sizes = sorted((sorted({s for s, _, _ in v}), len(v)) for v in packs.values())
    assert sizes == [(["1", "2"], 5), (["4"], 4), (["4"], 5), (["5"], 2)]
    assert all(split == (s == "4") for v in packs.values() for s, _, split in v)


def loop(subjects, budget):
    """Requests by one loop over ``(subject, name, [(predicate, first document)])``."""
    packs, current = [], []
    for subject, _, predicates in sorted(subjects, key=lambda s: (s[1], str(s[0]))):
        if len(predicates) < 2:
            continue
        if len(predicates) > budget:
            packs += [current] if current else []
            current = []
            groups: dict = {}
            for p, doc in sorted(predicates):
                groups.setdefault(doc, []).append(p)
            piece: list = []
            for ps in groups.values():
                if piece and len(piece) + len(ps) > budget:
                    packs.append(piece)
                    piece = []
                piece = piece + [(subject, p, True) for p in ps]
            packs.append(piece)
            continue
        if len(current) + len(predicates) > budget:
            packs.append(current)
            current = []
        current = current + [(subject, p, False) for p, _ in predicates]
    return packs + ([current] if current else [])


@pytest.mark.parametrize(("n", "run", "budget"), [(10_000, 20_000, 60), (3_000, 500, 60), (1_500, 7, 9), (1_500, 20_000, 60)])
def test_requests_equal_a_loop(spark, monkeypatch, n, run, budget):
    pick = random.Random(n + run)
    subjects = []
    for s in range(n):
        size = pick.choice([1, 2, 2, 3, 5, 9, 30]) if pick.random() < 0.99 else budget + pick.randrange(1, 50)
        subjects.append((str(s), f"n{pick.randrange(n // 2)}", [(f"p{k:03d}", f"d{pick.randrange(4)}") for k in range(size)]))
    monkeypatch.setattr(attributes, "RUN", run)
    rows = [(s, p, p, [doc]) for s, _, ps in subjects for p, doc in ps]
    d = spark.createDataFrame(rows, "subject_id string, pred_fold string, predicate string, source_docs array<string>").repartition(4)
    names = spark.createDataFrame([(s, name) for s, name, _ in subjects], "subject_id string, name string")
    got: dict = {}
    for x in attributes.pack_shards(d, names, budget).collect():
        got.setdefault(x.pack, set()).add((x.subject_id, x.pred_fold, x.split))
    want = loop(subjects, budget)
    assert [got.get(k) for k in range(len(want))] == [set(p) for p in want] and len(got) == len(want)


def test_no_subject_to_pack(spark):
    d = spark.createDataFrame([], "subject_id string, pred_fold string, predicate string, source_docs array<string>")
    assert attributes.pack_shards(d, spark.createDataFrame([], "subject_id string, name string")).collect() == []


def test_descriptors_are_sent_once(make):
    docs, facts, _, _ = make
    d = attributes.shard_descriptors(facts({"id": "a", "p": "p", "value": 5}), docs)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [subject_id") == 1 and plan.count("Join ") == 1
