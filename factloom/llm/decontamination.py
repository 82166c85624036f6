"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index is a table of postings of training texts: term, text, position, and the words
around it. It is built for the terms that the test phrases need: how often every
test term occurs is counted over all training texts first, and each phrase is then
looked up by its ``LISTS`` rarest terms. Their postings lists, shifted by the terms'
offsets in the phrase, are intersected from the rarest on, and what survives is compared
with the stored surroundings, so that matches are exact.

* :func:`phrase_matches` returns exact occurrences of phrases.
* :func:`proximity_matches` returns places where all terms of a phrase occur near each other, in any order.
* :func:`decontaminate` judges texts by the share of words inside exact occurrences.

Rows are texts, told apart by a row number that is stored with the index: repeated
ids are judged separately, and :func:`clean` drops rows by what their texts say, whatever
their ids. Nulls and texts without words have no hits and are not contaminated; test
items without words have no phrases, and repeated items count once. Null item ids are
ignored in lists of items. Very long texts are read whole. Further columns may have any
name; they are not read. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.sqltext import bitmap, in_bitmap, sized_bits, text_key, without_keys, words
from factloom.session import stored

WINDOW = 13
#: Rarest terms of a phrase whose postings are stored and intersected.
LISTS = 3
#: A text is contaminated if one word in this many is hit.
SHARE = 20


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(phrase, item_id, terms)``: each run of ``window`` words of an item; a shorter item is one phrase."""
    x = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    x = x.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    x = x.select("item_id", F.slice("w", F.col("at") + 1, F.lit(window)).alias("terms")).distinct()
    return x.select(F.xxhash64("terms").alias("phrase"), "item_id", "terms")


def _among(terms: DataFrame, label: str):
    """A test whether a word may be in the column ``term``: a bitmap sized by their number lets the scan skip most others."""
    bits = sized_bits(terms.count())
    slots = bitmap(terms.select(F.xxhash64("term").alias("h")), "h", bits, label).scalar()
    return lambda word: in_bitmap(F.xxhash64(word), slots, bits)


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """``(term, n)`` for the terms of ``terms`` that occur: their occurrences over all texts."""
    each = docs.select(F.explode(words(F.col(text_col))).alias("term")).where(_among(terms, "term-bitmap")(F.col("term")))
    return each.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term", "left_semi")


def plan_lookups(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """``(phrase, terms, t1, o1, t2, o2, ...)``: the ``LISTS`` rarest terms of each phrase and their offsets, the rarest first.

    Phrases with a term that occurs nowhere are left out. A phrase of fewer words repeats its last term.
    """
    each = wanted.select("phrase", "terms").distinct().select("phrase", "terms", F.posexplode("terms").alias("o", "term"))
    ranked = each.join(counts, "term", "left").groupBy("phrase").agg(
        F.first("terms").alias("terms"),
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "o"))).alias("by"),
    )
    at = lambda k: F.col("by")[F.least(F.lit(k), F.size("by") - 1)]
    listed = [c for k in range(LISTS) for c in (at(k)["term"].alias(f"t{k + 1}"), at(k)["o"].alias(f"o{k + 1}"))]
    return ranked.where(F.col("by")[0]["n"] > 0).select("phrase", "terms", *listed)


def looked_up(lookups: DataFrame) -> DataFrame:
    """``(term)``: the terms that phrases are looked up by, for :func:`build_index`."""
    return lookups.select(F.explode(F.array(*[f"t{k + 1}" for k in range(LISTS)])).alias("term")).distinct()


def build_index(docs: DataFrame, terms: DataFrame, radius: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: postings ``(row, id, key, n_words, head, term, pos, from, around)`` of the terms in ``terms``.

    ``around`` holds the words up to ``radius`` places away, and ``from`` the position of
    its first word. Every text has one row with ``head``, its only row if it has no posting,
    in which ``term`` may be null. Terms outside ``terms`` may slip through the bitmap;
    joins on the term drop them.
    """
    listed = _among(terms, "posting-bitmap")
    x = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), words(F.col(text_col)).alias("w"))
    x = x.select("row", "id", "key", "w", F.posexplode_outer("w").alias("pos", "term"))
    head = F.coalesce(F.col("pos") == 0, F.lit(True))
    x = x.where(head | listed(F.col("term")))
    begin = F.greatest(F.col("pos") - radius, F.lit(0))
    around = F.slice("w", begin + 1, F.col("pos") - begin + 1 + radius)
    indexed = x.select("row", "id", "key", F.size("w").cast("bigint").alias("n_words"), head.alias("head"), "term", "pos", begin.alias("from"), around.alias("around"))
    return stored(indexed, "postings")


def phrase_matches(index: DataFrame, lookups: DataFrame) -> DataFrame:
    """``(row, phrase, start, length)``: exact occurrences of phrases in the indexed texts."""
    rare = index.join(lookups, F.col("term") == F.col("t1"))
    rare = rare.select("row", "phrase", (F.col("pos") - F.col("o1")).alias("start"), "from", "around", "terms").where("start >= 0")
    rare = rare.where(F.col("start") >= F.col("from"))
    for k in range(1, LISTS):
        shifted = index.select("row", "term", "pos").join(lookups.select("phrase", F.col(f"t{k + 1}").alias("term"), F.col(f"o{k + 1}").alias("o")), "term")
        rare = rare.join(shifted.select("row", "phrase", (F.col("pos") - F.col("o")).alias("start")), ["row", "phrase", "start"], "left_semi")
    exact = F.slice("around", F.col("start") - F.col("from") + 1, F.size("terms")) == F.col("terms")
    return rare.where(exact).select("row", "phrase", "start", F.size("terms").alias("length"))


def proximity_matches(index: DataFrame, lookups: DataFrame, slop: int) -> DataFrame:
    """``(row, phrase, pos)``: postings of a phrase's rarest term with all its terms within ``slop`` words, in any order.

    ``slop`` may not exceed the radius of the index.
    """
    near = index.join(lookups, F.col("term") == F.col("t1"))
    begin = F.greatest(F.col("pos") - slop, F.col("from"))
    span = F.slice("around", begin - F.col("from") + 1, F.col("pos") - begin + 1 + slop)
    return near.where(F.size(F.array_except("terms", span)) == 0).select("row", "phrase", "pos").distinct()


def _covered(spans: Column) -> Column:
    """How many positions a sorted array of (start, stop) spans covers."""
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("bigint").alias("total"))

    def add(acc: Column, s: Column) -> Column:
        more = F.greatest(s["stop"] - F.greatest(s["start"], acc["reach"]), F.lit(0))
        return F.struct(F.greatest(acc["reach"], s["stop"]).alias("reach"), (acc["total"] + more).cast("bigint").alias("total"))

    return F.aggregate(spans, start, add, lambda acc: acc["total"])


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """A row for each text: ``id_col, n_words, n_hit, n_items, items_sha256, contaminated``."""
    out = _judged(docs, items, id_col, text_col, item_id_col, item_text_col, window)
    return out.drop("key").withColumnRenamed("id", id_col)


def _judged(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    wanted = stored(phrases(items, item_id_col, item_text_col, window), "phrases")
    vocabulary = wanted.select(F.explode("terms").alias("term")).distinct()
    counts = stored(term_counts(docs, vocabulary, text_col), "term-counts")
    lookups = stored(plan_lookups(wanted, counts), "lookups")
    index = build_index(docs, looked_up(lookups), window - 1, id_col, text_col)
    found = phrase_matches(index, lookups).join(wanted.select("phrase", "item_id"), "phrase")
    # spans and items are each bounded by the words of one text
    hits = found.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("stop")))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    out = index.where("head").select("row", "id", "key", "n_words").join(hits, "row", "left")
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0).cast("bigint"))
    names = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select(
        "id",
        "key",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * SHARE >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows whose text is contaminated."""
    judged = _judged(docs, items, id_col, text_col, **how)
    return without_keys(docs, text_key(F.col(text_col)), judged.where("contaminated").select("key"))
