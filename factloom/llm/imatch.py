"""Document fingerprints by I-Match, in DataFrame operations only.

Document frequencies of terms are counted over all texts. Terms whose inverse
document frequency lies in a band form the lexicon: neither so common that every
text has them nor so rare that one typo changes them. The lexicon is split into
several randomised subsets of different density. For each subset, the distinct
terms of a text that belong to it are sorted and hashed; the fingerprint lists
these hashes. Texts that differ little keep the hashes of the subsets that the
difference misses, and dense subsets react to less than sparse ones.

Frequencies are counted for 64-bit hashes of terms, all of them. The lexicon is a table
of these hashes: a term in the band is in 1 of 500 texts or more, so there are at most 500
times as many as a text has distinct terms on average, however large the corpus.

A text without lexicon terms has the SHA-256 of the text as its fingerprint: only
equal texts share it. Nulls are empty texts; very long texts are read whole. Ids are
integers of any size; others are refused where the order of rows matters. Rows with
equal ids are ordered by the hash of their text; null ids come first. The row after the
last is the first; a single row follows itself. Further columns are not read; empty
tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from factloom.llm.sqltext import bound, unused
from factloom.session import stored

#: The band of inverse document frequencies ln(N / n): terms in 1 of 5 to 1 of 500 texts.
IDF_BAND = (math.log(5), math.log(500))
#: What parts terms, in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Of each density, this many subsets; a term is in one of them with a chance of PER_DENSITY / density.
PER_DENSITY = 12
DENSITIES = (12, 48, 192, 768)
#: Hexadecimal digits kept of a subset's hash.
DIGITS = 8
#: Characters of the texts that one task puts in order.
BUCKET_CHARS = 8 << 20


def term_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of a text's terms, in lower case of all alphabets."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))
    return F.array_distinct(F.transform(F.array_remove(F.split(spaced, " ", -1), ""), lambda w: F.xxhash64(w)))


def _slot(hash_: Column, slots: Column | int) -> Column:
    return hash_.bitwiseAND((F.lit(slots) if isinstance(slots, int) else slots.cast("bigint")) - 1).cast("int")


def lexicon(docs: DataFrame, text_col: str = "text", idf_band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """One row: the hashes of the terms whose inverse document frequency is in the band, by slot, ``table array<array<bigint>>``.

    There are at least as many slots as terms, so that a slot holds very few.
    """
    counted = docs.select(F.explode(term_hashes(F.col(text_col))).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    total = docs.count()
    # the band as counts, so that no logarithm is taken for each term
    most, least = total / math.exp(idf_band[0]), total / math.exp(idf_band[1])
    # few terms, as said above: one file
    kept = stored(counted.where((F.col("n") <= F.lit(most)) & (F.col("n") >= F.lit(least))).select("h").repartition(1), "lexicon-terms")
    slots = max(1 << 10, 1 << (2 * max(kept.count(), 1) - 1).bit_length())
    held = kept.groupBy(_slot(F.col("h"), slots).alias("s")).agg(F.collect_list("h").alias("hs"))  # bounded, as the lexicon is
    blank = docs.sparkSession.range(slots).select(F.col("id").cast("int").alias("s"))
    full = blank.join(held, "s", "left").select("s", F.coalesce("hs", F.array().cast("array<bigint>")).alias("hs"))
    return stored(full.agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "hs"))), lambda x: x["hs"]).alias("table")), "lexicon")


def _blank() -> Column:
    return _short(F.array().cast("array<bigint>"))


def _short(hashes: Column) -> Column:
    return F.substring(F.lpad(F.lower(F.hex(F.xxhash64(hashes))), 16, "0"), 1, DIGITS)


def with_hashes(docs: DataFrame, text_col: str, table: DataFrame, name: str) -> DataFrame:
    """``docs`` with the subset hashes of a text column."""
    held = unused(docs, "table")
    x = docs.withColumn(held, table.scalar())
    slots = F.size(held)
    terms = F.array_sort(F.filter(term_hashes(F.col(text_col)), lambda h: F.array_contains(F.col(held)[_slot(h, slots)], h)))
    hashes = bound(terms, lambda t: F.concat(*[bound(_drawn(t, d), _each) for d in DENSITIES]))
    return x.withColumn(name, hashes).drop(held)


def _drawn(terms: Column, density: int) -> Column:
    """``(s, h)`` of the terms in one of the subsets of a density; s is drawn from the term."""
    drawn = F.transform(terms, lambda h: F.struct(F.pmod(F.xxhash64(h, F.lit(density)), F.lit(density)).cast("int").alias("s"), h.alias("h")))
    return F.filter(drawn, lambda x: x["s"] < PER_DENSITY)


def _each(drawn: Column) -> Column:
    subsets = F.sequence(F.lit(0), F.lit(PER_DENSITY - 1))
    return F.transform(subsets, lambda k: _short(F.transform(F.filter(drawn, lambda x: x["s"] == k), lambda x: x["h"])))


def fingerprint(hashes: Column, text: Column) -> Column:
    """A fingerprint string from subset hashes."""
    empty = F.size(F.array_remove(hashes, _blank())) == 0
    return F.when(empty, F.sha2(text, 256)).otherwise(F.array_join(hashes, ""))


def likeness(a: Column, b: Column, text_a: Column, text_b: Column) -> Column:
    """The share of subsets with equal hashes, of those that hold terms of either text; without any, whether the texts are equal."""
    used = F.filter(F.zip_with(a, b, lambda x, y: F.when((x == _blank()) & (y == _blank()), None).otherwise(x == y)), lambda e: e.isNotNull())
    share = F.size(F.filter(used, lambda e: e)).cast("double") / F.size(used)
    return F.when(F.size(used) == 0, (text_a == text_b).cast("double")).otherwise(share)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", idf_band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """``(id_col, fingerprint)`` for every row."""
    x = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    x = with_hashes(x, "text", lexicon(x, "text", idf_band), "hashes")
    return x.select(F.col("id").alias(id_col), fingerprint(F.col("hashes"), F.col("text")).alias("fingerprint"))


def _places(rows: DataFrame, buckets: int) -> Column:
    """A bucket for each row: ranges of ids of about equal size, in order; an id with more rows than a bucket has several, by ranges of ``tie``.

    Only quantiles of ids reach the driver.
    """
    found = rows.agg(F.percentile_approx("id", [k / buckets for k in range(1, buckets)], 100 * buckets), F.count("*"), F.count_if(F.col("id").isNull())).first() if buckets > 1 else (None, 1, 0)
    limits = list(found[0] or [])
    bits = lambda n: max(0, math.ceil(math.log2(max(n, 1))))  # noqa: E731  of buckets for n times a bucket's rows
    values = sorted(set(limits))
    # buckets of nulls, of ids below the first limit, and for each limit of its own rows and of those above
    hot = [bits(limits.count(v)) if limits.count(v) > 1 else 0 for v in values]
    null_bits = bits(-(-found[2] * buckets // max(found[1], 1)))

    def spread(b: Column) -> Column:
        """The range of ``tie`` among ``2 ** b``, in order."""
        return F.when(b == 0, 0).otherwise(F.call_function("shiftright", F.col("tie"), (64 - b).cast("int")) + F.call_function("shiftleft", F.lit(1), (b - 1).cast("int"))).cast("int")

    first, bases = (1 << null_bits) + 1, []
    for b in hot:
        bases.append(first)
        first += (1 << b) + 1
    if not values:
        return F.when(F.col("id").isNull(), spread(F.lit(null_bits))).otherwise(F.lit(1 << null_bits))
    k = F.size(F.filter(F.lit(values), lambda v: v <= F.col("id")))
    at = F.greatest(k - 1, F.lit(0))
    b, base = F.lit(hot)[at], F.lit(bases)[at]
    own = F.lit(values)[at] == F.col("id")
    placed = F.when(k == 0, 1 << null_bits).when(own, base + spread(b)).otherwise(base + F.call_function("shiftleft", F.lit(1), b.cast("int")))
    return F.when(F.col("id").isNull(), spread(F.lit(null_bits))).otherwise(placed).cast("int")


def followed(rows: DataFrame, carried: list[str], finish=lambda rows: rows, buckets: int | None = None) -> DataFrame:
    """``rows`` (with an integer ``id``, a ``text`` and a 64-bit ``tie`` from it), finished, and ``next_*`` of the columns in ``carried``.

    Rows are dealt into ranges of ids sized by their characters. The first row of each range
    is also sent to the range before it, and the very first to the last range, so that each
    range is worked off by itself. ``finish`` adds columns to rows before they are dealt.
    """
    if not isinstance(rows.schema["id"].dataType, IntegralType):
        raise ValueError("rows can only be put in order by integer ids")
    rows = rows.withColumn("id", F.col("id").cast("bigint"))
    if buckets is None:
        chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))
    dealt = rows.withColumn("bucket", _places(rows, buckets))
    # a row for each bucket, its first; there are few buckets, so they are put in a ring in one task
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("k"), "id", "tie")).alias("f"))
    ring = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(ring), F.max("bucket").over(Window.partitionBy(F.lit(0))))
    firsts = stored(firsts.withColumn("before", before).select("bucket", "before", F.col("f.id").alias("fid"), F.col("f.tie").alias("ftie")), "range-firsts")
    same = (F.col("d.bucket") == F.col("f.bucket")) & F.col("d.id").eqNullSafe(F.col("f.fid")) & (F.col("d.tie") == F.col("f.ftie"))
    # broadcast: a row of numbers for each bucket
    guests = dealt.alias("d").join(F.broadcast(firsts).alias("f"), same).select("d.id", "d.text", "d.tie", F.col("f.before").alias("bucket")).dropDuplicates(["bucket"])
    sent = finish(dealt).withColumn("guest", F.lit(False)).unionByName(finish(guests).withColumn("guest", F.lit(True)))
    run = Window.partitionBy("bucket").orderBy("guest", F.col("id").asc_nulls_first(), "tie")
    out = sent.select("*", *[F.lead(c).over(run).alias(f"next_{c}") for c in carried])
    return out.where("not guest").drop("bucket", "guest")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", idf_band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """Fingerprints of texts, of the same texts with their second half taken from the next row, and how alike they are.

    ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    x = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    slots = lexicon(x, "text", idf_band)
    x = followed(x.withColumn("tie", F.xxhash64("text")), ["text", "hashes"], lambda rows: with_hashes(rows, "text", slots, "hashes"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    kept = F.substring("text", F.lit(1), F.char_length("text") - half)
    x = x.withColumn("edited", F.concat(kept, F.substring("next_text", F.lit(1), half)))
    x = with_hashes(x, "edited", slots, "edited_hashes")
    return x.select(
        F.col("id").alias(id_col),
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("hashes"), F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited_hashes"), F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes"), F.col("text"), F.col("edited")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes"), F.col("text"), F.col("next_text")).alias("near_next"),
    )
