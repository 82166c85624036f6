"""Text expressions that stay inside the JVM: lower-casing, words, and fixed-size bitmaps of hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What parts words of digits, a-z and everything outside ASCII, once A-Z are lower-cased.
NO_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else kept; ASCII texts take the fast function. Null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column, separators: str = NO_ALNUM) -> Column:
    """The words of a text in order, A-Z lower-cased; null has none.

    Separators become one space, at which a split needs no pattern: listing the matches of
    a pattern costs many times more.
    """
    spaced = F.trim(F.regexp_replace(ascii_lower(text), separators, " "))
    return F.array_remove(F.split(spaced, " ", -1), "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often a lambda in ``use`` reads it.

    A column of an earlier projection would be put back into the lambda by the
    optimizer, which counts its mentions and not its evaluations.
    """
    return F.transform(F.array(value), use)[0]


def bitmap(hashes: DataFrame, col: str, bits: int, label: str) -> DataFrame:
    """One row, one array of ``bits / 64`` longs: a slot is set for each 64-bit hash in ``col``.

    The size is fixed by ``bits``, whatever the number of hashes, so the row may be
    embedded in a plan as a scalar.
    """
    word = F.shiftrightunsigned(F.col(col).bitwiseAND(F.lit(bits - 1)), 6).cast("int").alias("w")
    bit = F.expr(f"shiftleft(1L, cast(`{col}` & 63 as int))").alias("b")
    found = hashes.select(word, bit).groupBy("w").agg(F.bit_or("b").alias("b"))
    blank = hashes.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(bits // 64 - 1))).alias("w"), F.lit(0).cast("bigint").alias("b"))
    full = found.where("w is not null").unionByName(blank).groupBy("w").agg(F.bit_or("b").alias("b"))
    one = full.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits"))
    return stored(one, label)


def in_bitmap(hash_: Column, slots: Column, bits: int) -> Column:
    """Whether a hash's slot is set."""
    at = F.shiftrightunsigned(hash_.bitwiseAND(F.lit(bits - 1)), 6).cast("int")
    # a shift by a column is only in SQL; multiplying by a power is not exact for the sign bit
    return F.call_function("shiftrightunsigned", slots[at], hash_.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def sized_bits(n: int, least: int = 1 << 17, most: int = 1 << 27) -> int:
    """Bits of a bitmap for ``n`` hashes: 16 for each, within bounds."""
    return min(most, max(least, 1 << (16 * max(n, 1) - 1).bit_length()))


def unused(rows: DataFrame, stem: str) -> str:
    """A column name that ``rows`` does not have."""
    taken = {c.lower() for c in rows.columns}
    return next(name for name in (f"_{stem}{k}" for k in range(len(taken) + 1)) if name not in taken)


#: Slots of the bitmap that tells most rows apart from listed keys without a join.
KEY_BITS = 1 << 20


def split_by_keys(rows: DataFrame, key: Column, listed: DataFrame, label: str) -> tuple[DataFrame, DataFrame, str]:
    """``rows`` whose 64-bit ``key`` is surely not in the column ``key`` of ``listed``; the others, which a join has to decide, with the key in a column; and its name.

    A bitmap of fixed size does this, so rows that no key concerns are not shuffled. With
    more keys than slots, all rows are left to the join.
    """
    slots = bitmap(listed.select(F.col("key").alias("h")), "h", KEY_BITS, label).scalar()
    name, held = unused(rows, "key"), unused(rows, "slots")
    marked = rows.withColumns({name: key, held: slots})
    maybe = in_bitmap(F.col(name), F.col(held), KEY_BITS)
    return marked.where(~maybe).drop(name, held), marked.where(maybe).drop(held), name


def without_keys(rows: DataFrame, key: Column, listed: DataFrame) -> DataFrame:
    """``rows`` whose 64-bit ``key`` is not in the column ``key`` of ``listed``."""
    listed = stored(listed.select("key").distinct(), "listed-keys")
    clear, maybe, name = split_by_keys(rows, key, listed, "listed-slots")
    return clear.unionByName(maybe.join(listed.withColumnRenamed("key", name), name, "left_anti").select(*rows.columns))


def text_key(text: Column) -> Column:
    """A 64-bit digest of a text; null is a text of its own."""
    return F.xxhash64(text, F.octet_length(text))
