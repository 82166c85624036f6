"""Column functions of the knowledge model: comparison, canonical forms, normalisation, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.unicode import narrowed
from factloom.rules import SEVERITY_RANK

FAR = "9999-12-31"


def windows_overlap(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Inclusive validity windows with open ends overlap."""
    return F.coalesce(a_to >= b_from, F.lit(True)) & F.coalesce(b_to >= a_from, F.lit(True))


def expired_before(valid_to: Column, as_of: Column) -> Column:
    return F.coalesce(valid_to < as_of, F.lit(False))


def window_is_current(valid_from: Column, valid_to: Column, as_of: Column) -> Column:
    return ~expired_before(valid_to, as_of) & ~F.coalesce(valid_from > as_of, F.lit(False))


def age_basis(observed_at: Column, valid_from: Column) -> Column:
    return F.coalesce(observed_at, valid_from)


def number_text(value: Column) -> Column:
    """Numbers as text; integral doubles print as integers, so 149 and 149.0 are one."""
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def canonical_object(object_type: Column, string: Column, number: Column, day: Column, truth: Column, entity: Column) -> Column:
    """One string for an object of any type; equal strings are equal objects, and types never mix."""
    scalar = (
        F.when(object_type == "number", number_text(number))
        .when(object_type == "date", F.date_format(day, "yyyy-MM-dd"))
        .when(object_type == "boolean", truth.cast("string"))
        .otherwise(F.regexp_replace(string, r"(?U)^\s+|\s+$", ""))
    )
    return F.when(entity.isNotNull(), F.concat(F.lit("entity|"), entity)).otherwise(F.concat(F.lit("scalar|"), object_type, F.lit("|"), scalar))


def fold(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def severity_name(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, number in SEVERITY_RANK.items():
        out = F.when(rank == number, name).otherwise(out)
    return out


def ai_impact(severity: Column) -> Column:
    return F.when(severity == "warning", "low").otherwise(F.coalesce(severity, F.lit("unknown")))


def at_midday(day: Column) -> Column:
    return day.cast("timestamp") + F.expr("interval 12 hours")


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the compact JSON array of the parts."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def packed(text: Column) -> Column:
    """A text as bytes, half as many if it is hexadecimal; :func:`unpacked` gives it back. Equal texts have equal bytes, but their order may differ."""
    bare = F.unhex(text)
    return F.when(F.lower(F.hex(bare)) == text, F.concat(F.lit(b"\x01"), bare)).otherwise(F.concat(F.lit(b"\x00"), text.cast("binary")))


def unpacked(pack: Column) -> Column:
    rest = F.substring(pack, 2, 2147483647)
    return F.when(F.substring(pack, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def with_packed(frame: DataFrame, *columns: str) -> DataFrame:
    """A frame whose text ``columns`` travel as :func:`packed`; those that it lacks, or that are no text, stay."""
    return frame.withColumns({c: packed(F.col(c)) for c in columns if dict(frame.dtypes).get(c) == "string"})


def with_unpacked(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: unpacked(F.col(c)) for c in columns if dict(frame.dtypes).get(c) == "binary"})


def normalize_dimension(unit: Column) -> Column:
    """Full-width forms narrowed, no white space, lower case; empty is null."""
    return F.nullif(F.lower(F.regexp_replace(narrowed(unit), r"(?U)\s+", "")), F.lit(""))


def normalize_attribute_name(name: Column) -> Column:
    """Full-width forms narrowed, without white space and punctuation, in lower case."""
    return F.lower(F.regexp_replace(narrowed(name), r"(?U)[\s\p{P}]+", ""))


def confluence_key(name: Column, value_kind: Column, dimension: Column) -> Column:
    """The key under which attributes of one kind and dimension come together by name."""
    return F.concat_ws("|", value_kind, F.coalesce(dimension, F.lit("-")), normalize_attribute_name(name))


def scalar_text(object_type: Column, string: Column, number: Column, day: Column, truth: Column) -> Column:
    """A scalar as people read it: yes or no, a number without needless decimals, a date, else its text; nothing for null."""
    shown = F.when(object_type == "boolean", F.when(truth, "yes").otherwise("no")).when(object_type == "number", number_text(number)).when(object_type == "date", F.date_format(day, "yyyy-MM-dd")).otherwise(string)
    return F.coalesce(shown, F.lit(""))


def describe_object(entity_name: Column, scalar: Column) -> Column:
    """What a fact says: the name of an entity, else its scalar."""
    return F.coalesce(entity_name, scalar)


def normalize_entity_name(name: Column) -> Column:
    return fold(F.regexp_replace(name, r"(?U)\s+", " "))


def normalize_number(text: Column) -> Column:
    """A number from text with thousands separators; anything else is null."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), "[,，]", "")
    return F.when(bare.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))


def tax_compare(a: Column, b: Column) -> Column:
    return (
        F.when(a.isNull() & b.isNull(), "not_measure")
        .when(a.isNull() | b.isNull() | (a == "unknown") | (b == "unknown"), "missing")
        .when(a == b, "consistent")
        .otherwise("conflict")
    )


def measure_of(side: dict[str, Column]) -> dict[str, Column]:
    """A measure given as number, unit, currency and tax, with unit and currency in normal form: computed once before measures are compared in pairs."""
    currency = F.nullif(F.upper(F.regexp_replace(side["currency"], r"(?U)^\s+|\s+$", "")), F.lit(""))
    return {**side, "unit": normalize_dimension(side["unit"]), "currency": currency}


def measure_compare(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """:func:`measures_compared` of two measures as they are written."""
    return measures_compared(measure_of(a), measure_of(b))


def measures_compared(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """``struct(verdict, same_value)`` of two measures of :func:`measure_of`."""
    ua, ub, ca, cb = a["unit"], b["unit"], a["currency"], b["currency"]
    tax = tax_compare(a["tax"], b["tax"])
    verdict = (
        F.when(a["number"].isNull() | b["number"].isNull() | (ua.isNull() & ub.isNull()), "not_measure")
        .when(ua.isNull() | ub.isNull(), "missing")
        .when(ua != ub, "conflict")
        .when(F.coalesce(ca != cb, F.lit(False)), "conflict")
        .when(tax == "conflict", "conflict")
        .when(tax == "missing", "missing")
        .otherwise("consistent")
    )
    same = F.when(verdict.isin("missing", "consistent"), a["number"] == b["number"])
    return F.struct(verdict.alias("verdict"), same.alias("same_value"))


#: What parts the tokens of a name, how much two names must overlap, and characters that a name within another must have; fixed values.
NAME_SEPARATORS = r"(?U)[\s_\-/，,、()（）]+"
NAME_OVERLAP, NAME_CHARS = 0.6, 4


def name_tokens(name: Column) -> Column:
    parts = F.split(normalize_entity_name(name), NAME_SEPARATORS)
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def name_parts(name: Column) -> Column:
    """``struct(norm, tokens, chars)`` of a name, computed once before names are compared in pairs."""
    tokens = name_tokens(name)
    return F.struct(normalize_entity_name(name).alias("norm"), tokens.alias("tokens"), F.aggregate(tokens, F.lit(0), lambda s, t: s + F.length(t)).alias("chars"))


def parts_recall(a: Column, b: Column) -> Column:
    """Why two names, given as :func:`name_parts`, may be one entity's: equal, one within the other, or overlapping tokens; null if not."""
    ta, tb = a["tokens"], b["tokens"]
    common = F.size(F.array_intersect(ta, tb))
    first = F.size(ta) <= F.size(tb)
    small, chars = F.when(first, F.size(ta)).otherwise(F.size(tb)), F.when(first, a["chars"]).otherwise(b["chars"])
    inside = (small > 0) & (common == small) & (chars >= NAME_CHARS)
    overlap = common / F.nullif(F.size(ta) + F.size(tb) - common, F.lit(0))
    return F.when(a["norm"] == b["norm"], "exact_normalized_name").when(inside, "name_token_containment").when(overlap >= NAME_OVERLAP, "name_token_overlap")


def name_recall(a: Column, b: Column) -> Column:
    """:func:`parts_recall` of two names."""
    return parts_recall(name_parts(a), name_parts(b))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def vector_norm(x: Column) -> Column:
    """The length of a vector, computed once before vectors are compared in pairs."""
    return F.sqrt(dot(x, x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two vectors; 0 for a zero vector, missing vectors or unequal lengths."""
    norm = (vector_norm(a) if norm_a is None else norm_a) * (vector_norm(b) if norm_b is None else norm_b)
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), F.lit(0.0)).when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def squash(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def quote_supported(chunk: Column, quote: Column) -> Column:
    """Whether a quote occurs in a chunk, white space aside."""
    return F.coalesce(F.contains(squash(chunk), squash(quote)), F.lit(False))


#: Written forms of a date, with and without leading zeros; fixed values.
DATE_FORMS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyy年MM月dd日", "yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyy年M月d日")


def date_is_quoted(text: Column, day: Column) -> Column:
    """Whether any written form of a date occurs in a text, white space aside."""
    forms = [F.date_format(day, f) for f in DATE_FORMS]
    return F.coalesce(F.exists(F.array(*forms), lambda f: F.contains(squash(text), f)), F.lit(False))


def classify_valid_to(quote: Column, document: Column, valid_to: Column) -> Column:
    """Where the end of a validity window comes from; null without one."""
    return F.when(valid_to.isNull(), None).when(date_is_quoted(quote, valid_to), "quoted").when(date_is_quoted(document, valid_to), "document_scope").otherwise("calendar_derived")


def _blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)^\s*$"), F.lit(False))


def reject_reason(fact: dict[str, Column]) -> Column:
    """Why a candidate fact is invalid; null if it is valid.

    Values come as text with ``json_type``, the type that they had on the wire: string,
    number, boolean, other; where that is unknown it may be null, and is not checked.
    """
    entity, value, kind, wire = fact["object_entity"], fact["object_value"], fact["object_type"], fact["json_type"]
    measure = fact["unit"].isNotNull() | fact["currency"].isNotNull() | fact["tax_basis"].isNotNull()
    wrong = lambda *types: F.coalesce(~wire.isin(*types), F.lit(False))
    bad_date = lambda c: c.isNotNull() & normalize_date(c).isNull()
    return (
        F.when(fact["subject"].isNull() | _blank(fact["subject"]), "blank_subject")
        .when(fact["predicate"].isNull() | _blank(fact["predicate"]), "blank_predicate")
        .when(fact["quote"].isNull() | _blank(fact["quote"]), "blank_quote")
        .when(_blank(entity), "blank_object_entity")
        .when(_blank(fact["unit"]) | _blank(fact["currency"]), "blank_measure")
        .when(entity.isNotNull() & value.isNotNull(), "two_objects")
        .when(entity.isNull() & value.isNull(), "no_object")
        .when(entity.isNotNull() & kind.isNotNull(), "type_with_entity")
        .when(value.isNotNull() & kind.isNull(), "type_missing")
        .when(kind.isNotNull() & ~kind.isin("string", "number", "date", "boolean"), "type_unknown")
        .when(measure & ~F.coalesce(kind == "number", F.lit(False)), "unit_without_number")
        .when(F.coalesce(~fact["tax_basis"].isin("inclusive", "exclusive", "unknown"), F.lit(False)), "tax_basis_unknown")
        .when(fact["currency"].isNotNull() & fact["unit"].isNull(), "currency_without_unit")
        .when((kind == "string") & wrong("string"), "not_a_string")
        .when((kind == "number") & (wrong("number") | normalize_number(value).isNull()), "not_a_number")
        .when((kind == "boolean") & (wrong("boolean") | ~F.lower(value).isin("true", "false")), "not_a_boolean")
        .when((kind == "date") & (wrong("string") | bad_date(value)), "not_a_date")
        .when(bad_date(fact["valid_from"]) | bad_date(fact["valid_to"]) | bad_date(fact["observed_at"]), "bad_window_date")
        .when(F.coalesce(normalize_date(fact["valid_to"]) < normalize_date(fact["valid_from"]), F.lit(False)), "window_reversed")
        .when(F.coalesce((fact["confidence"] < 0) | (fact["confidence"] > 1), F.lit(False)), "confidence_out_of_range")
    )


def typed_objects(kind: Column, value: Column) -> dict[str, Column]:
    """A valid scalar given as text, in the column of its type."""
    return {
        "object_string": F.when(kind == "string", F.regexp_replace(value, r"(?U)^\s+|\s+$", "")),
        "object_number": F.when(kind == "number", normalize_number(value)),
        "object_date": F.when(kind == "date", normalize_date(value)),
        "object_bool": F.when(kind == "boolean", F.lower(value) == "true"),
    }


def normalize_date(text: Column) -> Column:
    """A date written as YYYY-MM-DD; anything else is null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text))
