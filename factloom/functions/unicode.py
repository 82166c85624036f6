"""Unicode normalisation, which Spark lacks: ASCII stays inside the JVM, the rest goes through Arrow."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from factloom.session import bound_batches

#: Full-width forms of ASCII and the wide space, by the rule that they lie 0xFEE0 above.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "


def narrowed(text: Column) -> Column:
    """Full-width letters, digits and signs as ASCII: the part of NFKC that units and names need, as a plain expression."""
    return F.translate(text, WIDE, NARROW)


def normalized(text: Column, form: str = "NFC") -> Column:
    """``text`` in a normal form, whole; ASCII is its own normal form and is not sent to Python."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"{form} is no normal form")

    # whole texts travel in the batches
    bound_batches(SparkSession.active())

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize(form, v), na_action="ignore")

    ascii_ = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_ | text.isNull(), text).otherwise(F.pandas_udf(run, "string")(F.when(~ascii_, text)))
