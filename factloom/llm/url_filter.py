"""URL filter: rules decide what they cover, gradient-boosted trees on lexical features decide the rest.

DataFrame operations and Spark ML only. The trees are trained on labelled URLs: a
sample, bounded by ``train_rows``, of the distinct URLs that carry a label, so that a
URL which many rows repeat counts once. Unless other labels are given, these are the
URLs that the rules decide. Features are lengths, depth, digit ratio, entropy, parameter
counts, and statistics of the host's suffix and of the leading path segment: how common
they are among all URLs, and how often they are blocked among the training URLs. For a
training URL these rates are taken from the half of the sample that it is not in.

Nulls and URLs without ``://`` have an empty host and path; no rule fits them. Repeated
rows are judged separately. Very long URLs are read whole. Labels that contradict each
other count as their mean, rounded to block. If no labelled URL exists, or all have one
label, what the rules leave open is given ``default``. Further columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.sqltext import ascii_lower
from factloom.session import ensure_checkpoint_dir, stored

TRAIN_ROWS = 20_000
#: Weight of the overall rate in the blocked rates of rare suffixes and segments.
PRIOR = 20.0
FEATURES = ["n_url", "n_host", "n_path", "depth", "labels", "digit_ratio", "upper_ratio", "entropy", "params", "query_len", "fragment", "secure", "extension", "hyphens", "longest", "suffix_common", "segment_common", "suffix_rate", "segment_rate"]


@dataclass(frozen=True)
class Rule:
    """``text`` is a host and a path prefix, like ``example.org/en/``; ``verdict`` is allow or block."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule whose host is the URL's or above it and whose path starts the URL's; among equally long the first in order. Null if none."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(rule.text)).otherwise(out)
    return out


def _ratio(part: Column, url: Column) -> Column:
    return F.coalesce(part / F.nullif(F.length(url), F.lit(0)), F.lit(0.0))


def _entropy(url: Column) -> Column:
    """Bits for each character of a URL, from the shares of its distinct characters."""
    distinct = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    n = F.length(url).cast("double")
    share = F.transform(distinct, lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n)
    return F.coalesce(F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p)), F.lit(0.0))


def lexical(pages: DataFrame, url_col: str, keep: list[str]) -> DataFrame:
    """Host, path, suffix, leading segment and the features that a URL shows by itself."""
    x = pages.select(*keep, F.coalesce(F.col(url_col), F.lit("")).alias("u"))
    x = x.withColumns({"host": host_of(F.col("u")), "path": path_of(F.col("u"))})
    query = F.regexp_extract("u", r"(?s)\?([^#]*)", 1)
    u = F.col("u")
    return x.withColumns(
        {
            "suffix": F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1),
            "segment": F.regexp_extract("path", r"^/([^/]*)", 1),
            "n_url": F.length(u).cast("double"),
            "n_host": F.length("host").cast("double"),
            "n_path": F.length("path").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "digit_ratio": _ratio(F.length(F.regexp_replace(u, "[^0-9]", "")), u),
            "upper_ratio": _ratio(F.length(F.regexp_replace(u, "[^A-Z]", "")), u),
            "entropy": _entropy(u),
            "params": F.size(F.filter(F.split(query, "&"), lambda s: s != "")).cast("double"),
            "query_len": F.length(query).cast("double"),
            "fragment": F.contains(u, F.lit("#")).cast("double"),
            "secure": u.startswith("https://").cast("double"),
            "extension": F.length(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).cast("double"),
            "hyphens": F.length(F.regexp_replace(u, "[^-_]", "")).cast("double"),
            "longest": F.coalesce(F.array_max(F.transform(F.split("path", "/"), lambda s: F.length(s))), F.lit(0)).cast("double"),
        }
    ).drop("u")


def _common(urls: DataFrame, key: str) -> DataFrame:
    """How common each value of ``key`` is among all URLs."""
    return urls.groupBy(key).agg(F.log1p(F.count("*").cast("double")).alias(f"{key}_common"))


def _rates(train: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The blocked training URLs of each value of ``key``, and all of them."""
    return train.groupBy(key, *by).agg(F.sum("label").alias("b"), F.count("*").alias("c"))


def _smoothed(overall: Column) -> Column:
    return (F.coalesce("b", F.lit(0.0)) + overall * PRIOR) / (F.coalesce("c", F.lit(0)) + PRIOR)


def _statistics(urls: DataFrame, train: DataFrame, key: str, overall: float) -> DataFrame:
    """How common each value of ``key`` is among all URLs, and its smoothed rate of blocked training URLs."""
    x = _common(urls, key).join(_rates(train, key, []), key, "left")
    return stored(x.select(key, f"{key}_common", _smoothed(F.lit(overall)).alias(f"{key}_rate")), f"{key}-statistics")


def _crossed(train: DataFrame, statistics: dict[str, DataFrame], overall: float) -> DataFrame:
    """Training URLs with the statistics of their values; each half has the rates of the other, so no URL tells its own label."""
    for key, stats in statistics.items():
        other = _rates(train, key, ["half"]).withColumn("half", 1 - F.col("half"))
        train = train.join(other, [key, "half"], "left").withColumn(f"{key}_rate", _smoothed(F.lit(overall))).drop("b", "c").join(stats.drop(f"{key}_rate"), key, "left")
    return train


@dataclass
class UrlModel:
    """A fitted model with the statistics that its features need."""

    statistics: dict[str, DataFrame]
    trees: GBTClassificationModel | None

    def features(self, lexical_rows: DataFrame) -> DataFrame:
        for key, stats in self.statistics.items():
            lexical_rows = lexical_rows.join(stats, key, "left")
        return lexical_rows

    def score(self, lexical_rows: DataFrame) -> DataFrame:
        """``lexical_rows`` with ``p_block``, the probability of being blocked; null without trees."""
        if self.trees is None:
            return lexical_rows.withColumn("p_block", F.lit(None).cast("double"))
        assembled = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(self.features(lexical_rows))
        scored = self.trees.transform(assembled)
        return scored.withColumn("p_block", vector_to_array("probability")[1])


def fit(urls: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS, trees: int = 15, depth: int = 4) -> UrlModel:
    """Fit on a sample of ``labelled`` (lexical rows with ``label`` 1 for block), chosen by hash and bounded by ``train_rows``."""
    spark = urls.sparkSession
    own = ["host", "path", "suffix", "segment", *[f for f in FEATURES if not f.endswith(("_common", "_rate"))]]
    # a row for each distinct URL, as far as features tell
    distinct = labelled.where("label is not null").groupBy(*own).agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    distinct = stored(distinct, "distinct-urls")
    n = distinct.count()
    parts = 1_000_000
    drawn = F.xxhash64("host", "path", "n_url", "query_len")
    chosen = F.pmod(drawn, F.lit(parts)) < F.lit(min(parts, parts * train_rows // max(n, 1)))
    train = stored(distinct.where(chosen).withColumn("half", F.pmod(F.xxhash64(drawn, F.lit(1)), F.lit(2)).cast("int")), "labelled-urls")
    found = train.agg(F.avg("label"), F.count_distinct("label")).first()
    overall = 0.5 if found[0] is None else found[0]
    model = UrlModel({key: _statistics(urls, train, key, overall) for key in ("suffix", "segment")}, None)
    if found[1] < 2:
        return model
    ensure_checkpoint_dir(spark)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(_crossed(train, model.statistics, overall)).select("features", "label")
    model.trees = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, checkpointInterval=-1).fit(stored(rows, "url-features").coalesce(4))
    return model


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None, train_rows: int = TRAIN_ROWS, default: str = "allow") -> DataFrame:
    """``id_col, host, path, rule, verdict, score`` for every row; ``score`` is the trees' probability of blocking.

    ``labels``, if given, has a URL column and ``label`` (1: block) and replaces the rules' verdicts as training data.
    """
    urls = lexical(pages, url_col, [F.col(id_col).alias("id")])
    urls = urls.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    verdict_of = F.lit(None).cast("string")
    for rule in rules:
        verdict_of = F.when(F.col("rule") == rule.text, rule.verdict).otherwise(verdict_of)
    urls = urls.withColumn("decided", verdict_of)
    if labels is None:
        labelled = urls.where("rule is not null").withColumn("label", (F.col("decided") == "block").cast("double"))
    else:
        labelled = lexical(labels, url_col, [F.col("label").cast("double").alias("label")])
    scored = fit(urls, labelled, train_rows).score(urls)
    method = F.when(F.col("p_block") >= 0.5, "block").when(F.col("p_block") < 0.5, "allow").otherwise(default)
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), F.col("p_block").alias("score"))
