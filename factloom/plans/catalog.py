"""Every query of the core library, by name, with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import projection as P
from factloom.functions import exprs as X
from factloom.functions import text as T
from factloom.operators import attributes, detect, evaluate, extract, remember, versions
from factloom.plans import oracles
from factloom.rules import RuleContext
from factloom.session import table
from factloom.sources import files

FLAGSHIP = "conflict_scored"
CTX = P.RULES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _conflicts(s: SparkSession, d: str, ctx: RuleContext = CTX) -> DataFrame:
    return detect.conflicts(P.facts(s, d), P.documents(s, d), ctx).drop("old_document_id", "new_document_id")


def _stale(s: SparkSession, d: str) -> DataFrame:
    return detect.stale(P.facts(s, d), P.documents(s, d), CTX).drop("predicate", "valid_to", "valid_to_anchor")


def _superseded(s: SparkSession, d: str) -> DataFrame:
    return detect.superseded(P.documents(s, d), CTX)


@query
def conflict_pairs(s, d):
    return _conflicts(s, d).select("subject_id", "old_fact_id", "new_fact_id", "old_value", "new_value")


@query
def conflict_scored(s, d):
    return _conflicts(s, d)


@query
def conflict_multi_valued_excluded(s, d):
    return _conflicts(s, d, replace(CTX, multi_valued=frozenset({" QTY_R "})))


@query
def superseded_docs(s, d):
    return _superseded(s, d)


@query
def chain_components(s, d):
    return versions.components(P.documents(s, d))


@query
def chain_heads(s, d):
    return versions.heads(P.documents(s, d))


@query
def chain_distance(s, d):
    return versions.distances(P.documents(s, d))


@query
def confirmed_stale(s, d):
    return _stale(s, d).where("drift_type = 'confirmed_stale'")


@query
def possibly_stale_inferred(s, d):
    return _stale(s, d).where("reason = 'inferred_validity_expired'")


@query
def possibly_stale_age(s, d):
    return _stale(s, d).where("reason = 'age_over_threshold'")


@query
def age_suppression(s, d):
    return detect.age_suppressed(P.facts(s, d), P.documents(s, d), CTX)


@query
def document_self_declared_expired(s, d):
    everything = P.facts(s, d).unionByName(P.statements(s, d), allowMissingColumns=True)
    return detect.expired_documents(everything, P.documents(s, d), CTX).select("drift_type", "doc_id", "fact_id", "severity", "effective_at", "fingerprint")


@query
def reused_stale_value(s, d):
    return detect.reused_values(P.facts(s, d), P.documents(s, d), CTX).drop("predicate", "measure_unit")


@query
def holders_df(s, d):
    return detect.holders(P.entity_facts(s, d))


@query
def shared_fact_pairs(s, d):
    return detect.shared_fact_pairs(P.entity_facts(s, d))


@query
def duplicate_findings(s, d):
    return detect.duplicates(P.entities(s, d), P.entity_facts(s, d), exact=True)


#: No two vectors of the tables reach the usual 0.85.
LEAST_COSINE = 0.3


@query
def duplicate_findings_all_recall(s, d):
    return detect.duplicates(P.entities(s, d), P.entity_facts(s, d), least_cosine=LEAST_COSINE)


@query
def name_recall(s, d):
    """Part names, short and with their type, as entities whose names alone recall each other."""
    p = table(s, d, "part")
    names = p.select("p_name").unionAll(p.select(F.concat("p_name", F.lit("-"), "p_type", F.lit(" (Plan)")))).distinct()
    return detect.name_pairs(names.select(F.col("p_name").alias("entity_id"), F.initcap("p_name").alias("name")))


@query
def cosine_recall(s, d):
    """Parts that share facts and have vectors, by their vectors alone."""
    vectors = P.entities(s, d).where("embedding is not null").withColumn("name", F.col("entity_id").cast("string"))
    return detect.shared_fact_pairs(P.entity_facts(s, d), vectors, LEAST_COSINE).where("recall = 'embedding_similarity'").select("a", "b")


@query
def fingerprint(s, d):
    """Fingerprints over text with quotes, line ends and every alphabet."""
    return table(s, d, "documents").select("doc_id", X.fingerprint(F.lit("conflict"), F.col("doc_id"), F.substring("text", 1, 60)).alias("fingerprint"))


@query
def known_suppression(s, d):
    found = _conflicts(s, d)
    return remember.new_findings(found, found.where("severity = 'critical'")).groupBy("subject_id").agg(F.count("*").alias("new_findings"))


@query
def second_scan_zero(s, d):
    """What a scan finds anew after one of a year before: nothing that was known, each new finding once."""
    before = detect.stale(P.facts(s, d), P.documents(s, d), replace(CTX, as_of=CTX.as_of.replace(year=CTX.as_of.year - 1)))
    found = _stale(s, d)
    return remember.new_findings(found.unionAll(found), before).groupBy("drift_type").agg(F.count("*").alias("new_findings"))


def _statuses(s, d):
    """Findings with a decision log: fingerprints from 0 to 4 are ignored, from 5 to 9 resolved, others open."""
    found = _superseded(s, d)
    first = F.substring("fingerprint", 1, 1)
    log = found.where(first <= "9").select("fingerprint", F.lit(1).cast("bigint").alias("at"), F.when(first >= "5", "resolve").otherwise("ignore").alias("action"), F.when(first >= "5", "accept_newer").alias("decision"))
    return remember.latest_status(found, log)


def _log(s, d):
    """Findings of conflicts, and entries of a decision log, some of which are faulty, late or repeated."""
    found = _conflicts(s, d)
    k = F.conv(F.substring("fingerprint", 1, 2), 16, 10).cast("int")
    entry = lambda at, action, decision, authority=F.lit(None), code=F.lit(None): F.struct(F.lit(at).cast("bigint").alias("at"), F.lit(action).alias("action"), F.lit(decision).alias("decision"), authority.cast("string").alias("authority_fact"), code.cast("string").alias("reason_code"))
    entries = (
        F.when(k < 60, F.array(entry(1, "resolve", "accept_newer"), entry(2, "ignore", None)))
        .when(k < 100, F.array(entry(2, "ignore", None), entry(1, "resolve", "keep_old", code=F.lit("still_valid"))))
        .when(k < 140, F.array(entry(1, "ignore", None), entry(2, "resolve", "keep_old"), entry(3, "ignore", None)))
        .when(k < 170, F.array(entry(1, "resolve", "guess"), entry(2, "resolve", "manual_override", authority=F.col("old_fact_id"))))
        .when(k < 200, F.array(entry(1, "resolve", "keep_old", authority=F.lit("no fact of it")), entry(2, "resolve", "keep_old", code=F.lit("no code"))))
        .otherwise(F.array().cast("array<struct<at:bigint,action:string,decision:string,authority_fact:string,reason_code:string>>"))
    )
    return found, found.select("fingerprint", F.explode(entries).alias("e")).select("fingerprint", "e.*")


@query
def decision_authority(s, d):
    found, log = _log(s, d)
    return remember.latest_status(found, log).select("fingerprint", "status", "decision", "authority_fact")


@query
def decision_problems(s, d):
    found, log = _log(s, d)
    return remember.judged_log(found, log).select("fingerprint", "at", "action", "problem")


@query
def drift_status_latest(s, d):
    return _statuses(s, d).select("fingerprint", "status", "decision")


@query
def ci_gate(s, d):
    return remember.blocking(_statuses(s, d), "critical")


@query
def by_type_rollup(s, d):
    return remember.counts_by(_stale(s, d).select("drift_type").unionAll(_superseded(s, d).select("drift_type")), "drift_type")


@query
def drift_list_order(s, d):
    """The first page of the list: 50 findings."""
    page = remember.ordered(_superseded(s, d), 50)
    w = Window.orderBy(X.severity_rank(F.col("severity")).desc(), F.col("effective_at").asc_nulls_first(), "fingerprint")
    return page.select("fingerprint", "severity", F.row_number().over(w).alias("place"))


@query
def snapshot_membership(s, d):
    return remember.snapshot_membership(P.facts(s, d))


@query
def knowledge_hash(s, d):
    return remember.knowledge_hash(remember.fact_records(P.facts(s, d), P.entities(s, d)))


@query
def stale_rollup_groups(s, d):
    return remember.stale_groups(_stale(s, d))


@query
def evidence_dedup(s, d):
    c = table(s, d, "conversations").select(F.col("conv_id").alias("chunk_id"), F.col("text").alias("quote"), F.col("turn").alias("ord"))
    return remember.first_evidence(c)


@query
def token_estimate(s, d):
    return table(s, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query
def fact_hash(s, d):
    return P.facts(s, d).select("fact_id", "subject_id", "canon_object")


def _suite(s, d):
    """Documents as cases: bad ones expect a finding, and texts below a length, or of a language, have one."""
    x = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select(F.col("doc_id").cast("string").alias("case_id"), "lang", "n_chars", "quality", "source")
    names = x.select("case_id", F.when(F.col("quality") == 0, "positive").when(F.col("lang") == "en", "ambiguous_negative").otherwise("negative").alias("category"))
    locators = {n: F.lit(None).cast("string") for n in evaluate.LOCATORS}
    wanted = x.where("quality = 0").select("case_id", F.lit("0000").alias("expected_id"), F.lit("possibly_stale").alias("drift_type")).withColumns({**locators, "predicate": F.lit("TEXT")})
    kinds = F.filter(F.array(F.when(F.col("n_chars") < 600, "possibly_stale"), F.when(F.col("lang") == "de", "conflict")), lambda k: k.isNotNull())
    found = x.select("case_id", F.explode(kinds).alias("drift_type")).select("case_id", F.concat_ws("-", "case_id", "drift_type").alias("finding_id"), "drift_type").withColumns({**locators, "predicate": F.lit("text")})
    matches = evaluate.match_findings(wanted, found)
    missed = wanted.join(matches.where("finding_id is null").select("case_id", "expected_id"), ["case_id", "expected_id"], "left_semi")
    unexpected = found.join(matches.where("finding_id is not null").select("case_id", "finding_id"), ["case_id", "finding_id"], "left_anti")
    return evaluate.suite_metrics(names, wanted, missed, found, unexpected)


@query
def suite_metrics(s, d):
    """By drift type."""
    return _suite(s, d)[2]


@query
def suite_categories(s, d):
    return _suite(s, d)[3]


@query
def gate(s, d):
    return _suite(s, d)[1]


@query
def measure_compare(s, d):
    cents = F.round(F.col("l_tax") * 100).cast("int")
    x = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("number"), F.when(F.col("l_returnflag") == "A", " Box").when(F.col("l_returnflag") == "R", "ｂｏｘ　").when(cents != 2, "unit").alias("unit"),
        F.when(F.col("l_linestatus") == "O", "EUR").when(cents > 5, " eur").when(cents > 3, "CHF").alias("currency"), _tax().alias("tax"),
    )
    side = lambda a: {c: F.col(f"{a}.{c}") for c in ("number", "unit", "currency", "tax")}
    x = x.select("k", "n", *[c.alias(name) for name, c in X.measure_of({c: F.col(c) for c in ("number", "unit", "currency", "tax")}).items()])
    both = x.alias("x").join(x.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.n") < F.col("y.n")))
    v = X.measures_compared(side("x"), side("y"))
    return both.select("x.k", F.col("x.n").alias("n1"), F.col("y.n").alias("n2"), v["verdict"].alias("verdict"), v["same_value"].alias("same_value"))


def _tax():
    """A tax basis for a line, by its tax; some have none."""
    cents = F.round(F.col("l_tax") * 100).cast("int")
    return F.when(cents < 3, "inclusive").when(cents < 5, "exclusive").when(cents < 7, "unknown")


@query
def tax_compare(s, d):
    x = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), _tax().alias("t"))
    both = x.alias("x").join(x.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.n") < F.col("y.n")))
    return both.select("x.k", F.col("x.n").alias("n1"), F.col("y.n").alias("n2"), X.tax_compare(F.col("x.t"), F.col("y.t")).alias("verdict"))


@query
def normalize_dimension(s, d):
    """Units with odd spaces, full-width signs and blank ones, and the names of attributes in them."""
    unit = F.when(F.col("p_size") % 5 == 0, F.lit(" 　 ")).otherwise(F.concat(F.lit(" "), F.col("p_type"), F.lit("　／ "), F.translate(F.col("p_brand"), "#0123456789", "＃０１２３４５６７８９"), F.lit("\t")))
    return table(s, d, "part").select("p_partkey", X.normalize_dimension(unit).alias("dimension"), X.confluence_key(unit, F.lit("measure"), X.normalize_dimension(unit)).alias("canonical_key"))


@query
def normalize_number(s, d):
    shown = F.concat(F.lit(" "), F.format_number(F.round(F.col("value") * 100).cast("bigint") / 100, 2), F.lit(" "))
    return table(s, d, "events").select("event_id", X.normalize_number(shown).alias("number"))


def _resolution(s, d):
    f, docs = P.facts(s, d), P.documents(s, d)
    return f, docs, attributes.resolve(f, docs, *P.clusters(s, d))


@query
def attribute_bindings(s, d):
    return _resolution(s, d)[2].bindings


@query
def rejected_merges(s, d):
    return _resolution(s, d)[2].rejected


@query
def shard_descriptors(s, d):
    docs = P.documents(s, d)
    x = attributes.shard_descriptors(attributes.eligible(P.facts(s, d), docs), docs)
    return x.select("subject_id", "pred_fold", "predicate", F.array_join("samples", "; ").alias("samples"), F.size("source_docs").alias("docs"))


@query
def pack_shards(s, d):
    """Requests of up to seven predicates."""
    docs = P.documents(s, d)
    x = attributes.shard_descriptors(attributes.eligible(P.facts(s, d), docs), docs)
    return attributes.pack_shards(x, P.entities(s, d).select(F.col("entity_id").alias("subject_id"), "name"), 7)


_ITEM = ["subject_id", "fact_a", "fact_b", "kind", "reason"]


@query
def conflict_channels_identity_a(s, d):
    f, docs, r = _resolution(s, d)
    return attributes._items(attributes.same_predicate_pairs(f, docs, CTX, r)).select(*_ITEM)


@query
def conflict_channels_identity_b(s, d):
    f, docs, r = _resolution(s, d)
    return attributes.merged_channels(f, docs, CTX, r).select(*_ITEM, "canonical_name")


@query
def cross_attribute_scan(s, d):
    f, docs, r = _resolution(s, d)
    return attributes.cross_channels(f, docs, CTX, r).select(*_ITEM)


def _talk(s, d):
    """Conversation turns as string facts of their conversation's class."""
    c = table(s, d, "conversations")
    return c.select((F.col("conv_id") % 40).alias("subject_id"), F.col("role").alias("pred_fold"), F.lit("string").alias("object_type"), F.substring("text", 1, (F.col("turn") * 9 + 6).cast("int")).alias("object_string"))


@query
def free_text_predicates(s, d):
    return attributes.free_text_predicates(_talk(s, d))


@query
def text_equivalence(s, d):
    """Orders of a customer whose priorities are said to mean the same, in either order and whatever their spaces and case."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("subject_id"), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.lower(F.replace("o_orderpriority", F.lit("-"), F.lit(" - ")))).alias("v"))
    a, b = o.alias("a"), o.alias("b")
    pairs = a.join(b, (F.col("a.subject_id") == F.col("b.subject_id")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey"))).select("a.subject_id", F.col("a.o_orderkey").alias("a"), F.col("b.o_orderkey").alias("b"), F.col("a.v").alias("va"), F.col("b.v").alias("vb"))
    same = o.select("subject_id").distinct().select("subject_id", F.lit("1-urgent").alias("a"), F.lit("2-high").alias("b"))
    return attributes.texts_equivalent(pairs, same, F.col("va"), F.col("vb")).select("subject_id", "a", "b", "texts_equivalent")


def _order_facts(s, d):
    """A candidate fact for each order, with a quote that may name its date in one of three ways."""
    o = table(s, d, "orders")
    day = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey") % 3
    quote = F.when(k == 0, F.concat(F.lit("valid until "), F.date_format(day, "yyyy / MM/dd"))).when(k == 1, F.lit("see the notice")).otherwise(F.lit("no date"))
    text = F.when(k == 1, F.concat(F.lit("ends on "), F.date_format(day, "yyyy年M月d日"))).otherwise(F.lit("general terms"))
    return o.select(F.col("o_orderkey").alias("doc_id"), day.alias("valid_to"), quote.alias("quote"), text.alias("text"), "o_custkey", "o_orderstatus", "o_orderpriority")


@query
def valid_to_anchor_class(s, d):
    x = _order_facts(s, d)
    return extract.with_anchor(x.select("doc_id", "valid_to", "quote"), x.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").select("doc_id", "valid_to", "valid_to_anchor")


@query
def anchor_replay(s, d):
    x = _order_facts(s, d)
    return extract.anchor_counts(extract.with_anchor(x.select("doc_id", "valid_to", "quote"), x.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id"))


@query
def evidence_anchor(s, d):
    """Conversation turns as quotes, their texts without white space as chunks of the same turn."""
    c = table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("text"), "role")
    chunks = c.select("chunk_id", F.concat(F.lit("  x "), F.regexp_replace("text", " ", "\n"), F.lit(" y")).alias("text"), F.col("text").alias("t")).groupBy("chunk_id").agg(F.min_by("text", "t").alias("text"))
    facts = c.select("chunk_id", F.when(F.col("role") == "user", F.concat(F.lit(" "), F.col("text"))).otherwise(F.concat("text", F.lit("?!"))).alias("quote"))
    return extract.with_evidence(facts, chunks).select("chunk_id", "quote_warning", F.sha2("evidence", 256).alias("evidence"))


@query
def review_date_propagation(s, d):
    """Orders of a customer as one chunk: reviews are dated, some by several dates, effective dates do not count."""
    o = table(s, d, "orders")
    k = F.col("o_orderkey") % 6
    predicate = F.when(k == 0, "Last Reviewed").when(k == 1, "复核日期").when(k == 2, "review of effective date").otherwise("amount")
    day = F.date_format(F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderdate")).otherwise(F.lit("1997-05-05").cast("timestamp")), "yyyy-MM-dd")
    facts = o.select(
        F.col("o_custkey").alias("chunk_id"), F.col("o_orderkey").alias("ord"), F.when(k % 2 == 0, " Order ").otherwise("order").alias("subject"), predicate.alias("predicate"),
        F.when(k < 3, "date").otherwise("number").alias("object_type"), F.when(k < 3, day).otherwise("5").alias("object_value"), F.when(k == 5, "1990-01-01").alias("observed_at"),
    )
    return extract.propagate_review_dates(facts).select("chunk_id", "ord", "observed_at")


@query
def fact_validation(s, d):
    """Order lines as candidates, most of which break a rule."""
    x = table(s, d, "lineitem")
    k = F.col("l_quantity").cast("int") % 16
    null = F.lit(None).cast("string")
    at = F.date_format("l_shipdate", "yyyy-MM-dd")
    facts = x.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", F.when(k == 0, "  ").otherwise("s").alias("subject"), F.lit("p").alias("predicate"), F.when(k == 1, "").otherwise("q").alias("quote"), F.when(k.isin(2, 3, 4), "thing").alias("object_entity"),
        F.when(k.isin(2, 3, 5), null).when(k == 6, "1e3x").when(k == 7, "2024-02-30").when(k == 8, "yes").otherwise("1,500").alias("object_value"),
        F.when(k == 3, null).when(k == 5, null).when(k == 4, null).when(k == 2, "string").when(k == 7, "date").when(k == 8, "boolean").when(k == 9, "string").when(k == 10, "list").otherwise("number").alias("object_type"), null.alias("json_type"),
        F.when(k.isin(9, 11), "kg").alias("unit"), F.when(k == 12, "EUR").alias("currency"), F.when(k == 13, "sometimes").alias("tax_basis"), F.when(k == 14, F.lit("14.3.2024")).otherwise(at).alias("valid_from"),
        F.when(k == 15, F.date_format(F.date_add("l_shipdate", -1), "yyyy-MM-dd")).alias("valid_to"), null.alias("observed_at"), F.lit(0.5).alias("confidence"),
    )
    good, bad = extract.validated(facts)
    key = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"]
    return good.select(*key, F.lit("valid").alias("verdict")).unionAll(bad.select(*key, "reject_reason")).distinct()


@query
def entity_references(s, d):
    """Names that are declared in their chunk, known by an alias, ambiguous or unknown."""
    p = table(s, d, "part")
    raw = p.select(
        (F.col("p_partkey") % 100).alias("chunk_id"), F.col("p_partkey").alias("ord"), F.concat(F.lit("Thing "), F.col("p_partkey")).alias("name"), F.lit("team").alias("type"),
        F.array(F.concat(F.lit("T"), F.col("p_partkey")), F.concat(F.lit("group "), F.col("p_size"))).alias("aliases"),
    )
    resolved = extract.resolve_entities(raw)
    k = F.col("p_partkey") % 4
    facts = p.select(F.col("p_partkey").alias("fact"), (F.col("p_partkey") % 100).alias("chunk_id"), F.when(k == 0, F.concat(F.lit(" THING  "), F.col("p_partkey"))).when(k == 1, F.concat(F.lit("t"), F.col("p_partkey") - 1)).when(k == 2, F.concat(F.lit("Group "), F.col("p_size"))).otherwise(F.concat(F.lit("nobody "), F.col("p_size"))).alias("subject"))
    return extract.resolve_references(facts, resolved).select("fact", "subject_kind", "subject_id")


@query
def fact_dedup(s, d):
    """Orders as facts by customer, status and priority; finished ones are known."""
    x = _order_facts(s, d).select("o_custkey", "o_orderstatus", "o_orderpriority")
    key = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return extract.new_facts(x, x.where("o_orderstatus = 'F'"), key)


@query
def entity_ladder(s, d):
    """Parts as mentions: names fold to entities within a class of types."""
    p = table(s, d, "part")
    raw = p.select(F.col("p_partkey").alias("chunk_id"), F.lit(0).alias("ord"), F.concat(F.lit(" "), F.initcap("p_name"), F.lit("  ")).alias("name"), F.when(F.col("p_size") < 20, "Product").when(F.col("p_size") < 40, "plan").otherwise("team").alias("type"))
    return extract.resolve_entities(raw).select("chunk_id", "entity_id")


@query
def match_findings(s, d):
    """Conversations as cases: expectations are user turns, findings assistant turns."""
    c = table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("case_id"), "turn", "role")
    null = {n: F.lit(None).cast("string") for n in evaluate.LOCATORS}
    e = c.where("role = 'user'").select("case_id", F.format_string("%05d", "turn").alias("expected_id"), F.lit("conflict").alias("drift_type")).withColumns(null).dropDuplicates(["case_id", "expected_id"])
    f = c.where("role <> 'user'").select("case_id", F.format_string("%05d", "turn").alias("finding_id"), F.lit("conflict").alias("drift_type")).withColumns(null).dropDuplicates(["case_id", "finding_id"])
    return evaluate.match_findings(e, f)


@query
def hcr_score(s, d):
    """Labelled documents as reported findings: good ones are confirmed, those that are not toxic actionable."""
    x = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    return evaluate.confirmed_rate(x.select(F.col("lang").alias("drift_type"), F.when(F.col("quality") == 1, "confirmed").alias("verdict"), (F.col("toxic") == 0).alias("actionable")))


@query
def normalize_text(s, d):
    """Documents with line ends and spaces that must go, and letters in parts that must be put together."""
    odd = F.concat(F.lit("\r\n 　"), F.replace("text", F.lit("\n"), F.lit("  \r\n\t")), F.lit("\r\rcafe\u0301 \xa0"))
    return table(s, d, "documents").select("doc_id", F.sha2(T.normalize_text(odd), 256).alias("sha256"))


@query
def paragraphs(s, d):
    return T.paragraphs(table(s, d, "documents"))


@query
def paragraph_places(s, d):
    """Paragraphs with their places: what stands there is the paragraph, but for spaces at the ends of lines."""
    x = table(s, d, "documents").select("doc_id", F.concat(F.lit(" \n"), F.col("text")).alias("t"))
    x = x.select("doc_id", "t", F.posexplode(T.paragraph_spans(F.col("t"))).alias("paragraph", "b"))
    return x.select("doc_id", "paragraph", "b.offset_start", "b.offset_end", F.md5("b.text").alias("text"))


@query
def content_hash(s, d):
    """Paragraphs of documents as blocks."""
    block = lambda t, i: F.struct(F.lit(None).cast("int").alias("page"), i.alias("paragraph"), t.alias("text"))
    return table(s, d, "documents").select("doc_id", T.content_hash(F.transform(T.paragraph_texts(F.col("text")), block)).alias("content_hash"))


@query
def chunk_greedy(s, d):
    return T.chunk_lines(table(s, d, "documents")).select("doc_id", "chunk_index", "token_count", F.md5("text").alias("text"), F.size("block_indexes").alias("blocks"))


@query
def long_line_windows(s, d):
    return T.long_line_windows(table(s, d, "documents"), 128, 16).withColumn("text", F.md5("text"))


@query
def ignore_filter(s, d):
    """Pages by the paths in their addresses."""
    path = F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1)
    return table(s, d, "pages").select("page_id", files.is_ignored(path, ["*.org/es/**", "**/[1-4]?", "*/fr/*"]).alias("ignored"))


@query
def ingest_skip(s, d):
    """Documents as files: a third is parsed already, a third has failed before."""
    x = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    known = x.where("doc_id % 3 < 2").select("file_hash", F.when(F.col("doc_id") % 3 == 0, "parsed").otherwise("failed").alias("status"))
    return files.pending(x, known).select("file_hash")


def _links(s, d):
    """Editions of suppliers as files in two folders, and a list of versions that names some by path, some by name, some wrongly."""
    x = P.documents(s, d).select(F.concat(F.when(F.col("doc_id") % 2 == 0, "a/").otherwise("b/"), "filename").alias("path"), "doc_id", "filename")
    docs = x.select("path", "doc_id").unionAll(x.where("doc_id % 7 = 0").select(F.concat(F.lit("c/"), "filename"), F.col("doc_id") + 10**9))
    newer = x.select(F.col("doc_id").alias("n"), F.col("filename").alias("older"))
    mapping = x.withColumn("n", F.col("doc_id") + 1).join(newer, "n", "left")
    k = F.col("doc_id") % 3
    named = F.when(k == 0, F.col("path")).when(k == 1, F.col("filename")).otherwise(F.concat(F.lit("z/"), "filename"))
    return docs, mapping.select(F.concat(F.lit("g"), F.floor(F.col("doc_id") / 10000)).alias("group"), F.lit(0).alias("ord"), named.alias("path"), F.col("doc_id").cast("string").alias("label"), F.col("older").alias("supersedes"))


@query
def version_links(s, d):
    return files.version_links(*_links(s, d))[0]


@query
def version_warnings(s, d):
    return files.version_links(*_links(s, d))[1]


ORACLES: dict[str, str] = oracles.ORACLES
