"""Rule settings, closed vocabularies and their ranks. Fixed values of the data model."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITY_RANK = {"warning": 1, "medium": 2, "high": 3, "critical": 4}
FAIL_ON_RANK = {"none": 0, **SEVERITY_RANK}
DRIFT_TYPES = ("conflict", "possibly_stale", "confirmed_stale", "reused_stale_value", "superseded", "duplicate")
DRIFT_STATUS = ("open", "ignored", "resolved")
DECISIONS = ("accept_newer", "keep_old", "manual_override", "false_positive")
REASON_CODES = ("source_updated", "newer_version", "duplicate_confirmed", "still_valid", "lower_authority", "multi_valued", "extraction_error", "detector_noise", "manual", "other")
CHANNELS = ("pending_review", "cross_attribute_review", "normalized_equivalent")
VALUE_KINDS = ("measure", "enumeration", "text", "date", "boolean", "entity_ref")
TRUSTED_ANCHORS = ("quoted",)
INFERRED_ANCHORS = ("document_scope", "calendar_derived")
CONFIDENCE_STRUCTURAL, CONFIDENCE_RECALL, CONFIDENCE_HEURISTIC = 0.95, 0.90, 0.60

#: Predicates of a document's own identity, which stay true of it for ever; fixed values, and a setting.
IMMUTABLE_PREDICATES = (
    "文件编号", "版本", "产品编码", "生效日期", "施行日期", "施行起始日", "发布日期", "制单日期", "废止日期",
    "有效期至", "报价含税", "制单部门", "发布部门", "编制部门", "审核人", "到期后执行版本", "解释权归属",
)
#: Predicates that state when a document itself ends: what they begin with, and whole ones. Fixed values, and settings.
STATEMENT_PREFIXES = ("有效期",)
STATEMENT_PREDICATES = ("失效日期", "截止日期", "到期日期")
#: Entity type labels that name the same kind of thing; fixed values.
OFFERING_TYPES = ("product", "service", "sku", "item", "plan", "offering", "package", "subscription", "产品", "服务", "套餐", "商品")
#: What the predicate of a review date contains, and what it may not contain; fixed values.
REVIEW_MARKERS = ("复核", "复审", "审核", "审阅", "确认有效", "确认仍", "review")
REVIEW_EXCLUSIONS = ("生效", "发布", "执行", "实施", "开始", "起始", "有效期", "valid", "effective", "publish", "start")


def _folded(names) -> frozenset[str]:
    return frozenset(n.strip().lower() for n in names)


@dataclass(frozen=True)
class RuleContext:
    """What the detectors need besides the frames. Predicates are compared folded."""

    as_of: date
    stale_after_days: int = 365
    pricing_stale_days: int | None = None
    severity: dict[str, str] = field(default_factory=dict)
    multi_valued: frozenset[str] = frozenset()
    immutable: frozenset[str] = frozenset(IMMUTABLE_PREDICATES)
    statement_prefixes: tuple[str, ...] = STATEMENT_PREFIXES
    statement_predicates: tuple[str, ...] = STATEMENT_PREDICATES

    def __post_init__(self) -> None:
        object.__setattr__(self, "multi_valued", _folded(self.multi_valued))
        object.__setattr__(self, "immutable", _folded(self.immutable))

    @property
    def pricing_days(self) -> int:
        return self.stale_after_days if self.pricing_stale_days is None else self.pricing_stale_days

    #: Columns that rows must carry for :class:`RowRules`.
    columns = ()

    def today(self, row: str = "") -> Column:
        """The day that is judged on. ``row`` is where the rules of a row are, for those that have their own."""
        return F.lit(self.as_of)

    def age_limit(self, pricing: Column) -> Column:
        return F.when(pricing, self.pricing_days).otherwise(self.stale_after_days)

    def is_multi_valued(self, predicate: Column) -> Column:
        return predicate.isin(*sorted(self.multi_valued)) if self.multi_valued else F.lit(False)

    def is_immutable(self, predicate: Column) -> Column:
        return predicate.isin(*sorted(self.immutable)) if self.immutable else F.lit(False)

    def severity_of(self, source_type: Column, row: str = "") -> Column:
        """The configured severity for a change in a source of this type; null if none."""
        out = F.lit(None).cast("string")
        for key, severity in self.severity.items():
            out = F.when(source_type == key.removesuffix("_change"), severity).otherwise(out)
        return out


@dataclass(frozen=True)
class RowRules(RuleContext):
    """Rules that each row has itself, in a struct ``rules`` of facts and documents: many rule sets in one plan."""

    as_of: date = date.min

    columns = ("rules",)
    SCHEMA = "struct<as_of:date,stale_days:int,pricing_days:int,severity:map<string,string>,multi_valued:array<string>,immutable:array<string>>"

    @staticmethod
    def row(ctx: RuleContext) -> tuple:
        severity = {k.removesuffix("_change"): v for k, v in ctx.severity.items()}
        return (ctx.as_of, ctx.stale_after_days, ctx.pricing_days, severity, sorted(ctx.multi_valued), sorted(ctx.immutable))

    def today(self, row: str = "") -> Column:
        return F.col(f"{row}rules.as_of")

    def age_limit(self, pricing: Column) -> Column:
        return F.when(pricing, F.col("rules.pricing_days")).otherwise(F.col("rules.stale_days"))

    def is_multi_valued(self, predicate: Column) -> Column:
        return F.coalesce(F.array_contains("rules.multi_valued", predicate), F.lit(False))

    def is_immutable(self, predicate: Column) -> Column:
        return F.coalesce(F.array_contains("rules.immutable", predicate), F.lit(False))

    def severity_of(self, source_type: Column, row: str = "") -> Column:
        return F.element_at(F.col(f"{row}rules.severity"), F.coalesce(source_type, F.lit("")))
