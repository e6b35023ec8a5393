"""Thresholds, weights, ladders and rule sets. All are parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: default thresholds, weights and ladders ------------------
NULL_WARNING_PCT = 5.0
NULL_CRITICAL_PCT = 30.0
ENUM_CARDINALITY_PCT = 5.0
STALE_AFTER_DAYS = 365
FRESHNESS_DECAY_DAYS = 3650
FK_BREACH_PCT = 99.0
OUTLIER_WARNING_PCT = 5.0
IQR_MULTIPLIER = 1.5
ORDER_STATUSES = (1, 2, 3, 4)
WEIGHTS6 = {
    "completeness": 0.25,
    "uniqueness": 0.20,
    "fk_integrity": 0.20,
    "freshness": 0.15,
    "validity": 0.10,
    "consistency": 0.10,
}
WEIGHTS4 = {"completeness": 0.4, "fk_integrity": 0.3, "freshness": 0.2, "baseline": 0.1}
BASELINE_DIMENSION = 80.0
# age limit in days -> score, first match wins; the last entry is the fallback
LADDER_APP = ((30, 100.0), (365, 80.0), (1825, 60.0), (None, 40.0))
LADDER_MODULE = ((1, 100.0), (7, 95.0), (30, 85.0), (90, 70.0), (365, 50.0), (None, 25.0))
# score floor -> colour / grade
COLOR_CUTS = ((90.0, "green"), (75.0, "yellow"), (50.0, "orange"), (None, "red"))
OVERALL_COLOR_CUTS = ((90.0, "green"), (75.0, "yellow"), (None, "red"))
GRADE_CUTS = ((90.0, "A"), (75.0, "B"), (50.0, "C"), (None, "D"))
COMPLETENESS_BANDS = ((95.0, "95-100%"), (80.0, "80-95%"), (60.0, "60-80%"),
                      (40.0, "40-60%"), (0.0, "0-40%"))
AMBIGUOUS_NAMES = ("id", "data", "value", "info", "name", "type", "status", "code",
                   "key", "flag", "desc", "text", "note", "temp")
SEVERITY_ORDER = ("critical", "warning", "info")
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class NameRule:
    """A value rule that applies to numeric columns whose name holds a token.

    `predicate` is a SQL boolean expression over the placeholder `{c}`.
    """

    code: str
    tokens: tuple[str, ...]
    predicate: str


@dataclass(frozen=True)
class SequenceRule:
    """`later` must not come before `earlier`; checked where both columns exist."""

    earlier: str
    later: str
    code: str = "DATE_SEQUENCE_VIOLATION"


@dataclass(frozen=True)
class EnumRule:
    """`column` must hold one of `allowed`; NULL counts as invalid by default."""

    column: str
    allowed: tuple
    null_is_invalid: bool = True
    code: str = "INVALID_STATUS"


@dataclass(frozen=True)
class FkPolicy:
    """Issue limits on referential integrity, in percent."""

    warn_below: float
    critical_below: float


FK_APP = FkPolicy(warn_below=99.0, critical_below=90.0)
FK_MODULE = FkPolicy(warn_below=100.0, critical_below=80.0)

DEFAULT_NAME_RULES = (
    NameRule("INVALID_PRICE", ("price", "amount"), "{c} = 0"),
    NameRule("INVALID_RANGE", ("discount",), "{c} > 1.0"),
)


@dataclass(frozen=True)
class QualityPolicy:
    """Everything the six-dimension scorecard needs to know besides the data."""

    null_warning_pct: float = NULL_WARNING_PCT
    null_critical_pct: float = NULL_CRITICAL_PCT
    enum_cardinality_pct: float = ENUM_CARDINALITY_PCT
    stale_after_days: int = STALE_AFTER_DAYS
    freshness_decay_days: int = FRESHNESS_DECAY_DAYS
    fk_breach_pct: float = FK_BREACH_PCT
    outlier_warning_pct: float = OUTLIER_WARNING_PCT
    iqr_multiplier: float = IQR_MULTIPLIER
    validity_penalty: float = 10.0
    consistency_penalty: float = 20.0
    name_rules: tuple[NameRule, ...] = DEFAULT_NAME_RULES
    sequence_rules: tuple[SequenceRule, ...] = (SequenceRule("order_date", "shipped_date"),)
    enum_rules: tuple[EnumRule, ...] = (EnumRule("order_status", ORDER_STATUSES),)
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS6))


DEFAULT_POLICY = QualityPolicy()
