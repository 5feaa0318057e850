"""Column functions of the risk formulas and of what reports say about scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = ("churn", "recent_churn", "size", "ownership_risk", "cochange_pressure", "source_coupling_pressure", "complexity_pressure")
BANDS = ("low", "medium", "high", "extreme")


def clamp01(x: Column) -> Column:
    """Between 0 and 1, null for null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def normalized(value: Column, saturation: float) -> Column:
    return clamp01(value / F.lit(float(saturation))) if saturation else F.lit(None).cast("double")


def risk_band(score: Column) -> Column:
    return F.when(score >= 0.85, "extreme").when(score >= 0.70, "high").when(score >= 0.40, "medium").otherwise("low")


def owner_count_component(owners: Column) -> Column:
    parts = F.when(owners == 1, 1.0).when(owners == 2, 0.60).when(owners == 3, 0.30).otherwise(0.0)
    return F.when(owners.isNotNull(), parts)


def confidence(coverage: Column) -> Column:
    return F.when(coverage >= 0.80, "high").when(coverage >= 0.30, "medium").when(coverage > 0, "low").otherwise("none")


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(clamp01(F.try_divide(part.cast("double"), whole.cast("double"))), F.lit(0.0))


# Tag of each term with its priority, and the least value that earns it.
TAG_OF_TERM = {
    "churn": ("high churn", 90),
    "cochange_pressure": ("coupling pressure", 85),
    "source_coupling_pressure": ("coupling pressure", 85),
    "ownership_risk": ("ownership risk", 80),
    "size": ("large file", 75),
    "complexity_pressure": ("complexity pressure", 70),
    "recent_churn": ("recent churn", 65),
}
TAG_OF_FLAG = {"is_test": ("test file", 20), "is_generated": ("generated", 10), "is_vendor": ("vendor", 10)}
TAG_LEAST = 0.60


def tags(flags: dict[str, Column], terms: dict[str, Column]) -> Column:
    """Labels by falling priority, then falling value, then name; each once."""
    signal = lambda label, priority, value, test: F.when(test, F.struct(
        F.lit(-priority).alias("p"), (-value).alias("v"), F.lit(label).alias("label")))
    signals = [signal(*TAG_OF_FLAG[k], F.lit(1.0), v) for k, v in flags.items()]
    signals += [signal(*TAG_OF_TERM[k], v, F.coalesce(v, F.lit(0.0)) >= TAG_LEAST) for k, v in terms.items() if k in TAG_OF_TERM]
    return F.array_distinct(F.transform(F.array_sort(F.array_compact(F.array(*signals))), lambda s: s["label"]))


# What two leading tags say together; None stands for any other second tag.
PHRASES = {
    ("high churn", "coupling pressure"): "Frequently changed coordination point — edits here ripple widely",
    ("high churn", "ownership risk"): "Frequently changed under divided ownership",
    ("high churn", "large file"): "Large, frequently changed file",
    ("high churn", "complexity pressure"): "Frequently changed, high-complexity file",
    ("high churn", None): "Frequently changed — top churn signal",
    ("coupling pressure", "ownership risk"): "Widely depended on under divided ownership",
    ("coupling pressure", "large file"): "Large, widely depended on file",
    ("coupling pressure", "complexity pressure"): "Complex, widely depended on file",
    ("coupling pressure", None): "High coupling pressure — changes here spread",
    ("ownership risk", "large file"): "Large file under divided ownership",
    ("ownership risk", "complexity pressure"): "Complex file under divided ownership",
    ("ownership risk", None): "Divided ownership — coordination risk",
    ("large file", "complexity pressure"): "Large, high-complexity file",
    ("large file", None): "Large file — size pressure",
    ("complexity pressure", None): "High control-flow complexity",
    ("recent churn", None): "Recently active — high recent churn",
    ("test file", None): "Test file",
    ("generated", None): "Generated file",
    ("vendor", None): "Vendor file",
}


def phrase(labels: Column) -> Column:
    """The phrase of the first two tags, null without tags."""
    first, second = F.get(labels, F.lit(0)), F.get(labels, F.lit(1))
    exact = [F.when((first == a) & (second == b), F.lit(text)) for (a, b), text in PHRASES.items() if b]
    loose = [F.when(first == a, F.lit(text)) for (a, b), text in PHRASES.items() if b is None]
    return F.coalesce(*exact, *loose)


def fixed(value: Column, digits: int) -> Column:
    """A double with fixed decimals, by the exact binary value (half-even on ties)."""
    return F.bround(value.cast("decimal(38,20)"), digits).cast(f"decimal(38,{digits})").cast("string")


def primary_driver(dimension: Column) -> Column:
    return F.when(dimension.isin("churn", "recent_churn"), "churn").when(dimension == "complexity_pressure", "complexity").when(
        dimension == "cochange_pressure", "cochange")


def git_history(status: Column, conf: Column, action: Column) -> Column:
    return F.when(status != "available", "absent").when(action.isin("reused", "incrementally_updated"), "incremental").when(
        conf.isin("full", "bounded", "incremental", "first_parent_only"), conf).otherwise("first_parent_only")


def scan_type(action: Column) -> Column:
    return F.when(action.isin("reused", "incrementally_updated"), "incremental").otherwise("full")


def is_reliable(conf: Column, history: Column) -> Column:
    return conf.isin("high", "medium") & (history != "absent")


def utc_iso8601(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rate(n: Column, elapsed: Column) -> Column:
    return F.when(elapsed <= 2.220446049250313e-16, n.cast("double")).otherwise(n / elapsed)
