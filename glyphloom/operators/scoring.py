"""The advisory cost model: weighted scores over coverage, precision, complexity and interpretability."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.plans.pattern import Pattern, matches


# The weights of a score, and how near two scores tie.
@dataclass(frozen=True)
class Weights:
    coverage: float = 2.0
    precision: float = 1.5
    complexity: float = 1.0
    interpretability: float = 0.5


# Interpretability for at most so many elements and values of the largest enumeration.
INTERPRETABLE = ((3, 5, 1.0), (5, 10, 0.8), (7, 15, 0.6))
TIE = 0.01


def complexity(pattern: Pattern) -> float:
    return min(pattern.cost() / 50, 1.0)


def interpretability(pattern: Pattern) -> float:
    n, largest = pattern.elements, pattern.largest_enum
    for most, values, grade in INTERPRETABLE:
        if n <= most and largest <= values:
            return grade
    return 0.3 if n > 10 or largest > 30 else 0.5


def matched_counts(counts: DataFrame, patterns: list[Pattern]) -> tuple[list[int], int]:
    """Matches of every pattern over (value, cnt), and the number of values, in one aggregate."""
    sums = [F.coalesce(F.sum(F.when(matches(F.col("value"), p), F.col("cnt"))), F.lit(0)) for p in patterns]
    row = counts.agg(*[s.alias(f"m{i}") for i, s in enumerate(sums)], F.coalesce(F.sum("cnt"), F.lit(0)).alias("n")).first()
    return list(row[:-1]), row[-1]


def coverage(counts: DataFrame, pattern: Pattern) -> float:
    (m,), n = matched_counts(counts, [pattern])
    return m / n if n else 0.0


def _precision(pattern: Pattern, valid: int, invalid: int | None) -> float:
    if invalid is None or not valid + invalid:
        return pattern.specificity()
    return (pattern.specificity() + valid / (valid + invalid)) / 2


def precision(counts: DataFrame, pattern: Pattern, invalid: DataFrame | None = None) -> float:
    """Specificity, averaged with the share of valid matches if samples of invalid values are given."""
    return score_all(counts, [pattern], invalid=invalid)[0]["precision"]


def score_all(counts: DataFrame, patterns: list[Pattern], weights: Weights = Weights(), invalid: DataFrame | None = None) -> list[dict]:
    valid, n = matched_counts(counts, patterns)
    wrong = [None] * len(patterns)
    if invalid is not None:
        found, size = matched_counts(invalid, patterns)
        wrong = found if size else wrong
    out = []
    for p, m, w in zip(patterns, valid, wrong, strict=True):
        c, pr, x, i = (m / n if n else 0.0), _precision(p, m, w), complexity(p), interpretability(p)
        total = weights.coverage * (1 - c) + weights.precision * (1 - pr) + weights.complexity * x + weights.interpretability * (1 - i)
        out.append({"coverage": c, "precision": pr, "complexity": x, "interpretability": i, "total_score": total, "matched_count": m, "total": n})
    return out


def score(counts: DataFrame, pattern: Pattern, **options) -> float:
    """Lower is better."""
    return score_all(counts, [pattern], **options)[0]["total_score"]


def rank(counts: DataFrame, patterns: list[Pattern], **options) -> list[tuple[Pattern, float]]:
    scored = [(p, s["total_score"]) for p, s in zip(patterns, score_all(counts, patterns, **options), strict=True)]
    return sorted(scored, key=lambda x: x[1])


def compare(counts: DataFrame, one: Pattern, two: Pattern, **options) -> tuple[str, float]:
    a, b = (s["total_score"] for s in score_all(counts, [one, two], **options))
    return ("tie", a) if abs(a - b) < TIE else ("first", a) if a < b else ("second", b)


def report(counts: DataFrame, pattern: Pattern, **options) -> dict:
    s = score_all(counts, [pattern], **options)[0]
    sample = [r["value"] for r in counts.where(~matches(F.col("value"), pattern)).orderBy("value").limit(5).collect() for _ in range(min(5, r["cnt"]))][:5]
    metrics = {k: s[k] for k in ("coverage", "precision", "complexity", "interpretability", "total_score")}
    stats = {"total_strings": s["total"], "matched_count": s["matched_count"], "unmatched_count": s["total"] - s["matched_count"], "unmatched_sample": sample}
    return {"pattern": pattern, "regex": pattern.regex(), "pretty": pattern.pretty(), "metrics": metrics, "stats": stats}


def suggest_enum_threshold(df: DataFrame, column: str = "value") -> DataFrame:
    """One row: distinct, total and threshold."""
    d, n = F.col("distinct"), F.col("total")
    mean = n / F.greatest(d, F.lit(1))
    rule = F.when((d <= 10) & (mean >= 3), d + 5).when((d <= 30) & (mean >= 2), 10).when(d <= 100, 5).otherwise(3)
    return df.agg(F.countDistinct(column).alias("distinct"), F.count(column).alias("total")).withColumn("threshold", rule.cast("long"))
