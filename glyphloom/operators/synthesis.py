"""Pattern synthesis: one Spark aggregate of position statistics, then decisions on those bounded rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.functions import tokens as T
from glyphloom.plans.pattern import Any, CharClass, Enum, Literal, Pattern, matches, matches_start, seq

# Enumeration thresholds tried, coverage asked for, sizes below which values are listed.
THRESHOLDS = (5, 10, 20, 50)
MIN_COVERAGE = 0.95
SMALL_SET, REPETITION = 5, 0.3
# Positions from which it is told whether a pattern can match enough values.
PREFIX = 64
# The character class of each token type.
TYPE_CLASS = {"digits": "digit", "upper": "upper", "lower": "lower", "alpha": "alpha", "alnum": "alnum"}


@dataclass(frozen=True)
class TypeStats:
    """Of one token type at one position: distinct values, tokens, length bounds, and the first values in byte order."""

    kind: str
    distinct: int
    total: int
    shortest: int
    longest: int
    values: tuple[str, ...]


def _tokens(counts: DataFrame, upto: int | None = None) -> DataFrame:
    """(cluster, cnt, pos, token, type), of each value's first ``upto`` tokens if that is given."""
    value = F.col("value") if upto is None else F.regexp_extract("value", rf"\A(?:{T.TOKEN}){{0,{upto}}}", 0)
    texts = counts.select("cluster", "cnt", F.posexplode(T.token_values(value)).alias("pos", "token"))
    return texts.withColumn("type", T.run_type(F.col("token")))


def position_stats(counts: DataFrame, keep: int = max(THRESHOLDS) + 1) -> DataFrame:
    """From (cluster, value, cnt) with distinct values: cluster, pos, type, distinct, total, shortest, longest, values.

    Values are grouped before at most ``keep`` of them are collected, so no array grows with the data.
    """
    return _exact_stats(_tokens(counts), keep)


def _exact_stats(tokens: DataFrame, keep: int) -> DataFrame:
    grouped = tokens.groupBy("cluster", "pos", "type", "token").agg(F.sum("cnt").alias("cnt")).withColumn("length", T.graphemes(F.col("token")))
    stats = grouped.groupBy("cluster", "pos", "type").agg(F.count("*").alias("distinct"), F.sum("cnt").alias("total"), F.min("length").alias("shortest"), F.max("length").alias("longest"))
    first = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("cluster", "pos", "type").orderBy("token"))).where(F.col("rank") <= keep)
    values = first.groupBy("cluster", "pos", "type").agg(F.array_sort(F.collect_list("token")).alias("values"))
    return stats.join(values, ["cluster", "pos", "type"])


def collect_positions(counts: DataFrame, keep: int = max(THRESHOLDS) + 1, upto: int | None = None) -> dict[int, list[list[TypeStats]]]:
    """The statistics by cluster and position; with ``upto`` only those of so many first positions."""
    out: dict[int, list[list[TypeStats]]] = {}
    for r in _exact_stats(_tokens(counts, upto), keep).orderBy("cluster", "pos", "type").collect():
        places = out.setdefault(r["cluster"], [])
        while len(places) <= r["pos"]:
            places.append([])
        places[r["pos"]].append(TypeStats(r["type"], r["distinct"], r["total"], r["shortest"], r["longest"], tuple(r["values"])))
    return out


def should_enumerate(distinct: int, total: int, threshold: int) -> bool:
    return distinct <= SMALL_SET or (distinct <= threshold and distinct <= total * REPETITION)


def position_pattern(stats: list[TypeStats], threshold: int) -> Pattern:
    """The element of one position. An empty position (only empty strings) is an empty enumeration."""
    kinds = {s.kind for s in stats}
    values = [v for s in stats for v in s.values]
    distinct, total = sum(s.distinct for s in stats), sum(s.total for s in stats)
    low, high = min((s.shortest for s in stats), default=0), max((s.longest for s in stats), default=0)
    if kinds <= {"upper", "lower"} and len(kinds) != 1:
        return Enum(values) if should_enumerate(distinct, total, threshold) else CharClass("alpha", low, high)
    if len(kinds) > 1:
        return Enum(values) if distinct <= threshold else CharClass("alnum", low, high)
    (kind,) = kinds
    if kind == "delimiter":
        return Literal(values[0]) if distinct == 1 else Enum(values)
    if kind == "whitespace":
        return Literal(" " * low) if low == high else CharClass("any", low, high)
    if kind == "literal":
        return Enum(values) if distinct <= threshold else Any(low, high)
    return Enum(values) if should_enumerate(distinct, total, threshold) else CharClass(TYPE_CLASS.get(kind, "any"), low, high)


def synthesize(positions: list[list[TypeStats]], threshold: int = 10) -> Pattern:
    """Compose the positions. No position at all stands for only empty strings, which count as two empty positions."""
    return seq(position_pattern(p, threshold) for p in (positions or [[], []])).optimized()


def starts(counts: DataFrame, clusters: list[int], positions: dict[int, list[list[TypeStats]]]) -> dict[int, int]:
    """For each cluster how many values, of any cluster, begin as one of its candidates does over the given first positions."""
    asked = {c: list(dict.fromkeys(seq(position_pattern(p, t) for p in positions[c]) for t in THRESHOLDS)) for c in clusters if positions.get(c)}
    sums = [F.coalesce(F.sum(F.when(matches_start(F.col("value"), p), F.col("cnt"))), F.lit(0)).alias(f"s{c}_{i}") for c, ps in asked.items() for i, p in enumerate(ps)]
    row = counts.agg(*sums).first() if sums else None
    return {c: max(row[f"s{c}_{i}"] for i in range(len(ps))) for c, ps in asked.items()}


def best_patterns(counts: DataFrame, clusters: list[int], sizes: dict[int, int], min_coverage: float = 0, total: int = 1) -> dict[int, Pattern]:
    """For each cluster the cheapest candidate that covers enough of it, else the first. All candidates are tried in one job.

    A cluster is left out if no candidate can match ``min_coverage`` of the ``total`` values of ``counts``: what a pattern matches begins as its first
    positions do, so these are built first, from the first ``PREFIX`` tokens. Only the others' later positions are looked at.
    """
    positions = collect_positions(counts, upto=PREFIX)
    full = [c for c in clusters if len(positions.get(c, [])) == PREFIX]
    if full and min_coverage > 0:
        began = starts(counts, full, positions)
        clusters, full = ([c for c in some if c not in began or began[c] / total >= min_coverage] for some in (clusters, full))
    if full:
        positions |= collect_positions(counts.where(F.col("cluster").isin(full)))
    tries = {c: [synthesize(positions.get(c, []), t) for t in THRESHOLDS] for c in clusters}
    asked = [(c, p) for c in clusters for p in dict.fromkeys(tries[c])]
    if not asked:
        return {}
    sums = [F.sum(F.when((F.col("cluster") == c) & matches(F.col("value"), p), F.col("cnt")).otherwise(0)).alias(f"m{i}") for i, (c, p) in enumerate(asked)]
    row = counts.agg(*sums).first()
    covered = {key: (row[i] or 0) / max(sizes[key[0]], 1) for i, key in enumerate(asked)}
    out = {}
    for c in clusters:
        good = [p for p in tries[c] if covered[c, p] >= MIN_COVERAGE]
        out[c] = min(good, key=lambda p: p.cost()) if good else tries[c][0]
    return out


def evaluate(counts: DataFrame, pattern: Pattern) -> dict:
    """Coverage, counts, cost, specificity and anchored regex over (value, cnt)."""
    row = counts.agg(F.coalesce(F.sum(F.when(matches(F.col("value"), pattern), F.col("cnt"))), F.lit(0)).alias("m"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("n")).first()
    return {"coverage": row["m"] / max(row["n"], 1), "matched_count": row["m"], "total_count": row["n"], "cost": pattern.cost(), "specificity": pattern.specificity(), "regex": pattern.anchored()}
