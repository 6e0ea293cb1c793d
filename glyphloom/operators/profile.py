"""Profiling a string column: patterns, anomalies, statistics."""

from __future__ import annotations

from copy import copy
from dataclasses import asdict, dataclass, field, replace
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.operators import clustering, synthesis
from glyphloom.plans import pattern as P
from glyphloom.plans.lineage import cut
from glyphloom.sources import columns


@dataclass(frozen=True)
class Options:
    """``length_tolerance`` is accepted and changes nothing. ``nulls`` is "error" or "ignore"; ``extra`` keeps unknown options."""

    max_clusters: int = 5
    min_coverage: float = 0.01
    enum_threshold: int = 10
    detect_anomalies: bool = True
    length_tolerance: float = 0.2
    nulls: str = "error"
    extra: dict = field(default_factory=dict, hash=False)

    @classmethod
    def of(cls, given: dict) -> Options:
        own = {k: v for k, v in given.items() if k in cls.__dataclass_fields__ and k != "extra"}
        return cls(**own, extra={k: v for k, v in given.items() if k not in own})


@dataclass(frozen=True)
class PatternInfo:
    pattern: P.Pattern
    regex: str
    pretty: str
    coverage: float
    matched_count: int
    cost: float
    specificity: float
    cluster: int | None


@dataclass(frozen=True)
class Stats:
    total_values: int
    distinct_values: int
    pattern_count: int
    total_coverage: float
    anomaly_count: int


SCHEMA = "regex string, pretty string, coverage double, matched_count long, cost double, specificity double"


class Profile:
    """The result. Patterns and statistics are on the driver; members and anomalies stay DataFrames of (value, cnt)."""

    def __init__(self, counts: DataFrame, members: DataFrame, patterns: list[PatternInfo], options: Options, total: int, distinct: int, anomalies: DataFrame | None):
        self.counts, self._members, self.patterns, self.options, self._anomalies = counts, members, patterns, options, anomalies
        matched = min(sum(p.matched_count for p in patterns), total)
        bad = 0 if anomalies is None else anomalies.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]
        self.stats = Stats(total, distinct, len(patterns), matched / total, bad)

    @property
    def spark(self) -> SparkSession:
        return self.counts.sparkSession

    def regexes(self) -> list[str]:
        return [p.regex for p in self.patterns]

    def anomalies(self) -> DataFrame:
        """(value, cnt) of the values that no pattern matches; none after the categorical shortcut or if not asked for."""
        return self.counts.limit(0) if self._anomalies is None else self._anomalies

    def members(self, info: PatternInfo | None = None) -> DataFrame:
        """(value, cnt) of a pattern's cluster, or of all retained patterns' clusters."""
        if info is not None:
            return self._members.where(F.col("cluster") == info.cluster).select("value", "cnt")
        return self._members.where(F.col("cluster").isin([p.cluster for p in self.patterns])).select("value", "cnt")

    def release(self) -> None:
        """Let go of what is cached. Nothing of the profile but its patterns and statistics is quick to use afterwards."""
        for held in (self.counts, self._members):
            held.unpersist()

    def settle(self) -> Profile:
        """The same profile with its members written down, so that its plan no longer holds what it was made from."""
        out = copy(self)
        kept = cut(self.members())
        out.counts, out._members, out._anomalies = kept, kept.withColumn("cluster", F.lit(None).cast("int")), None
        out.members = lambda info=None: kept
        self.release()
        return out

    def matches(self, value: Column) -> Column:
        return P.matches_any(value, [p.pattern for p in self.patterns])

    def validate(self, value: str) -> bool:
        return self.spark.range(1).select(self.matches(F.lit(value))).first()[0]

    def to_df(self) -> DataFrame:
        rows = [(p.regex, p.pretty, p.coverage, p.matched_count, float(p.cost), float(p.specificity)) for p in self.patterns]
        return self.spark.createDataFrame(rows, SCHEMA)

    def export(self) -> dict:
        kept = ("regex", "pretty", "coverage", "matched_count", "specificity")
        return {"patterns": [{k: getattr(p, k) for k in kept} for p in self.patterns], "stats": asdict(self.stats)}

    def summary(self) -> str:
        # Fixed headings.
        s = self.stats
        out = ["Profile Summary", "===============", f"Total values: {s.total_values}", f"Distinct values: {s.distinct_values}", f"Pattern coverage: {_percent(s.total_coverage)}%", "", f"Patterns ({s.pattern_count}):"]
        out.append("\n".join(f"  {i}. {p.regex} ({_percent(p.coverage)}% coverage)" for i, p in enumerate(self.patterns, 1)))
        if s.anomaly_count:
            shown = [r["value"] for r in self.anomalies().orderBy("value").limit(5).collect() for _ in range(r["cnt"])][:5]
            out += ["", f"Anomalies ({s.anomaly_count} values):", *(f"    - {P.inspect(v)}" for v in shown)]
        else:
            out.append("")
        return "\n".join(out) + "\n"


def _percent(share: float) -> Decimal:
    return Decimal(share * 100).quantize(Decimal("0.1"), ROUND_HALF_UP)


def _infos(counts: DataFrame, found: list[tuple[int, P.Pattern]], total: int) -> list[PatternInfo]:
    """Measure every pattern against all values in one pass."""
    sums = [F.coalesce(F.sum(F.when(P.matches(F.col("value"), p), F.col("cnt"))), F.lit(0)).alias(f"m{i}") for i, (_, p) in enumerate(found)]
    row = counts.agg(*sums).first() if found else ()
    return [PatternInfo(p, p.regex(), p.pretty(), row[i] / total, row[i], p.cost(), p.specificity(), c) for i, (c, p) in enumerate(found)]


def checked_counts(df: DataFrame, column: str, nulls: str = "error") -> tuple[DataFrame, int, int]:
    """Cached (value, cnt), the number of values, and of distinct ones."""
    return _checked(columns.value_counts(df, column), nulls)


def _checked(counts: DataFrame, nulls: str) -> tuple[DataFrame, int, int]:
    null = F.col("value").isNull()
    counts = counts.cache()
    row = counts.agg(F.sum(F.when(~null, F.col("cnt"))).alias("n"), F.count("value").alias("d"), F.sum(F.when(null, F.col("cnt"))).alias("nulls")).first()
    if row["nulls"] and nulls == "error":
        counts.unpersist()
        raise columns.NonStringValuesError(f"{row['nulls']} nulls")
    if not row["n"]:
        counts.unpersist()
        raise columns.EmptyInputError
    if not row["nulls"]:
        return counts, row["n"], row["d"]
    some = counts.where(~null).cache()
    some.count()
    counts.unpersist()
    return some, row["n"], row["d"]


def profile(df: DataFrame, column: str = "value", **options) -> Profile:
    """Profile a string column. Counting distinct values is the only pass over the input."""
    opts = options["_options"] if "_options" in options else Options.of(options)
    return _profile(columns.value_counts(df, column), opts)


def _profile(counts: DataFrame, opts: Options) -> Profile:
    counts, total, distinct = _checked(counts, opts.nulls)
    if distinct <= opts.enum_threshold:
        values = [r["value"] for r in counts.select("value").collect()]
        members = counts.withColumn("cluster", F.lit(0))
        return Profile(counts, members, _infos(counts, [(0, P.enum(values))], total), opts, total, distinct, None)
    clusters = clustering.cluster(counts, opts.max_clusters)
    members = clustering.with_cluster(counts, clusters).cache()
    best = synthesis.best_patterns(members, list(clusters.sizes), clusters.sizes, opts.min_coverage, total)
    kept = [i for i in _infos(counts, [(c, best[c]) for c in clusters.sizes if c in best], total) if i.coverage >= opts.min_coverage]
    kept.sort(key=lambda i: -i.coverage)
    anomalies = counts.where(~P.matches_any(F.col("value"), [i.pattern for i in kept])) if opts.detect_anomalies else None
    return Profile(counts, members, kept, opts, total, distinct, anomalies)


def profile_list(spark: SparkSession, values: list, **options) -> Profile:
    return profile(columns.from_list(spark, values), "value", **options)


def merge(one: Profile, two: Profile) -> Profile:
    """Profile the distinct union of both profiles' retained members, with the first one's options."""
    return profile(one.members().union(two.members()).select("value").distinct(), "value", _options=replace(one.options))


def infer_pattern(df: DataFrame, column: str = "value", enum_threshold: int = 10, **_ignored) -> P.Pattern:
    """One pattern for everything: no clustering, no shortcut, no candidates."""
    counts, _, _ = checked_counts(df, column)
    positions = synthesis.collect_positions(counts.withColumn("cluster", F.lit(0)), max(enum_threshold, synthesis.SMALL_SET, 32) + 1)
    counts.unpersist()
    return synthesis.synthesize(positions.get(0, []), enum_threshold)


def infer_regex(df: DataFrame, column: str = "value", **options) -> str:
    return infer_pattern(df, column, **options).regex()


def profile_groups(df: DataFrame, column: str, group: str, **options) -> dict:
    """An extension: a profile for each value of a low-cardinality group column. The input is read once; each profile starts from its group's distinct values."""
    counts = df.groupBy(F.col(group).alias("_group"), F.col(column).alias("value")).agg(F.count("*").alias("cnt"))
    columns.value_counts(df, column)  # for its checks
    counts = cut(counts)
    keys = [r[0] for r in counts.select("_group").distinct().orderBy("_group").collect()]
    return {k: _profile(counts.where(F.col("_group").eqNullSafe(F.lit(k))).drop("_group"), Options.of(options)) for k in keys}
