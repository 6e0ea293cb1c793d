"""Structural clustering: skeleton groups, greedy leader merging, and the limit on clusters.

Groups are merged in order of size: a leader takes every later group within ``MERGE_DISTANCE`` of it. Groups with one normalized
skeleton are at distance 0 and as far from any other, so they always end together and are merged first. What is left stays a DataFrame: each round takes its
first rows as possible leaders, settles which of them lead, and gives every row to the first leader near enough; only the
possible leaders and the clusters' sizes come to the driver. A round has more leaders when the one before took little. Rounds stop as soon as no later cluster can be among those kept.
Short skeletons are compared by the built-in edit distance; where one is longer than ``SHORT``, many at a time by bit vectors (``functions/distance.py``).
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.functions import distance
from glyphloom.functions import tokens as T
from glyphloom.plans.lineage import cut

# Fixed value: groups this near are merged.
MERGE_DISTANCE = 0.3
BLOCK, LONG_BLOCK = 64, 16
SHORT = 200
# Rows of a partition that are compared together, and their characters at most.
TOGETHER, TOGETHER_CHARS = 4096, 16_000_000


@dataclass(frozen=True)
class Clusters:
    """``assigned`` maps (norm, cluster), norm a normalized skeleton; ``sizes`` has the members of each cluster in order."""

    assigned: DataFrame
    sizes: dict[int, int]


def initial_groups(counts: DataFrame) -> DataFrame:
    """(value, cnt) to (skeleton, size), counting with multiplicity."""
    return counts.groupBy(T.skeleton(F.col("value")).alias("skeleton")).agg(F.sum("cnt").alias("size"))


def merged_groups(groups: DataFrame) -> DataFrame:
    """(skeleton, size) to (norm, size, first): first orders the classes by their largest group, ties in byte order."""
    first = F.min(F.struct((-F.col("size")).alias("most"), F.col("skeleton")))
    return groups.groupBy(T.normalized_skeleton(F.col("skeleton")).alias("norm")).agg(F.sum("size").alias("size"), first.alias("first"))


def _near(norm: Column, leader: str, threshold: float) -> Column:
    """Whether a normalized skeleton is within the threshold. Lengths and numbers of spaces rule most out before the edit distance, which gives up beyond it."""
    other, size = F.lit(leader), len(leader)
    longest = F.greatest(F.length(norm), F.lit(size))
    most = F.floor(longest * threshold + 1e-9).cast("int")
    spaces = F.length(norm) - F.length(F.replace(norm, F.lit("_"), F.lit("")))
    close = (F.abs(F.length(norm) - size) <= most) & (F.abs(spaces - leader.count("_")) <= most)
    distance = F.call_function("levenshtein", norm, other, most)
    return (norm == other) | F.when(close, (distance >= 0) & (distance / longest <= threshold)).otherwise(False)


def _with_first_near(left: DataFrame, leaders: list[str], base: int, threshold: float) -> DataFrame:
    """``left`` with the cluster of the first leader near enough, from ``base`` on, or null; by bit vectors."""

    def chunks(batches):
        for b in batches:
            at, lengths = 0, pc.binary_length(b.column("norm")).to_numpy()
            while at < b.num_rows:
                n = max(1, int((lengths[at : at + TOGETHER].cumsum() <= TOGETHER_CHARS).sum()))
                yield b.slice(at, n)
                at += n

    def run(batches):
        known = [distance.Leader(p) for p in leaders]
        for b in chunks(batches):
            place = distance.first_near(known, b.column("norm").to_pylist(), threshold)
            yield b.append_column("cluster", pa.array(place + base, pa.int32(), mask=place < 0))

    return left.mapInArrow(run, "id long, norm string, size long, cluster int")


def _leaders(possible: list[str], threshold: float) -> list[str]:
    """Those of the possible leaders that no earlier one takes; by bit vectors."""
    out = []
    while possible:
        out.append(possible[0])
        place = distance.first_near([distance.Leader(possible[0])], possible[1:], threshold)
        possible = [p for p, k in zip(possible[1:], place, strict=True) if k < 0]
    return out


def merge_groups(classes: DataFrame, max_clusters: int | None = None, threshold: float = MERGE_DISTANCE) -> tuple[DataFrame, list[int]]:
    """(norm, cluster) and the clusters' sizes in leader order. With ``max_clusters`` the rest, once it can't matter, is one cluster at the end."""
    left = cut(classes.orderBy("first").select(F.monotonically_increasing_id().alias("id"), "norm", F.col("size").cast("long").alias("size")))
    whole = left.agg(F.coalesce(F.sum("size"), F.lit(0)), F.max(F.length("norm"))).first()
    rest, long = whole[0], (whole[1] or 0) > SHORT
    parts, sizes, least = [], [], LONG_BLOCK if long else 1
    block = least
    while rest:
        if max_clusters and len(sizes) >= max_clusters and (max_clusters == 1 or sorted(sizes, reverse=True)[max_clusters - 2] >= rest):
            parts.append(left.select("norm", F.lit(len(sizes)).alias("cluster")))
            sizes.append(rest)
            break
        heads = left.select("id", "norm").orderBy("id").limit(block)
        possible = [r["norm"] for r in heads.collect()]
        base = len(sizes)
        if long:
            leaders = _leaders(possible, threshold)
            tried = cut(_with_first_near(left, leaders, base, threshold))
        else:
            leaders = possible[:1]
            if len(possible) > 1:
                table = heads.select("norm", *[_near(F.col("norm"), p, threshold).alias(f"n{i}") for i, p in enumerate(possible)]).collect()
                near = {r["norm"]: r for r in table}
                for p in possible[1:]:
                    if not any(near[p][f"n{possible.index(q)}"] for q in leaders):
                        leaders.append(p)
            which = F.coalesce(*[F.when(_near(F.col("norm"), p, threshold), F.lit(base + i)) for i, p in enumerate(leaders)])
            tried = cut(left.withColumn("cluster", which))
        taken = {r["cluster"]: r["size"] for r in tried.where("cluster is not null").groupBy("cluster").agg(F.sum("size").alias("size")).collect()}  # at most BLOCK rows
        sizes += [taken[base + i] for i in range(len(leaders))]
        parts.append(tried.where("cluster is not null").select("norm", "cluster"))
        left = tried.where("cluster is null").drop("cluster")
        before, rest = rest, rest - sum(taken.values())
        block = min(BLOCK, 2 * block) if rest > 0.8 * before else max(least, block // 2)
    out = parts[0] if parts else left.select("norm", F.lit(0).alias("cluster"))
    for part in parts[1:]:
        out = out.union(part)
    return out, sizes


def cluster(counts: DataFrame, max_clusters: int = 10, min_cluster_size: int = 1, threshold: float = MERGE_DISTANCE) -> Clusters:
    """Cluster (value, cnt). Over the limit, the largest ``max_clusters - 1`` are kept and the rest become one last cluster."""
    if max_clusters < 1:
        raise ValueError("max_clusters must be positive")
    assigned, sizes = merge_groups(merged_groups(initial_groups(counts)), max_clusters if min_cluster_size <= 1 else None, threshold)
    found = [[i] for i, size in enumerate(sizes) if size >= min_cluster_size]
    if len(found) > max_clusters:
        order = sorted(range(len(found)), key=lambda i: -sizes[found[i][0]])
        found = [*(found[i] for i in order[: max_clusters - 1]), [j for i in order[max_clusters - 1 :] for j in found[i]]]
    pairs = counts.sparkSession.createDataFrame([(i, c) for c, members in enumerate(found) for i in members], "old int, cluster int")
    joined = assigned.join(pairs, F.col("old") == assigned["cluster"]).select("norm", pairs["cluster"])
    return Clusters(joined, {c: sum(sizes[i] for i in members) for c, members in enumerate(found)})


def with_cluster(counts: DataFrame, clusters: Clusters) -> DataFrame:
    """(value, cnt) with its cluster; values of dropped clusters are left out."""
    return counts.withColumn("norm", T.normalized_skeleton(T.skeleton(F.col("value")))).join(clusters.assigned, "norm").select("cluster", "value", "cnt")


def cluster_stats(members: DataFrame) -> DataFrame:
    """cluster, size, min_length, max_length, min_tokens, max_tokens, distinct_values from (cluster, value, cnt)."""
    length, tokens = T.graphemes(F.col("value")), F.size(T.token_values(F.col("value")))
    return members.groupBy("cluster").agg(
        F.sum("cnt").alias("size"), F.min(length).alias("min_length"), F.max(length).alias("max_length"), F.min(tokens).alias("min_tokens"), F.max(tokens).alias("max_tokens"), F.countDistinct("value").alias("distinct_values")
    )


def representatives(members: DataFrame) -> DataFrame:
    """cluster, representative, signature, compact_signature: the value nearest the upper median length, ties in byte order."""
    sized = members.withColumn("length", T.graphemes(F.col("value")))
    upto = F.sum("cnt").over(Window.partitionBy("cluster").orderBy("length").rangeBetween(Window.unboundedPreceding, 0))
    total = sized.groupBy("cluster").agg(F.sum("cnt").alias("total"))
    lengths = sized.groupBy("cluster", "length").agg(F.sum("cnt").alias("cnt")).withColumn("upto", upto).join(total, "cluster")
    median = lengths.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("cluster").agg(F.min("length").alias("median"))
    best = sized.join(F.broadcast(median), "cluster").groupBy("cluster").agg(F.min(F.struct(F.abs(F.col("length") - F.col("median")).alias("off"), F.col("value"))).alias("best"))
    value = F.col("best.value")
    return best.select("cluster", value.alias("representative"), T.signature(value).alias("signature"), T.compact_signature(value).alias("compact_signature"))
