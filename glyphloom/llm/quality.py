"""Document quality by hierarchical empirical Bayes: text evidence, shrunk site and path posteriors.

Two logistic models over hashed words and a few shape features give each document's probability of good quality and of being
toxic. They are fitted on at most about ``SAMPLE`` labelled rows. Sites (source) and paths (source and lang) then get
beta posteriors from all documents: a path is shrunk toward its site and a site toward the whole, by prior strengths that the
method of moments takes from the spread between groups, so that a group with few documents says little. A document's own score is
left out of its path's and site's means, so its text is not counted twice. A document's
posterior adds its path's log odds, relative to the whole, to its own; toxicity stands on the text alone.

Defined cases: a null or empty text has no words and scores as the prior; a null source or lang is a group of its own; labels
of unknown documents are not used, of two labels of one document the worse counts; with no labels everything is kept at
0.5; repeated rows each get their row and count in their groups; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.shared import materialise, occupy, small_batches

SAMPLE = 6_000
BUCKETS = 1 << 15
ROUNDS, WORDS, MIN_ASSOCIATION = 40, 200, 18.0
MIN_QUALITY, MAX_TOXIC = 0.5, 0.5
GROUP_WEIGHT = 0.5
SHAPE = 8

_multiplier = np.uint64(0x9E3779B97F4A7C15)


def _hashes(text: str) -> np.ndarray:
    """The buckets of a text's distinct lower-case words, without punctuation at their ends."""
    import zlib

    words = {w.strip(".,;:!?\"'()*#$%&") for w in text.lower().split()}
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words if w), np.int64)


_ASCII_LETTERS = bytes(c for c in range(128) if chr(c).isalpha())


def _shape(text: str) -> list[float]:
    """Shares of letters, capitals, distinct words, distinct lines, separators and exclamation marks, length, odd signs."""
    n, words, lines = max(len(text), 1), text.split(), text.split("\n")
    ascii_text = text.encode("ascii", "ignore")
    letters = 1 - len(ascii_text.translate(None, _ASCII_LETTERS)) / n
    capitals = 1 - len(ascii_text.translate(None, _ASCII_LETTERS[:26])) / max(len(ascii_text), 1)
    return [letters, min(1.0, 5 * capitals), len(set(words)) / max(len(words), 1), len(set(lines)) / len(lines), min(len(words), 500) / 500, min(1.0, text.count("!") / n * 10), min(1.0, text.count("|") / n * 20), min(1.0, sum(text.count(c) for c in "#$%&*") / n * 10)]


@dataclass(frozen=True)
class Model:
    """Weights of the two targets: presence of hashed words; shape features and the constant."""

    words: np.ndarray
    shape: np.ndarray

    def scores(self, text: str | None) -> tuple[float, float]:
        text = text or ""
        z = self.shape[:, :SHAPE] @ np.array(_shape(text)) + self.shape[:, SHAPE] + self.words[:, _hashes(text)].sum(1)
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _association(with_one: np.ndarray, with_zero: np.ndarray, ones: int, zeros: int) -> np.ndarray:
    """The likelihood-ratio statistic of each word's presence against the target."""
    total, out = ones + zeros, 0.0
    for seen, rows in ((with_one, ones), (with_zero, zeros)):
        for count, share in ((seen, (with_one + with_zero) / total), (rows - seen, 1 - (with_one + with_zero) / total)):
            expected = np.maximum(share * rows, 1e-12)
            out = out + 2 * np.where(count > 0, count * np.log(np.maximum(count, 1e-12) / expected), 0.0)
    return out


def fit(texts: list[str], quality: np.ndarray, toxic: np.ndarray) -> Model:
    """For each target, penalized logistic regression by Newton's method on shape and the words most associated with it."""
    words, shape = np.zeros((2, BUCKETS)), np.zeros((2, SHAPE + 1))
    if not texts:
        return Model(words, shape)
    hashed = [np.unique(_hashes(t)) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(h) for h in hashed])
    flat = np.concatenate(hashed)
    base = np.hstack([np.array([_shape(t) for t in texts]), np.ones((len(texts), 1))])
    for k, y in enumerate((quality, toxic)):
        if y.min() == y.max():
            shape[k, SHAPE] = 3.0 if y[0] else -3.0
            continue
        one, zero = (np.bincount(flat[y[row] == c], minlength=BUCKETS).astype(float) for c in (1, 0))
        strength = _association(one, zero, int(y.sum()), int(len(y) - y.sum()))
        chosen = np.sort(np.argsort(-strength, kind="stable")[:WORDS])
        chosen = chosen[strength[chosen] > MIN_ASSOCIATION]
        place = np.full(BUCKETS, -1)
        place[chosen] = np.arange(len(chosen))
        x = np.hstack([np.zeros((len(texts), len(chosen))), base])
        inside = place[flat] >= 0
        x[row[inside], place[flat[inside]]] = 1.0
        ridge = np.concatenate([np.full(len(chosen), 1.0), np.full(SHAPE, 0.1), [1e-3]])
        w = np.zeros(x.shape[1])
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
            w -= np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-6:
                break
        words[k, chosen], shape[k] = w[: len(chosen)], w[len(chosen) :]
    return Model(words, shape)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a sample of labelled documents chosen by a hash of the id, at most about SAMPLE."""
    worst = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    n = worst.count()
    if not n:
        return fit([], np.zeros(0), np.zeros(0))
    chosen = worst.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, SAMPLE / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy("doc_id").collect()  # bounded by SAMPLE
    return fit([r["text"] or "" for r in rows], np.array([r["quality"] for r in rows], float), np.array([r["toxic"] for r in rows], float))


def _strength(groups: DataFrame, mean: str) -> float:
    """The beta prior's strength by the method of moments: how little the groups' means differ beyond chance."""
    row = groups.where("n > 1").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(mean), 2)).alias("between"), F.avg(mean).alias("m")).first()
    if not row["k"] or not row["n"]:
        return 100.0
    within = max(row["m"] * (1 - row["m"]), 1e-6)
    spread = max((row["between"] - row["k"] * within) / row["n"], 1e-6)
    return float(np.clip(within / spread - 1, 1.0, 1e6))


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, text_quality, path_quality, quality, toxic and kept of every document."""
    model = model or train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("quality double, toxic double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        occupy("quality")
        for series in texts:
            yield pd.DataFrame([shared.value.scores(t) for t in series], columns=["quality", "toxic"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("site"), F.coalesce("lang", F.lit("")).alias("path"), score(F.col("text")).alias("p"))
    scored = materialise(rows.select("doc_id", "site", "path", F.col("p.quality").alias("text_quality"), F.col("p.toxic").alias("toxic")), "scored")
    paths = materialise(scored.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum("text_quality").alias("s")), "paths")
    whole = paths.agg((F.sum("s") + 0.5) / (F.sum("n") + 1)).first()[0]
    if whole is None:
        whole = 0.5
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("whole", F.lit(float(whole)))
    a = _strength(sites, "whole")
    posterior = sites.select("site", F.col("n").alias("site_n"), F.col("s").alias("site_s"), ((F.col("s") + a * F.col("whole")) / (F.col("n") + a)).alias("site_quality"))
    by_path = materialise(paths.join(posterior, "site"), "path-sites")
    b = _strength(by_path, "site_quality")
    logit = lambda p: F.log(p / (1 - p))
    bounded = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(c)))
    by_path = F.broadcast(by_path) if by_path.count() <= 100_000 else by_path.hint("merge")
    own = F.col("text_quality")
    site = (F.col("site_s") - own + a * float(whole)) / (F.col("site_n") - 1 + a)
    others = scored.join(by_path, ["site", "path"]).withColumn("site_quality", site)
    joined = others.withColumn("path_quality", (F.col("s") - own + b * F.col("site_quality")) / (F.col("n") - 1 + b))
    total = logit(bounded("text_quality")) + GROUP_WEIGHT * (logit(bounded("path_quality")) - float(np.log(whole / (1 - whole))))
    quality = 1 / (1 + F.exp(-total))
    return joined.select("doc_id", "text_quality", "path_quality", quality.alias("quality"), "toxic", ((quality >= MIN_QUALITY) & (F.col("toxic") <= MAX_TOXIC)).alias("kept"))
