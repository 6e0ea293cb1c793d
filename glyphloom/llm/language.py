"""Language identification with language-bitmask n-gram filters.

Letters in lower case, everything else a space, in trigrams around a letter (a trigram packs exactly into 63 bits). A
language holds a trigram if it uses it at least ``MIN_RATE`` as often as the language that uses it most. One Bloom filter
keeps all languages: a slot is a mask with a bit for each language, so ``PROBES`` look-ups and an AND return every language
that holds a trigram. A document's counts by language are corrected for the filter's false positives; the largest wins, ties
going to the first in alphabetical order.

Training reads at most about ``SAMPLE`` documents of each language, chosen by a hash of the id, and only those outside the
held-out quarter; text and lang are its only inputs, and text the only one of a prediction.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with no language learned every text is ``und``;
a null lang is never learned; repeated rows each get their row; an empty table gives no rows; other columns are ignored by
``predict`` and kept by ``in_known_language``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.shared import Tidy, occupy, small_batches

SAMPLE = 3_000
MIN_COUNT, MIN_RATE = 3, 0.3
SLOTS_A_GRAM, PROBES = 16, 3
MIN_SCORE = 0.35
PIECE = 1 << 20

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once a process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed trigrams of all texts in order, and where each text's begin (one more entry at the end)."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    ok = letters()[points]
    points[~ok] = 32
    middle = np.flatnonzero(ok)  # never first or last: each text has a space on either side
    ends = np.cumsum([len(t) + 2 for t in low])
    return points[middle - 1] << 42 | points[middle] << 21 | points[middle + 1], np.searchsorted(middle, np.concatenate(([0], ends)))


def _probe(grams: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    h = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    step = h >> np.uint64(32) | np.uint64(1)
    for i in range(PROBES):
        yield ((h + np.uint64(i) * step) >> np.uint64(7)) & np.uint64(slots - 1)


@dataclass(frozen=True)
class Filters:
    """The bit-sliced filter: ``masks[slot, word]`` has bit b of word w for language 64 w + b."""

    languages: tuple[str, ...]
    masks: np.ndarray

    @classmethod
    def build(cls, languages: list[str], held: dict[int, list[int]]) -> Filters:
        slots = 1 << max(10, int(len(held) * SLOTS_A_GRAM).bit_length())
        masks = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
        if held:
            grams = np.array(list(held), np.int64)
            own = np.zeros((len(grams), masks.shape[1]), np.uint64)
            for i, langs in enumerate(held.values()):
                for k in langs:
                    own[i, k >> 6] |= np.uint64(1 << (k & 63))
            for at in _probe(grams, slots):
                np.bitwise_or.at(masks, at.astype(np.int64), own)
        return cls(tuple(languages), masks)

    def false_rates(self) -> np.ndarray:
        fill = [(self.masks[:, k >> 6] >> np.uint64(k & 63) & np.uint64(1)).mean() for k in range(len(self.languages))]
        return np.array(fill) ** PROBES

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        grams, bounds = trigrams([t or "" for t in texts])
        sizes = np.diff(bounds)
        if not self.languages or not len(grams):
            return [("und", 0.0)] * len(texts)
        found = None
        for at in _probe(grams, len(self.masks)):
            some = self.masks[at.astype(np.int64)]
            found = some if found is None else found & some
        hits = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            total = np.concatenate(([0], np.cumsum(found[:, k >> 6] >> np.uint64(k & 63) & np.uint64(1), dtype=np.int64)))
            hits[:, k] = total[bounds[1:]] - total[bounds[:-1]]
        false = self.false_rates()
        counts = np.maximum(0, (hits - sizes[:, None] * false) / np.maximum(1 - false, 1e-9))
        best = counts.argmax(1)
        score = np.minimum(1, counts[np.arange(len(texts)), best] / np.maximum(sizes, 1))
        return [(self.languages[b], float(s)) if n else ("und", 0.0) for b, s, n in zip(best, score, sizes, strict=True)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def _pieces(items: list, size) -> Iterator[list]:
    some, held = [], 0
    for x in items:
        some.append(x)
        held += size(x)
        if held >= PIECE:
            yield some
            some, held = [], 0
    if some:
        yield some


def _count(batches):
    for batch in batches:
        rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for lang in sorted({lang for lang, _ in rows}):
            for some in _pieces([t for k, t in rows if k == lang], len):
                grams, n = np.unique(trigrams(some)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def train(docs: DataFrame) -> Filters:
    """Filters from a bounded sample of the rows outside the held-out quarter that have a lang and a text."""
    rows = small_batches(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("lang", "text", "doc_id")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return Filters.build([], {})
    share = F.broadcast(docs.sparkSession.createDataFrame([(k, min(1.0, SAMPLE / v)) for k, v in sizes.items()], "lang string, share double"))
    chosen = rows.join(share, "lang").where((F.xxhash64("doc_id") % 1_000_000 + 1_000_000) % 1_000_000 < F.col("share") * 1_000_000)
    counts = chosen.select("lang", "text").mapInArrow(Tidy(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)
    languages = sorted(sizes)
    got = counts.collect()  # bounded by the sample
    total = dict.fromkeys(languages, 0)
    for r in got:
        total[r["lang"]] += r["n"]
    rates: dict[int, list[tuple[float, int]]] = {}
    for r in got:
        rates.setdefault(r["gram"], []).append((r["n"] / total[r["lang"]], languages.index(r["lang"])))
    held = {g: [k for rate, k in v if rate >= MIN_RATE * max(v)[0]] for g, v in rates.items()}
    return Filters.build(languages, held)


def _predictor(docs: DataFrame, model: Filters):
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict_text(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        occupy("language")
        for series in texts:
            out = [p for some in _pieces(list(series), lambda t: len(t or "")) for p in shared.value.predict(some)]
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return predict_text


def predict(docs: DataFrame, model: Filters | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; trains on ``docs`` unless a model is given."""
    model = model or train(docs)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), _predictor(docs, model)(F.col("text")).alias("_p"))
    return named.select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def in_known_language(docs: DataFrame, model: Filters | None = None) -> DataFrame:
    """The documents of which at least MIN_SCORE of the trigrams are the predicted language's, with all their columns."""
    model = model or train(docs)
    return docs.withColumn("_p", _predictor(docs, model)(F.col("text"))).where((F.col("_p.lang_pred") != "und") & (F.col("_p.score") >= MIN_SCORE)).drop("_p")
