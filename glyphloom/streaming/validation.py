"""Extensions for streams: a saved profile validates rows as they come, and micro-batches can be profiled again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.operators import profile as profiling
from glyphloom.plans.pattern import first_match


def with_validity(df: DataFrame, column: str, prof: profiling.Profile) -> DataFrame:
    """Batch or stream, plus ``valid`` and ``pattern_id`` (the first pattern that matches). Stateless, hence no watermark."""
    found = first_match(F.col(column), [p.pattern for p in prof.patterns])
    return df.withColumn("pattern_id", found).withColumn("valid", F.col("pattern_id").isNotNull())


def reject_stream(df: DataFrame, column: str, prof: profiling.Profile) -> DataFrame:
    return with_validity(df, column, prof).where(~F.col("valid"))


def profile_batches(df: DataFrame, column: str, use: Callable[[profiling.Profile, int], None], **options):
    """Profile each micro-batch, merged with what came before, and hand it to ``use``.

    What is held between batches is the former profile with its members written down, so plans and caches don't grow.
    """
    held: dict[str, profiling.Profile] = {}

    def batch(rows: DataFrame, epoch: int) -> None:
        if not rows.isEmpty():
            new = profiling.profile(rows, column, **options)
            found = profiling.merge(held["all"], new) if "all" in held else new
            use(found, epoch)
            held["all"] = found.settle()
            new.release()

    return df.writeStream.foreachBatch(batch)
