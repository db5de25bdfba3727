"""Structured Streaming counterparts: lines judged as they arrive, references checked when their time has passed.

Judging lines is a narrow map, so the batch operator runs on streams unchanged. Counts by month wait for the watermark. A
micro-batch of references is checked against the parents loaded by then; those found late or missing may be checked again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.operators import orphans, reject_lines


def judged(lines: DataFrame) -> DataFrame:
    """:func:`reject_lines.parse_lines` of a stream ``line_id, feed, line``."""
    return reject_lines.parse_lines(lines)


def write_judged(lines: DataFrame, valid_path: str, reject_path: str, checkpoint: str, feeds: tuple[str, ...] = ("genomes", "characters")):
    """Starts a query that writes valid rows by feed and faults of rejected lines; a batch written twice replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for feed in feeds:
                reject_lines.valid_rows(batch, feed).write.mode("overwrite").parquet(f"{valid_path}/{feed}/batch={number}")
            reject_lines.rejects(batch).write.mode("overwrite").parquet(f"{reject_path}/batch={number}")
        finally:
            batch.unpersist()

    return judged(lines).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def reject_counts(lines: DataFrame, at: str = "received_at", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """``start, feed, n, n_rejected`` per window of event time; rows later than the watermark are not counted any more.

    A line is rejected if :func:`reject_lines.parse_lines` finds any fault in it.
    """
    src = lines.select(F.lit(0).alias("line_id"), "feed", "line", F.col(at).alias("at"))
    x = reject_lines.parse_lines(src, carried=("at",)).withWatermark("at", late).groupBy(F.window("at", window), "feed")
    x = x.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("ok"), 0).otherwise(1)).alias("n_rejected"))
    return x.select(F.col("window.start").alias("start"), "feed", "n", "n_rejected")


def check_stream(refs: DataFrame, parents, sink, checkpoint: str):
    """Starts a query that checks each micro-batch of references (``ref_table, ref_id, at``) against ``parents()`` as of then."""

    def check(batch: DataFrame, number: int) -> None:
        sink(orphans.orphans(orphans.check_references(batch, parents())), number)

    return refs.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).start()
