"""Incremental archive of light curves: new event files become normalised, stitched series with their completeness.

    python -m jobs.light_curves --events IN --output OUT --checkpoint CHECKPOINT --config jobs/light_curves.json

A file stream with a checkpoint takes only files it has not seen and ends (availableNow). ``OUT/observations`` keeps each batch's
rows as they came, in a folder of the batch; ``OUT/curves`` holds the results by period. Only periods that a batch touches are computed anew,
from all their observations, and overwrite their own partitions. So late rows land in their period, rows delivered twice count once, and a batch that
was cut off half way leaves the same files when the checkpoint runs it again.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.operators import prep
from lacuna.sources.series import EPOCH_DAY, days
from lacuna.streaming import EVENTS

from .common import main

log = logging.getLogger("light_curves")

RAW = "event_id long, series_id long, label string, t double, flux double, batch long, period int"
CURVES = "event_id long, series_id long, label string, t double, flux double, normalised double, n long, n_flagged long, longest_gap double, completeness double, complete boolean, period int"


@dataclass(frozen=True)
class Settings:
    """Days of a period; days of a cadence slot; clipping; the share of slots that makes a series complete; files of a batch (0: all that are there).

    One series of one period is one window, so a period bounds what a task sorts: choose it by the densest series.
    """

    period_days: int = 90
    slot_days: float = 1.0
    sigma: float = 5.0
    window: int = 30
    min_completeness: float = 0.5
    files_per_batch: int = 0


def observations(events: DataFrame, settings: Settings) -> DataFrame:
    """Rows of the archive. Events without a number, a series or a time can't be placed and go; a missing flux stays as a gap."""
    t = days(F.col("ts")) - EPOCH_DAY
    rows = events.select("event_id", F.col("user_id").alias("series_id"), F.col("event_type").alias("label"), t.alias("t"), F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value")).alias("flux"))
    rows = rows.where("event_id IS NOT NULL AND series_id IS NOT NULL AND t IS NOT NULL")
    return rows.withColumn("period", F.floor(F.col("t") / settings.period_days).cast("int"))


def curves(rows: DataFrame, settings: Settings) -> DataFrame:
    """Per series and period: clipped points flagged, flux over the median of the unflagged points, gaps and completeness.

    Rows of one event within a period count once, the one delivered first; each period's result depends on its own observations alone.
    A series of a period is one window: the exchange is by both, so neither a long series nor a full period is one task.
    ``normalised`` is null where the flux is missing or flagged, or the median is 0 or missing. ``completeness``: the share of the period's slots with a point left.
    """
    keys = ("series_id", "period")
    one = Window.partitionBy("event_id", "period").orderBy("batch", "t", "series_id", "flux")
    once = rows.withColumn("_seen", F.row_number().over(one)).where("_seen = 1").drop("_seen", "batch")
    kept = prep.sigma_clip(once.where("flux IS NOT NULL"), settings.sigma, settings.window, keys, ("t", "event_id")).select("event_id", "period", F.lit(True).alias("_kept"))
    x = once.join(kept, ["event_id", "period"], "left").withColumn("_good", F.when(F.col("_kept"), F.col("flux")))
    whole, timed = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("t", "event_id")
    last = F.last(F.when(F.col("_good").isNotNull(), F.col("t")), ignorenulls=True).over(timed.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_gap", F.when(F.col("_good").isNotNull(), F.col("t") - last))
    slot = F.when(F.col("_good").isNotNull(), F.floor(F.col("t") / settings.slot_days))
    x = x.withColumns({
        "_median": F.median("_good").over(whole), "n": F.count("flux").over(whole), "n_flagged": (F.count("flux").over(whole) - F.count("_good").over(whole)),
        "longest_gap": F.max("_gap").over(whole), "_slots": F.size(F.collect_set(slot).over(whole))})
    x = x.withColumn("normalised", F.col("_good") / F.nullif(F.col("_median"), F.lit(0.0)))
    x = x.withColumn("completeness", F.least(F.lit(1.0), F.col("_slots") / F.lit(settings.period_days / settings.slot_days)))
    return x.withColumn("complete", F.col("completeness") >= settings.min_completeness).select(*[c.split()[0] for c in CURVES.split(", ")])


def archive(spark: SparkSession, events: str, output: str, checkpoint: str, settings: Settings = Settings()) -> dict[str, int]:
    """Take what is new in ``events`` into the archive at ``output``; returns counts of batches, rows read, rows kept and curve rows written."""
    done = {"batches": 0, "read": 0, "kept": 0, "written": 0}
    raw, out = f"{output}/observations", f"{output}/curves"

    def batch(new: DataFrame, number: int) -> None:
        session = new.sparkSession
        # the batch's own folder: running the batch again replaces it
        observations(new, settings).write.mode("overwrite").partitionBy("period").parquet(f"{raw}/batch={number}")
        archived = session.read.schema(RAW).option("basePath", raw).parquet(raw)
        # a row a period: a period is months, so they are few
        periods = archived.where(F.col("batch") == number).groupBy("period").count().collect()
        touched = sorted(r["period"] for r in periods)
        result = curves(archived.where(F.col("period").isin(touched)), settings)
        result.hint("rebalance", "period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(out)
        counts = {"batches": 1, "read": new.count(), "kept": sum(r["count"] for r in periods), "written": read_curves(session, output).where(F.col("period").isin(touched)).count()}
        log.info("batch %d: read %d rows of %s, kept %d, wrote %d rows of %d periods to %s", number, counts["read"], events, counts["kept"], counts["written"], len(touched), out)
        for name, n in counts.items():
            done[name] += n

    source = spark.readStream.schema(EVENTS)
    if settings.files_per_batch:
        source = source.option("maxFilesPerTrigger", settings.files_per_batch)
    stream = source.parquet(events).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    if not done["batches"]:
        log.info("nothing new in %s", events)
    return done


def read_curves(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(CURVES).parquet(f"{output}/curves")


if __name__ == "__main__":
    main("light_curves", {"events": "folder of event files, or a glob of files", "output": "archive", "checkpoint": "the stream's checkpoint"}, archive, Settings)
