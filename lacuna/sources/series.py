"""Series sources: adapters over tables, Parquet and CSV readers, catalogues, completeness gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import require

#: Day number that event times are counted from; it keeps 2 pi f t small.
EPOCH_DAY = 19723.0
CLASS_LABELS = {"RRLYR": 0, "DSCT": 1, "EB": 2, "GDOR": 3, "SOL": 4, "ROT": 5}


def days(ts: Column) -> Column:
    """Days since the epoch of a timestamp (with or without zone; the session runs in UTC)."""
    return F.unix_micros(ts.cast("timestamp")).cast("double") / F.lit(86400e6)


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(series_id, event_id, t, flux, label)`` of the events table: one irregular series a user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("series_id"), "event_id", (days(F.col("ts")) - EPOCH_DAY).alias("t"), F.col("value").alias("flux"), F.col("event_type").alias("label"))


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(series, t, flux)``: daily order totals by priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.col("o_orderpriority").alias("series"), F.floor(days(F.col("o_orderdate"))).cast("double").alias("t")).agg(F.sum("o_totalprice").alias("flux"))


def ship_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(series, t, flux)``: daily shipped value by return flag."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return x.groupBy(F.col("l_returnflag").alias("series"), F.floor(days(F.col("l_shipdate"))).cast("double").alias("t")).agg(F.sum("l_extendedprice").alias("flux"))


def load_light_curve(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """One Parquet light curve; only the named columns are read."""
    df = spark.read.parquet(path)
    return require(df, columns).select(*columns) if columns else df


def load_dataset(spark: SparkSession, folder: str, window: int = 4000, label_columns: tuple[str, ...] = ("label", "class_label")) -> DataFrame:
    """All light curves of a folder, ``series_id`` from the file's stem, the first ``window`` rows each by time.

    Files lacking time, flux or a label contribute nothing: with a merged schema their columns are null (so a file
    whose flux is null throughout counts as lacking it). Files of one stem in several folders are cut apart, but share their ``series_id``.
    """
    df = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(folder)
    labels = [F.col(c) for c in label_columns if c in df.columns]
    if not labels or not {"time", "flux"} <= set(df.columns):
        return df.sparkSession.createDataFrame([], "series_id string, time double, flux double, label int")
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.parquet)?$", 1)
    rows = df.select(F.col("_metadata.file_path").alias("_file"), stem.alias("series_id"), "time", "flux", F.coalesce(*labels).cast("int").alias("label"))
    rows = rows.withColumn("_seen", F.count("flux").over(Window.partitionBy("_file"))).where("_seen > 0 AND time IS NOT NULL AND label IS NOT NULL")
    return truncate_rows(rows.drop("_seen"), window, ("_file",), ("time",)).drop("_file")


def truncate_rows(df: DataFrame, n: int, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first ``n`` rows of each series."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def load_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true")
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)


def load_gap_files(spark: SparkSession, paths: dict[str, str], schema: str = "time double, ideal_flux double, observed_flux double, mask int") -> DataFrame:
    """Gap CSV files as one frame, tagged with their ``dataset`` name."""
    out = None
    for name, path in paths.items():
        df = spark.read.option("header", "true").schema(schema).csv(path).withColumn("dataset", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def completeness(df: DataFrame, keys: tuple[str, ...] = ("series_id",), value: str = "obs") -> DataFrame:
    return df.groupBy(*keys).agg((F.count(value) / F.count(F.lit(1))).alias("completeness"))


def completeness_gate(df: DataFrame, threshold: float = 0.95, keys: tuple[str, ...] = ("series_id",), value: str = "obs") -> DataFrame:
    """Rows of the series whose observed share reaches ``threshold``."""
    good = completeness(df, keys, value).where(F.col("completeness") >= threshold).select(*keys)
    return df.join(good, list(keys), "left_semi")


def union_catalogues(catalogues: list[tuple[str, DataFrame]], key: str = "KIC") -> DataFrame:
    """Catalogues in order of priority, tagged with their class; the first to name a key wins."""
    tagged = [df.select(key).withColumn("class_name", F.lit(name)).withColumn("_p", F.lit(i)) for i, (name, df) in enumerate(catalogues)]
    allof = tagged[0]
    for x in tagged[1:]:
        allof = allof.unionByName(x)
    first = allof.groupBy(key).agg(F.min_by("class_name", "_p").alias("class_name"))
    return first.withColumn("class_label", class_label(F.col("class_name")))


def class_label(name: Column, labels: dict[str, int] | None = None) -> Column:
    out = F.lit(None).cast("int")
    for k, v in (labels or CLASS_LABELS).items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out


def normalise_classes(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Maps raw class names; rows of unmapped classes go."""
    out = F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return df.withColumn("class_name", out).where("class_name IS NOT NULL")
