"""Cross-validation and features whose tasks and plans don't grow with what lies behind them."""

from pyspark.sql import functions as F

from lacuna.operators import classify, impute
from lacuna.operators import features as ft


def test_shape_features_are_dealt_by_rows(spark, monkeypatch):
    df = spark.range(1600).select((F.col("id") % 80).alias("series_id"), (F.col("id") % 2).cast("double").alias("label"), F.col("id").alias("event_id"), F.col("id").cast("double").alias("t"), F.sin("id").alias("flux"))
    want = ft.shape_features(df, ("series_id", "label")).collect()
    monkeypatch.setattr(impute, "TASK_ROWS", 50)
    out = ft.shape_features(df, ("series_id", "label"))
    assert out.select(F.spark_partition_id()).distinct().count() > 8  # 1600 rows: 32 partitions
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want))


def test_folds_are_staged_and_models_see_files_only(spark):
    df = spark.range(240).select(F.col("id").alias("series_id"), (F.col("id") % 2).cast("double").alias("label"), ((F.col("id") % 2) * 3 + F.rand(1)).alias("x"))
    seen = []

    def fit(x):
        seen.append((x.count(), x._jdf.queryExecution().executedPlan().toString()))
        return classify.train_forest(x, ["x"], trees=3, depth=3, folds=0)[0]

    out = classify.cross_validated(df, fit, folds=3)
    assert all("InMemoryRelation" not in plan and "FileScan" in plan for _, plan in seen) and sum(n for n, _ in seen) == 480
    assert "Forest" not in out._jdf.queryExecution().logical().toString() and "Join" not in out._jdf.queryExecution().logical().toString()
    assert out.dtypes == [("fold", "int"), ("accuracy", "double"), ("macro_f1", "double"), ("mcc", "double")]
    assert [r.fold for r in out.orderBy("fold").collect()] == [0, 1, 2] and all(min(r[1:]) > 1 - 1e-9 for r in out.collect())


def test_shape_features_of_words_sort_once_and_need_no_rank(spark, tmp_path):
    from lacuna.plans import catalogue_kernels as ck

    spark.range(40).selectExpr("id AS doc_id", "repeat(concat('ab c', id, ' '), 9) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(40).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    out = ck._documents(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan[:plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert plan.count("Sort [") == 1 and "ObjectHashAggregate" not in plan and "row_number" not in plan.replace("row_number() windowspecdefinition(series_id, label, t", "")
    assert out.dtypes[:2] == [("series_id", "bigint"), ("label", "double")] and out.count() == 40
