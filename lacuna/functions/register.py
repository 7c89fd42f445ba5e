"""Functions for SQL users: scalar, aggregate and table functions registered on a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import special


def register_functions(spark: SparkSession) -> list[str]:
    """Registers ``chi2_sf``, ``wilcoxon_p`` (Arrow scalars), ``trimmed_mean`` (an aggregate) and ``frequency_grid`` (a table function)."""

    @F.pandas_udf("double")
    def chi2_sf(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([special.chi2_sf(a, int(b)) for a, b in zip(x, k)], dtype="float64")

    @F.pandas_udf("double")
    def wilcoxon_p(w: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([special.wilcoxon_p(a, int(b)) for a, b in zip(w, n)], dtype="float64")

    @F.pandas_udf("double")
    def trimmed_mean(x: pd.Series) -> float:
        s = x.dropna().sort_values().to_numpy()
        cut = int(0.05 * len(s))
        return float(s[cut:len(s) - cut].mean()) if len(s) else float("nan")

    @F.udtf(returnType="k long, freq double")
    class FrequencyGrid:
        def eval(self, fmin: float, fmax: float, baseline: float):
            step = 1 / (5 * baseline)
            for k in range(1 + round((fmax - fmin) / step)):
                yield k, fmin + k * step

    for name, f in (("chi2_sf", chi2_sf), ("wilcoxon_p", wilcoxon_p), ("trimmed_mean", trimmed_mean)):
        spark.udf.register(name, f)
    spark.udtf.register("frequency_grid", FrequencyGrid)
    return ["chi2_sf", "wilcoxon_p", "trimmed_mean", "frequency_grid"]
