"""Fixed schemas, and the one rule of missing values: SQL NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SERIES = "series_id long, idx int, t double, flux double"
GAPPED = SERIES + ", fraction double, seed long, is_missing boolean, obs double, truth double"
METRICS = ("rmse", "mae", "mse", "relative_error", "period_recovered", "period_rel_err", "amplitude_error", "phase_error", "runtime_s", "memory_mb")
RAW_RESULT = (
    "method string, method_key string, fraction double, seed long, seed_idx int, rmse double, mae double, mse double, relative_error double, "
    "period_recovered int, period_rel_err double, amplitude_error double, phase_error double, runtime_s double, memory_mb double")
#: Feature names in the fixed order of the feature vector.
FEATURES = (
    "ls_period", "ls_power", "phase_amplitude", "phase_skewness",
    "flux_mean", "flux_std", "flux_skewness", "flux_kurtosis", "flux_mad",
    "stetson_j", "stetson_k", "stetson_l", "eta_index", "r_cs",
    "f_5_95", "f_10_90", "f_25_75",
    "acf_lag1", "acf_lag2", "acf_lag3", "acf_lag5", "acf_lag10", "acf_lag20",
    "phase_kurtosis", "phase_std", "period_ratio_half", "period_ratio_double", "ls_power_2nd", "ls_period_2nd",
    "flux_range", "above_2sigma_frac", "below_2sigma_frac", "flux_median", "flux_trimmed_mean", "slope_ratio",
)


class SchemaError(ValueError):
    """A required column is absent."""


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise SchemaError(f"missing columns: {', '.join(absent)}")
    return df


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """Replaces NaN and infinities by NULL in the named (default: all) double columns."""
    for c in columns or [n for n, k in df.dtypes if k in ("double", "float")]:
        bad = F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        df = df.withColumn(c, F.when(~bad, F.col(c)))
    return df
