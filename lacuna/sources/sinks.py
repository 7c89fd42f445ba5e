"""Writers: CSV, Parquet, JSON metadata, formatted tables, data frames behind plots."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_results(df: DataFrame, path: str, single: bool = True) -> None:
    """CSV with a header; ``single`` for results small enough for one file."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", "true").csv(path)


def save_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def save_json(meta: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        json.dump(meta, f, indent=2, sort_keys=True)


def render_table(df: DataFrame, fmt: str = "latex", float_format: str = "%.4f", caption: str = "", label: str = "", max_rows: int = 10_000) -> str:
    """A result table as text. Refuses frames of more than ``max_rows`` rows: they are no report."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    cells = [["" if v is None else float_format % v if isinstance(v, float) else str(v) for v in r] for r in rows]
    head = df.columns
    if fmt == "csv":
        return "\n".join([",".join(head), *[",".join(r) for r in cells]]) + "\n"
    if fmt == "markdown":
        return "\n".join(f"| {' | '.join(r)} |" for r in [head, ["---"] * len(head), *cells]) + "\n"
    if fmt != "latex":
        raise ValueError(f"unknown table format {fmt!r}")
    safe = lambda s: s.replace("\\", r"\textbackslash{}").replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    lines = [" & ".join(map(safe, r)) + r" \\" for r in [head, *cells]]
    body = [r"\begin{tabular}{" + "l" * len(head) + "}", r"\toprule", lines[0], r"\midrule", *lines[1:], r"\bottomrule", r"\end{tabular}"]
    if caption or label:
        body = [r"\begin{table}", *([rf"\caption{{{caption}}}"] if caption else []), *([rf"\label{{{label}}}"] if label else []), *body, r"\end{table}"]
    return "\n".join(body) + "\n"


def save_table(df: DataFrame, path: str, fmt: str = "latex", **options) -> None:
    text = render_table(df, fmt, **options)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def stem(kic) -> "F.Column":
    """File stem of a target: its number padded to nine digits."""
    return F.format_string("KIC%09d", kic)
