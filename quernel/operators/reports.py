"""Import validation and data-quality reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.operators import selection


@dataclass(frozen=True)
class Rule:
    """A named condition that every row must meet; null counts as a failure."""

    check: str
    holds: Column
    fatal: bool = True


def validate(df: DataFrame, rules: list[Rule], dataset_id: str, unique: tuple[str, ...] = (), parents: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """One row per check: dataset_id, check, status, n_failed, detail.

    All row rules are counted in one pass; the key and each parent take one
    more. ``unique`` columns form a
    key; surplus rows are failures. ``parents`` maps a column to a table and
    its key; values without a parent are failures, nulls are not. An empty
    table passes every check.
    """
    parts = []
    cells = [F.struct(F.lit(r.check).alias("check"), F.lit(r.fatal).alias("fatal"), F.count_if(~F.coalesce(r.holds, F.lit(False))).alias("n_failed")) for r in rules]
    if cells:
        parts.append(df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*"))
    if unique:
        surplus = df.groupBy(*unique).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_failed"))
        parts.append(surplus.select(F.lit(f"unique({', '.join(unique)})").alias("check"), F.lit(True).alias("fatal"), "n_failed"))
    for column, (parent, key) in (parents or {}).items():
        lost = df.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti").agg(F.count("*").alias("n_failed"))
        parts.append(lost.select(F.lit(f"parent({column})").alias("check"), F.lit(True).alias("fatal"), "n_failed"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    status = F.when(F.col("n_failed") == 0, "pass").when(F.col("fatal"), "fail").otherwise("warn")
    return out.select(F.lit(dataset_id).alias("dataset_id"), "check", status.alias("status"), "n_failed", F.concat(F.col("n_failed").cast("string"), F.lit(" rows")).alias("detail"))


def quality_report(df: DataFrame, dataset_id: str, table: str, columns: list[str] | None = None, quantiles: tuple[float, ...] = (0.5,), sketches: bool = False, sort_rows: int = selection.SORT_ROWS) -> DataFrame:
    """One row per column and metric: dataset_id, table, column, metric, value.

    Metrics: rows, nulls and distinct values of every column; minimum,
    maximum and quantiles (``p50``, ``p99_9``) of numeric ones. All are exact at any size:
    distinct values are exchanged by value, quantiles found by histogram
    rounds (``selection.quantiles``, which run when this is called), so no
    task holds a column. With ``sketches`` the metrics ``approx_distinct``
    and ``approx_p50`` come beside them, under these names of their own.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    columns = [c for c in (columns or df.columns) if not isinstance(kinds[c], (T.MapType, T.VariantType))]
    numeric = [c for c in columns if isinstance(kinds[c], T.NumericType)]
    names = {p: "p" + f"{100 * p:04.1f}".removesuffix(".0").replace(".", "_") for p in quantiles}
    cells: list[tuple[str, str, Column]] = [("*", "rows", F.count("*"))]
    for c in columns:
        q = F.col(f"`{c}`")
        cells.append((c, "nulls", F.count_if(q.isNull())))
        if c in numeric:
            cells += [(c, "min", F.min(q)), (c, "max", F.max(q))]
        if sketches:
            cells.append((c, "approx_distinct", F.approx_count_distinct(q)))
            cells += [(c, f"approx_{names[p]}", F.approx_percentile(q, F.lit(p))) for p in quantiles if c in numeric]
    wide = df.agg(*[e.cast("double").alias(f"v{i}") for i, (_, _, e) in enumerate(cells)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(m).alias("metric"), F.col(f"v{i}").alias("value")) for i, (c, m, _) in enumerate(cells)])
    out = wide.select(F.explode(rows).alias("x")).select("x.*")
    if columns:
        out = out.unionByName(selection.distinct_counts(df, columns).select("column", F.lit("distinct").alias("metric"), F.col("n").cast("double").alias("value")))
    held = [(c, names[p], v) for c in numeric for p, v in zip(quantiles, selection.quantiles(df, c, list(quantiles), sort_rows))]
    if held:
        out = out.unionByName(df.sparkSession.createDataFrame(held, "column string, metric string, value double"))
    return out.select(F.lit(dataset_id).alias("dataset_id"), F.lit(table).alias("table"), "column", "metric", "value")
