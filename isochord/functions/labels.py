"""Display strings and axis positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sig_stars(p: Column) -> Column:
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns"))


def params_label(millions: Column) -> Column:
    """86 -> 86M, 1100 -> 1.1B."""
    return F.when(millions >= 1000, F.format_string("%.1fB", (millions / 1000.0)))\
        .otherwise(F.concat(millions.cast("string"), F.lit("M")))


def size_label(size: Column, millions: Column) -> Column:
    return F.format_string("%s (%sM)", size, millions.cast("string"))


def member_label(display: Column, size: Column, millions: Column) -> Column:
    """Model_size_params, without the last part where the count is unknown."""
    return F.concat_ws("_", display, size, params_label(millions))


def performance_axis(models: DataFrame, perf: str = "perf", millions: str = "params_m",
                     name: str = "x") -> DataFrame:
    """Measured performance; log10 of the parameter count only if no model has any.

    Mixing both on one axis is an error at run time.
    """
    known = models.agg(F.count(perf).alias("__known"))
    proxy = F.when(F.col("__known") == 0, F.log10(millions)).otherwise(F.raise_error(F.lit(
        "some models have a measured performance and others do not")).cast("double"))
    return (models.join(F.broadcast(known))
            .withColumn(name, F.coalesce(F.col(perf).cast("double"), proxy))
            .withColumn(f"{name}_is_proxy", F.col("__known") == 0).drop("__known"))
