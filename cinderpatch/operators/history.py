"""Histories of fits as tables: which rounds were best, and where patience ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_best(history: DataFrame, by: list[str], loss: str = "val_loss", at: str = "round") -> DataFrame:
    """Adds ``is_best``, whether a round's loss is below all before it, and ``waited``, the rounds since the last such
    one. NaN is below nothing. A fit's rounds meet in one task; fits are dealt by ``by``."""
    order = Window.partitionBy(*by).orderBy(at)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    is_best = ~F.isnan(loss) & (F.col(loss) < F.coalesce(F.min(F.nanvl(F.col(loss), F.lit(float("inf")))).over(earlier), F.lit(float("inf"))))
    numbered = history.withColumns({"is_best": F.coalesce(is_best, F.lit(False)), "_n": F.row_number().over(order)})
    last = F.max(F.when(F.col("is_best"), F.col("_n"))).over(order)
    return numbered.withColumn("waited", F.col("_n") - F.coalesce(last, F.lit(0))).drop("_n")


def stopped_early(history: DataFrame, by: list[str], patience: int, loss: str = "val_loss", at: str = "round") -> DataFrame:
    """The rounds that are run when a fit ends after ``patience`` rounds without a better loss."""
    order = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    done = with_best(history, by, loss, at).withColumn("_over", F.coalesce(F.max(F.col("waited") >= patience).over(order), F.lit(False)))
    return done.where("not _over").drop("_over")


def best_rounds(history: DataFrame, by: list[str], patience: int, loss: str = "val_loss", at: str = "round") -> DataFrame:
    """For each fit: rounds run, the best of them and its loss (null where no loss is a number)."""
    ran = stopped_early(history, by, patience, loss, at)
    best = F.min(F.when(F.col("is_best"), F.struct(loss, at)))
    return ran.groupBy(*by).agg(F.count("*").alias("rounds"), best.alias("_b")).select(*by, "rounds", F.col("_b")[at].alias("best_round"), F.col("_b")[loss].alias("best_loss"))
