"""Accounting of lines: unions of spans, duplicated and savable lines, coverage, and pairs explained by clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.functions.scalar import encloses


def span_islands(spans: DataFrame, *keys: str, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Overlapping or adjacent spans of each key, merged: ``(*keys, start, end)``. Reversed and null spans are dropped."""
    valid = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end))).select(*keys, start, end).distinct()
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = valid.withColumn("fresh", F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0))
    island = F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("island", island).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def later_members(members: DataFrame) -> DataFrame:
    """All members of each cluster but the first by path and start line."""
    w = Window.partitionBy("cluster").orderBy("path", "start_line", "end_line")
    return members.withColumn("place", F.row_number().over(w)).where("place > 1").drop("place")


def duplicated_lines(members: DataFrame) -> DataFrame:
    """One row ``duplicated_lines``: lines in any later member of any cluster, each line once."""
    islands = span_islands(later_members(members), "path")
    return islands.agg(F.coalesce(F.sum(F.col("end_line") - F.col("start_line") + 1), F.lit(0)).cast("bigint").alias("duplicated_lines"))


def savable_lines(members: DataFrame) -> DataFrame:
    """``(cluster, savable)``: the lines of all members but the first."""
    return later_members(members).groupBy("cluster").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).cast("bigint").alias("savable"))


def enclosed_sides(pairs: DataFrame, members: DataFrame, side: str) -> DataFrame:
    """``(pair, cluster, member)``: cluster members that enclose one side of a pair."""
    inner = pairs.select("pair", F.col(f"path_{side}").alias("path"), F.col(f"start_{side}").alias("s"), F.col(f"end_{side}").alias("e"))
    return inner.join(members, "path").where(encloses(F.col("start_line"), F.col("end_line"), F.col("s"), F.col("e"))).select("pair", "cluster", "member")


def unexplained_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs ``(pair, path_a, start_a, end_a, path_b, ...)`` that no cluster explains.

    A cluster explains a pair if two different members of it enclose the two sides.
    """
    a = enclosed_sides(pairs, members, "a").withColumnRenamed("member", "ma")
    b = enclosed_sides(pairs, members, "b").withColumnRenamed("member", "mb")
    explained = a.join(b, ["pair", "cluster"]).where(F.col("ma") != F.col("mb")).select("pair").distinct()
    return pairs.join(explained, "pair", "left_anti")


def coverage(files: DataFrame, analyzed: DataFrame) -> DataFrame:
    """One row ``(covered_lines, total_lines, percent)`` of ``files(path, lines)``; an empty set is fully covered."""
    flagged = files.join(analyzed.select("path").distinct().withColumn("seen", F.lit(True)), "path", "left")
    sums = flagged.agg(F.coalesce(F.sum(F.when(F.col("seen"), F.col("lines"))), F.lit(0)).alias("covered_lines"), F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"))
    return sums.withColumn("percent", F.coalesce(F.try_divide(F.col("covered_lines") * 100.0, F.col("total_lines")), F.lit(100.0)))


def uncovered_by_extension(files: DataFrame, analyzed: DataFrame) -> DataFrame:
    """``(ext, lines)`` of the files that no detector analysed."""
    return files.join(analyzed.select("path").distinct(), "path", "left_anti").groupBy("ext").agg(F.sum("lines").alias("lines"))


def duplication_percent(duplicated: Column, covered: Column) -> Column:
    return F.when(covered > 0, duplicated * 100.0 / covered).otherwise(0.0)
