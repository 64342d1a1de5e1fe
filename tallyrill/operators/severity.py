"""Accessibility results: counts, severities, first nodes of each violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrill.functions.text import first_line

# The mark of each impact.
ICONS = {"critical": "🔴", "serious": "🟠", "moderate": "🟡", "minor": "🟢"}
NO_ICON = "⚪"


def icon(impact: Column) -> Column:
    out = F.when(impact.isNull(), NO_ICON)
    for name, mark in ICONS.items():
        out = out.when(impact == name, mark)
    return out.otherwise(NO_ICON)


def with_tags(rules: DataFrame, wanted: list[str], tags: str = "tags") -> DataFrame:
    """Rules that have one of the wanted tags."""
    return rules.where(F.arrays_overlap(F.col(tags), F.array(*map(F.lit, wanted))))


def summary(results: DataFrame) -> DataFrame:
    """One row of counts from ``outcome`` (pass, violation, incomplete)."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return results.agg(n("pass").alias("passed"), n("violation").alias("violations"), n("incomplete").alias("incomplete"))


def first_nodes(nodes: DataFrame, rule: str, order: str, text: str, most: int = 3) -> DataFrame:
    """For each rule: ``affected``, the first lines of its first nodes, and ``more`` where there are others.

    Ranks are cut before the rows of a rule are gathered.
    """
    counts = nodes.groupBy(rule).agg(F.count("*").alias("affected"))
    place = F.row_number().over(Window.partitionBy(rule).orderBy(order))
    first = nodes.withColumn("_r", place).where(F.col("_r") <= most).groupBy(rule).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", first_line(F.col(text)).alias("t")))), lambda x: x["t"]).alias("shown"))
    more = F.when(F.col("affected") > most, F.concat(F.lit("... and "), (F.col("affected") - most).cast("string"), F.lit(" more")))
    return counts.join(first, rule).withColumn("more", more)


def target_path(target: Column) -> Column:
    return F.array_join(target, " > ")


def nested(violations: DataFrame) -> DataFrame:
    """``id, impact, affected_elements, nodes`` from an array column ``nodes`` of ``target, html, failureSummary``; html cut to 200."""
    node = lambda n: F.struct(target_path(n["target"]).alias("target"), F.substring(n["html"], 1, 200).alias("html"), n["failureSummary"].alias("failureSummary"))
    return violations.withColumn("affected_elements", F.size("nodes").cast("long")).withColumn("nodes", F.transform("nodes", node))


def report_rows(violations: DataFrame) -> DataFrame:
    """The report's table: severity with its mark, rule, description, elements."""
    return violations.select(F.concat(icon(F.col("impact")), F.lit(" "), F.coalesce("impact", F.lit("undefined"))).alias("Severity"), F.col("id").alias("Rule"), F.col("description").alias("Description"), F.size("nodes").alias("Elements"))
