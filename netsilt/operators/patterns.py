"""Recurring message templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsilt import rules
from netsilt.functions.columns import lookup, mean_of_thousandths, rounded, surrogate_id
from netsilt.functions.text import message_template


def with_template(classified: DataFrame) -> DataFrame:
    return classified.withColumn("template", message_template("description"))


def _cells(classified: DataFrame) -> DataFrame:
    """Pre-aggregate per (template, source, category, severity).

    A template with a third of all logs is spread over its sources here; all
    later steps work on these few rows.
    """
    return with_template(classified).groupBy("template", "source", "category", "severity").agg(
        F.count("*").alias("n"),
        F.min("timestamp").alias("first"),
        F.max("timestamp").alias("last"),
    )


def recurring_patterns(classified: DataFrame, min_frequency: int = rules.MIN_PATTERN_FREQUENCY) -> DataFrame:
    """One row per template that occurs at least ``min_frequency`` times.

    The devices of a pattern are the relation ``pattern_sources``; here their
    number is given. ``description`` is the beginning of the ``template``, which is whole.
    """
    of_category = Window.partitionBy("template", "category")
    cells = _cells(classified).withColumns({
        "_of_category": F.sum("n").over(of_category), "_category_first": F.min("first").over(of_category)})
    order = {name: rank for rank, name in enumerate(rules.WORST_SEVERITY_ORDER)}
    rank = lookup(order, "severity", 0)
    weight = lookup(rules.IMPACT_WEIGHT, F.upper("severity"), rules.DEFAULT_IMPACT_WEIGHT)
    # worst severity: highest rank, first seen among equals
    earliest = -F.unix_micros("first")
    whole = cells.groupBy("template").agg(
        F.sum("n").alias("frequency"),
        F.count_distinct("source").alias("source_count"),
        F.sort_array(F.collect_set("category")).alias("categories"),
        F.min("first").alias("first_seen"),
        F.max("last").alias("last_seen"),
        F.max_by("severity", F.struct(rank, earliest)).alias("severity"),
        mean_of_thousandths(weight, F.col("n")).alias("_impact"),
        # most common category, first seen among equals
        F.max_by("category", F.struct("_of_category", -F.unix_micros("_category_first"))).alias("top_category"),
    ).filter(F.col("frequency") >= min_frequency)
    return whole.select(
        surrogate_id("PAT", "template").alias("pattern_id"),
        F.substring("template", 1, rules.PATTERN_DESCRIPTION_LENGTH).alias("description"), "template",
        "frequency", "source_count", "categories", "first_seen", "last_seen", "severity",
        F.lit(True).alias("is_recurring"),
        rounded("_impact", 3).alias("impact_score"),
        lookup(rules.PATTERN_ACTION, "top_category", rules.DEFAULT_PATTERN_ACTION).alias("recommended_action"),
    )


def pattern_sources(classified: DataFrame, min_frequency: int = rules.MIN_PATTERN_FREQUENCY) -> DataFrame:
    """(pattern_id, source): every device each recurring pattern was seen on."""
    cells = _cells(classified).groupBy("template", "source").agg(F.sum("n").alias("n"))
    frequent = (
        cells.groupBy("template").agg(F.sum("n").alias("frequency"))
        .filter(F.col("frequency") >= min_frequency).select("template")
    )
    return cells.join(frequent, "template", "left_semi").select(
        surrogate_id("PAT", "template").alias("pattern_id"), "source")


def patterns_by_frequency(patterns: DataFrame) -> DataFrame:
    return patterns.orderBy(F.desc("frequency"), F.desc("impact_score"), "pattern_id")
