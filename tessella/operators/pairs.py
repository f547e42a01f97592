"""Weighted (preferred, rejected) pairs of eligible, completely scored events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.splits import complete_events


def event_pairs(mode: Column | None = None) -> Column:
    """array<struct<w, l>> of an event, within the row: no shuffle."""
    mode = F.col("construction_mode") if mode is None else mode
    ranks = F.transform("entries", lambda x: x["rank"])
    lo, hi = F.array_min(ranks), F.array_max(ranks)

    def losers(w):
        fits = F.filter(
            "entries",
            lambda x: (w["rank"] < x["rank"]) & ((mode == "all_strict_pairs") | (w["rank"] == lo)) & ((mode != "best_vs_worst") | (x["rank"] == hi)),
        )
        return F.transform(fits, lambda x: F.struct(w["image_id"].alias("w"), x["image_id"].alias("l")))

    ranked = F.flatten(F.transform("entries", losers))
    chosen = F.transform(F.filter("candidate_ids", lambda c: c != F.col("winner_image_id")), lambda c: F.struct(F.col("winner_image_id").alias("w"), c.alias("l")))
    return F.when(F.col("dataset") == "choice", chosen).otherwise(ranked)


def construct_comparisons(events: DataFrame, valid: DataFrame | None = None, mode: str | None = None) -> DataFrame:
    """One row per pair; an event with any invalid candidate is left out whole."""
    live = events.where("exclusion_reason is null and sampled and analysis_split <> 'quarantine'")
    if valid is not None:
        live = live.join(complete_events(live, valid), "event_id", "left_semi")
    label = F.col("construction_mode") if mode is None else F.when(F.col("dataset") == "choice", F.col("construction_mode")).otherwise(F.lit(mode))
    rows = live.withColumn("construction_mode", label).withColumn("pairs", event_pairs()).withColumn("n", F.size("pairs"))
    return rows.select("*", F.explode("pairs").alias("p")).select(
        "event_id",
        F.col("p.w").alias("preferred_image_id"),
        F.col("p.l").alias("rejected_image_id"),
        (F.lit(1.0) / F.col("n")).alias("within_event_weight"),
        "prompt_group_id",
        "analysis_split",
        "dependency_cluster_id",
        "construction_mode",
    )


def excluded_events(events: DataFrame, valid: DataFrame) -> DataFrame:
    live = events.where("exclusion_reason is null and sampled and analysis_split <> 'quarantine'")
    return live.join(complete_events(live, valid), "event_id", "left_anti").select("event_id", F.lit("incomplete_valid_scored_event").alias("reason"))
