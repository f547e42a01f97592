"""Strata, confounder audits, activation correlation and the presentation list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.statistics import distribution, pearson

#: Numbers of an image whose distributions the confounder audit shows.
CONFOUNDERS = ("valid_patches", "width", "height", "aspect_ratio", "gs", "steps")


def event_strata(events: DataFrame, images: DataFrame) -> DataFrame:
    """(event_id, stratum) by all candidates of an event; an event may be in several."""
    side = images.select("image_id", *[c if c in images.columns else F.lit(None).cast(t).alias(c) for c, t in (("model_id", "string"), ("valid_patches", "int"), ("aspect_ratio", "double"), ("width", "int"), ("height", "int"), ("classification", "string"))])
    each = events.select("event_id", F.explode("candidate_ids").alias("image_id")).join(side, "image_id", "left")
    n = F.count("*")

    def all_one(c: str):
        return (F.count(c) == n) & (F.count_distinct(c) == 1)

    facts = each.groupBy("event_id").agg(
        (F.count("model_id") == n).alias("models_known"),
        F.count_distinct("model_id").alias("models"),
        F.min("model_id").alias("model"),
        all_one("valid_patches").alias("patches"),
        ((F.count("aspect_ratio") == n) & (F.max("aspect_ratio") - F.min("aspect_ratio") < 1e-8)).alias("ratio"),
        ((F.count("width") == n) & (F.count("height") == n) & (F.count_distinct("width") == 1) & (F.count_distinct("height") == 1)).alias("size"),
        all_one("classification").alias("category"),
        F.min("classification").alias("class"),
    )
    same = F.col("models_known") & (F.col("models") == 1)
    names = F.array(
        F.when(same, "same_model"),
        F.when(same, F.concat(F.lit("generator:"), "model")),
        F.when(F.col("models_known") & (F.col("models") > 1), "mixed_models"),
        F.when(F.col("patches"), "equal_patch_count_event"),
        F.when(F.col("ratio"), "equal_aspect_ratio_event"),
        F.when(F.col("size"), "equal_resolution_event"),
        F.when(F.col("category"), F.concat(F.lit("category:"), "class")),
    )
    return facts.select("event_id", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("stratum"))


def generator_pair_strata(comparisons: DataFrame, images: DataFrame) -> DataFrame:
    """Comparisons by the generators of their two images, weights renewed within each event.

    Pairs with an unknown generator are left out here only; exact copies count once.
    """
    rows = comparisons.distinct()
    m = images.select("image_id", "model_id").where("model_id is not null")
    rows = rows.join(m.select(F.col("image_id").alias("preferred_image_id"), F.col("model_id").alias("mw")), "preferred_image_id").join(m.select(F.col("image_id").alias("rejected_image_id"), F.col("model_id").alias("ml")), "rejected_image_id")
    same = F.col("mw") == F.col("ml")
    names = F.when(same, F.array(F.lit("same_model"), F.concat(F.lit("same_model:"), "mw"))).otherwise(F.array(F.lit("cross_model")))
    rows = rows.withColumn("stratum", F.explode(names)).drop("mw", "ml")
    size = rows.groupBy("stratum", "event_id").agg(F.count("*").alias("_n"))
    return rows.join(size, ["stratum", "event_id"]).withColumn("within_event_weight", 1.0 / F.col("_n")).drop("_n").select("stratum", *comparisons.columns)


def active_images(comparisons: DataFrame, events: DataFrame, images: DataFrame) -> DataFrame:
    """Images of events that have comparisons."""
    live = events.join(comparisons.select("event_id").distinct(), "event_id", "left_semi")
    return images.join(live.select(F.explode("candidate_ids").alias("image_id")).distinct(), "image_id", "left_semi")


def confounder_audit(comparisons: DataFrame, events: DataFrame, images: DataFrame) -> DataFrame:
    """(field, known, missing, min, max, q25, q50, q75) of CONFOUNDERS over the images of events
    that have comparisons; a column that images lack is missing throughout."""
    live = active_images(comparisons, events, images)
    cells = live.select(*[(F.col(c) if c in images.columns else F.lit(None)).cast("double").alias(c) for c in CONFOUNDERS])
    return distribution(cells.unpivot([], list(CONFOUNDERS), "field", "value"), "value", ("field",))


def annotator_counts(comparisons: DataFrame, events: DataFrame) -> DataFrame:
    live = events.join(comparisons.select("event_id").distinct(), "event_id", "left_semi").where("annotator_id is not null")
    n = live.groupBy("annotator_id").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("annotators"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def activation_correlation(scores: DataFrame, comparisons: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pearson correlation of each ordered pair of frozen concepts of one side over discovery
    images; 0 if one is constant."""
    discovery = comparisons.where("analysis_split = 'discovery'").select(F.explode(F.array("preferred_image_id", "rejected_image_id")).alias("image_id")).distinct()
    c = F.broadcast(candidates.select("concept_id", "side", "discovery_rank"))  # at most 2 * top_k rows
    s = scores.join(discovery, "image_id", "left_semi").join(c, "concept_id").select("image_id", "side", "concept_id", "discovery_rank", F.col("score").cast("double").alias("x"))
    t = s.withColumnsRenamed({"concept_id": "kept_id", "discovery_rank": "kept_rank", "x": "y"})
    both = s.join(t, ["image_id", "side"]).where("kept_rank < discovery_rank")
    r = both.groupBy("side", "concept_id", "discovery_rank", "kept_id", "kept_rank").agg(pearson("x", "y").alias("r"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return r.select("side", "concept_id", "discovery_rank", "kept_id", "kept_rank", F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.col("r")).otherwise(0.0).alias("correlation"))


def diversity_filter(correlations: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """Greedy in frozen order within a side: a concept goes if it correlates with one already
    kept; the first such is its parent.  The list has at most 2 * top_k rows."""
    if not 0 < threshold <= 1:
        raise ValueError("the correlation threshold must lie in (0, 1]")
    near = {(r.concept_id, r.kept_id): r.correlation for r in correlations.where(F.col("correlation") >= threshold).collect()}
    kept: dict[str, list[int]] = {}
    out = []
    for c in candidates.orderBy("side", "discovery_rank").collect():
        parent = next((k for k in kept.get(c.side, []) if (c.concept_id, k) in near), None)
        if parent is None:
            kept.setdefault(c.side, []).append(c.concept_id)
        out.append((c.concept_id, c.side, c.discovery_rank, parent is None, parent))
    return correlations.sparkSession.createDataFrame(out, "concept_id int, side string, discovery_rank int, retained boolean, parent_concept_id int")


def gallery_selection(comparisons: DataFrame, scores: DataFrame, candidates: DataFrame, per_kind: int = 2, seed: int = 42) -> DataFrame:
    """Examples per concept and kind: the best pair of each prompt, then the best prompts;
    ties and the random audit go by a seeded hash."""
    s = scores.join(F.broadcast(candidates.select("concept_id")), "concept_id", "left_semi")
    c = comparisons.join(F.broadcast(candidates.select("concept_id", "direction")))
    left = s.select("concept_id", F.col("image_id").alias("preferred_image_id"), F.col("score").cast("double").alias("w"))
    right = s.select("concept_id", F.col("image_id").alias("rejected_image_id"), F.col("score").cast("double").alias("l"))
    p = c.join(left, ["concept_id", "preferred_image_id"]).join(right, ["concept_id", "rejected_image_id"]).withColumn("difference", F.col("w") - F.col("l"))
    p = p.withColumn("signed", F.col("direction") * F.col("difference"))
    p = p.withColumn("h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("concept_id").cast("string"), "event_id", "preferred_image_id", "rejected_image_id"), 256))
    kinds = F.array(F.when(F.col("signed") > 0, F.struct(F.lit("supportive").alias("selection"), (-F.col("signed")).alias("o"))), F.when(F.col("signed") < 0, F.struct(F.lit("counterexample").alias("selection"), F.col("signed").alias("o"))), F.struct(F.lit("random_audit").alias("selection"), F.lit(0.0).alias("o")))
    p = p.withColumn("k", F.explode(F.filter(kinds, lambda x: x.isNotNull()))).select("*", "k.*")
    best = p.withColumn("a", F.row_number().over(Window.partitionBy("concept_id", "selection", "prompt_group_id").orderBy("o", "h"))).where("a = 1")
    got = best.withColumn("place", F.row_number().over(Window.partitionBy("concept_id", "selection").orderBy("o", "h"))).where(F.col("place") <= per_kind)
    return got.select("concept_id", "selection", "place", "prompt_group_id", "event_id", "preferred_image_id", "rejected_image_id", "difference")
