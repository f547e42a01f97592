"""Agreement of two datasets and transfer of a frozen list from one to the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.statistics import spearman


def joined_effects(left: DataFrame, right: DataFrame) -> DataFrame:
    """Concepts with both effects; the vocabularies must be equal."""
    both = left.select("concept_id", "concept", F.col("effect").alias("left_effect")).join(right.select("concept_id", F.col("concept").alias("other"), F.col("effect").alias("right_effect")), "concept_id", "full")
    return both.where(F.assert_true(F.col("concept").eqNullSafe(F.col("other")), F.lit("the two vocabularies differ")).isNull()).drop("other")


def agreement(joined: DataFrame) -> DataFrame:
    """Rank correlation and direction agreement; null without data, zero agrees with zero."""
    known = joined.where("left_effect is not null and right_effect is not null")
    same = known.agg(F.avg((F.signum("left_effect") == F.signum("right_effect")).cast("double")).alias("direction_agreement"))
    return spearman(known, "left_effect", "right_effect").join(F.broadcast(same))  # one row each


def topk_overlap(left: DataFrame, right: DataFrame, available: bool = True) -> DataFrame:
    """Intersection and Jaccard per side; null where a dataset has no discovery data."""
    both = left.select("side", "concept_id", F.lit(1).alias("a")).join(right.select("side", "concept_id", F.lit(1).alias("b")), ["side", "concept_id"], "full")
    n = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    got = both.groupBy("side").agg(n.alias("intersection"), F.try_divide(n, F.count("*")).alias("jaccard"))
    return got if available else got.withColumns({"intersection": F.lit(None).cast("bigint"), "jaccard": F.lit(None).cast("double")})


def identities(events: DataFrame, images: DataFrame) -> DataFrame:
    """(event_id, key): normalized prompt and content hashes, not source ids."""
    have = [c for c in ("content_hash", "pixel_hash") if c in images.columns]
    keys = events.select("event_id", F.concat(F.lit("p:"), "prompt_group_id").alias("key"))
    if have:
        side = images.select("image_id", F.explode(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(c[0] + ":"), c)) for c in have])).alias("key")).where("key is not null")
        keys = keys.unionByName(events.select("event_id", F.explode("candidate_ids").alias("image_id")).join(side, "image_id").select("event_id", "key"))
    return keys


def overlapping_events(recipient: DataFrame, recipient_images: DataFrame, donor: DataFrame, donor_images: DataFrame) -> DataFrame:
    """Recipient events that share a prompt or a hash with donor events."""
    donors = identities(donor, donor_images).select("key").distinct()
    return identities(recipient, recipient_images).join(donors, "key", "left_semi").select("event_id").distinct()


def retained_comparisons(target: DataFrame, overlapping: DataFrame) -> DataFrame:
    """Target comparisons without the whole components of overlapping events."""
    bad = target.join(overlapping, "event_id", "left_semi").select("dependency_cluster_id").distinct()
    return target.join(bad, "dependency_cluster_id", "left_anti").select(*target.columns)


def duplicate_audit(left: DataFrame, left_images: DataFrame, right: DataFrame, right_images: DataFrame) -> DataFrame:
    a, b = (identities(e, i).select("key").distinct() for e, i in ((left, left_images), (right, right_images)))
    shared = a.intersect(b)
    return shared.agg(F.count_if(F.col("key").startswith("p:")).alias("shared_prompts"), F.count_if(~F.col("key").startswith("p:")).alias("shared_hashes"))
