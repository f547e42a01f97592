"""Canonical images and events from ranked groups and from choice events, with audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import canon

MODES = ("all_strict_pairs", "best_vs_rest", "best_vs_worst")


def _required(df: DataFrame, column: str) -> DataFrame:
    """A null identity is an error, not an exclusion."""
    return df.where(F.assert_true(F.col(column).isNotNull(), F.lit(f"a row lacks {column}")).isNull())


def ranked_rows(rows: DataFrame) -> DataFrame:
    """Exact copies removed (the first of them counts), normalized prompt and identity added.

    rows: original_split, prompt_id, prompt, image_path, rank, image_amount_in_total, ordinal
    and any other fields; the ordinal is the source order and takes no part in equality.
    """
    fields = sorted(c for c in rows.columns if c != "ordinal")
    key = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    first = rows.withColumn("_k", key).groupBy("_k").agg(F.min_by(F.struct(*rows.columns), "ordinal").alias("r")).select("r.*")
    first = _required(first, "prompt_id")
    return first.withColumns(
        {
            "split": F.coalesce("original_split", F.lit("train")),
            "group": F.col("prompt_id").cast("string"),
            "norm": canon.normalize_prompt(F.col("prompt")),
            "image_id": F.when(F.length("image_path") > 0, F.concat(F.lit("ranked:"), "image_path")),
            "rank_ok": canon.whole_number(F.col("rank").cast("string")),
            "count_ok": canon.whole_number(F.col("image_amount_in_total").cast("string")),
        }
    )


def ranked_events(rows: DataFrame, mode: str = "all_strict_pairs") -> tuple[DataFrame, DataFrame]:
    """(images, events) of ranked groups.

    Reasons of single records overwrite each other in source order; then come, by precedence,
    conflicting_image_prompt_metadata, inconsistent_group_prompt, the last record's reason,
    incomplete_annotated_group and no_strict_rank_pairs.
    """
    r = ranked_rows(rows)
    seen = F.row_number().over(Window.partitionBy("split", "group", "image_id").orderBy("ordinal")) > 1
    bad = F.col("rank_ok").isNull() | F.col("count_ok").isNull() | (F.col("count_ok") < 2)
    reason = F.when(F.col("image_id").isNull(), "missing_image_identity").when(bad, "invalid_rank_or_candidate_count").when(seen, "conflicting_duplicate_image_annotation")
    r = r.withColumn("reason", reason)
    present = F.col("image_id").isNotNull()
    # the rank kept of an image is its last valid one
    per_image = r.where(present).groupBy("split", "group", "image_id").agg(F.max_by("rank_ok", F.when(F.col("rank_ok").isNotNull(), F.col("ordinal"))).alias("rank"))
    ranked = per_image.groupBy("split", "group").agg(F.array_sort(F.collect_list(F.struct("image_id", "rank"))).alias("entries"))
    counts = F.collect_set(F.when(present & ~bad, F.col("count_ok")))
    group = r.groupBy("split", "group").agg(
        F.min_by("prompt", "ordinal").alias("original_prompt"),
        F.min_by("norm", "ordinal").alias("first_norm"),
        F.array_sort(counts).alias("expected_candidates"),
        F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("ordinal"))).alias("record_reason"),
        (F.count_distinct("norm") + F.max(F.col("norm").isNull().cast("int"))).alias("prompts"),
        F.max(F.col("norm").isNull()).alias("null_prompt"),
    )
    prompts_of = r.where(present).groupBy("image_id").agg((F.count_distinct("norm") + F.max(F.col("norm").isNull().cast("int"))).alias("n"))
    conflict = r.where(present).select("split", "group", "image_id").distinct().join(prompts_of.where("n > 1"), "image_id").select("split", "group").distinct().withColumn("conflict", F.lit(True))
    e = group.join(ranked, ["split", "group"], "left").join(conflict, ["split", "group"], "left")
    entries = F.coalesce("entries", F.array().cast("array<struct<image_id:string,rank:bigint>>"))
    e = e.withColumn("entries", entries).withColumn("observed_candidates", F.size("entries"))
    incomplete = (F.size("expected_candidates") != 1) | (F.col("observed_candidates") != F.get("expected_candidates", F.lit(0)))
    ranks = F.array_distinct(F.filter(F.transform("entries", lambda x: x["rank"]), lambda x: x.isNotNull()))
    why = (
        F.when(F.col("conflict"), "conflicting_image_prompt_metadata")
        .when((F.col("prompts") != 1) | F.col("null_prompt"), "inconsistent_group_prompt")
        .when(F.col("record_reason").isNotNull(), F.col("record_reason"))
        .when(incomplete, "incomplete_annotated_group")
        .when(F.size(ranks) < 2, "no_strict_rank_pairs")
    )
    events = e.select(
        F.lit("ranked").alias("dataset"),
        F.concat(F.lit("ranked:"), "split", F.lit(":"), "group").alias("event_id"),
        F.col("split").alias("original_split"),
        "original_prompt",
        canon.digest_text(F.col("first_norm")).alias("prompt_group_id"),
        F.lit(None).cast("string").alias("annotator_id"),
        F.transform("entries", lambda x: x["image_id"]).alias("candidate_ids"),
        "entries",
        F.lit(None).cast("string").alias("winner_image_id"),
        F.lit(mode).alias("construction_mode"),
        "expected_candidates",
        "observed_candidates",
        why.alias("exclusion_reason"),
    )
    extra = [c for c in ("model_id", "classification", "width", "height", "aspect_ratio") if c in rows.columns]
    first = F.min_by(F.struct("image_path", "prompt", "norm", *extra), F.struct("split", "group", "ordinal")).alias("r")
    stem = canon.path_stem(F.col("image_path"))
    uid = F.when(F.lower(stem).rlike(f"^{canon.UUID_TEXT}$"), canon.hyphenated(stem))
    images = r.where(present).groupBy("image_id").agg(first).select("image_id", "r.*")
    images = images.select(F.lit("ranked").alias("dataset"), "image_id", F.coalesce(uid, "image_path").alias("source_image_uid"), F.col("prompt").alias("original_prompt"), "norm", *extra)
    return images, events


def choice_images(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, duplicate counts): the first row of each image_uid, with a conflict flag."""
    rows = _required(rows, "image_uid")
    fields = sorted(c for c in rows.columns if c != "ordinal")
    key = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    kept = rows.withColumn("_k", key).groupBy("image_uid").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "image_uid"]), "ordinal").alias("r"), (F.count_distinct("_k") > 1).alias("conflict"), F.count("*").alias("copies"))
    out = kept.select("image_uid", "r.*", "conflict", "copies").withColumn("image_id", F.concat(F.lit("choice:"), "image_uid"))
    return out.withColumn("norm", canon.normalize_prompt(F.col("prompt"))).withColumn("negative_norm", canon.normalize_prompt(F.col("negative_prompt"))), out


def choice_events(rankings: DataFrame, images: DataFrame, cohort: str = "matched") -> DataFrame:
    """Events of one winner among four, by the reasons' precedence.

    rankings: ranking_id, prompt, user_id, image_1_uid..image_4_uid, best_image_uid, ordinal;
    images: as from choice_images.
    """
    rankings = _required(rankings, "ranking_id")
    fields = sorted(c for c in rankings.columns if c != "ordinal")
    key = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    e = rankings.withColumn("_k", key).groupBy(F.col("ranking_id").cast("string").alias("uid")).agg(F.min_by(F.struct(*rankings.columns), "ordinal").alias("r"), (F.count_distinct("_k") > 1).alias("event_conflict"))
    uids = F.array(*[F.col(f"r.image_{i}_uid") for i in range(1, 5)])
    e = e.select("uid", "r.prompt", F.col("r.user_id").cast("string").alias("annotator_id"), F.col("r.best_image_uid").alias("winner"), F.filter(uids, lambda x: x.isNotNull()).alias("raw"), "event_conflict", *(["r.original_split"] if "original_split" in rankings.columns else []))
    e = e.withColumn("norm", canon.normalize_prompt(F.col("prompt")))
    side = images.select(F.col("image_uid").alias("c"), F.col("norm").alias("image_norm"), "negative_norm", F.col("negative_prompt").isNotNull().alias("has_negative"), F.col("conflict").alias("image_conflict"), F.lit(True).alias("known"))
    wide = e.select("uid", F.col("norm").alias("n"), F.posexplode("raw").alias("pos", "c")).join(side, "c", "left")
    facts = wide.groupBy("uid").agg(
        F.min(F.coalesce("known", F.lit(False))).alias("all_known"),
        F.max(F.coalesce("image_conflict", F.lit(False))).alias("any_conflict"),
        F.min(F.coalesce(F.col("image_norm") == F.col("n"), F.lit(False))).alias("prompts_equal"),
        F.count_if("has_negative").alias("negatives"),
        F.count_distinct("negative_norm").alias("negative_values"),
    )
    e = e.join(facts, "uid", "left")
    whole = (F.size("raw") == 4) & F.col("all_known")
    match = F.coalesce(whole & F.col("norm").isNotNull() & F.col("prompts_equal"), F.lit(False))
    compatible = F.coalesce(whole & ((F.col("negatives") == 0) | ((F.col("negatives") == 4) & (F.col("negative_values") == 1))), F.lit(False))
    why = (
        F.when(F.col("event_conflict"), "conflicting_duplicate_event")
        .when(canon.no_winner(F.col("winner")), "invalid_or_none_selection")
        .when((F.size("raw") != 4) | (F.size(F.array_distinct("raw")) != 4), "invalid_candidate_set")
        .when(~F.array_contains("raw", F.col("winner")), "winner_not_a_candidate")
        .when(~F.coalesce("all_known", F.lit(False)), "missing_candidate_metadata")
        .when(F.col("any_conflict"), "conflicting_image_metadata")
    )
    if cohort == "matched":
        why = why.when(~match, "candidate_prompt_mismatch").when(~compatible, "incompatible_or_partly_missing_negative_prompts")
    split = F.coalesce("original_split", F.lit("train")) if "original_split" in rankings.columns else F.lit("train")
    return e.select(
        F.lit("choice").alias("dataset"),
        F.concat(F.lit("choice:"), "uid").alias("event_id"),
        split.alias("original_split"),
        F.col("prompt").alias("original_prompt"),
        canon.digest_text(F.col("norm")).alias("prompt_group_id"),
        "annotator_id",
        F.transform("raw", lambda x: F.concat(F.lit("choice:"), x)).alias("candidate_ids"),
        F.array().cast("array<struct<image_id:string,rank:bigint>>").alias("entries"),
        F.concat(F.lit("choice:"), "winner").alias("winner_image_id"),
        F.lit("winner_vs_rest").alias("construction_mode"),
        F.array(F.lit(4).cast("bigint")).alias("expected_candidates"),
        F.size("raw").alias("observed_candidates"),
        why.alias("exclusion_reason"),
        match.alias("prompts_match"),
        compatible.alias("negative_prompts_compatible"),
        F.lit(cohort).alias("cohort"),
    )


def missingness(df: DataFrame) -> DataFrame:
    """Nulls and blank strings of every field, in one pass."""
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}

    def blanks(c: str) -> Column:
        return F.count_if(F.length(canon.normalize_prompt(F.col(c), False)) == 0) if c in texts else F.lit(0).cast("bigint")

    one = df.agg(*[F.struct(F.lit(c).alias("field"), F.count_if(F.col(c).isNull()).alias("null_count"), blanks(c).alias("blank_count")).alias(f"_{k}") for k, c in enumerate(df.columns)])
    return one.select(F.explode(F.array(*one.columns)).alias("x")).select("x.*")


def exclusion_histogram(events: DataFrame) -> DataFrame:
    return events.where("exclusion_reason is not null").groupBy("exclusion_reason").agg(F.count("*").alias("n"))


def candidate_count_distribution(events: DataFrame) -> DataFrame:
    ties = F.size(F.array_distinct(F.transform("entries", lambda x: x["rank"]))) < F.size("candidate_ids")
    return events.groupBy("observed_candidates").agg(F.count("*").alias("events"), F.count_if(ties).alias("with_ties"))


def reused_images(events: DataFrame) -> DataFrame:
    n = events.select(F.explode("candidate_ids").alias("image_id")).groupBy("image_id").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("images"), F.count_if(F.col("n") > 1).alias("reused"))
