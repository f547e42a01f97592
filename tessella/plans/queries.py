"""One query per operator, over the projections of the driver's tables."""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import canon
from tessella.operators import graph, ingest, pairs, scoring, sensitivity, splits, transfer
from tessella.operators import statistics as st
from tessella.plans import demo
from tessella.sources import io
from tessella.sources.scratch import Scratch

TOP_K, RESAMPLES, SEED = 10, 2000, 42
QUERIES: dict = {}


def query(f):
    @functools.wraps(f)
    def run(spark, d):
        demo.forget()
        try:
            return f(spark, d)
        finally:
            demo.forget()

    QUERIES[f.__name__] = run
    return run


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def discovery(c: DataFrame) -> DataFrame:
    return c.where("analysis_split = 'discovery'")


def test_of(c: DataFrame) -> DataFrame:
    return c.where("analysis_split = 'test'")


@demo.shared
def frozen(spark: SparkSession, d: str) -> DataFrame:
    effects = st.effects(discovery(demo.ranked_comparisons(spark, d)), demo.scores(spark, d)).select("concept_id", F.round("effect", 9).alias("effect"))
    return demo.kept(st.select_candidates(effects, demo.concepts(spark, d), TOP_K))


def listed(f: DataFrame) -> list[int]:
    """The concepts of a frozen list (at most 2 * TOP_K)."""
    return [r.concept_id for r in f.select("concept_id").collect()]


# --- canonical values -----------------------------------------------------------------------
@query
def prompt_normalize(spark, d):
    t = demo.table(spark, d, "documents")
    return t.select("doc_id", F.md5(canon.normalize_prompt(F.col("text"))).alias("norm_md5"))


@query
def prompt_digest(spark, d):
    t = demo.table(spark, d, "pages")
    return t.select("page_id", canon.prompt_group(F.col("url")).alias("prompt_group_id")).unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("page_id"), canon.prompt_group(F.lit(None).cast("string")).alias("prompt_group_id")))


@query
def uid_from_url(spark, d):
    t = demo.table(spark, d, "orders").select("o_orderkey")
    h = F.md5(F.col("o_orderkey").cast("string"))
    k = F.col("o_orderkey") % 5
    v = F.when(k == 0, canon.hyphenated(h)).when(k == 1, F.concat(F.lit("https://x.org/a/"), F.upper(canon.hyphenated(h)), F.lit(".png?v=1"))).when(k == 2, h).when(k == 3, F.lit("none"))
    return t.select("o_orderkey", canon.source_uid(v).alias("uid"))


@query
def identity_violations(spark, d):
    t = demo.table(spark, d, "orders").withColumn("u", canon.hyphenated(F.md5(F.col("o_orderkey").cast("string"))))
    k = F.col("o_orderkey") % 4
    a = F.struct(F.concat(F.lit("http://h/"), F.when(k == 1, F.lit("x")).otherwise(F.col("u")), F.lit(".jpg")).alias("url"), F.when(k == 2, "other").otherwise(" a  b ").alias("prompt"), F.col("o_orderstatus").alias("seed"))
    o = F.struct(F.col("u").alias("uid"), F.lit("a b").alias("prompt"), F.when(k == 3, "F").alias("seed"))
    t = t.select("o_orderkey", a.alias("archive"), o.alias("original"))
    return t.select("o_orderkey", canon.identity_violation(t, "archive", "original").alias("violation"))


@query
def safe_paths(spark, d):
    t = demo.table(spark, d, "pages")
    k = F.col("page_id") % 6
    path = F.regexp_replace("url", "^[a-z]+://", "")
    name = F.when(k == 1, F.concat(F.lit("/"), path)).when(k == 2, F.concat(F.lit("x/../"), path)).when(k == 3, F.concat(F.lit("C:"), path)).when(k == 4, F.concat(F.lit("a\\"), path)).otherwise(path)
    return t.select("page_id", canon.safe_member(name).alias("safe"))


@query
def whole_numbers(spark, d):
    t = demo.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("x"))
    k = F.col("l_orderkey") % 4
    v = F.when(k == 0, F.col("l_orderkey").cast("string")).when(k == 1, F.concat(F.col("l_orderkey").cast("string"), F.lit(".5"))).when(k == 2, "nan").otherwise(F.concat(F.col("l_orderkey").cast("string"), F.lit(".0")))
    return t.select("l_orderkey", canon.whole_number(v).alias("value"))


@query
def clean_values(spark, d):
    t = demo.table(spark, d, "events")
    v = F.when(F.col("event_id") % 3 == 0, float("nan")).when(F.col("event_id") % 3 == 1, float("inf")).otherwise(F.col("value"))
    return t.select("event_id", F.round(canon.clean_number(v), 6).alias("value"))


@query
def missingness_audit(spark, d):
    t = demo.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 7 == 1, " \t").otherwise(F.col("text")).alias("text"), "lang", "source", "n_chars")
    return ingest.missingness(t)


# --- sources --------------------------------------------------------------------------------
@query
def split_union_scan(spark, d):
    """A file per split, written and read back as one table."""
    t = demo.table(spark, d, "conversations")
    root = Scratch(spark, "splits").root
    paths = {s: f"{root}/{s}.parquet" for s in ("train", "validation", "test")}
    for k, path in enumerate(paths.values()):
        t.where(F.col("conv_id") % 3 == k).write.parquet(path)
    return io.union_splits(spark, paths).groupBy("original_split").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"))


@query
def uid_shard_scan(spark, d):
    """Column-pruned: where each candidate uid occurs (four columns to rows)."""
    return io.uid_occurrences(demo.choice_rows(spark, d), "ranking_id", [f"image_{k}_uid" for k in range(1, 5)]).withColumnRenamed("first_row", "first_ranking")


@query
def coverage_audit(spark, d):
    """Archive of images with i % 3 <> 0: known overlap and complete events."""
    images, events = demo.choice(spark, d)
    archive = images.where("cast(image_uid as bigint) % 3 <> 0 or cast(image_uid as bigint) < 40").select("image_id")
    return splits.coverage(events, archive)


@query
def telemetry_summary(spark, d):
    t = demo.table(spark, d, "events")
    t = t.select("event_type", F.when(F.col("event_id") % 11 == 0, "[N/A]").otherwise(F.concat(F.lit(" "), (F.col("event_id") % 100).cast("string"), F.lit(" %"))).alias("u"), F.concat((F.col("user_id") * 7).cast("string"), F.lit(" MiB")).alias("m"))
    return io.telemetry_summary(t, "event_type", "u", "m")


# --- ingest ---------------------------------------------------------------------------------
@query
def ranked_ingest(spark, d):
    e = demo.ranked(spark, d)[1]
    return e.select("event_id", "original_split", "prompt_group_id", F.array_join("candidate_ids", ",").alias("candidates"), F.array_join(F.transform("entries", lambda x: x["rank"].cast("string")), ",").alias("ranks"), "observed_candidates", "exclusion_reason")


@query
def choice_ingest(spark, d):
    e = demo.choice(spark, d)[1]
    return e.select("event_id", "prompt_group_id", F.array_join("candidate_ids", ",").alias("candidates"), "winner_image_id", "annotator_id", "exclusion_reason", "prompts_match", "negative_prompts_compatible")


@query
def ranked_exclusions(spark, d):
    """Groups of five with one defect each, by number: every reason of ranked groups."""
    images, events = ingest.ranked_events(demo.broken_groups(spark, d))
    return events.select("event_id", "exclusion_reason")


@query
def choice_exclusions(spark, d):
    """Events with one defect each, by number: every reason of choice events."""
    images, rankings = demo.broken_choices(spark, d)
    return ingest.choice_events(rankings, ingest.choice_images(images)[0]).select("event_id", "exclusion_reason")


@query
def exclusion_histogram(spark, d):
    return ingest.exclusion_histogram(demo.choice(spark, d)[1])


@query
def candidate_count_dist(spark, d):
    return ingest.candidate_count_distribution(demo.ranked(spark, d)[1])


@query
def reused_images(spark, d):
    return ingest.reused_images(demo.choice(spark, d)[1])


@query
def components_chain(spark, d):
    """Events that share nothing but an image with the next: ten in a row are one component."""
    e = demo.table(spark, d, "orders").select(F.col("o_orderkey").alias("j"))
    name = F.concat(F.lit("e"), F.lpad(F.col("j").cast("string"), 12, "0"))
    image = lambda k: F.concat(F.lit("i"), k.cast("string"))
    last = F.col("j") % 10 == 9
    events = e.select(name.alias("event_id"), F.sha2(name, 256).alias("prompt_group_id"), F.when(last, F.array(image(F.col("j")))).otherwise(F.array(image(F.col("j")), image(F.col("j") + 1))).alias("candidate_ids"), "j")
    images = events.select(F.explode("candidate_ids").alias("image_id")).distinct()
    return graph.components(events, images)


# --- components, splits, cohorts ------------------------------------------------------------
@query
def components_base(spark, d):
    images, events = demo.ranked(spark, d)
    return graph.components(events, images)


@query
def components_choice(spark, d):
    images, events = demo.choice(spark, d)
    return graph.components(events, images)


@query
def components_annotator(spark, d):
    images, events = demo.choice(spark, d)
    return graph.components(events, images, annotators=True)


@query
def official_split(spark, d):
    return demo.ranked_split(spark, d)[1].select("event_id", "dependency_cluster_id", "analysis_split")


@query
def grouped_split(spark, d):
    return demo.choice_split(spark, d)[1].select("event_id", "analysis_split")


@query
def split_audit(spark, d):
    return splits.split_audit(demo.choice_split(spark, d)[1])


@query
def leakage_check(spark, d):
    """Splits by event instead of component leak; those components are listed."""
    images, events = demo.ranked(spark, d)
    loose = events.withColumn("analysis_split", F.when(F.col("original_split") == "train", "discovery").otherwise(F.col("original_split")))
    return splits.leaking_components(loose, graph.components(events, images))


@query
def hash_quarantine(spark, d):
    """Images 0, 150 and 75 turn out to have one content."""
    images, events = demo.ranked_split(spark, d)
    images = images.withColumn("content_hash", F.when(F.col("image_id").isin("ranked:0", "ranked:150", "ranked:75"), "same"))
    return splits.quarantine_conflicts(events, images).select("event_id", "analysis_split", "sampled")


@query
def component_sample(spark, d):
    images, events = demo.choice(spark, d)
    tied = splits.assign_splits(events, images)
    return splits.sample_components(tied, 20, SEED).select("event_id", "sampled")


@query
def cohort_restrict(spark, d):
    images, events = demo.choice(spark, d)
    inside = images.where("cast(image_uid as bigint) % 12 <> 1").select("image_id")
    return splits.restrict_cohort(events, images, inside).groupBy("exclusion_reason").agg(F.count("*").alias("n"))


@query
def complete_events(spark, d):
    images, events = demo.ranked(spark, d)
    return splits.complete_events(events, images.where("cast(image_path as bigint) % 9 <> 4"))


@query
def required_images(spark, d):
    return splits.required_images(demo.choice_split(spark, d)[1])


# --- pairs ----------------------------------------------------------------------------------
def _pairs(spark, d, mode):
    c = demo.ranked_comparisons(spark, d, mode)
    return r6(c.select("event_id", "preferred_image_id", "rejected_image_id", "within_event_weight", "analysis_split", "construction_mode"), "within_event_weight")


@query
def strict_pairs(spark, d):
    return _pairs(spark, d, "all_strict_pairs")


@query
def best_vs_rest_pairs(spark, d):
    return _pairs(spark, d, "best_vs_rest")


@query
def best_vs_worst_pairs(spark, d):
    return _pairs(spark, d, "best_vs_worst")


@query
def winner_vs_rest_pairs(spark, d):
    c = pairs.construct_comparisons(demo.choice_split(spark, d)[1])
    return r6(c.select("event_id", "preferred_image_id", "rejected_image_id", "within_event_weight", "analysis_split"), "within_event_weight")


@query
def incomplete_exclusions(spark, d):
    images, events = demo.ranked_split(spark, d)
    return pairs.excluded_events(events, images.where("cast(image_path as bigint) % 9 <> 4"))


# --- scores ---------------------------------------------------------------------------------
@query
def concept_norm_audit(spark, d):
    return scoring.bank_audit(demo.concepts(spark, d))


@query
def max_patch_scores(spark, d):
    return r6(demo.scores(spark, d).long().where("score is not null"), "score")


@query
def patch_argmax(spark, d):
    return r6(scoring.patch_argmax(demo.patches(spark, d), demo.concepts(spark, d)), "sim")


@query
def nearest_bank_row(spark, d):
    others = demo.table(spark, d, "embeddings").where(F.col("vec_id") >= demo.bank_size(spark, d)).select(F.col("vec_id").cast("int").alias("concept_id"), demo.vector().alias("embedding"))
    return r6(scoring.nearest_rows(others, demo.concepts(spark, d)), "sim")


@query
def bank_diagnosis(spark, d):
    shifted = demo.table(spark, d, "embeddings").where(F.col("vec_id").between(1, demo.bank_size(spark, d))).select((F.col("vec_id") - 1).cast("int").alias("concept_id"), demo.vector().alias("embedding"))
    return scoring.bank_diagnosis(shifted, demo.concepts(spark, d))


def _contents(spark, d):
    rows = demo.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("image_id"), F.md5("text").alias("content_hash"), F.when(F.col("doc_id") % 4 == 0, F.md5(F.lower("text"))).alias("pixel_hash"))
    return rows


@query
def row_dedup_index(spark, d):
    return scoring.row_index(_contents(spark, d))


@query
def worker_partition(spark, d):
    return scoring.worker_of(scoring.row_index(_contents(spark, d)), 4)


@query
def score_reuse(spark, d):
    rows = _contents(spark, d).withColumn("score_row", F.xxhash64("content_hash") * 0 + F.col("image_id").cast("bigint")).withColumn("pixel_hash", F.lit(None).cast("string"))
    last = rows.groupBy("content_hash").agg(F.max("score_row").alias("score_row"), F.max_by("image_id", "score_row").alias("image_id")).withColumn("pixel_hash", F.lit(None).cast("string"))
    return scoring.score_reuse(rows.where("score_row % 2 = 0"), last.where("score_row % 3 <> 0"))


@query
def score_equivalence(spark, d):
    s = demo.scores(spark, d)

    def changed(ids, x):
        x = np.where(ids == 3, x + 0.001, x)
        x[:, (ids == 4) | (ids >= 49)] = np.nan
        return x

    return r6(scoring.equivalence(s, dataclasses.replace(s, edit=changed)), "max_abs_difference")


# --- estimands ------------------------------------------------------------------------------
@query
def hierarchical_effects(spark, d):
    return r6(st.effects(discovery(demo.ranked_comparisons(spark, d)), demo.scores(spark, d)), *st.METRICS)


@query
def effects_eager(spark, d):
    return r6(st.eager_effects(discovery(demo.ranked_comparisons(spark, d)), demo.scores(spark, d)), "effect")


@query
def pair_concordance(spark, d):
    return st.pair_wins(discovery(demo.ranked_comparisons(spark, d)), demo.scores(spark, d), 0.05)


@query
def agg_counts(spark, d):
    return st.counts(demo.ranked_comparisons(spark, d), ("analysis_split",))


@query
def pooled_auc(spark, d):
    t = demo.table(spark, d, "documents").join(demo.table(spark, d, "labels"), "doc_id").where("quality is not null")
    rows = t.select("lang", (F.col("quality") == 1).alias("positive"), F.col("n_chars").cast("double").alias("value"), (1.0 + F.col("doc_id") % 3).alias("weight"))
    return r6(st.pooled_auc(rows, ("lang",)), "auc")


@query
def signed_topk(spark, d):
    return r6(frozen(spark, d), "discovery_effect")


@query
def bootstrap_ci(spark, d):
    prompts = demo.kept(st.prompt_values(discovery(demo.ranked_comparisons(spark, d)), demo.scores(spark, d)))
    return r6(st.cluster_bootstrap(prompts, "effect", RESAMPLES, SEED), "low", "high")


EVALUATED = ("concept_id", "side", "direction", "discovery_rank", "heldout_effect", "effect_ci_low", "effect_ci_high", "raw_concordance", "direction_adjusted_concordance", "adjusted_concordance_ci_low", "adjusted_concordance_ci_high")


@query
def frozen_eval(spark, d):
    f = frozen(spark, d)
    prompts = demo.kept(st.prompt_values(test_of(demo.ranked_comparisons(spark, d)), demo.scores(spark, d), concepts=listed(f)))
    return r6(st.evaluate_frozen(f, prompts, RESAMPLES, SEED).select(*EVALUATED), *EVALUATED[4:])


@query
def joint_score(spark, d):
    # rounded so that ties stay ties in both engines
    s = st.joint_scores(demo.scores(spark, d), frozen(spark, d)).withColumn("score", F.round("score", 9))
    prompts = st.prompt_values(test_of(demo.ranked_comparisons(spark, d)), s)
    return r6(st.hierarchical_means(prompts).select("effect", "concordance", "prompts"), "effect", "concordance")


@query
def all_concepts_wide(spark, d):
    long = st.effects(demo.ranked_comparisons(spark, d), demo.scores(spark, d), by=("analysis_split",))
    return long.groupBy("concept_id").pivot("analysis_split", ["discovery", "validation", "test"]).agg(*[F.round(F.first(m), 6).alias(m) for m in st.METRICS])


@query
def construction_sensitivity(spark, d):
    images, events = demo.ranked_split(spark, d)
    c = None
    for m in ingest.MODES:
        part = pairs.construct_comparisons(events, mode=m)
        c = part if c is None else c.unionByName(part)
    return r6(st.effects(discovery(c), demo.scores(spark, d), by=("construction_mode",)).select("construction_mode", "concept_id", "effect", "prompts"), "effect")


@query
def distribution_summary(spark, d):
    t = demo.table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 10 != 0, F.col("value")))
    return r6(st.distribution(t, "v", ("event_type",)), "min", "max", "q25", "q50", "q75")


@query
def effect_spearman(spark, d):
    return r6(st.spearman(demo.table(spark, d, "part"), "p_retailprice", "p_size"), "spearman")


# --- sensitivities --------------------------------------------------------------------------
@query
def event_strata(spark, d):
    images, events = demo.choice_split(spark, d)
    c = pairs.construct_comparisons(events)
    live = events.join(c.select("event_id").distinct(), "event_id", "left_semi")
    i = F.col("image_uid").cast("bigint")
    k = F.floor(i / 4)
    size = (1 + F.when(k % 5 == 0, i % 2).otherwise(0)).cast("int")
    images = images.withColumns(
        {
            "width": 256 * size,
            "height": F.when(k % 2 == 0, 128 * size).otherwise((128 + i % 3).cast("int")),
            "valid_patches": (3 + F.when(k % 4 == 1, i % 2).otherwise(0)).cast("int"),
            "classification": F.when(k % 7 != 3, F.concat(F.lit("c"), (k % 3).cast("string"))),
        }
    ).withColumn("aspect_ratio", F.col("width") / F.col("height"))
    return sensitivity.event_strata(live, images).groupBy("stratum").agg(F.count("*").alias("events"))


@query
def confounder_distributions(spark, d):
    images, events = demo.choice_split(spark, d)
    live = sensitivity.active_images(pairs.construct_comparisons(events), events, images)
    return live.groupBy(F.coalesce("model_id", F.lit("unavailable")).alias("model_id")).agg(F.count("*").alias("images"), F.min("width").alias("min_width"), F.max("width").alias("max_width"))


@query
def confounder_audit(spark, d):
    """Distributions of six numbers of the images, some of them missing."""
    images, events = demo.choice_split(spark, d)
    i = F.col("image_uid").cast("bigint")
    images = images.withColumns({"height": F.when(i % 13 != 0, 128 + 32 * (i % 4)), "valid_patches": 1 + i % 9, "gs": F.when(i % 3 != 0, i % 5 + 0.5), "steps": F.when(i % 2 == 0, 20 + i % 7)})
    images = images.withColumn("aspect_ratio", F.col("width") / F.col("height"))
    return r6(sensitivity.confounder_audit(pairs.construct_comparisons(events), events, images), "min", "max", "q25", "q50", "q75")


@query
def annotator_audit(spark, d):
    events = demo.choice_split(spark, d)[1]
    return sensitivity.annotator_counts(pairs.construct_comparisons(events), events)


def _choice_pairs(spark, d):
    images, events = demo.choice_split(spark, d)
    return images, pairs.construct_comparisons(events)


@query
def generator_pair_strata(spark, d):
    images, c = _choice_pairs(spark, d)
    s = sensitivity.generator_pair_strata(c, images)
    return s.groupBy("stratum").agg(F.count("*").alias("pairs"), F.round(F.sum("within_event_weight"), 6).alias("weight"))


@query
def generator_sensitivity(spark, d):
    images, c = _choice_pairs(spark, d)
    s = sensitivity.generator_pair_strata(c, images)
    return r6(st.effects(s, demo.scores(spark, d, "choice:"), by=("stratum",)).select("stratum", "concept_id", "effect", "prompts"), "effect")


@query
def activation_corr(spark, d):
    f = frozen(spark, d)
    got = sensitivity.activation_correlation(demo.scores(spark, d).only(listed(f)).long(), demo.ranked_comparisons(spark, d), f)
    return r6(got.select("concept_id", "kept_id", "correlation"), "correlation")


@query
def diversity_filter(spark, d):
    f = frozen(spark, d)
    return sensitivity.diversity_filter(sensitivity.activation_correlation(demo.scores(spark, d).only(listed(f)).long(), demo.ranked_comparisons(spark, d), f), f, 0.1)


@query
def gallery_selection(spark, d):
    f = frozen(spark, d)
    got = sensitivity.gallery_selection(test_of(demo.ranked_comparisons(spark, d)), demo.scores(spark, d).only(listed(f)).long().withColumn("score", F.round("score", 9)), f)
    return r6(got, "difference")


# --- two datasets ---------------------------------------------------------------------------
def _effects(spark, d):
    names = demo.concepts(spark, d).select("concept_id", "concept")
    left = st.effects(discovery(demo.ranked_comparisons(spark, d)), demo.scores(spark, d))
    right = st.effects(discovery(_choice_pairs(spark, d)[1]), demo.scores(spark, d, "choice:"))
    return tuple(x.select("concept_id", F.round("effect", 9).alias("effect")).join(names, "concept_id") for x in (left, right))


@query
def direction_agreement(spark, d):
    return r6(transfer.agreement(transfer.joined_effects(*_effects(spark, d))), "spearman", "direction_agreement")


@query
def topk_overlap(spark, d):
    left, right = _effects(spark, d)
    names = demo.concepts(spark, d)
    return r6(transfer.topk_overlap(st.select_candidates(left, names, 10), st.select_candidates(right, names, 10)), "jaccard")


def _hashed(images: DataFrame) -> DataFrame:
    """Ranked and choice images of one number share a content for numbers under 12."""
    n = F.substring_index("image_id", ":", -1).cast("bigint")
    return images.withColumn("content_hash", F.concat(F.lit("h"), F.when(n < 12, n.cast("string")).otherwise(F.col("image_id"))))


def _transfer(spark, d):
    li, le = demo.ranked_split(spark, d)
    ri, re = demo.choice_split(spark, d)
    donors = le.join(discovery(pairs.construct_comparisons(le)).select("event_id").distinct(), "event_id", "left_semi")
    target = demo.kept(pairs.construct_comparisons(re))
    hit = transfer.overlapping_events(re.join(target.select("event_id").distinct(), "event_id", "left_semi"), _hashed(ri), donors, _hashed(li))
    return target, hit


@query
def transfer_exclusions(spark, d):
    target, hit = _transfer(spark, d)
    kept = transfer.retained_comparisons(target, hit)
    return target.groupBy("analysis_split").agg(F.count("*").alias("pairs")).join(kept.groupBy("analysis_split").agg(F.count("*").alias("retained")), "analysis_split", "left").fillna(0, ["retained"])


@query
def transfer_eval(spark, d):
    target, hit = _transfer(spark, d)
    kept = transfer.retained_comparisons(target, hit)
    f = frozen(spark, d)
    prompts = demo.kept(st.prompt_values(kept, demo.scores(spark, d, "choice:"), concepts=listed(f)))
    got = st.evaluate_frozen(f, prompts, RESAMPLES, SEED).select(*EVALUATED)
    return r6(got, *EVALUATED[4:])


@query
def duplicate_audit(spark, d):
    li, le = demo.ranked(spark, d)
    ri, re = demo.choice(spark, d)
    return transfer.duplicate_audit(le, _hashed(li), re, _hashed(ri))


@query
def replication_summary(spark, d):
    f = frozen(spark, d)
    prompts = st.prompt_values(test_of(demo.ranked_comparisons(spark, d)), demo.scores(spark, d), concepts=listed(f))
    held = st.hierarchical_means(prompts).select("concept_id", F.round("effect", 9).alias("effect"))
    return f.join(held, "concept_id").groupBy("side").agg(F.count_if(F.col("direction") * F.col("effect") > 0).alias("replicated"), F.count("*").alias("candidates"))
