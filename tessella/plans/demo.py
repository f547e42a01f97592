"""Projections of the driver's tables onto ranked groups, choice events, concepts and patches."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import ingest, pairs, scoring, splits
from tessella.sources.scratch import Scratch

_held: dict[tuple, object] = {}


def forget() -> None:
    """Ends the sharing below; each query starts with it."""
    _held.clear()


def shared(f):
    """Within a query a projection is made once, however many branches ask for it."""

    @functools.wraps(f)
    def once(spark, d, *args):
        key = (f.__name__, d, *args)
        if key not in _held:
            _held[key] = f(spark, d, *args)
        return _held[key]

    return once


def kept(df: DataFrame) -> DataFrame:
    """df as a written table, for what several branches of a query read."""
    return Scratch(df.sparkSession, "kept").write(df)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@shared
def bank_size(spark: SparkSession, d: str) -> int:
    """A tenth of the vectors are the concept bank, so it grows with the table."""
    return table(spark, d, "embeddings").count() // 10


def vector() -> Column:
    """The vectors have length one; these have not."""
    return F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 5))


def concepts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where(F.col("vec_id") < bank_size(spark, d))
    return e.select(F.col("vec_id").cast("int").alias("concept_id"), F.concat(F.lit("c"), "vec_id").alias("concept"), vector().alias("embedding"))


def patches(spark: SparkSession, d: str, prefix: str = "ranked:") -> DataFrame:
    """Two patches an image; every seventh vector, from the fourth, is padding."""
    e = table(spark, d, "embeddings")
    i = F.floor(F.col("vec_id") / 2).cast("bigint")
    name = F.concat(F.lit(prefix), i.cast("string"))
    return e.select(i.alias("i"), name.alias("image_id"), (F.col("vec_id") % 2).cast("int").alias("patch_id"), (F.col("vec_id") % 7 != 3).alias("valid"), vector().alias("embedding"), "label")


@shared
def scores(spark: SparkSession, d: str, prefix: str = "ranked:") -> scoring.PatchScores:
    """Scores of the vocabulary, made where they are read; image numbers whose valid patches are
    none have no row."""
    return scoring.PatchScores(patches(spark, d, prefix), concepts(spark, d))


def ranked_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("vec_id % 2 = 0")
    i = (F.col("vec_id") / 2).cast("bigint")
    e = e.select(i.alias("i"), F.floor(i / 5).cast("bigint").alias("g"), "label")
    g = F.col("g")
    split = F.when(g % 20 < 14, "train").when(g % 20 < 17, "validation").otherwise("test")
    prompt = F.when(g % 13 == 5, "shared").otherwise(F.concat(F.lit("  prompt "), (g % 40).cast("string"), F.lit("  x ")))
    return e.select(
        split.alias("original_split"),
        g.cast("string").alias("prompt_id"),
        prompt.alias("prompt"),
        F.col("i").cast("string").alias("image_path"),
        (1 + F.col("label") % 3).cast("bigint").alias("rank"),
        F.when(g % 17 == 0, 6).otherwise(5).cast("bigint").alias("image_amount_in_total"),
        F.col("i").alias("ordinal"),
    )


def ranked(spark: SparkSession, d: str, mode: str = "all_strict_pairs") -> tuple[DataFrame, DataFrame]:
    return ingest.ranked_events(ranked_rows(spark, d), mode)


@shared
def ranked_split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(images, events) with components, official splits and everything sampled."""
    images, events = ranked(spark, d)
    events = kept(events)
    return images, kept(splits.sample_components(splits.assign_splits(events, images), 0))


def whole_runs(spark: SparkSession, d: str, size: int) -> DataFrame:
    """The numbers (vec_id) of all runs of vectors of the given size, so that the last run is whole
    whatever the number of vectors."""
    k = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / size).cast("bigint").alias("k")).distinct()
    return k.select(F.explode(F.array(*[F.col("k") * size + j for j in range(size)])).alias("vec_id"))


def broken_groups(spark: SparkSession, d: str) -> DataFrame:
    """Ranked groups of five vectors; the group's number modulo 8 is its defect (0: none)."""
    g, k, x = F.floor(F.col("vec_id") / 5).cast("bigint"), F.col("vec_id") % 5, F.col("vec_id").cast("string")
    defect = g % 8
    first = k == 0
    path = F.when((defect == 1) & first, None).when((defect == 4) & (k == 1), (F.col("vec_id") - 1).cast("string")).when((defect == 7) & first, "shared").otherwise(x)
    return whole_runs(spark, d, 5).select(
        F.lit("train").alias("original_split"),
        g.cast("string").alias("prompt_id"),
        F.concat(F.lit("prompt "), g.cast("string"), F.when((defect == 2) & (k == 2), " other").otherwise("")).alias("prompt"),
        path.alias("image_path"),
        F.when(defect == 6, 1.0).when((defect == 3) & first, 1.5).otherwise((1 + k).cast("double")).alias("rank"),
        F.when(defect == 5, 6.0).otherwise(5.0).alias("image_amount_in_total"),
        F.col("vec_id").alias("ordinal"),
    )


def broken_choices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(images, rankings) of four vectors an event; its number modulo 9 is its defect (0: none)."""
    k, j, i = F.floor(F.col("vec_id") / 4).cast("bigint"), F.col("vec_id") % 4, F.col("vec_id")
    defect = k % 9
    e = whole_runs(spark, d, 4)
    prompt = F.concat(F.lit("p "), k.cast("string"))
    images = e.select(i.cast("string").alias("image_uid"), F.when((defect == 6) & (j == 2), "another").otherwise(prompt).alias("prompt"), F.when((defect == 7) & (j == 2), "blur").alias("negative_prompt"), i.alias("ordinal"))
    twice = e.where((defect == 8) & (j == 3)).select(i.cast("string").alias("image_uid"), F.lit("changed").alias("prompt"), F.lit(None).cast("string").alias("negative_prompt"), (i + 1_000_000).alias("ordinal"))
    one = e.where(j == 0)
    uid = lambda n: (F.col("vec_id") + n).cast("string")
    best = F.when(defect == 1, "none").when(defect == 2, "999999999").otherwise(uid(0))
    rankings = one.select(k.alias("ranking_id"), prompt.alias("prompt"), F.lit(7).alias("user_id"), best.alias("best_image_uid"), uid(0).alias("image_1_uid"), F.when(defect == 3, uid(0)).otherwise(uid(1)).alias("image_2_uid"), uid(2).alias("image_3_uid"), F.when(defect == 4, "missing").otherwise(uid(3)).alias("image_4_uid"), i.alias("ordinal"))
    again = rankings.where(F.col("ranking_id") % 9 == 5).withColumns({"best_image_uid": F.col("image_3_uid"), "ordinal": F.col("ordinal") + 1})
    return images.unionByName(twice), rankings.unionByName(again)


def choice_image_rows(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("i")
    k = F.floor(i / 4)
    rows = table(spark, d, "embeddings").where("vec_id % 2 = 0").select((F.col("vec_id") / 2).cast("bigint").alias("i"))
    negative = F.when((k % 11 == 3) | ((k % 11 == 5) & (i % 4 == 0)), "blur")
    return rows.select(
        i.cast("string").alias("image_uid"),
        F.concat(F.lit("block "), k.cast("bigint").cast("string"), F.when(i % 41 == 0, " altered").otherwise("")).alias("prompt"),
        negative.alias("negative_prompt"),
        F.when(i % 29 == 0, None).otherwise(F.concat(F.lit("m"), (i % 3).cast("string"))).alias("model_id"),
        (256 + 64 * (i % 3)).cast("int").alias("width"),
        i.alias("ordinal"),
    )


def choice_rows(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "embeddings").count() // 8
    e = table(spark, d, "events").where("event_type = 'purchase'")
    k = F.col("event_id") % n
    w = F.col("user_id") % 5
    return e.select(
        F.col("event_id").alias("ranking_id"),
        F.concat(F.lit("block "), k.cast("string")).alias("prompt"),
        "user_id",
        *[(4 * k + j).cast("string").alias(f"image_{j + 1}_uid") for j in range(4)],
        F.when(w == 4, "none").otherwise((4 * k + w).cast("string")).alias("best_image_uid"),
        F.col("event_id").alias("ordinal"),
    )


def choice(spark: SparkSession, d: str, cohort: str = "matched") -> tuple[DataFrame, DataFrame]:
    images, _ = ingest.choice_images(choice_image_rows(spark, d))
    return images.withColumn("dataset", F.lit("choice")).withColumn("source_image_uid", F.col("image_uid")), ingest.choice_events(choice_rows(spark, d), images, cohort)


@shared
def choice_split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    images, events = choice(spark, d)
    events = kept(events)
    return images, kept(splits.sample_components(splits.assign_splits(events, images), 0))


@shared
def ranked_comparisons(spark: SparkSession, d: str, mode: str | None = None) -> DataFrame:
    images, events = ranked_split(spark, d)
    return kept(pairs.construct_comparisons(events, mode=mode))
