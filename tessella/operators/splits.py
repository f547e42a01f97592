"""Leak-free splits, capped component samples, availability cohorts and quarantine."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.graph import components
from tessella.operators.numbering import row_numbers
from tessella.sources.scratch import Scratch

SPLITS = ("discovery", "validation", "test")
#: The official names of splits.
ALIASES = {"train": "discovery", "validation": "validation", "test": "test"}
#: The shares of the splits, in their order.
SHARES = (0.70, 0.15, 0.15)
#: Components that the greedy sample reads at once.
READ = 2000


def with_components(events: DataFrame, images: DataFrame, annotators: bool = False) -> DataFrame:
    return events.join(components(events, images, annotators).withColumnRenamed("component_id", "dependency_cluster_id"), "event_id")


def official_split(events: DataFrame) -> DataFrame:
    """A component of one known source split gets it; mixed or unknown ones are quarantined."""
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    one = events.groupBy("dependency_cluster_id").agg(F.min("original_split").alias("lo"), F.max("original_split").alias("hi"))
    split = F.when(F.col("lo") == F.col("hi"), F.try_element_at(alias, F.col("lo")))
    return events.join(one.select("dependency_cluster_id", F.coalesce(split, F.lit("quarantine")).alias("analysis_split")), "dependency_cluster_id")


def quota_sizes(n: int) -> list[int]:
    """Largest-remainder sizes of the three splits of n components."""
    want = [s * n for s in SHARES]
    sizes = [math.floor(w) for w in want]
    for i in sorted(range(3), key=lambda i: (-(want[i] - sizes[i]), i))[: n - sum(sizes)]:
        sizes[i] += 1
    return sizes


def seeded(seed: int, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256)


def shuffled_ids(ids: list[str], seed: int) -> list[str]:
    """NumPy's PCG64 shuffle of the sorted ids."""
    import numpy as np

    ids = sorted(ids)
    np.random.default_rng(seed).shuffle(ids)
    return ids


def grouped_split(events: DataFrame, seed: int = 42, rng: str = "sha") -> DataFrame:
    """Components with an eligible event are dealt 70/15/15, the others are quarantined.

    rng 'sha' orders components by a seeded hash and stays distributed; 'pcg64' repeats NumPy's generator on the driver, for up to 1,000,000 ids.
    """
    able = events.where("exclusion_reason is null").select("dependency_cluster_id").distinct()
    n = able.count()
    a, b, _ = quota_sizes(n)
    if rng == "pcg64":
        if n > 1_000_000:
            raise ValueError("too many components to shuffle on the driver")
        ids = shuffled_ids([r[0] for r in able.collect()], seed)
        ranked = events.sparkSession.createDataFrame([(c, k + 1) for k, c in enumerate(ids)], "dependency_cluster_id string, k long")
    else:
        ranked = row_numbers(able, [seeded(seed, F.col("dependency_cluster_id")), "dependency_cluster_id"], "k").withColumn("k", F.col("k") + 1)
    split = F.when(F.col("k") <= a, "discovery").when(F.col("k") <= a + b, "validation").otherwise("test")
    return events.join(ranked.select("dependency_cluster_id", split.alias("s")), "dependency_cluster_id", "left").withColumn("analysis_split", F.coalesce("s", F.lit("quarantine"))).drop("s")


def assign_splits(events: DataFrame, images: DataFrame, seed: int = 42, policy: str = "auto", rng: str = "sha") -> DataFrame:
    """Components and splits; ranked data keep official splits, choice data are grouped.

    The events are of one dataset.  Without events there are no rows, whatever the policy.
    """
    found = [r.dataset for r in events.select("dataset").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError("split each dataset by itself")
    dataset = found[0] if found else None
    official = policy == "official" or (policy == "auto" and dataset == "ranked")
    if dataset == "ranked" and not official:
        raise ValueError("ranked data keep their official splits")
    if dataset == "choice" and official:
        raise ValueError("choice data have one source split; use the grouped policy")
    tied = with_components(events, images)
    return official_split(tied) if official else grouped_split(tied, seed, rng)


def split_audit(events: DataFrame) -> DataFrame:
    return events.where("exclusion_reason is null").groupBy("analysis_split").agg(F.count("*").alias("events"), F.count_distinct("dependency_cluster_id").alias("components"))


def leaking_components(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Components of more than one split, quarantine aside; empty if there is no leak."""
    rows = events.where("analysis_split <> 'quarantine'").select("event_id", "analysis_split").join(mapping, "event_id")
    return rows.groupBy("component_id").agg(F.count_distinct("analysis_split").alias("splits")).where("splits > 1")


def assert_no_leakage(events: DataFrame, images: DataFrame) -> None:
    if leaking_components(events, components(events, images)).limit(1).count():
        raise ValueError("a prompt, image or content dependency crosses analysis splits")


def quarantine_conflicts(events: DataFrame, images: DataFrame) -> DataFrame:
    """After hashes are known: components of several splits, quarantine counting as one, are
    quarantined and unsampled; cluster ids are renewed."""
    tied = events.drop("dependency_cluster_id").join(components(events, images).withColumnRenamed("component_id", "dependency_cluster_id"), "event_id")
    bad = tied.groupBy("dependency_cluster_id").agg((F.count_distinct("analysis_split") > 1).alias("bad"))
    out = tied.join(bad, "dependency_cluster_id")
    return out.withColumn("analysis_split", F.when(F.col("bad"), "quarantine").otherwise(F.col("analysis_split"))).withColumn("sampled", F.col("sampled") & ~F.col("bad")).drop("bad")


def quotas(limit: int) -> dict[str, int]:
    part = round(limit * 0.15)  # half to even
    return {"discovery": limit - 2 * part, "validation": part, "test": part}


def sample_components(events: DataFrame, limit: int = 500, seed: int = 42) -> DataFrame:
    """Whole components in hash order until the prompt caps; one that overflows is skipped.

    Per split the driver reads the next READ components that still fit, until the cap is met or
    none is left, so it sees few more than it takes; at most ``limit`` are taken.  With limit 0
    all are taken and nothing is gathered.
    """
    able = F.col("exclusion_reason").isNull() & (F.col("analysis_split") != "quarantine")
    if not limit:
        return events.withColumn("sampled", able)
    sizes = events.where(able).groupBy("analysis_split", "dependency_cluster_id").agg(F.count_distinct("prompt_group_id").alias("size"))
    name = F.concat(F.lit(f"[{seed},["), F.to_json(F.array("analysis_split", "dependency_cluster_id")).substr(F.lit(2), F.lit(1 << 30)))
    sizes = Scratch(events.sparkSession, "sample").write(sizes.withColumn("h", F.sha2(F.concat(name, F.lit("]")), 256)))
    taken: list[str] = []
    for split, left in quotas(limit).items():
        after = ""
        while left:
            fits = sizes.where((F.col("analysis_split") == split) & (F.col("size") <= left) & (F.col("h") > after))
            rows = fits.orderBy("h").limit(READ).collect()
            for r in rows:
                if r["size"] <= left:
                    left -= r["size"]
                    taken.append(r.dependency_cluster_id)
            if len(rows) < READ:
                break
            after = rows[-1].h
    mark = events.sparkSession.createDataFrame([(c, True) for c in taken], "dependency_cluster_id string, t boolean")
    return events.join(F.broadcast(mark), "dependency_cluster_id", "left").withColumn("sampled", able & F.coalesce("t", F.lit(False))).drop("t")  # at most limit rows


def complete_events(events: DataFrame, valid: DataFrame) -> DataFrame:
    """event_id of events all of whose candidates are among the valid image_ids."""
    each = events.select("event_id", F.explode_outer("candidate_ids").alias("image_id"))
    known = valid.select("image_id").distinct().withColumn("ok", F.lit(1))
    return each.join(known, "image_id", "left").groupBy("event_id").agg((F.count("ok") == F.count("image_id")).alias("complete")).where("complete").select("event_id")


def coverage(events: DataFrame, archive: DataFrame) -> DataFrame:
    """One row: archive images that eligible events ask for, eligible events whose candidates the
    archive has all, and eligible events."""
    live = events.where("exclusion_reason is null")
    done = complete_events(live, archive).agg(F.count("*").alias("complete_events"))
    wanted = live.select(F.explode("candidate_ids").alias("image_id")).distinct()
    known = archive.select("image_id").distinct().join(wanted, "image_id", "left_semi").agg(F.count("*").alias("covered_images"))
    return known.join(F.broadcast(done)).join(F.broadcast(live.agg(F.count("*").alias("eligible_events"))))  # one row each


def restrict_cohort(events: DataFrame, images: DataFrame, available: DataFrame) -> DataFrame:
    """Eligible events with a candidate outside the declared archive are excluded; splits and
    components stay.  Unknown ids are an error."""
    if available.join(images, "image_id", "left_anti").limit(1).count():
        raise ValueError("the availability list has unknown image ids")
    inside = complete_events(events, available).withColumn("inside", F.lit(True))
    why = F.coalesce("exclusion_reason", F.when(F.col("inside").isNull(), "outside_available_archive_cohort"))
    return events.join(inside, "event_id", "left").withColumn("exclusion_reason", why).drop("inside")


def required_images(events: DataFrame) -> DataFrame:
    """Candidates of sampled, eligible events."""
    return events.where("sampled and exclusion_reason is null").select(F.explode("candidate_ids").alias("image_id")).distinct()


def order_key(seed: int, split: str, component: str) -> str:
    """The hash-order key of sample_components, for checks."""
    return hashlib.sha256(f'[{seed},["{split}","{component}"]]'.encode()).hexdigest()
