"""Ingest rules, components, splits, pairs and estimands on small literal rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import canon
from tessella.operators import blocks, graph, ingest, pairs, scoring, sensitivity, splits, transfer
from tessella.operators import statistics as st
from tessella.operators.numbering import row_numbers, running_sums

RANKED = "original_split string, prompt_id string, prompt string, image_path string, rank double, image_amount_in_total double, ordinal long"
COMPARISON = "event_id string, preferred_image_id string, rejected_image_id string, within_event_weight double, prompt_group_id string, analysis_split string, dependency_cluster_id string"


def group(ranks, split="train", name="g", prompt="A cat", total=None, start=0):
    return [(split, name, prompt, f"{name}/{k}.webp", float(r), float(total or len(ranks)), start + k) for k, r in enumerate(ranks)]


def events_of(spark, rows, mode="all_strict_pairs"):
    return ingest.ranked_events(spark.createDataFrame(rows, RANKED), mode)


def reasons(events):
    return {r.event_id.split(":")[-1]: r.exclusion_reason for r in events.select("event_id", "exclusion_reason").collect()}


@pytest.mark.parametrize(("mode", "n"), [("all_strict_pairs", 5), ("best_vs_rest", 4), ("best_vs_worst", 2)])
def test_pair_counts(spark, mode, n):
    _, e = events_of(spark, group((1, 1, 2, 3)), mode)
    e = e.withColumns({"sampled": F.lit(True), "analysis_split": F.lit("test"), "dependency_cluster_id": F.lit("c")})
    got = pairs.construct_comparisons(e)
    assert got.count() == n and math.isclose(got.agg(F.sum("within_event_weight")).first()[0], 1)
    some = e.select(F.explode("candidate_ids").alias("image_id")).where("image_id <> 'ranked:g/1.webp'")
    assert pairs.construct_comparisons(e, some).count() == 0 and pairs.excluded_events(e, some).count() == 1


def test_ranked_reasons(spark):
    rows = [
        *group((1, 1, 2, 3), name="ok"),
        *group((1, 2, 3), name="short", total=4, start=10),
        *group((2, 2), name="tied", start=20),
        *group((1, 2), name="prompts", start=30),
        ("train", "prompts", "Another", "prompts/9.webp", 3.0, 3.0, 33),
        *group((1, 2.5), name="rank", start=40),
        ("train", "dup", "A cat", "dup/0.webp", 1.0, 2.0, 50),
        ("train", "dup", "A cat", "dup/0.webp", 2.0, 2.0, 51),
        ("train", "noimage", "A cat", None, 1.0, 2.0, 60),
        ("train", "noimage", "A cat", "noimage/1.webp", 2.0, 2.0, 61),
        ("test", "shared1", "A cat", "same.webp", 1.0, 2.0, 70),
        ("test", "shared1", "A cat", "other.webp", 2.0, 2.0, 71),
        ("test", "shared2", "A dog", "same.webp", 1.0, 2.0, 72),
        ("test", "shared2", "A dog", "third.webp", 2.0, 2.0, 73),
        ("train", "ok", "A cat", "ok/0.webp", 1.0, 4.0, 80),  # an exact copy
    ]
    assert reasons(events_of(spark, rows)[1]) == {
        "ok": None,
        "short": "incomplete_annotated_group",
        "tied": "no_strict_rank_pairs",
        "prompts": "inconsistent_group_prompt",
        "rank": "invalid_rank_or_candidate_count",
        "dup": "conflicting_duplicate_image_annotation",
        "noimage": "missing_image_identity",
        "shared1": "conflicting_image_prompt_metadata",
        "shared2": "conflicting_image_prompt_metadata",
    }
    with pytest.raises(Exception, match="prompt_id"):
        events_of(spark, [(None, None, "x", "y", 1.0, 2.0, 0)])[1].collect()


CHOICE = "ranking_id long, prompt string, user_id long, best_image_uid string, image_1_uid string, image_2_uid string, image_3_uid string, image_4_uid string, ordinal long"
IMAGE = "image_uid string, prompt string, negative_prompt string, ordinal long"


def choice(spark, events, images=None, cohort="matched"):
    images = images or [(str(k), "cat", None, k) for k in range(5)]
    im, _ = ingest.choice_images(spark.createDataFrame(images, IMAGE))
    return {r.event_id.split(":")[1]: r for r in ingest.choice_events(spark.createDataFrame(events, CHOICE), im, cohort).collect()}


def test_choice_reasons(spark):
    e = lambda n, w="0", c=("0", "1", "2", "3"), prompt="cat", o=0: (n, prompt, 7, w, *c, n * 10 + o)
    got = choice(spark, [e(1), e(1, o=1), e(2, "None "), e(3, None), e(4, "99"), e(5, c=("0", "0", "1", "2")), e(6, c=("0", "1", "2", "77")), e(7), e(7, "1", o=1), e(8, c=("0", "1", None, "2")), e(9, prompt=" cat\t")])
    assert {k: r.exclusion_reason for k, r in got.items()} == {
        "1": None,
        "2": "invalid_or_none_selection",
        "3": "invalid_or_none_selection",
        "4": "winner_not_a_candidate",
        "5": "invalid_candidate_set",
        "6": "missing_candidate_metadata",
        "7": "conflicting_duplicate_event",
        "8": "invalid_candidate_set",
        "9": None,
    }
    assert got["8"].candidate_ids == ["choice:0", "choice:1", "choice:2"]
    images = [(str(k), "dog" if k == 2 else "cat", None, k) for k in range(4)]
    assert choice(spark, [e(1)], images)["1"].exclusion_reason == "candidate_prompt_mismatch"
    loose = choice(spark, [e(1)], images, "event")["1"]
    assert loose.exclusion_reason is None and loose.prompts_match is False
    images = [(str(k), "cat", "blur" if k == 2 else None, k) for k in range(4)]
    assert "negative" in choice(spark, [e(1)], images)["1"].exclusion_reason
    images = [(str(k), "cat", None, k) for k in range(4)] + [("3", "other", None, 9)]
    assert choice(spark, [e(1)], images)["1"].exclusion_reason == "conflicting_image_metadata"


def test_components_quarantine_and_cohort(spark):
    rows = [*group((1, 2), name="a", prompt="p"), *group((1, 2), "test", "b", "p", start=10), *group((1, 2), "test", "c", "q", start=20), *group((1, 2), "train", "d", "r", start=30)]
    images, events = events_of(spark, rows)
    e = splits.sample_components(splits.assign_splits(events, images), 0)
    got = {r.event_id: (r.analysis_split, r.sampled) for r in e.collect()}
    assert got == {"ranked:train:a": ("quarantine", False), "ranked:test:b": ("quarantine", False), "ranked:test:c": ("test", True), "ranked:train:d": ("discovery", True)}
    splits.assert_no_leakage(e, images)
    tied = images.withColumn("content_hash", F.when(F.col("image_id").isin("ranked:c/0.webp", "ranked:d/1.webp"), "h"))
    with pytest.raises(ValueError):
        splits.assert_no_leakage(e, tied)
    assert {r.analysis_split for r in splits.quarantine_conflicts(e, tied).collect()} == {"quarantine"}
    with pytest.raises(ValueError):
        splits.assign_splits(events, images, policy="grouped")
    with pytest.raises(ValueError):
        splits.restrict_cohort(e, images, spark.createDataFrame([("unknown",)], "image_id string"))
    inside = images.where("image_id like 'ranked:c%'").select("image_id")
    why = {r.event_id: r.exclusion_reason for r in splits.restrict_cohort(e, images, inside).collect()}
    assert why["ranked:test:c"] is None and why["ranked:train:d"] == "outside_available_archive_cohort"


def test_component_ids_are_digests(spark):
    from tessella.sources.io import digest

    images, events = events_of(spark, [*group((1, 2), name="aé", prompt="p"), *group((1, 2), name="b", prompt="p", start=9)])
    ids = {r.component_id for r in graph.components(events, images).collect()}
    assert ids == {digest(["ranked:train:aé", "ranked:train:b"])}


def test_long_chain_is_one_component(spark):
    edges = spark.range(200).selectExpr("concat('e', lpad(id, 4, '0')) as event_id", "explode(array(id, id + 1)) as k").selectExpr("event_id", "concat('k', k) as key")
    assert {r.label for r in graph.least_labels(edges).collect()} == {"e0000"}


def test_sampling_skips_what_overflows(spark):
    rows = [(f"e{k}_{j}", None, s, f"c{k}", f"p{k}_{j}") for k, (s, n) in enumerate([("discovery", 3), ("discovery", 9), ("discovery", 2), ("test", 1), ("quarantine", 1)]) for j in range(n)]
    e = spark.createDataFrame(rows, "event_id string, exclusion_reason string, analysis_split string, dependency_cluster_id string, prompt_group_id string")
    assert splits.quotas(10) == {"discovery": 6, "validation": 2, "test": 2}
    taken = {r.dependency_cluster_id for r in splits.sample_components(e, 10).where("sampled").collect()}
    assert taken == {"c0", "c2", "c3"}
    assert {r.dependency_cluster_id for r in splits.sample_components(e, 0).where("sampled").collect()} == {"c0", "c1", "c2", "c3"}
    assert splits.quota_sizes(20) == [14, 3, 3] and sum(splits.quota_sizes(7)) == 7


def comparisons(spark, rows):
    """rows of (event, preferred, rejected, weight, prompt, cluster)."""
    return spark.createDataFrame([(e, w, x, k, p, "test", c) for e, w, x, k, p, c in rows], COMPARISON)


def scores(spark, table):
    return spark.createDataFrame([(i, j, float(x)) for i, row in table.items() for j, x in enumerate(row)], "image_id string, concept_id int, score double")


def test_hierarchical_effect_golden(spark):
    c = comparisons(spark, [("a", "0", "1", 1.0, "P", "k"), ("b", "2", "3", 1.0, "P", "k"), ("c", "4", "5", 1 / 3, "Q", "m"), ("c", "4", "6", 1 / 3, "Q", "m"), ("c", "5", "6", 1 / 3, "Q", "m")])
    s = scores(spark, {str(k): [x] for k, x in enumerate((1, 0, 0.5, 0, 0, 0, 0))})
    st.check_hierarchy(c)
    for rows in (c, st.unique_comparisons(c.union(c))):
        r = st.hierarchical_means(st.prompt_values(rows, s)).first()
        assert r.effect == 0.375 and r.effect == r.preferred_mean - r.rejected_mean
    assert abs(st.eager_effects(c, s).first().effect - 0.375) < 1e-12
    n = st.counts(c).first()
    assert (n.prompts, n.events, n.comparisons, n.components, n.unique_images) == (2, 3, 5, 2, 7)
    bad = c.union(c.withColumn("within_event_weight", F.lit(0.9)))
    with pytest.raises(Exception, match="conflicting"):
        st.unique_comparisons(bad).collect()
    with pytest.raises(ValueError):
        st.check_hierarchy(c.withColumn("within_event_weight", F.lit(0.9)))
    with pytest.raises(Exception, match="invalid image score"):
        st.prompt_values(c, s.withColumn("score", F.lit(float("nan")))).collect()


@pytest.mark.parametrize(("pos", "neg", "wp", "wn", "auc"), [([1, 1], [1, 1], None, None, 0.5), ([0, 1], [1, 2], None, None, 0.125), ([0, 1], [0, 1], [1, 3], [3, 1], 0.75), ([], [1], None, None, None)])
def test_auc(spark, pos, neg, wp, wn, auc):
    rows = [(True, float(v), float(w)) for v, w in zip(pos, wp or [1] * len(pos), strict=True)] + [(False, float(v), float(w)) for v, w in zip(neg, wn or [1] * len(neg), strict=True)]
    assert st.pooled_auc(spark.createDataFrame(rows, "positive boolean, value double, weight double")).first().auc == auc


def test_concordance(spark):
    got = spark.createDataFrame([(0.0,), (0.01,), (-0.01,), (1.0,)], "d double").select(st.concordance(F.col("d"), 0.02).alias("o")).collect()
    assert [r.o for r in got] == [0.5, 0.5, 0.5, 1.0]
    with pytest.raises(ValueError):
        st.concordance(F.col("d"), -1)


def test_bootstrap_golden(spark):
    x = [0.0, 0.0, 0.0, 1.0]
    rows = [(0, f"p{k}", "a" if k < 3 else "b", v) for k, v in enumerate(x)]
    p = spark.createDataFrame(rows, "concept_id int, prompt_group_id string, dependency_cluster_id string, effect double")
    g = np.random.default_rng(8)
    nb = np.array([(g.integers(0, 2, 2) == 1).sum() for _ in range(2000)])
    want = np.quantile(nb / (3 * (2 - nb) + nb), [0.025, 0.975])
    r = st.cluster_bootstrap(p, "effect", 2000, 8, "pcg64").first()
    assert np.allclose([r.low, r.high], want)
    assert st.cluster_bootstrap(p, "effect", 1, 1, "pcg64").first().low == 0.25
    one = st.cluster_bootstrap(p.withColumn("dependency_cluster_id", F.lit("z")), "effect", 10).first()
    assert one.low is None and one.high is None


def test_selection_and_direction(spark):
    names = spark.createDataFrame([(0, "up"), (1, "down"), (2, "flat")], "concept_id int, concept string")
    c = comparisons(spark, [("a", "0", "1", 1.0, "P", "k"), ("b", "2", "3", 1.0, "Q", "m")])
    s = scores(spark, {"0": [1, 0, 0.5], "1": [0, 1, 0.5], "2": [1, 0, 0.5], "3": [0, 1, 0.5]})
    f = st.select_candidates(st.hierarchical_means(st.prompt_values(c, s)), names).orderBy(F.desc("direction")).collect()
    assert [(r.concept, r.side, r.discovery_rank) for r in f] == [("up", "preferred", 1), ("down", "rejected", 1)]
    turned = s.withColumn("score", 1 - F.col("score"))
    got = st.evaluate_frozen(spark.createDataFrame(f), st.prompt_values(c, turned), 50).collect()
    assert {r.direction_adjusted_concordance for r in got} == {0.0}
    assert all(r.adjusted_concordance_ci_low <= r.adjusted_concordance_ci_high for r in got)


def test_generator_strata_golden(spark):
    c = comparisons(spark, [("e", "0", str(k), 1 / 3, "p", "k") for k in (1, 2, 3)])
    images = spark.createDataFrame([("0", "A"), ("1", "A"), ("2", "B"), ("3", "B")], "image_id string, model_id string")
    s = scores(spark, {"0": [1], "1": [2], "2": [0], "3": [0.5]})
    g = sensitivity.generator_pair_strata(c.union(c), images)
    assert {(r.stratum, r.within_event_weight) for r in g.collect()} == {("same_model", 1.0), ("same_model:A", 1.0), ("cross_model", 0.5)}
    effects = {r.stratum: r.effect for r in st.hierarchical_means(st.prompt_values(g, s, by=("stratum",)), ("stratum",)).collect()}
    assert effects == {"same_model": -1.0, "same_model:A": -1.0, "cross_model": 0.75}
    less = images.withColumn("model_id", F.when(F.col("image_id") != "3", F.col("model_id")))
    assert sensitivity.generator_pair_strata(c, less).where("stratum = 'cross_model'").count() == 1


def test_scores(spark):
    patches = spark.createDataFrame([("x", 0, True, [-1.0, 0.0]), ("x", 1, False, [1.0, 0.0]), ("void", 0, False, [1.0, 0.0])], "image_id string, patch_id int, valid boolean, embedding array<float>")
    bank = spark.createDataFrame([(0, "c", [1.0, 0.0])], "concept_id int, concept string, embedding array<float>")
    assert {r.image_id: r.score for r in scoring.max_patch_scores(patches, bank).collect()} == {"x": -1.0, "void": None}
    # cosines: rows of any length count alike
    names = "concept_id int, concept string, embedding array<float>"
    three = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0]), (2, "c", [2.0, 0.0])], names)
    wide = scoring.score_blocks(patches.withColumn("embedding", F.transform("embedding", lambda x: x * 3)), three)
    assert {r.image_id: list(r.scores) for r in wide.rows.collect()} == {"x": [-1.0, 0.0, -1.0], "void": [None] * 3} and wide.ids == ((0, 1, 2),)
    for bad in ([0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0]):
        with pytest.raises(Exception, match="zero or not finite"):
            scoring.score_blocks(patches.withColumn("embedding", F.lit(bad).cast("array<float>")), three).rows.collect()
    with pytest.raises(ValueError):
        scoring.score_blocks(patches, three.where("concept_id <> 1"))
    scoring.bank_audit(bank).collect()
    for bad in ([(0, " ", [1.0])], [(0, "c", [0.0])], [(0, "c", [float("nan")])]):
        with pytest.raises(Exception, match="blank"):
            scoring.bank_audit(spark.createDataFrame(bad, "concept_id int, concept string, embedding array<float>")).collect()


def test_store(spark, tmp_path):
    root = str(tmp_path / "store")
    store = scoring.ScoreStore(spark, root).open({"bank": 1})
    index = spark.range(3).withColumnRenamed("id", "score_row")
    assert store.missing(index).count() == 3
    store.append(spark.createDataFrame([(0, [1.0, 2.0], None), (1, [float("nan"), 1.0], None), (2, None, "broken")], "score_row long, scores array<float>, error string"))
    assert store.missing(index).count() == 0 and store.valid(False).count() == 1
    with pytest.raises(Exception, match="non-finite"):
        store.valid().collect()
    with pytest.raises(ValueError):
        scoring.ScoreStore(spark, root).open({"bank": 2}, resume=True)
    with pytest.raises(FileExistsError):
        scoring.ScoreStore(spark, root).open({"bank": 1})


def test_workers_keep_aliases_together(spark):
    images = spark.createDataFrame([(f"i{k:02d}", f"h{k}", f"x{min(k, 11)}") for k in range(13)], "image_id string, content_hash string, pixel_hash string")
    index = scoring.row_index(images)
    w = {r.image_id: r.worker for r in scoring.worker_of(index, 4).collect()}
    assert w["i11"] == w["i12"] and index.select("score_row").distinct().count() == 12
    assert sorted(index.select("identity").distinct().join(scoring.worker_of(index, 4).join(index, "image_id").select("identity", "worker").distinct(), "identity").groupBy("worker").count().select("count").collect()) == [(3,)] * 4


def test_values(spark):
    u = "0f8fad5b-d9cb-469f-a165-70867728950e"
    rows = spark.createDataFrame([(u,), (f"https://h/x/{u}.png?a=1",), (None,), ("none",), ("word",), (u.replace("-", "").upper(),)], "v string")
    assert [r[0] for r in rows.select(canon.source_uid(F.col("v"))).collect()] == [u, u, None, None, None, u]
    paths = spark.createDataFrame([("../x",), ("/absolute",), ("x/../a",), ("a\\b",), ("C:x",), ("a/b..c.png",)], "v string")
    assert [r[0] for r in paths.select(canon.safe_member(F.col("v"))).collect()] == [False] * 5 + [True]
    texts = ["é  a b\x1cc ", "", " ", "A.b"]
    got = spark.createDataFrame([(t,) for t in texts], "v string").select(canon.normalize_prompt(F.col("v"))).collect()
    assert [r[0] for r in got] == ["é a b c", "", "", "A.b"]
    null = spark.range(1).select(canon.prompt_group(F.lit(None).cast("string"))).first()[0]
    from tessella.sources.io import digest

    assert null == digest(None)


def test_spearman_and_overlap(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (None, 9.0)], "x double, y double")
    assert abs(st.spearman(rows, "x", "y").first().spearman - 0.8660254) < 1e-6
    assert st.spearman(rows.withColumn("x", F.lit(1.0)), "x", "y").first().spearman is None
    a = spark.createDataFrame([("preferred", 1), ("preferred", 2)], "side string, concept_id int")
    b = spark.createDataFrame([("preferred", 2), ("preferred", 3)], "side string, concept_id int")
    r = transfer.topk_overlap(a, b).first()
    assert r.intersection == 1 and abs(r.jaccard - 1 / 3) < 1e-9
    assert transfer.topk_overlap(a, b, False).first().jaccard is None


def test_blocks_equal_the_long_form(spark, monkeypatch):
    """Scores of several blocks and slices, patches of an image in several partitions and batches."""
    r = np.random.default_rng(4)
    monkeypatch.setattr(scoring, "BLOCK", 8)
    monkeypatch.setattr(scoring, "BANK_BYTES", 8 * 3 * 16)
    monkeypatch.setattr(scoring, "STEP_BYTES", 1)
    monkeypatch.setattr(blocks, "BLOCK", 8)
    p, c = r.normal(size=(90, 3)), r.normal(size=(37, 3))
    rows = [(f"i{k % 12}", k // 12, k % 5 != 0 and k % 12 != 7, p[k].tolist()) for k in range(90)]
    patches = spark.createDataFrame(rows, "image_id string, patch_id int, valid boolean, embedding array<double>").repartition(5)
    bank = spark.createDataFrame([(k, f"c{k}", c[k].tolist()) for k in range(37)], "concept_id int, concept string, embedding array<double>")
    sims = (p / np.linalg.norm(p, axis=1)[:, None]) @ (c / np.linalg.norm(c, axis=1)[:, None]).T
    got = {(x.image_id, x.concept_id): x.score for x in scoring.max_patch_scores(patches, bank).collect()}
    assert len(got) == 12 * 37
    for i in range(12):
        live = [k for k, x in enumerate(rows) if x[0] == f"i{i}" and x[2]]
        for j in range(37):
            assert got[f"i{i}", j] is None if not live else abs(got[f"i{i}", j] - sims[live, j].max()) < 1e-12
    best = {(x.image_id, x.concept_id): x.patch_id for x in scoring.patch_argmax(patches, bank).collect()}
    assert len(best) == 11 * 37 and best["i3", 30] == max((k for k, x in enumerate(rows) if x[0] == "i3" and x[2]), key=lambda k: sims[k, 30]) // 12
    near = {x.query_id: x.concept_id for x in scoring.nearest_rows(bank.select((F.col("concept_id") + 5).alias("concept_id"), "embedding"), bank).collect()}
    assert near == {k + 5: k for k in range(37)}
    made = scoring.score_blocks(patches.where("image_id <> 'i7'"), bank)
    some = {(x.image_id, x.concept_id): x.score for x in made.only([30, 2, 3]).long().collect()}
    assert some == {k: v for k, v in got.items() if k[1] in (2, 3, 30) and k[0] != "i7"}
    # estimands from blocks equal those of plain loops
    pairs_ = [(f"e{k % 9}", f"i{a}", f"i{b}", 1.0, f"p{k % 3}", f"k{k % 3}") for k, (a, b) in enumerate((a, b) for a in range(7) for b in range(8, 12))]
    values = {(x.concept_id, x.prompt_group_id): x for x in st.prompt_values(comparisons(spark, pairs_), made).collect()}
    for j in (0, 17, 36):
        for g in range(3):
            events = {}
            for e, a, b, _, prompt, _ in pairs_:
                if prompt == f"p{g}":
                    events.setdefault(e, []).append((got[a, j], got[b, j]))
            w = np.mean([np.mean([a for a, _ in v]) for v in events.values()])
            o = np.mean([np.mean([a > b for a, b in v]) for v in events.values()])
            assert abs(values[j, f"p{g}"].preferred - w) < 1e-12 and abs(values[j, f"p{g}"].ordering - o) < 1e-12
    n = len(pairs_)
    eager = {x.concept_id: x.effect for x in st.eager_effects(comparisons(spark, pairs_), made).collect()}
    plain = {x.concept_id: x.effect for x in st.hierarchical_means(st.prompt_values(comparisons(spark, pairs_), made.long())).collect()}
    assert n and len(eager) == 37 and all(abs(eager[j] - plain[j]) < 1e-12 for j in eager)


def test_bootstrap_of_several_values(spark):
    rows = [(c, f"p{k}", f"k{k % 6}", float(k * (c + 1) % 7), float(k % 2)) for k in range(30) for c in range(3)]
    p = spark.createDataFrame(rows, "concept_id int, prompt_group_id string, dependency_cluster_id string, effect double, ordering double")
    both = {r.concept_id: r for r in st.cluster_bootstrap(p, ("effect", "ordering"), 300, 5).collect()}
    draws = [d for d in st.sha_draws(300, 6, 5)]
    for c in range(3):
        for name, v in (("effect", 3), ("ordering", 4)):
            sums = np.array([sum(x[v] for x in rows if x[0] == c and x[2] == f"k{k}") for k in range(6)])
            size = np.array([sum(1 for x in rows if x[0] == c and x[2] == f"k{k}") for k in range(6)])
            x = [sums[d].sum() / size[d].sum() for d in draws]
            assert np.allclose([both[c][f"{name}_low"], both[c][f"{name}_high"]], np.quantile(x, [0.025, 0.975]))
    assert st.cluster_bootstrap(p.limit(0), "effect", 5).count() == 0
    with pytest.raises(ValueError):
        st.cluster_bootstrap(p, "effect", 0)


def test_numbers_and_running_sums(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"), F.lit(2).alias("n")).repartition(7)
    assert all(r.k == r.x for r in row_numbers(df, ["x"], "k").collect())
    assert all(r.s == 2 * (r.x + 1) for r in running_sums(df, "x", {"n": "s"}).collect())
    assert row_numbers(df.limit(0), ["x"], "k").count() == 0 and running_sums(df.limit(0), "x", {"n": "s"}).count() == 0


def test_components_by_stars_and_in_parts(spark):
    import random

    r = random.Random(2)
    rows = [(f"e{r.randrange(150):03d}", f"k{r.randrange(140)}") for _ in range(260)] + [(f"x{k:03d}", f"c{j}") for k in range(70) for j in (k, k + 1)]
    edges = spark.createDataFrame(rows, "event_id string, key string")
    one = {tuple(x) for x in graph.least_labels(edges).collect()}
    assert {tuple(x) for x in graph.least_labels(edges, local_links=0).collect()} == one and ("x069", "x000") in one
    labels = spark.createDataFrame(sorted(one), "event_id string, label string")
    whole = dict(graph.component_digests(labels).collect())
    parts = dict(graph.component_digests(labels, members=20).collect())
    from tessella.sources.io import digest

    chain = [f"x{k:03d}" for k in range(70)]
    assert whole["x000"] == digest(chain) and parts["x000"] == digest([digest(chain[k : k + 20]) for k in range(0, 70, 20)])
    small = {k for k in whole if sum(x[1] == k for x in one) <= 20}
    assert small and all(parts[k] == whole[k] for k in small)


def test_nothing_to_split(spark):
    images, events = events_of(spark, group((1, 2)))
    assert splits.assign_splits(events.limit(0), images).count() == 0
    with pytest.raises(ValueError):
        splits.assign_splits(events.unionByName(events.withColumn("dataset", F.lit("choice"))), images)


def test_sample_reads_on(spark, monkeypatch):
    """Many components too large for what is left are passed over."""
    monkeypatch.setattr(splits, "READ", 3)
    rows = [(f"e{k}_{j}", None, "discovery", f"c{k}", f"p{k}_{j}") for k in range(40) for j in range(1 + k % 4)]
    e = spark.createDataFrame(rows, "event_id string, exclusion_reason string, analysis_split string, dependency_cluster_id string, prompt_group_id string")
    want, left = set(), splits.quotas(30)["discovery"]
    for c in sorted((f"c{k}" for k in range(40)), key=lambda c: splits.order_key(42, "discovery", c)):
        size = 1 + int(c[1:]) % 4
        if size <= left:
            left -= size
            want.add(c)
    assert {r.dependency_cluster_id for r in splits.sample_components(e, 30).where("sampled").collect()} == want
