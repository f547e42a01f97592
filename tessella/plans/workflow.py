"""Chained jobs: prepare, score, analyze, compare and report, with the freeze between
discovery and held-out data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import ingest, pairs, scoring, sensitivity, splits, transfer
from tessella.operators import statistics as st
from tessella.sources import io


def prepare(spark: SparkSession, root: str, dataset: str, metadata: str, image_metadata: str | None = None, limit: int = 500, seed: int = 42, mode: str = "all_strict_pairs", cohort: str = "matched", policy: str = "auto", available: str | None = None, resume: bool = False) -> dict:
    """Reads a source, applies the ingest rules, splits, samples and writes the manifest."""
    settings = dict(dataset=dataset, metadata=metadata, image_metadata=image_metadata, limit=limit, seed=seed, mode=mode, cohort=cohort, policy=policy, available=available)
    path = f"{root}/prepare.json"
    if io.exists(spark, path):
        if io.read_json(path) != io.strict(settings):
            raise ValueError("the folder was prepared with other settings")
        if not resume:
            raise FileExistsError("the folder is prepared; resume or choose another")
    rows = io.read_rows(spark, metadata)
    rows = rows if "ordinal" in rows.columns else rows.withColumn("ordinal", F.monotonically_increasing_id())
    if dataset == "ranked":
        images, events = ingest.ranked_events(rows, mode)
    else:
        if image_metadata is None:
            raise ValueError("choice data need the image table")
        side = io.read_rows(spark, image_metadata)
        side = side if "ordinal" in side.columns else side.withColumn("ordinal", F.monotonically_increasing_id())
        images, _ = ingest.choice_images(side)
        images = images.withColumns({"dataset": F.lit("choice"), "source_image_uid": F.col("image_uid")})
        events = ingest.choice_events(rows, images, cohort)
    events = splits.assign_splits(events, images, seed, policy)
    if available:
        events = splits.restrict_cohort(events, images, io.read_rows(spark, available).select("image_id"))
    events = splits.sample_components(events, limit, seed)
    audit = dict(dataset=dataset, exclusions={r.exclusion_reason: r.n for r in ingest.exclusion_histogram(events).collect()}, missingness={r.field: [r.null_count, r.blank_count] for r in ingest.missingness(rows).collect()})
    io.save_manifest(root, {"images": images, "events": events, "comparisons": pairs.construct_comparisons(events)}, audit, {"settings": settings})
    splits.assert_no_leakage(spark.read.parquet(f"{root}/events"), spark.read.parquet(f"{root}/images"))
    io.write_json(path, settings)
    return audit


def score(spark: SparkSession, root: str, patches: str, concepts: str, resume: bool = False, reuse: str | None = None) -> dict:
    """Scores the prepared images against the bank into root/store, and from it root/scores.

    Images of one content are scored once.  resume goes on with a store of the same bank and
    images: rows without error and with finite cells stay, all others are made again.  reuse
    names another run whose store was made from the same bank; its rows of equal content are
    taken over.  An image without a valid patch gets a row with an error.
    """
    bank, images = io.read_rows(spark, concepts), spark.read.parquet(f"{root}/images")
    audit = scoring.bank_audit(bank).first()
    settings = dict(bank=scoring.table_digest(bank.select("concept_id", "concept", "embedding")), width=audit.max_dim)
    contents = scoring.with_hashes(images)
    index = scoring.row_index(contents)
    store = scoring.ScoreStore(spark, f"{root}/store").open(dict(settings, images=scoring.table_digest(contents)), resume)
    taken = 0
    if reuse:
        other = scoring.ScoreStore(spark, f"{reuse}/store")
        theirs = other.settings()
        if any(theirs[k] != v for k, v in settings.items()):
            raise ValueError("the other store was made from another bank")
        source = scoring.with_hashes(spark.read.parquet(f"{reuse}/images"))
        source = source.join(scoring.row_index(source).select("image_id", "score_row"), "image_id")
        done = other.valid()
        hits = scoring.score_reuse(store.pending(contents.join(index.select("image_id", "score_row"), "image_id")), source.join(done.select("score_row"), "score_row", "left_semi"))
        before = store.valid(strict=False).count()
        store.append(hits.join(done.withColumnRenamed("score_row", "source_row"), "source_row"))
        taken = store.valid(strict=False).count() - before
    todo = store.pending(index).groupBy("score_row").agg(F.min("image_id").alias("image_id"))
    live = io.read_rows(spark, patches).join(todo, "image_id", "left_semi")
    store.append(scoring.score_rows(todo, scoring.score_blocks(live, bank)))
    rows = store.valid().join(index.select("image_id", "score_row"), "score_row")
    rows.select("image_id", F.posexplode("scores").alias("concept_id", "score")).write.mode("overwrite").parquet(f"{root}/scores")
    bank.select("concept_id", "concept").write.mode("overwrite").parquet(f"{root}/concepts")
    return dict(rows=store.valid().count(), reused=taken, failed=store.pending(index).select("score_row").distinct().count())


def freeze(path: str, candidates: list[dict], settings: dict) -> None:
    """Writes the frozen list once; the same list again is fine, any change is an error."""
    made = dict(settings=settings, candidates=candidates)
    made["artifact_hash"] = io.digest(made)
    if io.exists(SparkSession.active(), path):
        if io.read_json(path)["artifact_hash"] != made["artifact_hash"]:
            raise ValueError("the frozen list differs; held-out data must not change it")
        return
    io.write_json(path, made)


def analyze(spark: SparkSession, root: str, out: str | None = None, top_k: int = 10, bootstrap: int = 2000, tolerance: float = 0.0, seed: int = 42, mode: str | None = None, rng: str = "sha", diversity: float | None = None) -> dict:
    """Discovery effects, the freeze (an action), then the frozen list on held-out data."""
    out = out or f"{root}/analysis"
    images, events = spark.read.parquet(f"{root}/images"), spark.read.parquet(f"{root}/events")
    scores, concepts = spark.read.parquet(f"{root}/scores"), spark.read.parquet(f"{root}/concepts")
    valid = scores.groupBy("image_id").agg(F.min(F.col("score").isNotNull() & ~F.isnan("score")).alias("ok")).where("ok").select("image_id")
    c = st.unique_comparisons(pairs.construct_comparisons(events, valid, mode))
    c.write.mode("overwrite").parquet(f"{out}/comparisons")
    c = spark.read.parquet(f"{out}/comparisons")
    st.check_hierarchy(c)
    live = scores.join(valid, "image_id", "left_semi")
    prompts = st.prompt_values(c, live, tolerance, ("analysis_split",))
    prompts.write.mode("overwrite").parquet(f"{out}/prompt_values")
    prompts = spark.read.parquet(f"{out}/prompt_values")
    means = st.hierarchical_means(prompts, ("analysis_split",))
    found = st.select_candidates(means.where("analysis_split = 'discovery'"), concepts, top_k).orderBy("direction", "discovery_rank").collect()
    frozen = [r.asDict() for r in sorted(found, key=lambda r: (-r.direction, r.discovery_rank))]
    key = c.agg(F.sum(F.xxhash64(*sorted(c.columns)).cast("decimal(38,0)")).cast("string")).first()[0]
    freeze(f"{out}/frozen_candidates.json", frozen, dict(seed=seed, top_k=top_k, tie_tolerance=tolerance, mode=mode, comparisons=key))

    wide = means.groupBy("concept_id").pivot("analysis_split", list(splits.SPLITS)).agg(*[F.first(m).alias(m) for m in st.METRICS])
    io.write_csv(concepts.join(wide, "concept_id").orderBy("concept_id"), f"{out}/all_concepts", mode="overwrite")
    used = c.select("construction_mode").first()
    summary: dict = dict(construction=used and used.construction_mode, counts={r.analysis_split: r.asDict() for r in st.counts(c, ("analysis_split",)).collect()}, tie_tolerance=tolerance, mode=mode, seed=seed, top_k=top_k)
    if frozen:
        f = spark.createDataFrame(found)
        test = prompts.where("analysis_split = 'test'").drop("analysis_split")
        summary["top_concepts"] = [r.asDict() for r in st.evaluate_frozen(f, test, bootstrap, seed, rng).orderBy(F.desc("direction"), "discovery_rank").collect()]
        joint = st.joint_scores(live, f)
        tc = c.where("analysis_split = 'test'")
        summary["joint"] = [r.asDict() for r in st.evaluate_frozen(st.joint_candidate(f), st.prompt_values(tc, joint, tolerance), bootstrap, seed, rng).collect()]
        if diversity is not None:
            kept = sensitivity.diversity_filter(sensitivity.activation_correlation(live, c, f), f, diversity)
            io.write_json(f"{out}/presentation_candidates.json", [r.asDict() for r in kept.collect()])
        strata = sensitivity.event_strata(events.join(tc.select("event_id").distinct(), "event_id", "left_semi"), images)
        in_stratum = st.prompt_values(tc.join(strata, "event_id"), live, tolerance, ("stratum",))
        summary["strata"] = [r.asDict() for r in st.evaluate_frozen(f, in_stratum, bootstrap, seed, rng, ("stratum",)).collect()]
        if "model_id" in images.columns:
            g = st.prompt_values(sensitivity.generator_pair_strata(tc, images), live, tolerance, ("stratum",))
            summary["generators"] = [r.asDict() for r in st.evaluate_frozen(f, g, bootstrap, seed, rng, ("stratum",)).collect()]
            g = st.prompt_values(sensitivity.generator_pair_strata(tc, images), joint, tolerance, ("stratum",))
            summary["generators_joint"] = [r.asDict() for r in st.evaluate_frozen(st.joint_candidate(f), g, bootstrap, seed, rng, ("stratum",)).collect()]
        if events.where("annotator_id is not null").limit(1).count():
            tied = splits.with_components(events.drop("dependency_cluster_id"), images, True).select("event_id", "dependency_cluster_id")
            a = st.prompt_values(tc.drop("dependency_cluster_id").join(tied, "event_id"), joint, tolerance)
            summary["annotator_components"] = [r.asDict() for r in st.evaluate_frozen(st.joint_candidate(f), a, bootstrap, seed, rng).collect()]
        sensitivity.gallery_selection(tc, live, f, seed=seed).write.mode("overwrite").parquet(f"{out}/gallery")
    else:
        summary["top_concepts"], summary["joint"] = [], []
    audit = {r.field: r.asDict() for r in sensitivity.confounder_audit(c, events, images).collect()}
    model = F.coalesce("model_id", F.lit("unavailable")) if "model_id" in images.columns else F.lit("unavailable")
    models = sensitivity.active_images(c, events, images).groupBy(model.alias("m")).agg(F.count("*").alias("n"))
    io.write_json(f"{out}/confounder_audit.json", dict(distributions=audit, annotators=sensitivity.annotator_counts(c, events).first().asDict(), generation_models={r.m: r.n for r in models.collect()}))
    io.write_json(f"{out}/analysis_summary.json", summary)
    return summary


def analyze_with_sensitivities(spark: SparkSession, root: str, out: str | None = None, **settings) -> dict:
    """analyze, and for ranked data the same over the other constructions, below out/sensitivity."""
    out = out or f"{root}/analysis"
    summary = analyze(spark, root, out, **settings)
    if io.read_json(f"{root}/dataset_audit.json")["dataset"] == "ranked":
        for mode in ingest.MODES:
            if mode != summary["construction"]:
                analyze(spark, root, f"{out}/sensitivity/{mode}", **{**settings, "mode": mode})
    return summary


def discrimination_summary(out: str) -> list[dict]:
    """The joint concept's concordance, interval and counts per construction, as rows and CSV."""
    spark, rows = SparkSession.active(), []
    for folder in (out, *(f"{out}/sensitivity/{m}" for m in ingest.MODES)):
        if io.exists(spark, f"{folder}/analysis_summary.json"):
            s = io.read_json(f"{folder}/analysis_summary.json")
            n = s["counts"].get("test", {})
            rows += [dict(construction=s["construction"], paired_concordance=r["raw_concordance"], ci_low=r["concordance_ci_low"], ci_high=r["concordance_ci_high"], signed_effect=r["heldout_effect"], prompts=r["prompts"], components=n.get("components"), comparisons=n.get("comparisons")) for r in s["joint"]]
    kinds = "construction string, paired_concordance double, ci_low double, ci_high double, signed_effect double, prompts long, components long, comparisons long"
    io.write_csv(spark.createDataFrame(rows, kinds).coalesce(1), f"{out}/discrimination_summary", mode="overwrite")
    return rows


def compare(spark: SparkSession, left: str, right: str, out: str, bootstrap: int = 2000, seed: int = 42, rng: str = "sha") -> dict:
    """Agreement of two analyses and transfer of each frozen list to the other's test data."""
    data = {}
    for name, root in (("left", left), ("right", right)):
        data[name] = {t: spark.read.parquet(f"{root}/{t}") for t in ("images", "events", "scores", "concepts", "analysis/comparisons", "analysis/prompt_values")}
        data[name]["frozen"] = io.read_json(f"{root}/analysis/frozen_candidates.json")
    if data["left"]["frozen"]["settings"]["top_k"] != data["right"]["frozen"]["settings"]["top_k"]:
        raise ValueError("the two analyses were made with different settings")
    effects = [d["concepts"].join(st.hierarchical_means(d["analysis/prompt_values"].where("analysis_split = 'discovery'")).select("concept_id", "effect"), "concept_id", "left") for d in data.values()]
    joined = transfer.joined_effects(*effects)
    io.write_csv(joined.orderBy("concept_id"), f"{out}/joined_concepts", mode="overwrite")
    summary: dict = dict(discovery=transfer.agreement(joined).first().asDict())
    lists = {n: spark.createDataFrame(d["frozen"]["candidates"]) if d["frozen"]["candidates"] else None for n, d in data.items()}
    if all(x is not None for x in lists.values()):
        summary["overlap"] = [r.asDict() for r in transfer.topk_overlap(lists["left"], lists["right"]).collect()]
    else:
        summary["overlap"] = None
    for donor, recipient in (("left", "right"), ("right", "left")):
        a, b = data[donor], data[recipient]
        if lists[donor] is None:
            continue
        target = b["analysis/comparisons"].where("analysis_split = 'test'")
        given = a["events"].join(a["analysis/comparisons"].where("analysis_split = 'discovery'").select("event_id").distinct(), "event_id", "left_semi")
        hit = transfer.overlapping_events(b["events"].join(target.select("event_id").distinct(), "event_id", "left_semi"), b["images"], given, a["images"])
        kept = transfer.retained_comparisons(target, hit)
        p = st.prompt_values(kept, b["scores"], b["frozen"]["settings"]["tie_tolerance"])
        got = st.evaluate_frozen(lists[donor].select("concept_id", "concept", "side", "direction", "discovery_rank", "discovery_effect"), p, bootstrap, seed, rng)
        summary[f"{donor}_to_{recipient}"] = dict(metrics=[r.asDict() for r in got.collect()], duplicate_events=[r.event_id for r in hit.orderBy("event_id").collect()])
    summary["duplicates"] = transfer.duplicate_audit(data["left"]["events"].where("sampled"), data["left"]["images"], data["right"]["events"].where("sampled"), data["right"]["images"]).first().asDict()
    io.write_json(f"{out}/comparison_summary.json", summary)
    return summary


def number(x, digits: int = 3) -> str:
    return "n/a" if x is None or x != x else f"{x:.{digits}f}"


#: Characters that LaTeX reads as commands, and how they are written.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex(text: str) -> str:
    return "".join(LATEX.get(c, c) for c in text)


def report(out: str) -> str:
    """Markdown, a LaTeX table and the replication summary of an analysis folder."""
    summary = io.read_json(f"{out}/analysis_summary.json")
    top = summary["top_concepts"]
    head = "| concept | side | discovery | held-out | interval | concordance |\n|---|---|---|---|---|---|\n"
    lines = [f"| {r['concept']} | {r['side']} | {number(r['discovery_effect'])} | {number(r['heldout_effect'])} | [{number(r['effect_ci_low'])}, {number(r['effect_ci_high'])}] | {number(r['direction_adjusted_concordance'])} |" for r in top]
    text = "# Held-out evaluation of the frozen concepts\n\n" + head + "\n".join(lines) + "\n"
    table = "\n".join(f"{latex(r['concept'])} & {r['side']} & {number(r['heldout_effect'])} & {number(r['direction_adjusted_concordance'])} \\\\" for r in top)
    io.atomic_text(f"{out}/report.md", text)
    io.atomic_text(f"{out}/results_table.tex", "\\begin{tabular}{llrr}\n" + table + "\n\\end{tabular}\n")
    discrimination_summary(out)
    io.write_json(f"{out}/replication_summary.json", {side: dict(replicated=sum(r["direction"] * r["heldout_effect"] > 0 for r in top if r["side"] == side), candidates=sum(r["side"] == side for r in top)) for side in ("preferred", "rejected")})
    return text


def fixture(spark: SparkSession, root: str, dataset: str = "ranked", null: bool = False) -> None:
    """A synthetic run of 20 groups of four images and four concepts with known effects."""
    n = spark.range(80).select((F.col("id") / 4).cast("int").alias("g"), (F.col("id") % 4).cast("int").alias("k"), F.col("id").alias("ordinal"))
    name = F.concat(F.lit("g"), "g", F.lit("_"), "k")
    split = F.when(F.col("g") < 14, "train").when(F.col("g") < 17, "validation").otherwise("test")
    prompt = F.concat(F.lit("synthetic prompt "), F.col("g").cast("string"))
    if dataset == "ranked":
        rows = n.select(split.alias("original_split"), F.concat(F.lit("p"), "g").alias("prompt_id"), prompt.alias("prompt"), name.alias("image_path"), (F.col("k") + 1).cast("bigint").alias("rank"), F.lit(4).cast("bigint").alias("image_amount_in_total"), "ordinal")
    else:
        images = n.select(name.alias("image_uid"), prompt.alias("prompt"), F.lit(None).cast("string").alias("negative_prompt"), F.lit("synthetic-generator").alias("model_id"), "ordinal")
        images.write.mode("overwrite").parquet(f"{root}/image_metadata.parquet")
        rows = n.where("k = 0").select(F.col("g").cast("bigint").alias("ranking_id"), prompt.alias("prompt"), (F.col("g") % 3).cast("bigint").alias("user_id"), *[F.concat(F.lit("g"), "g", F.lit(f"_{j}")).alias(f"image_{j + 1}_uid") for j in range(4)], F.concat(F.lit("g"), "g", F.lit("_0")).alias("best_image_uid"), "ordinal")
    rows.write.mode("overwrite").parquet(f"{root}/metadata.parquet")
    prepare(spark, root, dataset, f"{root}/metadata.parquet", f"{root}/image_metadata.parquet" if dataset == "choice" else None, 0)
    third = F.col("k") / F.lit(3.0)
    cells = [F.lit(0.5)] * 4 if null else [1 - third, third, F.lit(0.5), (F.col("g") % 2) * 0.1]
    image = F.concat(F.lit(f"{dataset}:"), name)
    n.select(image.alias("image_id"), F.posexplode(F.array(*[c.cast("float") for c in cells])).alias("concept_id", "score")).write.mode("overwrite").parquet(f"{root}/scores")
    words = ("known_positive", "known_negative", "constant_null", "irrelevant_balanced")
    spark.createDataFrame(list(enumerate(words)), "concept_id int, concept string").write.mode("overwrite").parquet(f"{root}/concepts")
