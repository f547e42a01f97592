"""Command line: inspect, prepare, score, analyze, compare, report, run, fixture."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tessella.plans import workflow
from tessella.sources import io


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella")
    p.add_argument("verb", choices=("inspect", "prepare", "score", "analyze", "compare", "report", "run", "fixture"))
    p.add_argument("--output", required=True)
    p.add_argument("--dataset", choices=("ranked", "choice"), default="ranked")
    for name in ("metadata", "image-metadata", "available-image-ids", "patches", "concepts", "reuse-scores", "left", "right"):
        p.add_argument(f"--{name}")
    p.add_argument("--group-limit", type=int, default=500)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--comparison-mode", choices=("all_strict_pairs", "best_vs_rest", "best_vs_worst"), default="all_strict_pairs")
    p.add_argument("--cohort", choices=("matched", "event"), default="matched")
    p.add_argument("--split-policy", choices=("auto", "official", "grouped"), default="auto")
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--bootstrap", type=int, default=2000)
    p.add_argument("--tie-tolerance", type=float, default=0.0)
    p.add_argument("--diversity-correlation", type=float)
    p.add_argument("--rng", choices=("sha", "pcg64"), default="sha")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--null-fixture", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    p = parser()
    a = p.parse_args(argv)
    if a.group_limit < 0 or a.top_k < 0 or a.bootstrap < 1:
        p.error("limits must not be negative and the bootstrap must be positive")
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    if a.verb == "inspect":
        io.write_json(a.output, io.inspect_source(io.read_rows(spark, a.metadata)))
    if a.verb in ("prepare", "run"):
        workflow.prepare(spark, a.output, a.dataset, a.metadata, a.image_metadata, a.group_limit, a.seed, a.comparison_mode, a.cohort, a.split_policy, a.available_image_ids, a.resume)
    if a.verb in ("score", "run"):
        workflow.score(spark, a.output, a.patches, a.concepts, a.resume, a.reuse_scores)
    if a.verb in ("analyze", "run"):
        workflow.analyze_with_sensitivities(spark, a.output, top_k=a.top_k, bootstrap=a.bootstrap, tolerance=a.tie_tolerance, seed=a.seed, rng=a.rng, diversity=a.diversity_correlation)
    if a.verb in ("report", "run"):
        workflow.report(f"{a.output}/analysis")
    if a.verb == "compare":
        workflow.compare(spark, a.left, a.right, a.output, a.bootstrap, a.seed, a.rng)
    if a.verb == "fixture":
        workflow.fixture(spark, a.output, a.dataset, a.null_fixture)


if __name__ == "__main__":
    main()
