"""Whole runs on the synthetic fixture, sinks, incremental components and the registry."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessella import cli
from tessella.plans import workflow
from tessella.sources import io
from tessella.streaming import increments


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    out = {}
    for name, dataset, null in (("ranked", "ranked", False), ("choice", "choice", False), ("null", "ranked", True)):
        path = str(root / name)
        workflow.fixture(spark, path, dataset, null)
        out[name] = (path, workflow.analyze(spark, path, bootstrap=20))
    return out


def test_known_effects(runs):
    top = runs["ranked"][1]["top_concepts"]
    assert top[0]["concept"] == "known_positive" and abs(top[0]["discovery_effect"] - 10 / 18) < 1e-6 and top[0]["heldout_effect"] > 0
    assert {r["concept"] for r in top} == {"known_positive", "known_negative"}
    assert abs(runs["ranked"][1]["joint"][0]["raw_concordance"] - 1) < 1e-9
    choice = runs["choice"][1]
    assert abs(choice["top_concepts"][0]["discovery_effect"] - 2 / 3) < 1e-6
    assert {k: v["components"] for k, v in choice["counts"].items()} == {"discovery": 14, "validation": 3, "test": 3}


def test_null_fixture(runs):
    path, summary = runs["null"]
    assert summary["top_concepts"] == []
    json.loads(open(f"{path}/analysis/analysis_summary.json").read(), parse_constant=lambda _: pytest.fail("not strict"))


def test_freeze(spark, runs):
    path = runs["ranked"][0]
    before = open(f"{path}/analysis/frozen_candidates.json").read()
    workflow.analyze(spark, path, bootstrap=20)
    assert open(f"{path}/analysis/frozen_candidates.json").read() == before
    with pytest.raises(ValueError):
        workflow.analyze(spark, path, top_k=1, bootstrap=20)


def test_other_constructions_and_audit(spark, runs, tmp_path):
    path = runs["ranked"][0]
    workflow.analyze_with_sensitivities(spark, path, str(tmp_path), bootstrap=20)
    rows = {r["construction"]: r for r in workflow.discrimination_summary(str(tmp_path))}
    assert rows.keys() == {"all_strict_pairs", "best_vs_rest", "best_vs_worst"}
    assert all(abs(r["paired_concordance"] - 1) < 1e-9 and r["prompts"] == r["components"] == 3 for r in rows.values())
    assert [rows[m]["comparisons"] for m in ("all_strict_pairs", "best_vs_rest", "best_vs_worst")] == [18, 9, 3]
    audit = io.read_json(f"{path}/analysis/confounder_audit.json")
    assert audit["distributions"]["gs"]["missing"] == 80 and audit["generation_models"] == {"unavailable": 80}
    choice = io.read_json(f"{runs['choice'][0]}/analysis/confounder_audit.json")
    assert choice["annotators"]["annotators"] == 3 and choice["generation_models"] == {"synthetic-generator": 80}


def test_score_resume_and_reuse(spark, tmp_path):
    """A store goes on where it stopped, heals failed rows and takes rows of equal content."""
    roots = [str(tmp_path / n) for n in ("a", "b")]
    bank = spark.createDataFrame([(0, "x", [2.0, 0.0]), (1, "y", [0.0, 1.0])], "concept_id int, concept string, embedding array<double>")
    bank.write.parquet(f"{tmp_path}/bank.parquet")
    images = [(f"i{k}", None, "same" if k < 2 else f"h{k}") for k in range(4)]
    for root in roots:
        spark.createDataFrame(images, "image_id string, pixel_hash string, content_hash string").write.parquet(f"{root}/images")
    kind = "image_id string, patch_id int, valid boolean, embedding array<double>"
    rows = [("i0", 0, True, [3.0, 4.0]), ("i0", 1, False, [0.0, 0.0]), ("i1", 0, True, [3.0, 4.0]), ("i2", 0, True, [0.0, 5.0]), ("i3", 0, False, [1.0, 1.0])]
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/some.parquet")
    spark.createDataFrame([*rows[:4], ("i3", 0, True, [1.0, 0.0])], kind).write.parquet(f"{tmp_path}/all.parquet")
    spark.createDataFrame(rows[:0], kind).write.parquet(f"{tmp_path}/none.parquet")
    args = lambda patches: (f"{tmp_path}/{patches}.parquet", f"{tmp_path}/bank.parquet")
    got = lambda root: {(r.image_id, r.concept_id): round(r.score, 6) for r in spark.read.parquet(f"{root}/scores").collect()}
    assert workflow.score(spark, roots[0], *args("some")) == dict(rows=2, reused=0, failed=1)
    want = {("i0", 0): 0.6, ("i0", 1): 0.8, ("i1", 0): 0.6, ("i1", 1): 0.8, ("i2", 0): 0.0, ("i2", 1): 1.0}
    assert got(roots[0]) == want
    with pytest.raises(FileExistsError):
        workflow.score(spark, roots[0], *args("some"))
    assert workflow.score(spark, roots[0], *args("all"), resume=True) == dict(rows=3, reused=0, failed=0)
    assert got(roots[0]) == {**want, ("i3", 0): 1.0, ("i3", 1): 0.0}
    assert workflow.score(spark, roots[1], *args("none"), reuse=roots[0]) == dict(rows=3, reused=3, failed=0)
    assert got(roots[1]) == got(roots[0])
    bank.withColumn("concept", F.upper("concept")).write.parquet(f"{tmp_path}/other.parquet")
    with pytest.raises(ValueError):
        workflow.score(spark, roots[0], args("all")[0], f"{tmp_path}/other.parquet", resume=True)
    with pytest.raises(ValueError):
        workflow.score(spark, str(tmp_path / "b"), args("all")[0], f"{tmp_path}/other.parquet", reuse=roots[0])


def test_command_line(spark, tmp_path):
    """fixture, inspect, prepare, analyze and report by their verbs."""
    root, again = str(tmp_path / "f"), str(tmp_path / "p")
    cli.main(["fixture", "--output", root])
    cli.main(["inspect", "--metadata", f"{root}/metadata.parquet", "--output", str(tmp_path / "i.json")])
    assert io.read_json(str(tmp_path / "i.json"))["rows"] == 80
    cli.main(["prepare", "--metadata", f"{root}/metadata.parquet", "--output", again, "--group-limit", "0"])
    assert spark.read.parquet(f"{again}/events").count() == 20
    cli.main(["analyze", "--output", root, "--bootstrap", "20"])
    cli.main(["report", "--output", root])
    assert len(spark.read.option("header", True).csv(f"{root}/analysis/discrimination_summary").collect()) == 3
    with pytest.raises(SystemExit):
        cli.main(["prepare", "--output", again, "--group-limit", "-1"])


def test_compare_and_report(spark, runs, tmp_path):
    got = workflow.compare(spark, runs["ranked"][0], runs["choice"][0], str(tmp_path), 20)
    assert got["discovery"]["direction_agreement"] == 1.0
    assert got["duplicates"]["shared_prompts"] == 20
    text = workflow.report(f"{runs['ranked'][0]}/analysis")
    assert "known_positive" in text and os.path.exists(f"{runs['ranked'][0]}/analysis/results_table.tex")
    assert workflow.latex("a_b\\") == r"a\_b\textbackslash{}"


def test_prepare_settings(spark, runs):
    path = runs["ranked"][0]
    with pytest.raises(ValueError):
        workflow.prepare(spark, path, "ranked", f"{path}/metadata.parquet", None, 7, resume=True)
    workflow.prepare(spark, path, "ranked", f"{path}/metadata.parquet", None, 0, resume=True)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [1, 2], 'a"b'), (2, 1.5, None, "c,d\ne")], "a long, b double, c array<int>, d string")
    io.write_jsonl(df, str(tmp_path / "x.jsonl"))
    back = io.read_rows(spark, str(tmp_path / "x.jsonl"))
    assert {(r.a, r.b) for r in back.collect()} == {(1, None), (2, 1.5)}
    io.write_csv(df, str(tmp_path / "x.csv"), ["d", "c", "z"])
    rows = {(r.d, r.c, r.z) for r in io.read_rows(spark, str(tmp_path / "x.csv")).collect()}
    assert rows == {('a"b', "[1,2]", None), ("c,d\ne", None, None)}
    (tmp_path / "doc.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert io.read_rows(spark, str(tmp_path / "doc.json")).count() == 2
    (tmp_path / "y.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert io.read_rows(spark, str(tmp_path / "y.jsonl")).count() == 2
    index = io.artifact_index(spark, str(tmp_path / "x.csv"))
    assert index.where("length(sha256) = 64").count() == index.count() > 0
    union = io.union_splits(spark, {"train": str(tmp_path / "y.jsonl"), "test": str(tmp_path / "doc.json")})
    assert union.groupBy("original_split").count().count() == 2


def test_incremental_components(spark, tmp_path):
    root = str(tmp_path / "c")
    schema = "event_id string, key string"
    for version, rows in enumerate(([("e1", "a"), ("e2", "b")], [("e3", "c")], [("e4", "b"), ("e4", "c")])):
        merged = increments.merge_components(increments.current(spark, root), spark.createDataFrame(rows, schema))
        merged.withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(root)
    labels = {r.event_id: r.label for r in increments.current(spark, root).collect()}
    assert labels == {"e1": "e1", "e2": "e2", "e3": "e2", "e4": "e2"}


def test_registry(spark):
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 60
    assert __spark_entry__.entry(spark).count() == 20


def test_every_vector_outside_the_bank_is_looked_up(spark):
    d = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").toPandas()
    m = np.array(e.embedding.tolist(), np.float64)
    others = (e.vec_id >= 50).to_numpy()
    sims = m[others] @ m[~others].T
    want = {k: (int(b), s) for k, b, s in zip(e.vec_id[others], e.vec_id[~others].to_numpy()[sims.argmax(axis=1)], sims.max(axis=1), strict=True)}
    got = {r.query_id: (r.concept_id, r.sim) for r in __spark_entry__.queries()["nearest_bank_row"](spark, d).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
