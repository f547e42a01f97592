"""What must not grow with images times concepts, and results that do not depend on size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import blocks, fused, graph, scoring
from tessella.operators import statistics as st

COMPARISON = "event_id string, preferred_image_id string, rejected_image_id string, within_event_weight double, prompt_group_id string, analysis_split string, dependency_cluster_id string"


@pytest.fixture
def made(spark):
    r = np.random.default_rng(9)
    p, c = r.normal(size=(60, 4)), r.normal(size=(37, 4))
    patches = spark.createDataFrame([(f"i{k % 20:02d}", k // 20, k % 5 != 0 or k < 20, p[k].tolist()) for k in range(60)], "image_id string, patch_id int, valid boolean, embedding array<double>").repartition(5)
    bank = spark.createDataFrame([(k, f"c{k}", c[k].tolist()) for k in range(37)], "concept_id int, concept string, embedding array<double>")
    pairs = [(f"e{k // 2 % 23}", f"i{a:02d}", f"i{b:02d}", 1.0, f"p{k // 2 % 23 % 6}", "test" if k // 2 % 23 % 2 else "discovery", f"k{k // 2 % 23 % 3}") for k, (a, b) in enumerate((a, b) for a in range(9) for b in range(9, 22))]
    return spark.createDataFrame(pairs, COMPARISON), scoring.PatchScores(patches, bank)


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def same(got, want, names):
    assert got.keys() == want.keys() and got
    for k in want:
        for n in names:
            a, b = got[k][n], want[k][n]
            assert (a is None and b is None) or abs(a - b) < 1e-9, (k, n, a, b)


@pytest.mark.parametrize(("units", "pairs", "bank"), [(512, 1024, None), (2, 5, 8 * 4 * 16), (1, 1, None)])
def test_estimands_without_a_table_of_scores(spark, monkeypatch, made, units, pairs, bank):
    """Prompts finished in one task and in several, several slices, blocks and tiles; images 20 and
    21 have no patches."""
    c, s = made
    monkeypatch.setattr(fused, "UNITS", units)
    monkeypatch.setattr(fused, "PAIRS", pairs)
    monkeypatch.setattr(fused, "TILE", 7)
    for m in (scoring, blocks):
        monkeypatch.setattr(m, "BLOCK", 8)
    if bank:
        monkeypatch.setattr(scoring, "BANK_BYTES", bank)
    table = s.long().cache()
    for by in ((), ("analysis_split",)):
        plain = st.prompt_values(c, table, by=by)
        same(rows(st.prompt_values(c, s, by=by), *by, "concept_id", "prompt_group_id"), rows(plain, *by, "concept_id", "prompt_group_id"), ["preferred", "rejected", "ordering", "effect"])
        same(rows(st.effects(c, s, by=by), *by, "concept_id"), rows(st.hierarchical_means(plain, by), *by, "concept_id"), [*st.METRICS, "prompts"])
    known = table.select("image_id")
    whole = c.join(known.withColumnRenamed("image_id", "rejected_image_id"), "rejected_image_id", "left_semi")
    same(rows(st.eager_effects(whole, s), "concept_id"), rows(st.eager_effects(whole, table), "concept_id"), ["effect"])
    same(rows(st.pair_wins(c, s, 0.05), "concept_id"), rows(st.pair_wins(c, table, 0.05), "concept_id"), ["wins", "pairs"])
    got = rows(s.only([30, 2]).long(), "image_id", "concept_id")
    same(got, rows(table.where("concept_id in (2, 30)"), "image_id", "concept_id"), ["score"])
    assert st.effects(c.limit(0), s).count() == 0


def test_an_image_without_a_valid_patch_is_an_error(spark, made):
    c, s = made
    void = scoring.PatchScores(s.patches.withColumn("valid", F.col("valid") & (F.col("image_id") != "i03")), s.concepts)
    for f in (st.effects, st.prompt_values, st.pair_wins):
        with pytest.raises(Exception, match="invalid image score"):
            f(c, void).collect()


def test_equivalence_without_a_table_of_scores(spark, made):
    import dataclasses

    s = made[1]

    def edit(ids, x):
        x = np.where(ids == 3, x + 0.25, x)
        x[:, ids >= 30] = np.nan
        return x

    part = scoring.PatchScores(s.patches.where("image_id <> 'i07'"), s.concepts)
    got = scoring.equivalence(s, dataclasses.replace(part, edit=edit)).first()
    other = part.long().where("concept_id < 30").withColumn("score", F.when(F.col("concept_id") == 3, F.col("score") + 0.25).otherwise(F.col("score")))
    assert got == scoring.equivalence(s.long(), other).first() and got.cells == 20 * 37
    assert scoring.equivalence(s, s).first().equivalent


def shuffled(df):
    """Numbers of the rows that the plan's exchanges would carry: none may hold a score array."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


def test_scores_are_not_shuffled(spark, made):
    c, s = made
    for df in (s.long(), s.blocks().rows, scoring.patch_argmax(s.patches, s.concepts)):
        assert shuffled(df) and not any("scores" in line or "block_id" in line for line in shuffled(df))


def test_ids_of_large_components_are_digests_of_all_events(spark, monkeypatch):
    from tessella.sources.io import digest

    monkeypatch.setattr(graph, "MEMBERS", 20)
    names = {f"x{n}": [f'e"{n}:é{k}' for k in range(size)] for n, size in enumerate((20, 21, 400, 3))}
    labels = spark.createDataFrame([(e, x) for x, some in names.items() for e in some], "event_id string, label string").repartition(7)
    assert dict(graph.component_digests(labels).collect()) == {x: digest(sorted(some)) for x, some in names.items()}


def test_defects_by_number_whatever_the_number_of_vectors(spark, tmp_path):
    """362 vectors: the last event has two of its four and the last group two of its five."""
    import duckdb

    import __spark_entry__

    spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id < 362").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("choice_exclusions", "ranked_exclusions"):
        got = {tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()}
        assert got == set(con.execute(__spark_entry__.oracle_sql()[name]).fetchall()) and len(got) > 70


def test_links_of_keys_and_settled_stars(spark, monkeypatch):
    """Chains over ranges, keys of many events, copies of rows; every component by its least event."""
    import random

    links = lambda rows: spark.createDataFrame(rows, "u string, v string")
    assert graph._settled(links([("b", "a"), ("c", "a"), ("y", "x")]))
    assert not graph._settled(links([("b", "a"), ("c", "b")])) and not graph._settled(links([("c", "a"), ("c", "b")]))
    r = random.Random(5)
    rows = [(f"e{k:03d}", f"c{j}") for k in range(90) for j in (k, k + 1)] + [(f"h{k}", "hot") for k in range(40)] * 2 + [(f"r{r.randrange(60):02d}", f"k{r.randrange(70)}") for _ in range(80)] + [("one", "alone")]
    edges = spark.createDataFrame(rows, "event_id string, key string").repartition(6)
    parent = {e: e for e, _ in rows}

    def root(e):
        while parent[e] != e:
            e = parent[e]
        return e

    least = {}
    for e, k in sorted(rows):
        a, b = root(e), root(least.setdefault(k, e))
        parent[max(a, b)] = min(a, b)
    want = {e: root(e) for e in parent}
    monkeypatch.setattr(graph, "LOCAL_LINKS", 7)
    for local in (0, 10_000):
        assert dict(graph.least_labels(edges, local).collect()) == want
