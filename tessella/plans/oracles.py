"""The registered queries in DuckDB SQL, from shared common table expressions."""

from __future__ import annotations

import itertools

#: Text of each common table expression; a query names those it needs, in order.
CTES = {
    "vecs": "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 5)) AS emb, label, vec_id < (SELECT count(*) // 10 FROM embeddings) AS bank FROM embeddings",
    "concepts": "SELECT vec_id::INT AS concept_id, 'c' || vec_id AS concept, emb FROM vecs WHERE bank",
    "patches": "SELECT vec_id // 2 AS i, (vec_id % 2)::INT AS patch_id, vec_id % 7 <> 3 AS valid, emb, label FROM vecs",
    "sims": "SELECT i, patch_id, concept_id, list_dot_product(p.emb, c.emb) / sqrt(list_dot_product(p.emb, p.emb) * list_dot_product(c.emb, c.emb)) AS sim FROM patches p, concepts c WHERE valid",
    "scores": "SELECT i, concept_id, max(sim) AS score FROM sims GROUP BY ALL",
    "rr": """SELECT i, i // 5 AS g, label, 1 + label % 3 AS rank,
               CASE WHEN i // 5 % 20 < 14 THEN 'train' WHEN i // 5 % 20 < 17 THEN 'validation' ELSE 'test' END AS split,
               CASE WHEN i // 5 % 13 = 5 THEN 'shared' ELSE 'prompt ' || (i // 5 % 40) || ' x' END AS norm,
               CASE WHEN i // 5 % 17 = 0 THEN 6 ELSE 5 END AS expected
             FROM (SELECT vec_id // 2 AS i, label FROM embeddings WHERE vec_id % 2 = 0)""",
    "re": """SELECT 'ranked:' || split || ':' || g AS event_id, g, split, sha256(to_json(norm)) AS prompt_group_id,
               string_agg('ranked:' || i, ',' ORDER BY 'ranked:' || i) AS candidates,
               string_agg(rank::VARCHAR, ',' ORDER BY 'ranked:' || i) AS ranks,
               count(*)::INT AS observed, min(rank) AS lo, max(rank) AS hi,
               CASE WHEN count(*) <> min(expected) THEN 'incomplete_annotated_group'
                    WHEN count(DISTINCT rank) < 2 THEN 'no_strict_rank_pairs' END AS exclusion_reason
             FROM rr GROUP BY g, split, norm""",
    "rcomp": """SELECT prompt_group_id, sha256(to_json(list(event_id ORDER BY event_id))) AS component_id,
                CASE WHEN count(DISTINCT split) > 1 THEN 'quarantine' WHEN min(split) = 'train' THEN 'discovery' ELSE min(split) END AS analysis_split
              FROM re GROUP BY prompt_group_id""",
    "ev": "SELECT * FROM re JOIN rcomp USING (prompt_group_id)",
    "live": "SELECT * FROM ev WHERE exclusion_reason IS NULL AND analysis_split <> 'quarantine'",
    "modes": "SELECT unnest(['all_strict_pairs', 'best_vs_rest', 'best_vs_worst']) AS mode",
    "rpairs": """SELECT *, 1.0 / count(*) OVER (PARTITION BY mode, event_id) AS weight FROM (
                SELECT mode, e.event_id, a.i AS w, b.i AS l, prompt_group_id, component_id, analysis_split
                FROM live e JOIN rr a ON a.g = e.g JOIN rr b ON b.g = e.g AND a.rank < b.rank, modes
                WHERE (mode = 'all_strict_pairs' OR a.rank = lo) AND (mode <> 'best_vs_worst' OR b.rank = hi))""",
    "rc": "SELECT * FROM rpairs WHERE mode = 'all_strict_pairs'",
    "ci": """SELECT i, i // 4 AS k, 'block ' || (i // 4) || CASE WHEN i % 41 = 0 THEN ' altered' ELSE '' END AS norm,
               CASE WHEN i // 4 % 11 = 3 OR (i // 4 % 11 = 5 AND i % 4 = 0) THEN 'blur' END AS negative,
               CASE WHEN i % 29 <> 0 THEN 'm' || (i % 3) END AS model_id, (256 + 64 * (i % 3))::INT AS width
             FROM (SELECT vec_id // 2 AS i FROM embeddings WHERE vec_id % 2 = 0)""",
    "cb": "SELECT k, bool_and(norm = 'block ' || k) AS prompts_match, count(negative) IN (0, 4) AS compatible FROM ci GROUP BY k",
    "ce": """SELECT 'choice:' || event_id AS event_id, x.k, user_id, sha256(to_json('block ' || x.k)) AS prompt_group_id,
               user_id % 5 AS w, prompts_match, compatible,
               CASE WHEN user_id % 5 = 4 THEN 'invalid_or_none_selection'
                    WHEN NOT prompts_match THEN 'candidate_prompt_mismatch'
                    WHEN NOT compatible THEN 'incompatible_or_partly_missing_negative_prompts' END AS exclusion_reason
             FROM (SELECT *, event_id % (SELECT count(*) // 8 FROM embeddings) AS k FROM events WHERE event_type = 'purchase') x JOIN cb ON cb.k = x.k""",
    "ccomp": "SELECT k, sha256(to_json(list(event_id ORDER BY event_id))) AS component_id, bool_or(exclusion_reason IS NULL) AS able FROM ce GROUP BY k",
    "csplit": """SELECT k, component_id, coalesce(split, 'quarantine') AS analysis_split FROM ccomp LEFT JOIN (
                SELECT component_id, CASE WHEN r <= a THEN 'discovery' WHEN r <= a + b THEN 'validation' ELSE 'test' END AS split FROM (
                  SELECT component_id, row_number() OVER (ORDER BY sha256('42:' || component_id), component_id) AS r, count(*) OVER () AS n FROM ccomp WHERE able),
                  quota WHERE quota.n = (SELECT count(*) FROM ccomp WHERE able)) USING (component_id)""",
    "cev": "SELECT ce.*, component_id, analysis_split FROM ce JOIN csplit USING (k)",
    "cc": "SELECT event_id, 4 * k + w AS w, x.i AS l, 1.0 / 3 AS weight, prompt_group_id, component_id, analysis_split, k FROM cev, (SELECT unnest([0, 1, 2, 3]) AS j), LATERAL (SELECT 4 * k + j AS i) x WHERE exclusion_reason IS NULL AND analysis_split <> 'quarantine' AND j <> w",
    "pv": """SELECT analysis_split, concept_id, prompt_group_id, component_id, avg(w) AS preferred, avg(l) AS rejected, avg(o) AS ordering, avg(w) - avg(l) AS effect FROM (
               SELECT analysis_split, a.concept_id, prompt_group_id, component_id, event_id, avg(a.score) AS w, avg(b.score) AS l,
                      avg(CASE WHEN a.score - b.score > 0 THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS o
               FROM rc JOIN scores a ON a.i = rc.w JOIN scores b ON b.i = rc.l AND a.concept_id = b.concept_id
               GROUP BY ALL) GROUP BY ALL""",
    "cpv": """SELECT analysis_split, concept_id, prompt_group_id, component_id, avg(w) AS preferred, avg(l) AS rejected, avg(o) AS ordering, avg(w) - avg(l) AS effect FROM (
               SELECT analysis_split, a.concept_id, prompt_group_id, component_id, event_id, avg(a.score) AS w, avg(b.score) AS l,
                      avg(CASE WHEN a.score - b.score > 0 THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS o
               FROM cc JOIN scores a ON a.i = cc.w JOIN scores b ON b.i = cc.l AND a.concept_id = b.concept_id
               GROUP BY ALL) GROUP BY ALL""",
    "lefteff": "SELECT concept_id, round(avg(effect), 9) AS effect FROM pv WHERE analysis_split = 'discovery' GROUP BY concept_id",
    "righteff": "SELECT concept_id, round(avg(effect), 9) AS effect FROM cpv WHERE analysis_split = 'discovery' GROUP BY concept_id",
    "frozen": """SELECT concept_id, 'c' || concept_id AS concept, side, CASE WHEN side = 'preferred' THEN 1 ELSE -1 END AS direction, r::INT AS discovery_rank, effect AS discovery_effect FROM (
               SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(effect) DESC, concept_id) AS r FROM (
                 SELECT *, CASE WHEN effect > 0 THEN 'preferred' ELSE 'rejected' END AS side FROM lefteff WHERE effect <> 0)) WHERE r <= 10""",
    "docs": "SELECT doc_id::VARCHAR AS image_id, md5(text) AS content_hash, CASE WHEN doc_id % 4 = 0 THEN md5(lower(text)) END AS pixel_hash, doc_id FROM documents",
    "didx": "SELECT image_id, coalesce(pixel_hash, content_hash) AS identity FROM docs",
    "gstrata": """SELECT *, count(*) OVER (PARTITION BY stratum, event_id) AS n FROM (
                SELECT cc.*, unnest(CASE WHEN a.model_id = b.model_id THEN ['same_model', 'same_model:' || a.model_id] ELSE ['cross_model'] END) AS stratum
                FROM cc JOIN ci a ON a.i = cc.w JOIN ci b ON b.i = cc.l WHERE a.model_id IS NOT NULL AND b.model_id IS NOT NULL)""",
}


def quota_table(most: int = 400) -> str:
    """Largest-remainder 70/15/15 sizes for every number of components up to the most."""
    n = f"(SELECT unnest(range({most})) AS n)"
    return f"""SELECT n, a + (rest >= 1 AND ra = m)::INT + 0 AS a, CASE WHEN rest = 2 OR (rest = 1 AND ra <> m) THEN b + 1 ELSE b END AS b FROM (
        SELECT n, a, b, n - a - 2 * b AS rest, n * 70 % 100 AS ra, greatest(n * 70 % 100, n * 15 % 100) AS m FROM (
          SELECT n, n * 70 // 100 AS a, n * 15 // 100 AS b FROM {n}))"""


CTES["quota"] = quota_table()
ORDER = ["vecs", "concepts", "patches", "sims", "scores", "rr", "re", "rcomp", "ev", "live", "modes", "rpairs", "rc", "ci", "cb", "ce", "ccomp", "quota", "csplit", "cev", "cc", "pv", "cpv", "lefteff", "righteff", "frozen", "docs", "didx", "gstrata"]


def needs(text: str) -> set[str]:
    import re

    names = {n for n in CTES if re.search(rf"\b{n}\b", text)}
    return names.union(*(needs(CTES[n]) for n in names)) if names else names


def sql(text: str, extra: str = "", recursive: bool = False) -> str:
    """The query with the expressions that it needs."""
    used = needs(text + extra)
    parts = [f"{n} AS ({CTES[n]})" for n in ORDER if n in used] + ([extra] if extra else [])
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else "") + text


def bootstrap(source: str, value: str, keys: str = "concept_id", resamples: int = 2000, seed: int = 42) -> str:
    """(keys, low, high) over the components of a prompt-value expression."""
    return f"""SELECT {keys}, CASE WHEN max(kk) > 1 THEN quantile_cont(x, 0.025) END AS low, CASE WHEN max(kk) > 1 THEN quantile_cont(x, 0.975) END AS high FROM (
        SELECT {keys}, b, max(kk) AS kk, sum(v * n) / sum(s * n) AS x FROM (
          SELECT {keys}, dense_rank() OVER (ORDER BY component_id) - 1 AS k, sum({value}) AS v, count(*) AS s FROM {source} GROUP BY {keys}, component_id) c
        JOIN (SELECT b, k, kk, count(*) AS n FROM (
          SELECT b, kk, ('0x' || substr(sha256('{seed}:' || b || ':' || i), 1, 8))::BIGINT % kk AS k
          FROM (SELECT count(DISTINCT component_id) AS kk FROM {source}), (SELECT unnest(range({resamples})) AS b), LATERAL (SELECT unnest(range(kk)) AS i)) GROUP BY ALL) d USING (k)
        GROUP BY {keys}, b) GROUP BY {keys}"""


def evaluated(source: str) -> str:
    """Columns of an evaluated frozen list, from prompt values."""
    return f"""SELECT concept_id, side, direction, discovery_rank, round(heldout, 6) AS heldout_effect, round(e.low, 6) AS effect_ci_low, round(e.high, 6) AS effect_ci_high,
        round(raw, 6) AS raw_concordance, round(CASE WHEN direction = 1 THEN raw ELSE 1 - raw END, 6) AS direction_adjusted_concordance,
        round(CASE WHEN direction = 1 THEN o.low ELSE 1 - o.high END, 6) AS adjusted_concordance_ci_low, round(CASE WHEN direction = 1 THEN o.high ELSE 1 - o.low END, 6) AS adjusted_concordance_ci_high
        FROM frozen JOIN (SELECT concept_id, avg(effect) AS heldout, avg(ordering) AS raw FROM {source} GROUP BY concept_id) m USING (concept_id)
        JOIN ({bootstrap(source, "effect")}) e USING (concept_id) JOIN ({bootstrap(source, "ordering")}) o USING (concept_id)"""


PY_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HEX = "md5(o_orderkey::VARCHAR)"
UUID = "regexp_replace(" + HEX + r", '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5')"
METRICS = "round(avg(effect), 6) AS effect, round(avg(preferred), 6) AS preferred_mean, round(avg(rejected), 6) AS rejected_mean, round(avg(ordering), 6) AS concordance, round(stddev_samp(effect), 6) AS prompt_effect_sd, round(stddev_samp(preferred), 6) AS preferred_prompt_sd, round(stddev_samp(rejected), 6) AS rejected_prompt_sd, count(*) AS prompts"
PAIR = "event_id, 'ranked:' || w AS preferred_image_id, 'ranked:' || l AS rejected_image_id, round(weight, 6) AS within_event_weight, analysis_split, mode AS construction_mode"


def _pairs(mode: str) -> str:
    return sql(f"SELECT {PAIR} FROM rpairs WHERE mode = '{mode}'")


METRIC_CELLS = (("avg(effect)", "effect"), ("avg(preferred)", "preferred_mean"), ("avg(rejected)", "rejected_mean"), ("avg(ordering)", "concordance"), ("stddev_samp(effect)", "prompt_effect_sd"), ("stddev_samp(preferred)", "preferred_prompt_sd"), ("stddev_samp(rejected)", "rejected_prompt_sd"))


def _wide() -> str:
    cells = ", ".join(f"round({c} FILTER (analysis_split = '{s}'), 6) AS {s}_{n}" for s, (c, n) in itertools.product(("discovery", "validation", "test"), METRIC_CELLS))
    return sql(f"SELECT concept_id, {cells} FROM pv GROUP BY concept_id")


ORACLES = {
    "prompt_normalize": rf"SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '{PY_SPACE}+', ' ', 'g'), ' ')) AS norm_md5 FROM documents",
    "prompt_digest": rf"SELECT page_id, sha256(to_json(trim(regexp_replace(nfc_normalize(url), '{PY_SPACE}+', ' ', 'g'), ' '))::VARCHAR) AS prompt_group_id FROM pages UNION ALL SELECT -1, sha256('null')",
    "uid_from_url": f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN {UUID} END AS uid FROM orders",
    "identity_violations": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'uid' WHEN 2 THEN 'prompt' WHEN 3 THEN CASE WHEN o_orderstatus <> 'F' THEN 'seed' END END AS violation FROM orders",
    "safe_paths": "SELECT page_id, page_id % 6 IN (0, 5) AS safe FROM pages",
    "whole_numbers": "SELECT l_orderkey, CASE WHEN l_orderkey % 4 IN (0, 3) THEN l_orderkey END AS value FROM lineitem GROUP BY l_orderkey",
    "clean_values": "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN round(value, 6) END AS value FROM events",
    "missingness_audit": r"""SELECT 'text' AS field, count(*) FILTER (doc_id % 7 = 0 OR (doc_id % 7 <> 1 AND text IS NULL)) AS null_count, count(*) FILTER (doc_id % 7 = 1 OR (doc_id % 7 <> 0 AND regexp_full_match(text, '\s*'))) AS blank_count FROM documents
        UNION ALL SELECT 'doc_id', count(*) - count(doc_id), 0 FROM documents UNION ALL SELECT 'n_chars', count(*) - count(n_chars), 0 FROM documents
        UNION ALL SELECT 'lang', count(*) - count(lang), count(*) FILTER (trim(lang) = '') FROM documents UNION ALL SELECT 'source', count(*) - count(source), count(*) FILTER (trim(source) = '') FROM documents""",
    "split_union_scan": "SELECT ['train', 'validation', 'test'][1 + conv_id % 3] AS original_split, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1",
    "uid_shard_scan": "SELECT (4 * (event_id % (SELECT count(*) // 8 FROM embeddings)) + j)::VARCHAR AS uid, count(*) AS n, min(event_id) AS first_ranking FROM events, (SELECT unnest([0, 1, 2, 3]) AS j) WHERE event_type = 'purchase' GROUP BY 1",
    "coverage_audit": sql("""SELECT (SELECT count(DISTINCT i) FROM ce JOIN ci USING (k) WHERE exclusion_reason IS NULL AND (i % 3 <> 0 OR i < 40)) AS covered_images,
        (SELECT count(*) FROM ce WHERE exclusion_reason IS NULL AND 4 * k + 3 < 40) + (SELECT count(*) FROM ce WHERE exclusion_reason IS NULL AND 4 * k + 3 >= 40 AND NOT EXISTS (SELECT 1 FROM ci WHERE ci.k = ce.k AND i % 3 = 0 AND i >= 40)) AS complete_events,
        (SELECT count(*) FROM ce WHERE exclusion_reason IS NULL) AS eligible_events"""),
    "telemetry_summary": "SELECT event_type AS device, count(*) AS samples, max(event_id % 100)::DOUBLE AS max_utilization, round(avg(event_id % 100), 6) AS mean_utilization, round(avg(event_id % 100) FILTER (event_id % 100 > 0), 6) AS active_mean_utilization, max(user_id * 7)::DOUBLE AS max_memory FROM events WHERE event_id % 11 <> 0 GROUP BY 1",
    "ranked_ingest": sql("SELECT event_id, split AS original_split, prompt_group_id, candidates, ranks, observed AS observed_candidates, exclusion_reason FROM re"),
    "choice_ingest": sql("SELECT event_id, prompt_group_id, 'choice:' || (4 * k) || ',choice:' || (4 * k + 1) || ',choice:' || (4 * k + 2) || ',choice:' || (4 * k + 3) AS candidates, 'choice:' || CASE WHEN w = 4 THEN 'none' ELSE (4 * k + w)::VARCHAR END AS winner_image_id, user_id::VARCHAR AS annotator_id, exclusion_reason, prompts_match, compatible AS negative_prompts_compatible FROM ce"),
    "ranked_exclusions": """SELECT 'ranked:train:' || g AS event_id, CASE g % 8 WHEN 1 THEN 'missing_image_identity' WHEN 2 THEN 'inconsistent_group_prompt' WHEN 3 THEN 'invalid_rank_or_candidate_count' WHEN 4 THEN 'conflicting_duplicate_image_annotation'
        WHEN 5 THEN 'incomplete_annotated_group' WHEN 6 THEN 'no_strict_rank_pairs' WHEN 7 THEN 'conflicting_image_prompt_metadata' END AS exclusion_reason FROM (SELECT DISTINCT vec_id // 5 AS g FROM embeddings)""",
    "choice_exclusions": """SELECT 'choice:' || k AS event_id, CASE k % 9 WHEN 1 THEN 'invalid_or_none_selection' WHEN 2 THEN 'winner_not_a_candidate' WHEN 3 THEN 'invalid_candidate_set' WHEN 4 THEN 'missing_candidate_metadata' WHEN 5 THEN 'conflicting_duplicate_event'
        WHEN 6 THEN 'candidate_prompt_mismatch' WHEN 7 THEN 'incompatible_or_partly_missing_negative_prompts' WHEN 8 THEN 'conflicting_image_metadata' END AS exclusion_reason FROM (SELECT DISTINCT vec_id // 4 AS k FROM embeddings)""",
    "components_chain": """WITH RECURSIVE e AS (SELECT o_orderkey AS j, 'e' || lpad(o_orderkey::VARCHAR, 12, '0') AS event_id FROM orders),
        reach(j, label) AS (SELECT j, event_id FROM e WHERE j % 10 = 0 OR j - 1 NOT IN (SELECT j FROM e) UNION ALL SELECT e.j, label FROM reach JOIN e ON e.j = reach.j + 1 AND e.j % 10 <> 0)
        SELECT event_id, sha256(to_json(list(event_id ORDER BY event_id) OVER (PARTITION BY label ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) AS component_id FROM e JOIN reach USING (j)""",
    "exclusion_histogram": sql("SELECT exclusion_reason, count(*) AS n FROM ce WHERE exclusion_reason IS NOT NULL GROUP BY 1"),
    "candidate_count_dist": sql("SELECT observed AS observed_candidates, count(*) AS events, count(*) FILTER (d < observed) AS with_ties FROM re JOIN (SELECT g, count(DISTINCT rank) AS d FROM rr GROUP BY g) USING (g) GROUP BY 1"),
    "reused_images": sql("SELECT 4 * count(*) AS images, 4 * count(*) FILTER (n > 1) AS reused FROM (SELECT k, count(*) AS n FROM ce GROUP BY k)"),
    "components_base": sql("SELECT event_id, component_id FROM re JOIN rcomp USING (prompt_group_id)"),
    "components_choice": sql("SELECT event_id, component_id FROM ce JOIN ccomp USING (k)"),
    "components_annotator": sql(
        "SELECT event_id, sha256(to_json(list(event_id ORDER BY event_id) OVER (PARTITION BY label ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) AS component_id FROM ce JOIN labels_ ON labels_.b = ce.k",
        "links AS (SELECT DISTINCT a.k AS x, b.k AS y FROM ce a JOIN ce b USING (user_id)), reach(a, b) AS (SELECT x, x FROM links UNION SELECT reach.a, y FROM reach JOIN links ON links.x = reach.b), labels_ AS (SELECT b, min(a) AS label FROM reach GROUP BY b)",
        True,
    ),
    "official_split": sql("SELECT event_id, component_id AS dependency_cluster_id, analysis_split FROM ev"),
    "grouped_split": sql("SELECT event_id, analysis_split FROM cev"),
    "split_audit": sql("SELECT analysis_split, count(*) AS events, count(DISTINCT component_id) AS components FROM cev WHERE exclusion_reason IS NULL GROUP BY 1"),
    "leakage_check": sql("SELECT component_id, count(DISTINCT split) AS splits FROM re JOIN rcomp USING (prompt_group_id) GROUP BY 1 HAVING count(DISTINCT split) > 1"),
    "hash_quarantine": sql("""SELECT event_id, CASE WHEN hit THEN 'quarantine' ELSE analysis_split END AS analysis_split, exclusion_reason IS NULL AND analysis_split <> 'quarantine' AND NOT hit AS sampled
        FROM (SELECT *, prompt_group_id IN (SELECT prompt_group_id FROM ev WHERE g IN (0, 30, 15)) AND (SELECT count(DISTINCT analysis_split) FROM ev WHERE g IN (0, 30, 15)) > 1 AS hit FROM ev)"""),
    "component_sample": sql(
        "SELECT event_id, exclusion_reason IS NULL AND component_id IN (SELECT unnest(taken) FROM pick) AS sampled FROM cev",
        """sizes AS (SELECT analysis_split, component_id, count(DISTINCT prompt_group_id) AS size, row_number() OVER (PARTITION BY analysis_split ORDER BY sha256('[42,["' || analysis_split || '","' || component_id || '"]]')) AS r
             FROM cev WHERE exclusion_reason IS NULL AND analysis_split <> 'quarantine' GROUP BY 1, 2),
           walk(analysis_split, r, used, taken) AS (SELECT DISTINCT analysis_split, 0::BIGINT, 0::BIGINT, []::VARCHAR[] FROM sizes
             UNION ALL SELECT s.analysis_split, s.r, CASE WHEN used + size <= cap THEN used + size ELSE used END, CASE WHEN used + size <= cap THEN list_append(taken, component_id) ELSE taken END
             FROM walk w JOIN sizes s ON s.analysis_split = w.analysis_split AND s.r = w.r + 1, LATERAL (SELECT CASE WHEN s.analysis_split = 'discovery' THEN 14 ELSE 3 END AS cap)),
           pick AS (SELECT analysis_split, arg_max(taken, r) AS taken FROM walk GROUP BY 1)""",
        True,
    ),
    "cohort_restrict": sql("SELECT coalesce(exclusion_reason, CASE WHEN k % 3 = 0 THEN 'outside_available_archive_cohort' END) AS exclusion_reason, count(*) AS n FROM ce GROUP BY 1"),
    "complete_events": sql("SELECT event_id FROM re JOIN rr USING (g) GROUP BY event_id HAVING bool_and(i % 9 <> 4)"),
    "required_images": sql("SELECT DISTINCT 'choice:' || i AS image_id FROM cev JOIN ci USING (k) WHERE exclusion_reason IS NULL AND analysis_split <> 'quarantine'"),
    "strict_pairs": _pairs("all_strict_pairs"),
    "best_vs_rest_pairs": _pairs("best_vs_rest"),
    "best_vs_worst_pairs": _pairs("best_vs_worst"),
    "winner_vs_rest_pairs": sql("SELECT event_id, 'choice:' || w AS preferred_image_id, 'choice:' || l AS rejected_image_id, round(weight, 6) AS within_event_weight, analysis_split FROM cc"),
    "incomplete_exclusions": sql("SELECT event_id, 'incomplete_valid_scored_event' AS reason FROM live JOIN rr USING (g) GROUP BY event_id HAVING NOT bool_and(i % 9 <> 4)"),
    "concept_norm_audit": sql("SELECT count(*) AS concepts, min(len(emb))::INT AS min_dim, max(len(emb))::INT AS max_dim, round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm, round(avg(n), 6) AS mean_norm FROM (SELECT emb, sqrt(list_dot_product(emb, emb)) AS n FROM concepts)"),
    "max_patch_scores": sql("SELECT 'ranked:' || i AS image_id, concept_id, round(score, 6) AS score FROM scores"),
    "patch_argmax": sql("SELECT 'ranked:' || i AS image_id, concept_id, arg_max(patch_id, sim) AS patch_id, round(max(sim), 6) AS sim FROM sims GROUP BY i, concept_id"),
    "nearest_bank_row": sql("SELECT vec_id::INT AS query_id, arg_max(concept_id, list_cosine_similarity(v.emb, c.emb)) AS concept_id, round(max(list_cosine_similarity(v.emb, c.emb)), 6) AS sim FROM vecs v, concepts c WHERE NOT bank GROUP BY vec_id"),
    "bank_diagnosis": sql(
        "SELECT round(avg(cos), 6) AS mean_cosine, round(min(cos), 6) AS min_cosine, round(max(err), 6) AS max_abs_error, (SELECT round(avg((best = q)::INT), 6) FROM (SELECT x.concept_id AS q, arg_max(c.concept_id, list_cosine_similarity(x.emb, c.emb)) AS best FROM shifted x, concepts c GROUP BY 1)) AS same_row_nearest FROM (SELECT list_cosine_similarity(x.emb, c.emb) AS cos, list_max(list_transform(range(1, 65), lambda t: abs(x.emb[t] / sqrt(list_dot_product(x.emb, x.emb)) - c.emb[t] / sqrt(list_dot_product(c.emb, c.emb))))) AS err FROM shifted x JOIN concepts c USING (concept_id))",
        "shifted AS (SELECT (vec_id - 1)::INT AS concept_id, emb FROM vecs WHERE vec_id >= 1 AND vec_id <= (SELECT count(*) // 10 FROM embeddings))",
    ),
    "row_dedup_index": sql("SELECT image_id, identity, dense_rank() OVER (ORDER BY first) - 1 AS score_row FROM didx JOIN (SELECT identity, min(image_id) AS first FROM didx GROUP BY identity) USING (identity)"),
    "worker_partition": sql("SELECT image_id, ((dense_rank() OVER (ORDER BY identity) - 1) % 4)::INT AS worker FROM didx"),
    "score_reuse": sql("SELECT doc_id AS score_row, source_row FROM docs JOIN (SELECT content_hash, max(doc_id) AS source_row FROM docs GROUP BY 1) USING (content_hash) WHERE doc_id % 2 = 0 AND source_row % 3 <> 0"),
    "score_equivalence": sql("SELECT count(*) AS cells, 0.001 AS max_abs_difference, count(*) FILTER (concept_id = 4 OR concept_id >= 49) AS validity_differences, false AS equivalent FROM scores"),
    "hierarchical_effects": sql(f"SELECT concept_id, {METRICS} FROM pv WHERE analysis_split = 'discovery' GROUP BY concept_id"),
    "effects_eager": sql("SELECT concept_id, round(avg(effect), 6) AS effect FROM pv WHERE analysis_split = 'discovery' GROUP BY concept_id"),
    "pair_concordance": sql("SELECT concept_id, sum(CASE WHEN d > 0.05 THEN 1.0 WHEN abs(d) <= 0.05 THEN 0.5 ELSE 0 END)::DOUBLE AS wins, count(*) AS pairs FROM (SELECT a.concept_id, round(a.score - b.score, 9) AS d FROM rc JOIN scores a ON a.i = rc.w JOIN scores b ON b.i = rc.l AND a.concept_id = b.concept_id WHERE analysis_split = 'discovery') GROUP BY 1"),
    "agg_counts": sql("SELECT analysis_split, count(DISTINCT prompt_group_id) AS prompts, count(DISTINCT event_id) AS events, count(*) // 2 AS comparisons, count(DISTINCT component_id) AS components, count(DISTINCT x) AS unique_images FROM (SELECT *, unnest([w, l]) AS x FROM rc) GROUP BY 1"),
    "pooled_auc": """WITH t AS (SELECT lang, quality, n_chars AS v, 1.0 + doc_id % 3 AS w FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)
        SELECT lang, round(m / (p * n), 6) AS auc FROM (SELECT lang, coalesce(sum(w) FILTER (quality = 1), 0) AS p, coalesce(sum(w) FILTER (quality <> 1), 0) AS n FROM t GROUP BY lang)
        LEFT JOIN (SELECT a.lang, sum(a.w * b.w * CASE WHEN a.v > b.v THEN 1 WHEN a.v = b.v THEN 0.5 ELSE 0 END) AS m FROM t a JOIN t b ON a.lang = b.lang AND a.quality = 1 AND b.quality <> 1 GROUP BY a.lang) USING (lang)""",
    "signed_topk": sql("SELECT concept_id, concept, side, direction, discovery_rank, round(discovery_effect, 6) AS discovery_effect FROM frozen"),
    "bootstrap_ci": sql("SELECT concept_id, round(low, 6) AS low, round(high, 6) AS high FROM (" + bootstrap("dpv", "effect") + ")", "dpv AS (SELECT * FROM pv WHERE analysis_split = 'discovery')"),
    "frozen_eval": sql(evaluated("tpv"), "tpv AS (SELECT * FROM pv WHERE analysis_split = 'test')"),
    "joint_score": sql(
        """SELECT round(avg(effect), 6) AS effect, round(avg(o), 6) AS concordance, count(*) AS prompts FROM (SELECT prompt_group_id, avg(e) AS effect, avg(o) AS o FROM (
        SELECT prompt_group_id, event_id, avg(a.s) - avg(b.s) AS e, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) AS o FROM rc JOIN js a ON a.i = w JOIN js b ON b.i = l WHERE analysis_split = 'test' GROUP BY ALL) GROUP BY 1)""",
        "js AS (SELECT i, round(sum(direction * score) / (SELECT count(*) FROM frozen), 9) AS s FROM scores JOIN frozen USING (concept_id) GROUP BY i)",
    ),
    "all_concepts_wide": _wide(),
    "construction_sensitivity": sql("""SELECT mode AS construction_mode, concept_id, round(avg(e), 6) AS effect, count(*) AS prompts FROM (SELECT mode, concept_id, prompt_group_id, avg(e) AS e FROM (
        SELECT mode, a.concept_id, prompt_group_id, event_id, avg(a.score) - avg(b.score) AS e FROM rpairs JOIN scores a ON a.i = w JOIN scores b ON b.i = l AND a.concept_id = b.concept_id WHERE analysis_split = 'discovery' GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"""),
    "distribution_summary": "SELECT event_type, count(v) AS known, count(*) - count(v) AS missing, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75 FROM (SELECT event_type, CASE WHEN event_id % 10 <> 0 THEN value END AS v FROM events) GROUP BY 1",
    "effect_spearman": "SELECT round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM (SELECT rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS rx, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS ry FROM part)",
    "event_strata": sql(
        """SELECT stratum, count(*) AS events FROM (SELECT unnest(list_filter([CASE WHEN m AND g = 1 THEN 'same_model' END, CASE WHEN m AND g = 1 THEN 'generator:' || a END, CASE WHEN m AND g > 1 THEN 'mixed_models' END, CASE WHEN k % 4 <> 1 THEN 'equal_patch_count_event' END,
        CASE WHEN k % 2 = 0 THEN 'equal_aspect_ratio_event' END, CASE WHEN k % 2 = 0 AND k % 5 <> 0 THEN 'equal_resolution_event' END, CASE WHEN k % 7 <> 3 THEN 'category:c' || (k % 3) END], lambda x: x IS NOT NULL)) AS stratum
        FROM cev JOIN b USING (k) WHERE exclusion_reason IS NULL AND analysis_split <> 'quarantine') GROUP BY 1""",
        "b AS (SELECT k, count(model_id) = 4 AS m, count(DISTINCT model_id) AS g, min(model_id) AS a FROM ci GROUP BY k)",
    ),
    "confounder_distributions": sql("SELECT coalesce(model_id, 'unavailable') AS model_id, count(*) AS images, min(width) AS min_width, max(width) AS max_width FROM ci WHERE k IN (SELECT k FROM cc) GROUP BY 1"),
    "confounder_audit": sql("""SELECT field, count(v) AS known, count(*) - count(v) AS missing, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75 FROM (
        SELECT unnest(['valid_patches', 'width', 'height', 'aspect_ratio', 'gs', 'steps']) AS field, unnest([1 + i % 9, width, height, width / height, CASE WHEN i % 3 <> 0 THEN i % 5 + 0.5 END, CASE WHEN i % 2 = 0 THEN 20 + i % 7 END]::DOUBLE[]) AS v
        FROM (SELECT i, width, CASE WHEN i % 13 <> 0 THEN 128 + 32 * (i % 4) END AS height FROM ci WHERE k IN (SELECT k FROM cc))) GROUP BY 1"""),
    "annotator_audit": sql("SELECT count(*) AS annotators, count(*) FILTER (n > 1) AS repeated, coalesce(max(n), 0) AS most FROM (SELECT user_id, count(*) AS n FROM cev WHERE exclusion_reason IS NULL AND analysis_split <> 'quarantine' GROUP BY 1)"),
    "generator_pair_strata": sql("SELECT stratum, count(*) AS pairs, round(sum(1.0 / n), 6) AS weight FROM gstrata GROUP BY 1"),
    "generator_sensitivity": sql("""SELECT stratum, concept_id, round(avg(e), 6) AS effect, count(*) AS prompts FROM (SELECT stratum, concept_id, prompt_group_id, avg(e) AS e FROM (
        SELECT stratum, a.concept_id, prompt_group_id, event_id, avg(a.score) - avg(b.score) AS e FROM gstrata g JOIN scores a ON a.i = w JOIN scores b ON b.i = l AND a.concept_id = b.concept_id GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"""),
    "activation_corr": sql("""SELECT x.concept_id, y.concept_id AS kept_id, round(corr(a.score, b.score), 6) AS correlation FROM frozen x JOIN frozen y ON x.side = y.side AND y.discovery_rank < x.discovery_rank
        JOIN scores a ON a.concept_id = x.concept_id JOIN scores b ON b.concept_id = y.concept_id AND a.i = b.i WHERE a.i IN (SELECT unnest([w, l]) FROM rc WHERE analysis_split = 'discovery') GROUP BY 1, 2"""),
    "diversity_filter": sql(
        "SELECT concept_id, side, discovery_rank, parent IS NULL AS retained, parent AS parent_concept_id FROM walk WHERE concept_id IS NOT NULL",
        """near AS (SELECT concept_id, list(kept_id) AS ids FROM (SELECT x.concept_id, y.concept_id AS kept_id, corr(a.score, b.score) AS r FROM frozen x JOIN frozen y ON x.side = y.side AND y.discovery_rank < x.discovery_rank
             JOIN scores a ON a.concept_id = x.concept_id JOIN scores b ON b.concept_id = y.concept_id AND a.i = b.i WHERE a.i IN (SELECT unnest([w, l]) FROM rc WHERE analysis_split = 'discovery') GROUP BY 1, 2) WHERE r >= 0.1 GROUP BY 1),
           listed AS (SELECT frozen.*, coalesce(ids, []::INT[]) AS ids FROM frozen LEFT JOIN near USING (concept_id)),
           walk(side, discovery_rank, kept, concept_id, parent) AS (SELECT DISTINCT side, 0::INT, []::INT[], NULL::INT, NULL::INT FROM frozen
             UNION ALL SELECT l.side, l.discovery_rank, CASE WHEN list_has_any(kept, ids) THEN kept ELSE list_append(kept, l.concept_id) END, l.concept_id, list_filter(kept, lambda k: list_contains(ids, k))[1]
             FROM walk w JOIN listed l ON l.side = w.side AND l.discovery_rank = w.discovery_rank + 1)""",
        True,
    ),
    "gallery_selection": sql(
        """SELECT concept_id, selection, place::INT AS place, prompt_group_id, event_id, preferred_image_id, rejected_image_id, round(d, 6) AS difference FROM (
        SELECT *, row_number() OVER (PARTITION BY concept_id, selection ORDER BY o, h) AS place FROM (
          SELECT *, row_number() OVER (PARTITION BY concept_id, selection, prompt_group_id ORDER BY o, h) AS r FROM kinds) WHERE r = 1) WHERE place <= 2""",
        """gp AS (SELECT f.concept_id, f.direction, prompt_group_id, event_id, 'ranked:' || w AS preferred_image_id, 'ranked:' || l AS rejected_image_id, round(a.score, 9) - round(b.score, 9) AS d,
             sha256('42:' || f.concept_id || ':' || event_id || ':ranked:' || w || ':ranked:' || l) AS h
             FROM rc, frozen f, scores a, scores b WHERE analysis_split = 'test' AND a.i = w AND b.i = l AND a.concept_id = f.concept_id AND b.concept_id = f.concept_id),
           kinds AS (SELECT *, 'supportive' AS selection, -direction * d AS o FROM gp WHERE direction * d > 0 UNION ALL SELECT *, 'counterexample', direction * d FROM gp WHERE direction * d < 0 UNION ALL SELECT *, 'random_audit', 0.0 FROM gp)""",
    ),
    "direction_agreement": sql("SELECT round(corr(rx, ry), 6) AS spearman, count(*) AS n, round(avg((sign(x) = sign(y))::INT), 6) AS direction_agreement FROM (SELECT l.effect AS x, r.effect AS y, rank() OVER (ORDER BY l.effect) + (count(*) OVER (PARTITION BY l.effect) - 1) / 2.0 AS rx, rank() OVER (ORDER BY r.effect) + (count(*) OVER (PARTITION BY r.effect) - 1) / 2.0 AS ry FROM lefteff l JOIN righteff r USING (concept_id))"),
    "topk_overlap": sql(
        "SELECT side, count(*) FILTER (n = 2) AS intersection, round(count(*) FILTER (n = 2) / count(*), 6) AS jaccard FROM (SELECT side, concept_id, count(*) AS n FROM (SELECT * FROM lk UNION ALL SELECT * FROM rk) GROUP BY 1, 2) GROUP BY 1",
        ", ".join(f"{a} AS (SELECT side, concept_id FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(effect) DESC, concept_id) AS r FROM (SELECT *, CASE WHEN effect > 0 THEN 'preferred' ELSE 'rejected' END AS side FROM {b} WHERE effect <> 0)) WHERE r <= 10)" for a, b in (("lk", "lefteff"), ("rk", "righteff"))),
    ),
    "transfer_exclusions": sql(
        "SELECT analysis_split, count(*) AS pairs, count(*) FILTER (component_id NOT IN (SELECT component_id FROM cc WHERE k IN (SELECT k FROM hit))) AS retained FROM cc GROUP BY 1",
        "hit AS (SELECT DISTINCT i // 4 AS k FROM rr WHERE i < 12 AND g IN (SELECT g FROM live WHERE analysis_split = 'discovery'))",
    ),
    "transfer_eval": sql(
        evaluated("kept"),
        "hit AS (SELECT DISTINCT i // 4 AS k FROM rr WHERE i < 12 AND g IN (SELECT g FROM live WHERE analysis_split = 'discovery')), kept AS (SELECT concept_id, prompt_group_id, component_id, avg(effect) AS effect, avg(ordering) AS ordering FROM cpv WHERE component_id NOT IN (SELECT component_id FROM cc WHERE k IN (SELECT k FROM hit)) GROUP BY ALL)",
    ),
    "duplicate_audit": sql("SELECT 0::BIGINT AS shared_prompts, count(DISTINCT i) AS shared_hashes FROM ci WHERE i < 12 AND k IN (SELECT k FROM ce)"),
    "replication_summary": sql("SELECT side, count(*) FILTER (direction * effect > 0) AS replicated, count(*) AS candidates FROM frozen JOIN (SELECT concept_id, round(avg(effect), 9) AS effect FROM pv WHERE analysis_split = 'test' GROUP BY 1) USING (concept_id) GROUP BY 1"),
}
