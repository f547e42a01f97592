"""The pipeline on a small planted corpus against the same stages written plainly."""

import random
import re

import numpy as np

import corpus_pipeline
from pyspark.sql import functions as F
from tessella.llm import mixing

from test_documents import brute_near, shingle_set, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item string, bands string, topic string, mix_weight string"
TOXIC = ("scumvile", "trashvile")


def corpus():
    """Documents (some rows twice), labels and benchmark items."""
    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(2000)] + ["nation", "painting", "station", "moving", "cable"] * 40
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [" ".join(text(r.randint(8, 40))) for _ in range(8)]
    texts = []
    for k in range(240):
        w = text(r.randint(25, 90))
        if k % 4 == 1:
            for _ in range(6):
                w.insert(r.randrange(len(w)), r.choice(TOXIC))
        if k % 12 == 2:
            w[10:10] = items[k % 8].split(" ")
        texts.append(" ".join(w))
    texts += [texts[k].replace(" ", "  ", 3) for k in range(0, 60, 3)]
    for k in range(0, 120, 5):
        w = texts[k].split(" ")
        w[-1] = f"e{k}"
        texts.append(" ".join(w))
    texts += [None, "", " \t"]
    rows = [(k, t, ("en", "de")[k % 7 > 3], f"s{k % 3}", len(t or ""), "x", "y", "z", "m") for k, t in enumerate(texts)]
    rows += [rows[k] for k in (3, 10, 20, 241)]
    labels = [(k, 1, int(k % 4 == 1)) for k in range(200)]
    return rows, labels, list(enumerate(items))


def plain(rows, items):
    """Rows left before mixing."""
    rows = [x for x in rows if not set(words(x[1])) & set(TOXIC)]
    keep = {}
    for k, t, *_ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep[norm] = min(keep.get(norm, (1, 0)), (-len(t or ""), k))
    first = {}
    for x in rows:  # of a text one row stays, of repeated rows too
        norm = re.sub(r"[\x20\x09-\x0D]", "", x[1] or "")
        if keep[norm][1] == x[0]:
            first.setdefault(norm, x)
    rows = list(first.values())
    one = sorted({x[0]: x[1] for x in rows}.items())
    near = brute_near([t for _, t in one])
    gone = {one[k][0] for k, (_, c) in near.items() if c != k}
    rows = [x for x in rows if x[0] not in gone]
    sets = [shingle_set(t) for _, t in items]
    return [x for x in rows if not any(4 * len(q & shingle_set(x[1])) >= 3 * len(q) for q in sets)]


def plain_rates(rows):
    """Probability and weight of each row with tokens, by raking in NumPy."""
    def topic(t):
        counts = [t.count(m) for m in mixing.TOPIC_MARKERS]
        return mixing.TOPIC_MARKERS[int(np.argmax(counts))] if max(counts) else "none"

    cell_of = [(x[3], x[2], topic(x[1])) if words(x[1]) else None for x in rows]
    names = sorted({c for c in cell_of if c})
    tokens = np.zeros(len(names))
    for x, c in zip(rows, cell_of, strict=True):
        if c:
            tokens[names.index(c)] += len(words(x[1]))
    part, w = tokens**mixing.TEMPER, tokens / tokens.sum()
    codes = [np.unique([n[d] for n in names], return_inverse=True)[1] for d in range(3)]
    for _ in range(3000):
        for c in codes:
            w = w * (np.bincount(c, part) / part.sum() / np.bincount(c, w))[c]
    rate = w * tokens.sum() / tokens
    share = rate / rate[tokens >= mixing.MIN_CELL_SHARE * tokens.sum()].max()
    return [(min(1.0, share[names.index(c)]), max(1.0, share[names.index(c)])) if c else (1.0, 1.0) for c in cell_of]


def test_pipeline(spark, tmp_path):
    rows, labels, items = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = plain(rows, items)
    draw = {r.id: r.u for r in spark.range(len(rows)).select("id", mixing.uniform(F.col("id")).alias("u")).collect()}
    want = sorted((x[:8] + pw for x, pw in zip(left, plain_rates(left), strict=True) if not words(x[1]) or draw[x[0]] < pw[0]), key=lambda x: x[0])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "item", "bands", "topic", "mix_probability", "mix_weight"]
    got = sorted((tuple(x) for x in got.collect()), key=lambda x: x[0])
    assert [x[:8] for x in got] == [x[:8] for x in want] and len({x[0] for x in got}) == len(got) < len(left) < len(rows) - 100
    assert np.allclose([x[8:] for x in got], [x[8:] for x in want], atol=1e-4)
