"""Operators on documents against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessella.llm import components, decontaminate, exact_dedup, mixing, near_dedup, repeat_dedup, tokens, toxicity
from tessella.llm.workspace import Workspace

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item string, bands string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def table(spark, texts):
    """Texts as documents from id 0, with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or ""), "x", "y") for k, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty texts, ties, repeats, near copies, long texts."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeñé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 120))) for _ in range(40)]
    texts = [None, "", " \t\n", "A b", "a B", "a b", *base]
    for b in base[:20]:
        w = b.split(" ")
        for _ in range(4):
            v = list(w)
            for _ in range(r.randint(0, max(1, len(v) // 12))):
                v[r.randrange(len(v))] = r.choice(vocabulary)
            texts.append(" ".join(v))
    texts += [base[3], base[3] + " ", base[4].upper(), " ".join(r.choice(vocabulary) for _ in range(30_000)), "x" * 9000]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    texts += [base[k] + "\n" + passage + " " + base[k + 1] for k in range(10)]
    return texts


def brute_near(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 4 * len(a) >= 3 * len(b) and 4 * len(b) >= 3 * len(a):
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in range(len(texts))}


def test_near_duplicates(spark, odd):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(spark, odd)).collect()}
    assert got == brute_near(odd)


def test_near_duplicates_of_a_crowded_group(spark):
    """Edits of one text, many too far from it but linked among themselves."""
    r = random.Random(1)
    base = [f"w{r.randrange(5000)}" for _ in range(90)]
    texts = []
    for k in range(160):
        w = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 4, 5))):
            w[r.randrange(90)] = f"e{r.randrange(40)}"
        texts.append(" ".join(w))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(table(spark, texts)).collect()}
    assert got == brute_near(texts)


SMALL_SETS = ((4, 3), (8, 6), (12, 9))


def test_signatures_of_small_sets():
    """Pairs at the threshold pass both estimate filters, but for about 3e-5 of them."""
    r = np.random.default_rng(1)
    for m, n in SMALL_SETS:
        for factors, least in ((near_dedup._FACTORS, near_dedup.LEAST_MATCH), (near_dedup._FINE_FACTORS, near_dedup.LEAST_FINE)):
            lost = 0
            for _ in range(500):
                x = r.integers(0, 1 << 32, m, dtype=np.uint32)
                a, b = (near_dedup._pack(near_dedup.tc.minima(u, factors)) for u in (x, x[:n]))
                z = a ^ b
                lost += len(factors) - int(np.bitwise_count((z | (z >> np.uint64(1))) & np.uint64(near_dedup._LANES)).sum()) < least
            assert lost <= 1


@pytest.mark.parametrize("crowded", [False, True])
def test_near_duplicates_of_small_sets(spark, crowded):
    """A text and its beginning, similar to 0.75; in crowded buckets with its end, too."""
    r = random.Random(6)
    texts = []
    for m, n in SMALL_SETS:
        for _ in range(60):
            w = [f"w{r.randrange(10**6)}" for _ in range(m + 4)]
            texts += [" ".join(w), " ".join(w[: n + 4])] + [" ".join(w[m - n :])] * crowded
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(table(spark, texts)).collect()}
    assert got == brute_near(texts)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0
    assert [tuple(x) for x in near_dedup.near_duplicates(table(spark, [None])).collect()] == [(0, 0, 0, True)]


def test_rows_without_an_id(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(None, long), (3, long), (2, long + " end"), (None, "other"), (5, ""), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert near == sorted([(None, None, True)] * 3 + [(3, 2, False), (2, 2, True), (5, 5, True)], key=str)
    exact = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(df).collect()), key=str)
    assert exact == sorted([(None, 3, 2, False), (3, 3, 2, True), (2, 2, 1, True), (None, None, 1, True), (5, 5, 2, True), (None, 5, 2, False)], key=str)


def test_near_duplicates_of_one_id(spark):
    """Of different texts under one id the one of least hash is linked; clashing columns do nothing."""
    w = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(w)), (1, " ".join(w)), (2, " ".join(w[:-1])), (5, " ".join(w[1:])), (5, "some other words that have nothing in common"), (7, "some other words that have nothing in common")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit("x"), "first": F.lit(1), "label": F.lit(2)})
    h = dict(df.where("doc_id = 5").select("text", F.xxhash64("text")).collect())
    linked = min(h, key=h.get) == rows[3][1]
    got = sorted((x.doc_id, x.component_id) for x in near_dedup.near_duplicates(df.repartition(3)).collect())
    assert got == sorted([(1, 1), (1, 1), (2, 1), (5, 1 if linked else 5), (5, 5), (7, 7 if linked else 5)])


@pytest.mark.parametrize("block", [4, 64])
def test_crowded_buckets(spark, monkeypatch, block):
    """Clusters that share most bands, so that buckets hold several components of several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    r = random.Random(21)
    common = [f"c{k}" for k in range(70)]
    texts = []
    for c in range(6):
        own = common + [f"o{c}x{k}" for k in range(28 if c % 2 else 45)]
        for _ in range(25):
            w = list(own)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
            texts.append(" ".join(w))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(table(spark, texts)).collect()}
    assert got == brute_near(texts)


def test_components_both_ways(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(260)] + [(k, k + 1) for k in range(400, 460)]
    df = spark.createDataFrame(edges, "a long, b long").where("a <> b")
    ws = Workspace(spark, "test")
    one = {tuple(x) for x in components.connected_components(df, ws, "one").collect()}
    far = {tuple(x) for x in components.connected_components(df, ws, "far", local_edges=0).collect()}
    assert one == far and len(one) == len({n for n, _ in one})
    ws.close()


def test_exact_duplicates(spark, odd):
    texts = [*odd, odd[6] + "  ", odd[6]]
    groups = {}
    for k, t in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(k)
    want = {}
    for norm, ids in groups.items():
        keep = min(ids, key=lambda k: (-len(texts[k] or ""), k))
        for k in ids:
            want[k] = (keep, len(ids), k == keep, hashlib.sha256(norm.encode()).hexdigest())
    got = exact_dedup.exact_duplicates(table(spark, texts), capacity=4).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0


def test_exact_duplicates_chain_collisions(spark, odd, tmp_path):
    """With a hash of eight values most texts share one; chains tell them apart by their bytes."""
    weak = lambda c: F.xxhash64(c).bitwiseAND(-(1 << 61))
    texts = [f"text {k % 50}" for k in range(140)] + odd
    df = table(spark, texts).repartition(3).withColumn("h", F.lit("x")).withColumn("norm", F.lit(1))
    one = sorted(map(tuple, exact_dedup.exact_duplicates(df).collect()))
    assert sorted(map(tuple, exact_dedup.exact_duplicates(df, capacity=4, hash_of=weak).collect())) == one
    ws = Workspace(spark, "chains")
    keyed = df.select("doc_id", weak(exact_dedup.normalised(F.col("text"))).alias("h"), F.sha2(exact_dedup.normalised(F.col("text")), 256).alias("text_sha256"))
    index = exact_dedup.build_index(df.select("doc_id", "text"), keyed, ws, 4, 3, weak).collect()
    chains = {}
    for x in index:
        chains.setdefault(x.h, []).append(x.chain)
    assert len(chains) <= 8 and all(sorted(c) == list(range(len(c))) for c in chains.values()) and max(map(len, chains.values())) > 5
    ws.close()


def test_index_files_hold_key_ranges(spark):
    """Each index file has whole buckets, each owner one range of keys, each bucket a bounded load."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 2500).cast("string")).alias("text"))
    ws = Workspace(spark, "ranges")
    keyed = df.select("doc_id", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("text_sha256"))
    index = exact_dedup.build_index(df, keyed, ws, 20, 8).withColumn("file", F.input_file_name()).collect()
    assert sum(x.group_size for x in index) == 3000 and len(index) == 2500
    files, buckets, spans = {}, {}, {}
    for x in index:
        files.setdefault(x.owner, set()).add(x.file)
        buckets.setdefault(x.bucket, []).append(x)
        spans.setdefault(x.owner, []).append(x.h % (1 << 64))
    assert len(spans) == 8 and all(len(f) == 1 for f in files.values())
    assert max(map(len, buckets.values())) <= 20 and len(buckets) > 125
    ranges = sorted((min(s), max(s)) for s in spans.values())
    assert all(a[1] < b[0] for a, b in zip(ranges[:-1], ranges[1:], strict=True))
    ws.close()


def test_deduplicated_rows(spark, monkeypatch):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (1, "a  b", "y"), (2, "ab", "z"), (None, "c", "n"), (None, "c", "m"), (4, None, "e"), (3, " ", "f"), (9, "alone", "g"), (5, "d", "p"), (None, "d", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    want = sorted([(1, "a  b", "y"), (3, " ", "f"), (9, "alone", "g"), (5, "d", "p")], key=str)
    for limit in (exact_dedup.MAX_BROADCAST_ROWS, 0):
        monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_ROWS", limit)
        got = sorted(map(tuple, exact_dedup.deduplicated(df).collect()), key=str)
        assert [x for x in got if x[1] != "c"] == want and [x[:2] for x in got if x[1] == "c"] == [(None, "c")]
        assert sorted(x.kept for x in exact_dedup.exact_duplicates(df).collect()).count(True) == 8
    assert exact_dedup.deduplicated(df.limit(0)).columns == df.columns


def test_directory_splits_overfull_buckets(spark):
    entries = spark.range(5000).selectExpr("xxhash64(id) as h")
    slots, depth = exact_dedup.directory(entries, 100)
    rows = slots.collect()
    assert sorted(r.slot for r in rows) == list(range(1 << depth))
    load = {}
    for r in entries.collect():
        slot = (r.h % (1 << 64)) >> (64 - depth)
        load.setdefault(next(x.bucket for x in rows if x.slot == slot), []).append(r.h)
    assert max(map(len, load.values())) <= 100 and len(load) > 50


def brute_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    seen, out = {}, {}
    for k, b in enumerate(raw):
        for i in range(len(b) - 49):
            seen.setdefault(b[i : i + 50], k)
    for k, b in enumerate(raw):
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if seen[b[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[k] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("max_pieces", [repeat_dedup.MAX_PIECES, 2])
def test_repeats(spark, odd, max_pieces):
    texts = [*odd, "ab" * 300, "ba" * 200, "x" * 50, "x" * 49]
    got = repeat_dedup.remove_repeats(table(spark, texts).repartition(5), max_pieces=max_pieces).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(texts)
    assert repeat_dedup.remove_repeats(table(spark, [])).count() == 0


def test_repeats_do_not_trust_hashes(spark, odd, monkeypatch):
    """With an 8-bit content hash most claims are wrong; comparing bytes leaves only true ones."""
    whole = repeat_dedup.anchored_runs

    def weak(*args, **kw):
        s, e, anchor, content = whole(*args, **kw)
        return s, e, anchor & np.uint64(0xFFFFFF), np.full(len(content), 5, np.uint64)

    monkeypatch.setattr(repeat_dedup, "anchored_runs", weak)
    r = random.Random(5)
    base = ["".join(r.choice("abcd ") for _ in range(90)) for _ in range(6)]
    texts = [base[k % 6][: 60 + k] + "".join(r.choice("xyz") for _ in range(30)) for k in range(24)]
    raw = [t.encode() for t in texts]
    for x in repeat_dedup.remove_repeats(table(spark, texts).repartition(3)).collect():
        k = x.doc_id
        gone = bytearray(len(raw[k]))
        for i in range(len(raw[k]) - 49):
            if any(raw[k][i : i + 50] in raw[j] for j in range(k)):
                gone[i : i + 50] = b"\1" * 50
        assert x.n_removed <= sum(gone)


def test_joined_claims():
    a = [np.array(v) for v in ([2, 1, 1, 1, 1, 1], [0, 30, 0, 10, 200, 5], [50, 60, 50, 70, 50, 50], [1, 0, 0, 0, 0, 0], [9, 130, 100, 110, 300, 7])]
    got = [tuple(x) for x in zip(*(v.tolist() for v in repeat_dedup.joined_claims(*a)), strict=True)]
    assert sorted(got) == [(1, 0, 90, 0, 100), (1, 5, 50, 0, 7), (1, 200, 50, 0, 300), (2, 0, 50, 1, 9)]


def test_repeats_of_repeated_rows(spark, monkeypatch):
    long = "".join(chr(97 + k * 7 % 26) for k in range(97)) * 2
    rows = [(5, long), (5, long), (3, long[10:150]), (7, "other text of some length " * 4), (7, long), (None, long), (8, None), (9, long[20:80])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("x")).withColumn("pos", F.lit(1))
    for limit in (repeat_dedup.MAX_BROADCAST_ROWS, 0):
        monkeypatch.setattr(repeat_dedup, "MAX_BROADCAST_ROWS", limit)
        got = repeat_dedup.remove_repeats(df.repartition(4)).collect()
        assert len(got) == len(rows)
        main = [x for x in got if x.doc_id in (3, 5, 8, 9)]
        one = {3: long[10:150], 5: long, 8: "", 9: long[20:80]}
        h = dict(df.where("doc_id = 7").select("text", F.xxhash64("text")).collect())
        one[7] = min(h, key=h.get)
        ids = sorted(one)
        want = brute_repeats([one[k] for k in ids])
        for x in main:
            assert tuple(x[1:]) == want[ids.index(x.doc_id)]
        assert sorted(x.n_removed for x in got if x.doc_id == 7) == sorted([0, want[ids.index(7)][1]])
        assert [x.n_removed for x in got if x.doc_id is None] == [0]


def test_collection_bwt():
    r = random.Random(3)
    for alphabet in ("ab", "abcdefgh"):
        strings = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))).encode() for _ in range(60)] + [b"aaaa", b"aaaa"]
        size = np.array([len(s) for s in strings])
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        owner, length, bwt, lcp = repeat_dedup.collection_bwt(np.frombuffer(b"".join(strings), np.uint8), begin, size, 6)
        want = sorted((s[i:], k, len(s) - i) for k, s in enumerate(strings) for i in range(len(s) + 1))
        # suffixes that equal another are in the order of their strings' marks
        assert [(s, k, n) for s, k, n in want] == [(strings[o][len(strings[o]) - n :], o, n) for o, n in zip(owner.tolist(), length.tolist(), strict=True)]
        for x in range(len(want)):
            s, k, n = want[x]
            assert bwt[x] == (strings[k][len(strings[k]) - n - 1] if n < len(strings[k]) else -1)
            if x and s:
                t = want[x - 1][0]
                common = next((i for i in range(min(len(s), len(t))) if s[i] != t[i]), min(len(s), len(t)))
                assert lcp[x] == min(6, common)


def test_benchmark_hits(spark, odd):
    r = random.Random(9)
    source = max((words(t) for t in odd), key=len)
    items = [None, "", "lone", " ".join(source[100:130]), " ".join(source[5000:5009]), " ".join(source[7000:7005]), " ".join(source[20:23]), "never seen words in any of these"]
    for _ in range(12):
        n = r.randint(6, 90)
        at = r.randrange(20_000)
        w = list(source[at : at + n])
        for _ in range(r.randint(0, 2)):
            w[r.randrange(n)] = "zzz"
        items.append(" ".join(w))
    docs = [*odd, "Lone lone wolf", " ".join(source[99:140])]
    want = set()
    for i, item in enumerate(items):
        w = words(item)
        for k, t in enumerate(docs):
            d = words(t)
            if not w:
                continue
            if len(w) < 5:
                if any(d[a : a + len(w)] == w for a in range(len(d) - len(w) + 1)):
                    want.add((k, i, 1, 1))
            elif len(d) >= 5:
                q = shingle_set(item)
                n = len(q & shingle_set(t))
                if 100 * n >= 75 * len(q):
                    want.add((k, i, len(q), n))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.benchmark_hits(table(spark, docs), bench).collect()
    assert {(x.doc_id, x.item_id, x.n_item, x.n_shared) for x in got} == want and len(want) > 10
    dirty = {k for k, *_ in want}
    clean = decontaminate.clean_documents(table(spark, docs), bench)
    assert clean.columns == table(spark, docs).columns
    assert {x.doc_id for x in clean.collect()} == set(range(len(docs))) - dirty
    assert decontaminate.benchmark_hits(table(spark, docs), bench.limit(0)).count() == 0
    assert decontaminate.benchmark_hits(table(spark, []), bench).count() == 0


def test_benchmark_in_blocks(spark, odd, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {tuple(x) for x in decontaminate.benchmark_hits(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2500)
    assert {tuple(x) for x in decontaminate.benchmark_hits(docs, bench).collect()} == whole


def test_benchmark_items_that_repeat_themselves(spark):
    """Items of 64 positions over 5 shingles, held as one cycle or whole, are found once each."""
    r = random.Random(8)
    items, docs, want = [], [], []
    for i in range(10):
        cycle = [f"c{i}x{k}" for k in range(5)]
        items.append(" ".join((cycle * 14)[:68]))
        for k in range(30):
            w = [f"w{r.randrange(10**6)}" for _ in range(400)]
            at = r.randrange(400)
            w[at:at] = (cycle * 14)[: 9 if k else 68]
            want.append((len(docs), i, 5, 5))
            docs.append(" ".join(w))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.benchmark_hits(table(spark, docs), bench).collect()
    assert sorted((x.doc_id, x.item_id, x.n_item, x.n_shared) for x in got) == want


def naive_pieces(word, pieces, inner):
    n, at, vocabulary = 0, 0, pieces
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in vocabulary:
                break
        else:
            return -1
        n, at, vocabulary = n + 1, end, inner
    return n


@pytest.mark.parametrize("split", [False, True])
def test_automaton(split):
    r = random.Random(4)
    make = lambda: {bytes(r.choice(b"abc") for _ in range(r.randint(1, 6))) for _ in range(25)}
    for _ in range(20):
        pieces, inner = make(), make()
        machine = tokens.Automaton(pieces, inner if split else None)
        for _ in range(200):
            w = bytes(r.choice(b"abcd"[: r.choice((3, 3, 4))]) for _ in range(r.randint(1, 14)))
            assert machine.count(w) == naive_pieces(w, pieces, inner if split else pieces)


def marked_pieces(word, plain, final):
    """Longest match where pieces of final end the word and those of plain do not."""
    n, at = 0, 0
    while at < len(word):
        fits = [e for e in range(at + 1, len(word) + 1) if word[at:e] in (final if e == len(word) else plain)]
        if not fits:
            return -1
        n, at = n + 1, fits[-1]
    return n


def test_marked_automaton():
    r = random.Random(5)
    make = lambda: {bytes(r.choice(b"abc") for _ in range(r.randint(1, 5))) for _ in range(25)}
    for _ in range(20):
        plain, final = make(), make()
        machine = tokens.Automaton(plain, None, final)
        for _ in range(200):
            w = bytes(r.choice(b"abcd"[: r.choice((3, 3, 4))]) for _ in range(r.randint(1, 14)))
            assert machine.count(w) == marked_pieces(w, plain, final)


def test_token_counts(spark, odd, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    plain, inner, final = tokens.load_pieces()
    rows = table(spark, odd).withColumn("n_tokens", F.lit("x")).unionByName(spark.createDataFrame([(None, "two words", "y")], "doc_id long, text string, n_tokens string"), allowMissingColumns=True)
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in tokens.token_counts(rows, tokens.Automaton(plain, inner, final)).collect()}
    cache = {}
    for k, t in enumerate(odd):
        w = words(t)
        for x in w:
            if x not in cache:
                cache[x] = marked_pieces(x.encode(), plain, final)
        assert got[k] == (len(w), sum(cache[x] for x in w), 0)
    assert got[None] == (2, 2, 0) and tokens.token_counts(rows.limit(0), tokens.Automaton(plain, inner, final)).count() == 0


def test_toxicity(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    hit = rows.predicted == rows.toxic
    assert hit.mean() > 0.975
    assert rows[rows.toxic == 1].predicted.mean() > 0.85 and rows[rows.toxic == 0].predicted.mean() < 0.02


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(1, 0, 1), (7, 1, 0), (8, 1, None), (9, 0, 3), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_scores(table(spark, odd), labels).collect()
    assert len(rows) == len(odd) and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.toxicity_scores(table(spark, odd), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.toxicity_scores(table(spark, []), labels).count() == 0


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).toPandas()
    assert len(rows) == docs.count()
    count = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    assert dict(zip(rows.doc_id, rows.n_tokens, strict=True)) == count
    rows = rows[rows.n_tokens > 0]
    rows["mass"] = rows.n_tokens * rows.probability * rows.weight
    cells = rows.groupby(list(mixing.DIMENSIONS)).n_tokens.sum() ** mixing.TEMPER
    for d in mixing.DIMENSIONS:
        own = cells.groupby(level=d).sum()
        got = rows.groupby(d).mass.sum() / rows.mass.sum()
        assert np.allclose(got, own / own.sum(), atol=1e-6)
    assert rows.probability.between(0, 1).all() and (rows.weight >= 1).all()


def test_mixing_edges(spark, odd):
    rows = mixing.mix(table(spark, odd)).collect()
    assert len(rows) == len(odd)
    assert all(r.sampled for r in rows if r.n_tokens == 0)
    assert mixing.mix(table(spark, [])).count() == 0


def test_mixed_documents_follow_the_verdicts(spark, odd):
    """The sampled documents are those that the verdicts name; a clashing column is replaced."""
    df = table(spark, odd).withColumnRenamed("item", "mix_weight").withColumnRenamed("bands", "topic")
    want = {r.doc_id: (r.probability, r.weight) for r in mixing.mix(df).collect() if r.sampled}
    got = mixing.mixed_documents(df)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "topic", "mix_probability", "mix_weight"]
    rows = got.collect()
    assert {r.doc_id: (r.mix_probability, r.mix_weight) for r in rows} == want and len(rows) == len(want)
    assert {r.doc_id: r.text for r in rows} == {k: t for k, t in enumerate(odd) if k in want}
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_raking_ends_at_its_targets(spark, monkeypatch):
    """Nearly separable cells take over 60 rounds; targets that cannot be met are an error."""
    cells = spark.createDataFrame([("s", "a", "x", 1000), ("s", "a", "y", 1), ("s", "b", "x", 1), ("s", "b", "y", 1000)], "source string, lang string, topic string, tokens long")
    want = {"lang": {"a": 0.5, "b": 0.5}, "topic": {"x": 0.53, "y": 0.47}}
    targets = {d: spark.createDataFrame(list(t.items()), f"{d} string, target double") for d, t in want.items()}
    ws = Workspace(spark, "test")
    rows = mixing.rake(cells, targets, ws).toPandas()
    for d, t in want.items():
        got = rows.groupby(d).w.sum()
        assert all(abs(got[k] - v) < 1e-6 for k, v in t.items())
    monkeypatch.setattr(mixing, "MAX_ROUNDS", 12)
    with pytest.raises(ValueError, match="missed"):
        mixing.rake(cells.where("lang = 'a'"), targets, ws)
    ws.close()


@pytest.mark.parametrize("limit", [mixing.MAX_SMALL_CELLS, 0])
def test_raking_equals_plain_fitting(spark, monkeypatch, limit):
    """Both ways of raking against NumPy."""
    monkeypatch.setattr(mixing, "MAX_SMALL_CELLS", limit)
    r = np.random.default_rng(3)
    tokens_ = r.integers(50, 90, (3, 2, 3)).astype(float)
    targets = [np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4]), np.array([0.2, 0.5, 0.3])]
    w = tokens_ / tokens_.sum()
    for _ in range(200):
        for d, t in enumerate(targets):
            axes = tuple(k for k in range(3) if k != d)
            w = w * np.expand_dims(t / w.sum(axis=axes), axes)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", int(tokens_[i, j, k])) for i in range(3) for j in range(2) for k in range(3)], "source string, lang string, topic string, tokens long")
    tables = {d: spark.createDataFrame([(f"{d[0]}{k}", float(x)) for k, x in enumerate(t)], f"{d} string, target double") for d, t in zip(mixing.DIMENSIONS, targets, strict=True)}
    ws = Workspace(spark, "plain")
    for x in mixing.rake(cells, tables, ws).collect():
        assert abs(x.w - w[int(x.source[1]), int(x.lang[1]), int(x.topic[1])]) < 1e-6
    own = mixing.rake(cells.limit(5), None, ws).collect()
    assert abs(sum(x.w for x in own) - 1) < 1e-9
    ws.close()
