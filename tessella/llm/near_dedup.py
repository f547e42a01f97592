"""Near-duplicate documents by b-bit MinHash.

Each distinct shingle set gets 512 MinHash minima.  The first 128 form 32 bands of 4 rows,
which generate candidates; of all 512 only 2 bits of a mixed hash are kept, packed into 16
longs (the low bits of the minima themselves follow from those of the shingles, so in small
sets they agree by chance far more or less often than 1 in 4), and the similarity of a candidate is estimated from bit counts with the usual correction
for chance collisions, ``(match - 1/4) / (3/4)``.  Candidates whose estimate is within four
standard deviations of the threshold or above it are confirmed on their full shingle sets.

No group is ever expanded into all its pairs:

1. documents with equal shingle sets collapse to one representative;
2. in each band bucket every member is compared with one hub, chosen by hash, so a bucket
   of n members costs n comparisons; confirmed links are joined into components;
3. only buckets that still hold several components are looked at again.  Their members are
   cut into blocks, the m of them outside the bucket's largest component apart from the n
   inside, and block pairs are spread over tasks; pairs of two blocks inside it are never
   formed, so a bucket costs (n + m) * m / BLOCK rows, and nothing once all are linked.  Just
   the pairs of *different* components with a high enough estimate leave the task, each from
   the first band the two documents share.  For these, longer signatures of 2048 minima leave few pairs under the
   threshold.  They are confirmed the same way and the components are joined again.

A pair of similarity 0.75 shares no band with probability (1 - 0.75**4)**32 = 5e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .components import connected_components
from .workspace import Workspace

BANDS, ROWS, SIGNATURE = 32, 4, 512
THRESHOLD_NUM, THRESHOLD_DEN = 75, 100
#: 0.75 less four standard deviations of the estimate from 512 two-bit minima.
LEAST_ESTIMATE = 0.655
LEAST_MATCH = int(SIGNATURE * (0.25 + 0.75 * LEAST_ESTIMATE))
#: The same for the 2048 minima that decide which pairs of a crowded bucket are confirmed.
FINE, LEAST_FINE = 2048, int(2048 * (0.25 + 0.75 * 0.704))
BLOCK = 512
_FACTORS = tc.multipliers(SIGNATURE)
_FINE_FACTORS = tc.multipliers(FINE, 78)
_BAND_SEED = tc.splitmix(BANDS, 91)
_ROW_MUL = tc.splitmix(ROWS, 92) | np.uint64(1)
_LANES = 0x5555555555555555


def _pack(low: np.ndarray) -> np.ndarray:
    """Two bits of each minimum's hash, 32 of them in a long."""
    x = (tc.mix64(low.astype(np.uint64)) >> np.uint64(62)).reshape(-1, 32)
    return np.bitwise_or.reduce(x << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=1)


def _sketches(id_col: str, text_col: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(id_col)
            for ch in tc.chunks(batch.column(text_col), 1 << 18):
                s, e, first = ch.words()
                h, at = tc.shingles(ch.word_hashes(s, e), first, n)
                size = np.zeros(len(ch), np.int64)
                bands = np.zeros((len(ch), BANDS), np.uint64)
                packed = np.zeros((len(ch), SIGNATURE // 32), np.uint64)
                digest: list[bytes | None] = [None] * len(ch)
                for d in range(len(ch)):
                    u = np.unique(h[at[d] : at[d + 1]])
                    size[d] = len(u)
                    if not len(u):
                        continue
                    digest[d] = hashlib.blake2b(u.tobytes(), digest_size=16).digest()
                    low = tc.minima((u >> np.uint64(32)).astype(np.uint32), _FACTORS)
                    packed[d] = _pack(low)
                    rows = low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
                    bands[d] = tc.mix64((tc.mix64(rows + _BAND_SEED[:, None]) * _ROW_MUL).sum(axis=1, dtype=np.uint64))
                k = len(ch)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(ch.first, k),
                        pa.array(size),
                        pa.array(digest, type=pa.binary()),
                        tc.list_array(bands.view(np.int64).ravel(), np.full(k, BANDS), pa.int64()),
                        tc.list_array(packed.view(np.int64).ravel(), np.full(k, SIGNATURE // 32), pa.int64()),
                        batch.column("h").slice(ch.first, k),
                    ],
                    names=["doc_id", "n_shingles", "fp", "bands", "sig", "h"],
                )

    return run


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """(doc_id, shingles): the distinct n-word shingle hashes of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(id_col)
            for ch in tc.chunks(batch.column(text_col)):
                s, e, first = ch.words()
                h, at = tc.shingles(ch.word_hashes(s, e), first, n)
                sets = [np.unique(h[at[d] : at[d + 1]]) for d in range(len(ch))]
                sizes = np.array([len(u) for u in sets])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(ch.first, len(ch)), tc.list_array(flat, sizes, pa.int64())], names=["doc_id", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, shingles array<bigint>")


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Longer signatures of shingle sets."""
    for batch in batches:
        column = batch.column("shingles")
        flat, at = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        packed = np.zeros((batch.num_rows, FINE // 32), np.uint64)
        for d in range(batch.num_rows):
            packed[d] = _pack(tc.minima((flat[at[d] : at[d + 1]] >> np.uint64(32)).astype(np.uint32), _FINE_FACTORS, 64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), tc.list_array(packed.view(np.int64).ravel(), np.full(batch.num_rows, FINE // 32), pa.int64())], names=["doc_id", "sig"])


def _matches(a: str, b: str):
    """Number of equal two-bit minima of two packed signatures."""
    lane = F.lit(_LANES).cast("bigint")

    def differing(x, y):
        z = x.bitwiseXOR(y)
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(lane))

    return F.lit(SIGNATURE) - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, x: acc + x)


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - F.col("both")
    return pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), "sa", "sb").where(THRESHOLD_DEN * F.col("both") >= THRESHOLD_NUM * union).select("a", "b")


def _residual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, bi, bj): pairs of different components that may be similar."""
    lane = np.uint64(_LANES)

    def solve(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids, label, band, own = rows["doc_id"], rows["label"], int(rows["band"][0]), rows["block"]
        bi, bj = rows["bi"][0], rows["bj"][0]
        order = np.argsort(ids, kind="stable")
        ids, label, own, sig, bands = ids[order], label[order], own[order], rows["sig"][order], rows["bands"][order]
        left = np.flatnonzero(own == bi)
        right = np.flatnonzero(own == bj)
        out_a, out_b = [], []
        for i in left:
            j = right[right > i] if bi == bj else right
            j = j[label[j] != label[i]]
            if not len(j):
                continue
            z = sig[j] ^ sig[i]
            z = (z | (z >> np.uint64(1))) & lane
            j = j[FINE - np.bitwise_count(z).sum(axis=1, dtype=np.int64) >= LEAST_FINE]
            if band and len(j):
                j = j[~(bands[j, :band] == bands[i, :band]).any(axis=1)]
            if len(j):
                out_a.append(np.minimum(ids[i], ids[j]))
                out_b.append(np.maximum(ids[i], ids[j]))
        if not out_a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_a), np.concatenate(out_b)

    def groups():
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "band", "bi", "bj", "block", "doc_id", "label")}
            for c, width in (("sig", FINE // 32), ("bands", BANDS)):
                cols[c] = batch.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, width)
            if held is not None:
                cols = {c: np.concatenate((held[c], v)) for c, v in cols.items()}
            change = np.flatnonzero((cols["key"][1:] != cols["key"][:-1]) | (cols["bi"][1:] != cols["bi"][:-1]) | (cols["bj"][1:] != cols["bj"][:-1])) + 1
            cuts = np.concatenate(([0], change))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield {c: v[a:b] for c, v in cols.items()}
            held = {c: v[cuts[-1] :] for c, v in cols.items()}
        if held is not None:
            yield held

    for g in groups():
        if len(g["doc_id"]) > 1:
            a, b = solve(g)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Null and empty texts, and texts of white space only, have no shingles and stand alone.
    A text of fewer than ``shingle`` words has its whole sequence as its one shingle.
    A row without an id is linked with nothing and stays.
    Repeated rows of a doc_id are returned as often as they come, with the same verdict; of
    different texts under one doc_id the one of least hash is linked, the others with nothing.
    Ids must be integers; extra columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "near_dedup")
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    schema = "doc_id bigint, n_shingles bigint, fp binary, bands array<bigint>, sig array<bigint>, h bigint"
    sketch = ws.write(docs.mapInArrow(_sketches("doc_id", "text", shingle), schema), "sketch")
    several = ws.write(sketch.groupBy("doc_id").agg(F.min("h").alias("first"), F.max("h").alias("last")).where("first < last and doc_id is not null").select("doc_id", "first"), "several")
    odd = several.limit(1).count() > 0

    def linked() -> Column:
        """Whether a row takes part: it has an id, and the least hash of the id's texts."""
        return F.col("doc_id").isNotNull() & (F.coalesce(F.col("first") == F.col("h"), F.lit(True)) if odd else F.lit(True))

    def with_first(rows: DataFrame) -> DataFrame:
        return rows.join(several, "doc_id", "left") if odd else rows

    some = with_first(sketch).where((F.col("n_shingles") > 0) & linked())
    reps = ws.write(some.groupBy("fp").agg(F.min(F.struct("doc_id", "bands", "sig")).alias("r")).select("fp", "r.*"), "reps")

    rows = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    order = F.xxhash64("key", "doc_id")
    hubs = ws.write(rows.groupBy("key").agg(F.count("*").alias("n"), F.min_by("doc_id", order).alias("hub")).where("n > 1"), "hubs")
    members = ws.write(rows.join(hubs, "key"), "members")

    ids = members.select("doc_id").distinct()
    asked = with_first(docs.join(ids, "doc_id", "left_semi")).where(linked())
    sets = ws.write(shingle_sets(asked.groupBy("doc_id").agg(F.min("text").alias("text")), n=shingle), "sets")
    sigs = reps.select("doc_id", "sig")
    star = members.where("doc_id <> hub").select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()
    star = star.join(sigs.withColumnsRenamed({"doc_id": "a", "sig": "ga"}), "a").join(sigs.withColumnsRenamed({"doc_id": "b", "sig": "gb"}), "b")
    star = star.where(_matches("ga", "gb") >= LEAST_MATCH).select("a", "b")
    edges = ws.write(confirm(star, sets), "edges")
    first = ws.write(connected_components(edges, ws, "c1"), "labels1")

    labelled = members.join(first.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").select("key", "band", "n", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    labelled = ws.write(labelled, "labelled")
    open_keys = ws.write(labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("n").alias("size")).where("lo < hi and size > 2").select("key"), "open")
    # of each such bucket the largest component apart from the others
    sizes = labelled.join(open_keys, "key", "left_semi").groupBy("key", "label").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("inside"))
    todo = labelled.join(largest, "key").withColumn("main", F.col("label") == F.col("main"))
    outer = F.ceil((F.col("n") - F.col("inside")) / BLOCK).cast("int")
    todo = todo.withColumns({"outer": outer, "blocks": outer + F.ceil(F.col("inside") / BLOCK).cast("int")})
    h = F.xxhash64("doc_id")
    todo = todo.withColumn("block", F.when(F.col("main"), F.col("outer") + F.pmod(h, F.col("blocks") - F.col("outer"))).otherwise(F.pmod(h, F.col("outer"))).cast("int"))
    todo = todo.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("main"), F.col("outer")).otherwise(F.col("blocks")) - 1)))
    todo = todo.select("key", "band", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "doc_id", "label")
    fine = sets.join(todo.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_fine, "doc_id bigint, sig array<bigint>")
    fine = fine.join(reps.select("doc_id", "bands"), "doc_id")
    todo = todo.join(fine, "doc_id").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    more = ws.write(todo.mapInArrow(_residual, "a bigint, b bigint"), "more")
    late = confirm(more, sets)
    edges = ws.write(edges.unionByName(late), "all_edges")
    labels = ws.write(connected_components(edges, ws, "c2"), "labels2")

    by_fp = ws.write(reps.select("fp", "doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("fp", F.coalesce("label", "doc_id").alias("component_id")), "by_fp")
    ws.drop("hubs", "members", "sets", "edges", "labels1", "labelled", "open", "more", "all_edges", "labels2", "reps")
    out = with_first(sketch).select("doc_id", "n_shingles", F.when(linked(), F.col("fp")).alias("fp")).join(by_fp, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
