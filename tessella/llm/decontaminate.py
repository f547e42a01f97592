"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents may be very long, so a MinHash of a whole document says
little about an item inside it.  Items are partitioned by size, class c holding those of
2**c to 2**(c+1)-1 shingle positions.  For each class a document is seen as overlapping
windows of three blocks of 2**c shingles, so a run of the item's length lies in one window
and their Jaccard similarity stays above 0.23 at containment 0.75.  A window is a candidate
for an item when any of 64 minima agree (miss probability 0.77**64 = 5e-8).  Block minima
are computed once and merged upwards from class to class.  Candidates are verified by exact
containment: the item's distinct shingles found anywhere in the whole document.

The items are the stated query set.  They are taken in blocks of bounded total length, each
broadcast and searched in one pass over the documents; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc

HASHES = 64
CONTAIN_NUM, CONTAIN_DEN = 75, 100
#: Characters of item text in one broadcast block.
BLOCK_CHARS = 8_000_000
_FACTORS = tc.multipliers(HASHES, 301)


class ItemIndex:
    """Shingle sets and size-partitioned minima of one block of items."""

    def __init__(self, texts: list[str | None], n: int):
        self.n = n
        self.sets: list[np.ndarray] = []
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_class: dict[int, list[tuple[int, np.ndarray]]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        column = pa.array(texts, type=pa.string())
        for ch in tc.chunks(column):
            s, e, first = ch.words()
            w = ch.word_hashes(s, e)
            h, at = tc.ngram_hashes(w, first, n)
            for d in range(len(ch)):
                item, words = ch.first + d, int(first[d + 1] - first[d])
                own = h[at[d] : at[d + 1]]
                distinct = np.unique(own)
                self.sets.append(distinct)
                if len(own):
                    low = tc.minima((own >> np.uint64(32)).astype(np.uint32), _FACTORS)
                    for c in range(len(distinct).bit_length() - 1, len(own).bit_length()):
                        by_class.setdefault(c, []).append((item, low))
                elif words:
                    one, _ = tc.ngram_hashes(w[first[d] : first[d + 1]], np.array([0, words]), words)
                    short.setdefault(words, []).append((int(one[0]), item))
        for m, pairs in short.items():
            pairs.sort()
            self.short[m] = (np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs]))
        self.classes: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]] = []
        for c, rows in sorted(by_class.items()):
            keys = np.concatenate([(np.arange(HASHES, dtype=np.uint64) << np.uint64(32)) | low for _, low in rows])
            items = np.repeat([i for i, _ in rows], HASHES)
            order = np.argsort(keys, kind="stable")
            keys, items = keys[order], items[order]
            bits = min(24, max(16, int(len(keys)).bit_length() + 5))
            seen = np.zeros(1 << bits, dtype=bool)
            seen[self.slot(keys, bits)] = True
            self.classes.append((c, keys, items, seen, bits))

    @staticmethod
    def slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)

    def candidates(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and item indices that share a minimum in some window."""
        none = np.zeros(0, np.int64)
        if not self.classes or not len(h):
            return none, none
        size = np.diff(at)
        step = 1 << self.classes[0][0]
        docs = np.flatnonzero(size)
        blocks = -(-size[docs] // step)
        # every document padded to whole blocks with its last shingle
        length = blocks * step
        put = np.concatenate(([0], np.cumsum(length)))
        local = np.arange(put[-1]) - np.repeat(put[:-1], length)
        take = np.repeat(at[:-1][docs], length) + np.minimum(local, np.repeat(size[docs] - 1, length))
        padded = (h[take] >> np.uint64(32)).astype(np.uint32).reshape(-1, step)
        low = np.empty((len(padded), HASHES), np.uint32)
        part = max(1, 4096 // step)
        for i in range(0, len(padded), part):
            low[i : i + part] = (padded[i : i + part, :, None] * _FACTORS[None, None, :]).min(axis=1)
        lane = np.arange(HASHES, dtype=np.uint64) << np.uint64(32)
        out, c = [], self.classes[0][0]
        for want, keys, items, seen, bits in self.classes:
            while c < want:
                begin = np.concatenate(([0], np.cumsum(blocks)[:-1]))
                half = -(-blocks // 2)
                starts = np.repeat(begin, half) + 2 * (np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half))
                low, blocks, c = np.minimum.reduceat(low, starts, axis=0), half, c + 1
            last = np.repeat(np.cumsum(blocks) - 1, blocks)
            row = np.arange(len(low))
            window = np.minimum(np.minimum(low, low[np.minimum(row + 1, last)]), low[np.minimum(row + 2, last)])
            probe = lane[None, :] | window
            hit = np.flatnonzero(seen[self.slot(probe, bits)].ravel())
            value = probe.ravel()[hit]
            lo, hi = np.searchsorted(keys, value, "left"), np.searchsorted(keys, value, "right")
            many = hi - lo
            if not many.any():
                continue
            owner = np.repeat(docs, blocks)[hit // HASHES]
            which = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            out.append(np.unique(np.repeat(owner, many) * len(self.sets) + items[which]))
        if not out:
            return none, none
        pair = np.unique(np.concatenate(out))
        return pair // len(self.sets), pair % len(self.sets)

    def hits(self, ch: tc.Chunk) -> Iterator[tuple[int, int, int, int]]:
        """(document in chunk, item, item shingles, shared shingles) of verified hits."""
        s, e, first = ch.words()
        w = ch.word_hashes(s, e)
        h, at = tc.ngram_hashes(w, first, self.n)
        doc, item = self.candidates(h, at)
        order = np.argsort(doc, kind="stable")
        doc, item = doc[order], item[order]
        for d in np.unique(doc):
            own = np.unique(h[at[d] : at[d + 1]])
            for i in item[np.searchsorted(doc, d, "left") : np.searchsorted(doc, d, "right")]:
                q = self.sets[i]
                spot = np.minimum(np.searchsorted(own, q), len(own) - 1)
                shared = int((own[spot] == q).sum())
                if CONTAIN_DEN * shared >= CONTAIN_NUM * len(q):
                    yield int(d), int(i), len(q), shared
        for m, (keys, items) in self.short.items():
            g, ga = tc.ngram_hashes(w, first, m)
            found = np.flatnonzero(np.isin(g, keys))
            if len(found):
                owner = np.searchsorted(ga, found, "right") - 1
                lo, hi = np.searchsorted(keys, g[found], "left"), np.searchsorted(keys, g[found], "right")
                for d, i in sorted({(int(d), int(i)) for d, a, b in zip(owner, lo, hi, strict=True) for i in items[a:b]}):
                    yield d, i, 1, 1


def item_blocks(items: DataFrame, id_col: str, text_col: str, n: int) -> Iterator[tuple[list, ItemIndex]]:
    """Ids and index of each block of items; a block's text is bounded by BLOCK_CHARS."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // BLOCK_CHARS))
    for k in range(parts):
        block = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else rows
        got = block.orderBy("item_id", "text").collect()
        yield [r.item_id for r in got], ItemIndex([r.text for r in got], n)


def benchmark_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5) -> DataFrame:
    """One row per document and test item that it contains to 0.75 or more.

    Columns: doc_id, item_id, n_item (distinct shingles of the item), n_shared, containment.
    Null texts count as empty; empty texts hold nothing and are held by nothing.  Items of
    fewer than ``shingle`` words are found as an unbroken run of their words (n_item 1).
    Repeated rows give repeated hits.  Empty tables give no rows.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item long, n_item long, n_shared long"
    out = None
    for ids, index in item_blocks(items, item_id, item_text, shingle):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [(ch.first + d, i, q, k) for ch in tc.chunks(batch.column("text"), 1 << 17) for d, i, q, k in shared.value.hits(ch)]
                if got:
                    at, item, q, k = (pa.array(x, type=pa.int64()) for x in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), item, q, k], names=["doc_id", "item", "n_item", "n_shared"])

        names = spark.createDataFrame([(k, i) for k, i in enumerate(ids)] or [], f"item long, item_id {items.schema[item_id].dataType.simpleString()}")
        part = rows.mapInArrow(run, schema).join(F.broadcast(names), "item")
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5) -> DataFrame:
    """The documents that contain no test item, all columns kept; nothing is shuffled."""
    out = docs
    for _, index in item_blocks(items, item_id, item_text, shingle):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = {ch.first + d for ch in tc.chunks(batch.column(text_col), 1 << 17) for d, *_ in shared.value.hits(ch)}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], type=pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out
