"""Repeated byte strings across documents, by column-wise collection BWT and LCP construction.

Every byte covered by a 50-byte string that also starts in a document with a smaller id is
removed, judged on the input.  Sorting all suffixes of a corpus would move several times its
size, so the corpus is first cut into pieces that alone decide the question:

1. Each 50-byte window has an anchor, its 20-byte substring of least hash (the leftmost of
   equals).  Consecutive windows with one anchor form a run of 50 to 80 bytes.  Equal windows
   have equal anchors, wherever they stand.
2. Runs with equal anchor and content hash are taken for copies of the one in the least
   document.  Copies met in one map task are settled there, so a passage that a third of all
   documents share reaches its bucket as one entry a flush.  Neighbouring copies join into
   claims "these bytes of document d are those of document e", and every claim is compared
   byte for byte before it counts: within a task at once, across tasks by sending the bytes.
3. What is left of a run is its occurrence in its least document; it is a *piece* if its anchor
   has other runs, as at the borders of a repeated passage.  Pieces that share anchors form
   collections.  A collection's Burrows-Wheeler transform and LCP array are built column by
   column (Bauer, Cox and Rosone; LCP after Cox et al.): round j inserts the symbol that
   precedes the suffix of length j of every piece, and updates the common prefixes of what
   stands next to it.  Suffixes joined by LCP values of 50 or more are equal windows; all but
   those of the least document are removed.  A collection is bounded, so the files of the
   method are arrays here that each round reads and writes once from end to end.
4. An anchor with more than MAX_PIECES runs is not gathered: its windows are compared by
   128-bit content hash in an aggregation with partial minima, which has the same result.

Texts meet what belongs to them in one pass over (document, kind) order, so no list is
collected for a document, however often it is repeated elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .workspace import Workspace, small

LENGTH = 50
K = 20
BUCKET_CHARS = 5_000_000
MIN_BUCKETS = 64
FLUSH_RUNS = 500_000
COLLECTION = 8_000
MAX_PIECES = 100_000
#: Most ids of repeated rows (16 bytes each) that are broadcast instead of joined by shuffle.
MAX_BROADCAST_ROWS = 500_000
_U = np.uint64
_POS_BITS = 20  # a chunk is longer only if a single document is
_GOLD = _U(0x9E3779B97F4A7C15)


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K):
    """Start, end, anchor hash and content hash of every run of a chunk."""
    n, w = len(data), length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(_U), none.astype(_U)
    up, down = tc.powers(n + 1)
    acc = np.empty(n + 1, _U)
    acc[0] = 0
    np.cumsum(tc._TABLE[data] * up[:n], out=acc[1:])
    m, nw = n - k + 1, n - length + 1
    h = tc.mix64((acc[k:] - acc[:m]) * down[:m])
    bits = _U(max(_POS_BITS, int(n).bit_length()))
    key = ((h >> bits) << bits) | np.arange(m, dtype=_U)
    blocks = -(-m // w)
    pad = np.full(blocks * w, 0xFFFFFFFFFFFFFFFF, _U)
    pad[:m] = key
    pad = pad.reshape(blocks, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:nw], ahead[w - 1 : w - 1 + nw])
    anchor = (least & ((_U(1) << bits) - _U(1))).astype(np.int64)
    # windows inside one document
    last = np.repeat(offsets[1:], np.diff(offsets))[:nw]
    p = np.flatnonzero(np.arange(nw) + length <= last)
    if not len(p):
        return none, none, none.astype(_U), none.astype(_U)
    a = anchor[p]
    cut = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1))))
    start = p[cut]
    end = p[np.concatenate((cut[1:], [len(p)])) - 1] + length
    content = tc.mix64((acc[end] - acc[start]) * down[start] + (end - start).astype(_U) * _GOLD)
    return start, end, h[a[cut]], content


def spans_of(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a union of intervals."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))
    return start[new], end[last]


_FIELDS = (("anchor", np.uint32), ("content", _U), ("doc", np.int64), ("pos", np.int32), ("size", np.uint8), ("span", np.int32), ("src", np.int64), ("spos", np.int32))


def _blob_row(part: int, kind: int, **arrays) -> list:
    return [part, kind, *(np.ascontiguousarray(arrays[f], t).tobytes() if f in arrays else None for f, t in _FIELDS)]


def _blob_batch(rows: list[list]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=["part", "kind", *(f for f, _ in _FIELDS)])


BLOBS = "part int, kind int, " + ", ".join(f"{f} binary" for f, _ in _FIELDS)
#: Kinds of rows: runs on their way to a bucket, and to a document's task covered spans (doc,
#: pos, span), pieces, pieces of anchors with too many runs, and claims still to be compared
#: (doc, pos and span are those of src and spos).  TEXT is a document itself.
RUNS, COVERED, PIECE, HOT_PIECE, CLAIM, TEXT = 0, 1, 2, 3, 4, -1


def _deal(kind: int, parts: int, part: np.ndarray, rows: list, **arrays) -> None:
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))), [len(part)])) if len(part) else np.zeros(1, np.int64)
    arrays = {f: a[order] for f, a in arrays.items()}
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows.append(_blob_row(int(part[a]), kind, **{f: x[a:b] for f, x in arrays.items()}))


def _doc_part(doc: np.ndarray, parts: int) -> np.ndarray:
    return (tc.mix64(doc.astype(_U) * _GOLD) % _U(parts)).astype(np.int32)


def _settle(anchor, content, doc):
    """Order by (anchor, content, doc); where a new (anchor, content) starts; the index of each
    one's first in that order."""
    order = np.lexsort((doc, content, anchor))
    a, c = anchor[order], content[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
    return order, new, np.flatnonzero(new)[np.cumsum(new) - 1]


def joined_claims(doc: np.ndarray, pos: np.ndarray, size: np.ndarray, src: np.ndarray, spos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Claims on one diagonal of two documents that overlap or touch, joined."""
    if not len(doc):
        return doc, pos, size.astype(np.int64), src, spos
    pos, spos, size = pos.astype(np.int64), spos.astype(np.int64), size.astype(np.int64)
    order = np.lexsort((pos, pos - spos, src, doc))
    doc, pos, size, src, spos = doc[order], pos[order], size[order], src[order], spos[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (src[1:] != src[:-1]) | (pos[1:] - spos[1:] != pos[:-1] - spos[:-1])))
    # runs have at most 80 bytes, so ends rise with starts but for runs within others
    shift = np.cumsum(new) << 40
    far = np.maximum.accumulate(shift + pos + size)
    new[1:] |= shift[1:] + pos[1:] > far[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(doc) - 1]))
    return doc[first], pos[first], far[last] - shift[last] - pos[first], src[first], spos[first]


def equal_spans(a: bytes, b: bytes, at: int) -> list[tuple[int, int]]:
    """Stretches of LENGTH or more equal bytes of two strings, moved by ``at``."""
    if a == b:
        return [(at, at + len(a))]
    n = min(len(a), len(b))
    same = np.frombuffer(a[:n], np.uint8) == np.frombuffer(b[:n], np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    return [(at + int(s), at + int(e)) for s, e in edge.reshape(-1, 2) if e - s >= LENGTH]


def _map_runs(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        texts: list[np.ndarray] = []
        count = base = 0

        def flush() -> pa.RecordBatch:
            anchor, content, doc, pos, size, spot = (np.concatenate(x) for x in zip(*held, strict=True))
            data = b"".join(t.tobytes() for t in texts)
            held.clear()
            texts.clear()
            order, _, first = _settle(anchor, content, doc)
            anchor, content, doc, pos, size, spot = (x[order] for x in (anchor, content, doc, pos, size, spot))
            here = doc > doc[first]  # a smaller document of this flush has the run
            least = first[here]
            # claims by place in the flush: one number for document and position
            d, q, n, e, s = joined_claims(doc[here], spot[here], size[here], doc[least], spot[least])
            ids_, at = np.unique(doc, return_index=True)
            start = dict(zip(ids_.tolist(), (spot - pos)[at].tolist(), strict=True))  # place of each document
            out: list[tuple[int, int, int]] = []
            for k, q_, n_, s_ in zip(d.tolist(), q.tolist(), n.tolist(), s.tolist(), strict=True):
                out += [(k, x - start[k], y - x) for x, y in equal_spans(data[q_ : q_ + n_], data[s_ : s_ + n_], q_)]
            rows: list = []
            if out:
                covered = np.array(out, np.int64)
                _deal(COVERED, parts, _doc_part(covered[:, 0], parts), rows, doc=covered[:, 0], pos=covered[:, 1], span=covered[:, 2])
            keep = ~here
            mixed = tc.mix64(anchor[keep])  # anchors are minima, so crowd at zero
            part = ((mixed >> _U(32)) * _U(parts) >> _U(32)).astype(np.int32)
            _deal(RUNS, parts, part, rows, anchor=mixed & _U(0xFFFFFFFF), content=content[keep], doc=doc[keep], pos=pos[keep], size=size[keep])
            return _blob_batch(rows)

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for ch in tc.chunks(batch.column("text"), 1 << 18):
                s, e, anchor, content = anchored_runs(ch.data, ch.offsets)
                if not len(s):
                    continue
                d = np.searchsorted(ch.offsets, s, "right") - 1
                held.append((anchor, content, ids[ch.first + d].astype(np.int64), (s - ch.offsets[d]).astype(np.int32), (e - s).astype(np.uint8), s + base))
                texts.append(ch.data)
                base += len(ch.data)
                count += len(s)
                if count >= FLUSH_RUNS:
                    yield flush()
                    count = base = 0
        if held:
            yield flush()

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """Rows sorted by (part, kind), joined into one set of arrays each."""
    now, held = None, []

    def out():
        return {f: np.concatenate([np.frombuffer(r[2 + k], t) for r in held]) for k, (f, t) in enumerate(_FIELDS) if held[0][2 + k] is not None}

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", *(f for f, _ in _FIELDS))), strict=True):
            if row[:2] != now:
                if held:
                    yield (*now, out())
                now, held = row[:2], []
            held.append(row)
    if held:
        yield (*now, out())


def _reduce_runs(parts: int, max_pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, kind, x in _grouped(batches):
            rows: list = []
            if kind == COVERED:  # already on its way to its document
                rows.append(_blob_row(part, COVERED, **x))
                yield _blob_batch(rows)
                continue
            order, new, least = _settle(x["anchor"], x["content"], x["doc"])
            anchor, doc, pos, size = (x[f][order] for f in ("anchor", "doc", "pos", "size"))
            gone = doc > doc[least]
            src = least[gone]
            _deal(CLAIM, parts, _doc_part(doc[gone], parts), rows, doc=doc[gone], pos=pos[gone], size=size[gone], src=doc[src], spos=pos[src])
            # anchors whose runs lie in several documents
            first = np.concatenate(([True], anchor[1:] != anchor[:-1]))
            at = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            runs = np.add.reduceat(new.astype(np.int64), at)
            mixed = np.minimum.reduceat(np.where(gone, np.iinfo(np.int64).max, doc), at) < np.maximum.reduceat(np.where(gone, np.iinfo(np.int64).min, doc), at)
            ask = mixed[group] & ~gone & (runs[group] > 1)
            for kind_, some in ((PIECE, ask & (runs[group] <= max_pieces)), (HOT_PIECE, ask & (runs[group] > max_pieces))):
                # a piece's anchor is told from others by bucket and 32 bits
                _deal(kind_, parts, _doc_part(doc[some], parts), rows, anchor=anchor[some], content=np.full(int(some.sum()), part, _U), doc=doc[some], pos=pos[some], size=size[some])
            if rows:
                yield _blob_batch(rows)

    return run


#: Rows for documents: kind, the document to read, for claims the document that makes it, anchors
#: of pieces, places (pos, size; for COVERED start, end), and for claims the places there.
FOUND = "kind int, doc_id bigint, to_doc bigint, anchors array<bigint>, places array<int>, goals array<int>"


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document and kind, for claims per pair of documents."""

    def rows(kind: int, keys: list[np.ndarray], places: np.ndarray, goals: np.ndarray | None = None, anchors: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """keys: sorted arrays (document to read, document that asks)."""
        new = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))
        first = np.flatnonzero(new)
        sizes = np.diff(np.concatenate((first, [len(new)])))
        step = 4000
        for i in range(0, len(first), step):
            a, b = first[i], first[i] + sizes[i : i + step].sum()
            n = sizes[i : i + step]
            one = [k[first[i : i + step]] for k in keys]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(n), kind, np.int32)),
                    pa.array(one[0]),
                    pa.array(one[-1]),
                    tc.list_array(anchors[a:b] if anchors is not None else np.zeros(0, np.int64), n if anchors is not None else n * 0, pa.int64()),
                    tc.list_array(places[a:b].ravel(), 2 * n, pa.int32()),
                    tc.list_array(goals[a:b] if goals is not None else np.zeros(0, np.int32), n if goals is not None else n * 0, pa.int32()),
                ],
                names=["kind", "doc_id", "to_doc", "anchors", "places", "goals"],
            )

    for _, kind, x in _grouped(batches):
        if not len(x["doc"]):
            continue
        if kind == CLAIM:
            doc, pos, size, src, spos = joined_claims(x["doc"], x["pos"], x["size"], x["src"], x["spos"])
            yield from rows(kind, [src, doc], np.stack((spos, size), axis=1).astype(np.int32), goals=pos.astype(np.int32))
            continue
        order = np.lexsort((x["pos"], x["doc"]))
        doc, pos = x["doc"][order], x["pos"][order]
        if kind == COVERED:
            yield from rows(kind, [doc], np.stack((pos, pos + x["span"][order]), axis=1))
        else:
            anchors = (x["content"][order] << _U(32)) | x["anchor"][order].astype(_U)
            yield from rows(kind, [doc], np.stack((pos, x["size"][order].astype(np.int32)), axis=1), anchors=anchors.view(np.int64))


CUT = "kind int, anchor bigint, doc_id bigint, pos int, piece binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (doc_id, kind), each text before what asks for its bytes: those bytes."""
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    out: list[list] = [[] for _ in types]
    at, raw, held = None, b"", 0

    def batch_of() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types, strict=True)], names=["kind", "anchor", "doc_id", "pos", "piece"])
        for c in out:
            c.clear()
        return made

    for batch in batches:
        for kind, doc, text, to, anchors, places, goals in zip(*(batch.column(c) for c in ("kind", "doc_id", "text", "to_doc", "anchors", "places", "goals")), strict=True):
            kind, doc = kind.as_py(), doc.as_py()
            if kind == TEXT:
                at, raw = doc, text.as_py().encode("utf-8", "surrogatepass")
                continue
            if doc != at:
                raise ValueError(f"no text of document {doc}")
            places = places.as_py()
            starts, sizes = places[::2], places[1::2]
            n = len(starts)
            out[0] += [kind] * n
            out[1] += [None] * n if kind == CLAIM else anchors.as_py()
            out[2] += [to.as_py()] * n
            out[3] += goals.as_py() if kind == CLAIM else starts
            out[4] += [raw[p : p + s] for p, s in zip(starts, sizes, strict=True)]
            held += sum(sizes)
            if held > 2_000_000:
                yield batch_of()
                held = 0
    if out[0]:
        yield batch_of()


def _cut_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of pieces of hot anchors: (window, doc_id, pos)."""
    for batch in batches:
        names, docs, places = [], [], []
        for doc, pos, piece in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "pos", "piece")), strict=True):
            for i in range(len(piece) - LENGTH + 1):
                names.append(hashlib.blake2b(piece[i : i + LENGTH], digest_size=16).digest())
                docs.append(doc)
                places.append(pos + i)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(docs, pa.int64()), pa.array(places, pa.int32())], names=["window", "doc_id", "pos"])


def collection_bwt(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, cap: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Column-wise BWT and LCP of a collection of byte strings.

    flat holds the strings' bytes, begin and size their places.  Returns, in the order of the
    sorted suffixes (the empty ones first), string, suffix length, BWT symbol (-1 where the
    suffix is the whole string) and the common prefix with the suffix before, at most cap.
    Each string ends in a mark of its own that is less than every byte.
    """
    n = len(size)
    bwt = np.where(size > 0, flat[np.maximum(begin + size - 1, 0)].astype(np.int16), -1)
    owner = np.arange(n, dtype=np.int32)
    length = np.zeros(n, np.int16)
    lcp = np.zeros(n, np.uint8)
    rank = np.arange(n)  # where each string's longest suffix so far stands
    active = np.flatnonzero(size > 0)
    for j in range(1, int(size.max(initial=0)) + 1):
        # stable order by symbol is the order of the extended suffixes
        valid = np.flatnonzero(bwt >= 0)
        order = valid[np.argsort(bwt[valid].astype(np.uint8), kind="stable")]
        symbol = bwt[order]
        spot = np.empty(len(bwt), np.int64)
        spot[order] = np.arange(len(order))
        old = rank[active]
        put = spot[old]  # among the extended suffixes, in the new list after n empty ones
        by = np.argsort(put)
        put, who = put[by], active[by]
        # common prefix of consecutive equal symbols: one more than the least between them
        fresh = np.zeros(len(order), bool)
        fresh[put] = True
        same = np.concatenate((symbol[1:] == symbol[:-1], [False]))  # with the next one
        before = np.concatenate(([False], same[:-1]))
        need = (fresh | np.concatenate(([False], fresh[:-1]))) & before
        x = np.flatnonzero(need)
        value = np.zeros(len(order), np.uint8)
        if len(x):
            lo, hi = order[x - 1] + 1, order[x] + 1
            turn = np.argsort(lo)
            pairs = np.empty(2 * len(x), np.int64)
            pairs[::2], pairs[1::2] = lo[turn], hi[turn]
            padded = np.append(lcp, np.uint8(0))
            got = np.minimum.reduceat(padded, pairs)[::2]
            value[x[turn]] = np.minimum(got, cap - 1) + 1
        # the new list: the old one with the new suffixes inserted
        total = n + len(order)
        where = put + n
        keep = np.ones(total, bool)
        keep[where] = False
        owner_, length_, bwt_, lcp_ = np.empty(total, np.int32), np.empty(total, np.int16), np.empty(total, np.int16), np.empty(total, np.uint8)
        owner_[keep], length_[keep], bwt_[keep], lcp_[keep] = owner, length, bwt, lcp
        owner_[where], length_[where] = who, j
        more = size[who] > j
        bwt_[where] = np.where(more, flat[np.maximum(begin[who] + size[who] - j - 1, 0)].astype(np.int16), -1)
        after = np.concatenate(([False], fresh[:-1]))
        changed = np.flatnonzero(fresh | after)
        lcp_[n + changed] = value[changed]
        owner, length, bwt, lcp = owner_, length_, bwt_, lcp_
        rank[who] = where
        active = np.sort(who[more])
        if not len(active):
            break
    return owner, length, bwt, lcp


def _solve(doc: np.ndarray, pos: np.ndarray, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of every window that a piece of a smaller document also has."""
    owner, length, _, lcp = collection_bwt(flat, begin, size)
    at = np.flatnonzero(length >= LENGTH)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = lcp[at] < LENGTH
    new[0] = True
    d = doc[owner[at]]
    least = np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1]
    gone = at[d > least]
    return doc[owner[gone]], pos[owner[gone]] + size[owner[gone]] - length[gone]


def _solve_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: (doc_id, covered) spans of repeated windows."""

    def collections() -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows < COLLECTION:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            anchor = table["anchor"].to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1], "left"))  # the last anchor may go on
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            rows = sum(b.num_rows for b in held)
        if held:
            yield pa.Table.from_batches(held)

    for table in collections():
        table = table.combine_chunks()
        column = table["piece"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        raw = b"".join(column.to_pylist())
        size = np.array(pa.compute.binary_length(column), np.int64)
        doc, pos = table["doc_id"].to_numpy(), table["pos"].to_numpy().astype(np.int64)
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        d, p = _solve(doc, pos, np.frombuffer(raw, np.uint8), begin, size)
        if not len(d):
            continue
        order = np.lexsort((p, d))
        d, p = d[order], p[order]
        new = np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] > p[:-1] + LENGTH)))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:] - 1, [len(d) - 1]))
        spans = np.stack((p[first], p[last] + LENGTH), axis=1).astype(np.int32).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(d[first]), tc.list_array(spans, np.full(len(first), 2), pa.int32())], names=["doc_id", "covered"])


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (doc_id, kind), each text before its spans and claimed bytes."""
    out: list[tuple] = []
    at, raw, spans = None, b"", []

    def settle() -> None:
        flat = np.array(spans, np.int64).reshape(-1, 2)
        a, b = spans_of(flat[:, 0], flat[:, 1])
        digest, last = hashlib.sha256(), 0
        for s, e in zip(a.tolist(), b.tolist(), strict=True):
            digest.update(raw[last:s])
            last = e
        digest.update(raw[last:])
        out.append((at, len(raw), int((b - a).sum()), len(a), digest.hexdigest()))
        spans.clear()

    def batch_of() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        made = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        out.clear()
        return made

    started = False
    for batch in batches:
        for kind, doc, text, covered, pos, piece in zip(*(batch.column(c) for c in ("kind", "doc_id", "text", "covered", "pos", "piece")), strict=True):
            kind = kind.as_py()
            if kind == TEXT:
                if started:
                    settle()
                started, at, raw = True, doc.as_py(), text.as_py().encode("utf-8", "surrogatepass")
                continue
            if doc.as_py() != at:
                raise ValueError(f"no text of document {doc}")
            if kind == CLAIM:
                start, claim = pos.as_py(), piece.as_py()
                spans += equal_spans(raw[start : start + len(claim)], claim, start)
            else:
                flat = covered.as_py()
                spans += zip(flat[::2], flat[1::2], strict=True)
        if len(out) > 2000:
            yield batch_of()
    if started:
        settle()
    if out:
        yield batch_of()


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that keep all their bytes."""
    for batch in batches:
        raw = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        zero = pa.array(np.zeros(len(raw), np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), zero, zero, pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _remove(rows: DataFrame, ws: Workspace, max_pieces: int) -> DataFrame:
    """The result for rows (doc_id, text) without nulls, each id once."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(MIN_BUCKETS, -(-chars // BUCKET_CHARS))
    runs = rows.mapInArrow(_map_runs(parts), BLOBS)
    runs = runs.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(_reduce_runs(parts, max_pieces), BLOBS)
    runs = runs.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(_per_document, FOUND)
    found = ws.write(runs, "found")

    texts = rows.select(F.lit(TEXT).alias("kind"), "doc_id", "text")
    asked = texts.unionByName(found.where(F.col("kind") != COVERED), allowMissingColumns=True)
    asked = asked.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "kind")
    cut = ws.write(asked.mapInArrow(_cut, CUT), "cut")

    pieces = cut.where(F.col("kind") == PIECE).select("anchor", "doc_id", "pos", "piece")
    late = pieces.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_solve_pieces, "doc_id bigint, covered array<int>")
    spans = ws.write(late, "late").unionByName(found.where(F.col("kind") == COVERED).select("doc_id", F.col("places").alias("covered")))
    hot = cut.where(F.col("kind") == HOT_PIECE)
    if hot.limit(1).count():
        windows = ws.write(hot.mapInArrow(_cut_hot, "window binary, doc_id bigint, pos int"), "windows")
        least = ws.write(windows.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most"), "least")
        over = windows.join(least, "window").where("doc_id > least")
        spans = spans.unionByName(over.select("doc_id", F.array("pos", F.col("pos") + LENGTH).alias("covered")))

    whole = texts.unionByName(spans.withColumn("kind", F.lit(COVERED)), allowMissingColumns=True)
    whole = whole.unionByName(cut.where(F.col("kind") == CLAIM).select("kind", "doc_id", "pos", "piece"), allowMissingColumns=True)
    return whole.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "kind").mapInArrow(_finish, RESULT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_pieces: int = MAX_PIECES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null counts as the empty text.  Texts under 50 bytes lose nothing.  Rows repeated with one
    doc_id and text are one document.  Of different texts under one doc_id that of least hash
    is the document; the others, and rows without an id, keep all their bytes and cover
    nothing.  An empty table gives no rows; extra columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "repeats")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    known = rows.where("doc_id is not null")
    h = F.xxhash64("text").alias("h")
    repeated = ws.write(known.select("doc_id", h).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("h").alias("first")).where("n > 1").select("doc_id", "first"), "repeated")
    if repeated.limit(1).count():
        ids = F.broadcast(repeated) if small(repeated, MAX_BROADCAST_ROWS) else repeated
        again = known.select("doc_id", "text", h).join(ids, "doc_id")
        one = again.where(F.col("h") == F.col("first")).groupBy("doc_id").agg(F.min("text").alias("text"))
        single = ws.write(known.join(ids, "doc_id", "left_anti").unionByName(one), "single")
        done = ws.write(_remove(single, ws, max_pieces), "done")
        same = F.col("h") == F.col("first")
        copies = again.where(same).select("doc_id").join(done, "doc_id")
        out = done.join(ids, "doc_id", "left_anti").unionByName(copies).unionByName(again.where(~same).select("doc_id", "text").mapInArrow(_plain, RESULT))
    else:
        out = _remove(known, ws, max_pieces)
    return out.unionByName(rows.where("doc_id is null").mapInArrow(_plain, RESULT))
