"""Dependence components of events that share prompts, images, sources, hashes or annotators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import canon
from tessella.operators.numbering import row_numbers
from tessella.sources.scratch import Scratch

#: Links up to this number (about 100 bytes each) are joined by one task, more by stars.
LOCAL_LINKS = 500_000
#: Members that one row may hold; larger components are digested as a stream.
MEMBERS = 20_000


def event_keys(events: DataFrame, images: DataFrame, annotators: bool = False) -> DataFrame:
    """(event_id, key) of everything that ties events together; excluded events count too."""
    own = events.select("event_id", F.concat(F.lit("p:"), "prompt_group_id").alias("key"))
    each = events.select("event_id", F.explode("candidate_ids").alias("image_id"))
    have = [c for c in ("source_image_uid", "content_hash", "pixel_hash") if c in images.columns]
    side = images.select("image_id", F.array(*[F.when(F.length(c) > 0, F.concat(F.lit(c[0] + ":"), *(["dataset", F.lit(":")] if c == "source_image_uid" else []), c)) for c in have]).alias("more")) if have else None
    keys = each.select("event_id", F.concat(F.lit("i:"), "image_id").alias("key"))
    if side is not None:
        keys = keys.unionByName(each.join(side, "image_id").select("event_id", F.explode("more").alias("key")).where("key is not null"))
    keys = keys.unionByName(own)
    if annotators:
        keys = keys.unionByName(events.where("annotator_id is not null").select("event_id", F.concat(F.lit("a:"), "annotator_id").alias("key")))
    return keys.distinct()


def _joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(u, v): the least event v that a task's links lead to from u, of about ``most`` links at a
    time; an event that leads to none has no row."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            yield from _least(held)
            held, size = [], 0
    yield from _least(held)


def _least(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union by least number over links."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got)
    ends = [table[c].combine_chunks() for c in ("u", "v")]
    names = pc.unique(pa.concat_arrays(ends))
    names = names.take(pc.array_sort_indices(names))
    u, v = (pc.index_in(e, names).to_numpy(zero_copy_only=False) for e in ends)
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[u], label[v])
        following = label.copy()
        for ends in (u, v):
            np.minimum.at(following, label[ends], low)
            np.minimum.at(following, ends, low)
        while not np.array_equal(ahead := following[following], following):
            following = ahead
        if np.array_equal(following, label):
            break
        label = following
    moved = np.flatnonzero(label != np.arange(len(names)))
    for k in range(0, len(moved), 50_000):
        some = moved[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), names.take(pa.array(label[some]))], names=["u", "v"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hangs each node's larger (or smaller) neighbours on the least node around it."""
    if large:
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every event hangs on one event that hangs on none."""
    if links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return False
    return not links.join(links.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()


def key_links(edges: DataFrame) -> DataFrame:
    """(u, v): each event of a key and the key's least event.  A key of two events needs no join;
    larger ones are summed before the shuffle, so a key that a third of all events share costs one
    row an event."""
    keys = edges.groupBy("key").agg(F.min("event_id").alias("v"), F.max("event_id").alias("u"), F.count("*").alias("n")).where("u <> v")
    keys = Scratch(edges.sparkSession, "keys").write(keys)
    links = keys.select("u", "v")
    large = keys.where("n > 2").select("key", "v")
    if large.limit(1).count():
        links = links.unionByName(edges.join(large, "key").where("event_id <> v").select(F.col("event_id").alias("u"), "v"))
    return links.distinct()


def least_labels(edges: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(event_id, label): the least event reachable over shared keys.

    Few links are joined by one task.  Of more, each task first joins the links of a range of
    events among themselves; what is left goes by alternating large and small stars (Kiveris et
    al., 2014), whose rounds grow with the logarithm of the size, until every event hangs on its
    component's least.
    """
    scratch = Scratch(edges.sparkSession, "components")
    edges = scratch.write(edges)
    links = scratch.write(key_links(edges))
    if links.limit(local_links + 1).count() <= local_links:
        found = links.coalesce(1).mapInArrow(lambda it: _joined(it, local_links + 1), "u string, v string")
    else:
        most = LOCAL_LINKS
        found = scratch.write(links.repartitionByRange("u").mapInArrow(lambda it: _joined(it, most), "u string, v string").distinct())
        while not _settled(found):
            found = scratch.write(_star(_star(found, True), False))
    found = found.select(F.col("u").alias("event_id"), F.col("v").alias("label"))
    events = edges.select("event_id").distinct()
    return scratch.write(events.join(found, "event_id", "left").select("event_id", F.coalesce("label", "event_id").alias("label")))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the JSON lists of rows sorted by label and event: no list is held."""
    label, state = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for name, event in zip(batch.column("label").to_pylist(), batch.column("quoted").to_pylist(), strict=True):
            if name != label:
                if state is not None:
                    state.update(b"]")
                    done.append((label, state.hexdigest()))
                label, state = name, hashlib.sha256(b"[")
            else:
                state.update(b",")
            state.update(event.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=["label", "component_id"])
    if state is not None:
        state.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([state.hexdigest()])], names=["label", "component_id"])


def component_digests(labels: DataFrame, members: int | None = None) -> DataFrame:
    """(label, component_id): the digest of the component's sorted event ids, whatever their
    number.  A component of more than MEMBERS ids is read as a stream of sorted rows.

    With ``members``, larger components get the digest of the digests of their parts in order.
    """
    most = MEMBERS if members is None else members
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > most).select("label")
    ids = F.array_sort(F.collect_list("event_id"))
    if not large.limit(1).count():
        return labels.groupBy("label").agg(canon.digest_list(ids).alias("component_id"))
    large = Scratch(labels.sparkSession, "large").write(large)
    some = labels.join(large, "label", "left_anti").groupBy("label").agg(canon.digest_list(ids).alias("component_id"))
    if members is None:
        rows = labels.join(large, "label", "left_semi").select("label", "event_id", canon.json_string(F.col("event_id")).alias("quoted"))
        rows = rows.repartition("label").sortWithinPartitions("label", "event_id").select("label", "quoted")
        return some.unionByName(rows.mapInArrow(_digested, "label string, component_id string"))
    placed = row_numbers(labels.join(large, "label", "left_semi"), ["label", "event_id"], "k")
    placed = placed.join(placed.groupBy("label").agg(F.min("k").alias("first")), "label").withColumn("part", F.floor((F.col("k") - F.col("first")) / members))
    parts = placed.groupBy("label", "part").agg(canon.digest_list(ids).alias("d"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"])
    return some.unionByName(parts.groupBy("label").agg(canon.digest_list(whole).alias("component_id")))


def components(events: DataFrame, images: DataFrame, annotators: bool = False) -> DataFrame:
    """(event_id, component_id) by component_digests."""
    labels = least_labels(event_keys(events, images, annotators))
    return labels.join(component_digests(labels), "label").select("event_id", "component_id")
