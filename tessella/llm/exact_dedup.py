"""Exact deduplication with an extendible-hash index on shared files; DataFrame operations only.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``.

1. Every document is hashed once; (doc_id, hash, ...) goes to a shared table.
2. The directory: distinct hashes, pre-aggregated to one entry each, are counted by their
   leading bits.  It doubles until no bucket holds more than ``capacity`` entries, and buckets
   that fit with fewer bits (local depth) keep several of its slots.  The capacity grows with
   the table, so that the directory never has more than about MAX_BUCKETS buckets.
3. Buckets are dealt to owners by key range.  Documents whose hash is theirs alone go to their
   owner as a bare entry; of the others the texts go too, equal texts of one input split
   combined before (so a group of any size reaches its owner as one row a split).
4. An owner task has its range of buckets in order and chains the entries of a hash: equal
   bytes are one entry, other bytes of the same hash are the next in the chain.  It writes the
   entries to its index file.
5. Documents look their verdict up in the index files by hash, and by digest within a chain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, small

CAPACITY = 4096
#: Buckets of the directory, at most about twice as many; it is broadcast (24 bytes a slot).
MAX_BUCKETS = 16_384
#: Most ids (8 bytes each) that are broadcast instead of joined by shuffle.
MAX_BROADCAST_ROWS = 500_000


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def slot_of(h: Column, depth: int) -> Column:
    """The first ``depth`` bits of a hash."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("bigint")


def directory(entries: DataFrame, capacity: int = CAPACITY, owners: int = 1) -> tuple[DataFrame, int]:
    """The directory of distinct hashes h, and its global depth G.

    Columns: slot (of 2**G), bucket (first slot of the bucket), depth (local), owner.  No bucket
    holds more than ``capacity`` entries, or than 1 / MAX_BUCKETS of them all where that is more.
    Two slots are buddies of one bucket wherever that fits.
    """
    total = entries.count()
    capacity = max(capacity, -(-total // MAX_BUCKETS))
    depth = max(0, math.ceil(math.log2(max(1, total / capacity))))
    while (entries.groupBy(slot_of(F.col("h"), depth).alias("slot")).count().agg(F.max("count")).first()[0] or 0) > capacity:
        depth += 1  # the directory doubles
        if depth > 26:
            raise ValueError("the hash is not uniform: one in 2**26 slots has more entries than a bucket holds")
    slots = entries.groupBy(slot_of(F.col("h"), depth).alias("slot")).agg(F.count("*").alias("n"))
    slots = entries.sparkSession.range(1 << depth).withColumnRenamed("id", "slot").join(slots, "slot", "left").fillna(0, ["n"])
    prefix = F.expr(f"shiftright(slot, {depth} - level)").alias("prefix")
    tree = slots.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).groupBy("level", prefix).agg(F.sum("n").alias("n"))
    # a slot's bucket ends at the least depth where it is not overfull
    reach = F.explode(F.sequence(F.expr(f"shiftleft(prefix, {depth} - level)"), F.expr(f"shiftleft(prefix + 1, {depth} - level) - 1"))).alias("slot")
    fitting = tree.where((F.col("n") <= capacity) | (F.col("level") == depth)).select("level", "prefix", reach)
    leaf = fitting.groupBy("slot").agg(F.min(F.struct("level", "prefix")).alias("b"))
    leaf = leaf.select("slot", F.expr(f"shiftleft(b.prefix, {depth} - b.level)").alias("bucket"), F.col("b.level").alias("depth"))
    return leaf.withColumn("owner", F.floor(F.col("bucket") * owners / (1 << depth)).cast("int")), depth


def build_index(rows: DataFrame, keyed: DataFrame, ws: Workspace, capacity: int = CAPACITY, owners: int = 1, hash_of=F.xxhash64) -> DataFrame:
    """The index files: (owner, bucket, h, chain, text_sha256, keep_id, keep_points, group_size),
    a file a task.

    rows: doc_id, text; keyed: doc_id, h, text_sha256 of the same rows.  chain counts the
    different texts of one hash from 0.
    """
    entries = ws.write(keyed.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min("text_sha256").alias("text_sha256")), "entries")
    slots, depth = directory(entries, capacity, owners)
    slots = F.broadcast(ws.write(slots.select("slot", "bucket", "owner"), "directory"))
    located = entries.withColumn("slot", slot_of(F.col("h"), depth)).join(slots, "slot").drop("slot")
    alone = located.where("n = 1").select("owner", "bucket", "h", F.lit("").alias("norm"), "text_sha256", F.struct(F.lit(None).cast("int").alias("p"), F.lit(False).alias("q"), "doc_id").alias("best"), F.col("n").alias("copies"))

    shared = located.where("n > 1").select("owner", "bucket", "h")
    if small(shared, MAX_BROADCAST_ROWS):
        shared = F.broadcast(shared)
    points = F.coalesce(F.length("text"), F.lit(0))
    texts = rows.select("doc_id", points.alias("points"), normalised(F.col("text")).alias("norm")).withColumn("h", hash_of(F.col("norm")))
    first = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("q"), "doc_id"))
    # copies of one input split, then each to its owner
    split = F.spark_partition_id().alias("split")
    combined = texts.select("*", split).join(shared, "h").groupBy("split", "owner", "bucket", "h", "norm").agg(first.alias("best"), F.count("*").alias("copies"))
    combined = combined.select("owner", "bucket", "h", "norm", F.lit(None).cast("string").alias("text_sha256"), "best", "copies")

    dealt = alone.unionByName(combined).repartition(owners, "owner")
    chained = dealt.groupBy("owner", "bucket", "h", "norm").agg(F.min("best").alias("best"), F.sum("copies").alias("group_size"), F.first("text_sha256", True).alias("known"))
    chain = F.row_number().over(Window.partitionBy("owner", "bucket", "h").orderBy("norm")) - 1
    digest = F.coalesce("known", F.sha2("norm", 256))
    index = ws.write(chained.select("owner", "bucket", "h", chain.alias("chain"), digest.alias("text_sha256"), F.col("best.doc_id").alias("keep_id"), (-F.col("best.p")).alias("keep_points"), "group_size"), "index")
    ws.drop("entries", "directory")
    return index


def _owners(docs: DataFrame) -> int:
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_of=F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points, then the smallest id, stays.  Null
    counts as the empty text, and empty texts are equal.  Rows repeated with one doc_id are
    one document seen twice: both count in group_size and share the verdict.  A row without an
    id stays only where no row of equal length and text has one.  An empty table
    gives no rows.  Extra columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "exact_dedup")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    norm = normalised(F.col("text"))
    keyed = ws.write(rows.select("doc_id", hash_of(norm).alias("h"), F.sha2(norm, 256).alias("text_sha256")), "keyed")
    index = build_index(rows, keyed, ws, capacity, _owners(docs), hash_of)
    out = keyed.join(index.select("h", "text_sha256", "keep_id", "group_size"), ["h", "text_sha256"])
    return out.select("doc_id", "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row of each text, all its columns: the row that exact_duplicates keeps.

    Of rows repeated with that id and length the one of least hash over all columns stays.  A
    text that no other row has is never shuffled; nulls and the empty table as above.
    """
    ws = Workspace(docs.sparkSession, "deduplicated")
    norm = normalised(F.col(text_col))
    keyed = ws.write(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(norm).alias("h"), F.sha2(norm, 256).alias("text_sha256")), "keyed")
    index = build_index(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), keyed, ws, capacity, _owners(docs))
    groups = ws.write(index.where("group_size > 1").select("h", "text_sha256", "keep_id", "keep_points", "group_size"), "groups")
    if small(groups, MAX_BROADCAST_ROWS):
        groups = F.broadcast(groups)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    rows = docs.select(own, F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("points"), F.xxhash64(norm).alias("h"), F.sha2(norm, 256).alias("text_sha256"))
    found = rows.join(groups, ["h", "text_sha256"], "left")
    single = found.where("group_size is null").select("own.*")
    best = found.where((F.col("group_size") > 1) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points")))
    best = best.groupBy("h", "text_sha256").agg(F.min_by("own", F.xxhash64("own")).alias("own")).select("own.*")
    return single.unionByName(best)


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Anti join on an id list, which is broadcast only while it has at most 500,000 rows."""
    ids = ids.select(id_col).distinct()
    return docs.join(F.broadcast(ids) if small(ids, MAX_BROADCAST_ROWS) else ids, id_col, "left_anti").select(*docs.columns)
