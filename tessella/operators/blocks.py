"""Scores as arrays: one row per image and block of concepts, and sums of such rows.

An array of a block's scores moves through joins as one value, where the long form has a row
per concept; Arrow batches are turned into matrices and worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 512
#: Bytes of partial sums that a task holds before it passes them on.
HELD_BYTES = 64 << 20


@dataclass(frozen=True)
class ScoreBlocks:
    """rows: image_id, block_id, scores array<double>; ids: per block the concepts of its places.

    The vocabulary (ids) is known to the driver; it does not grow with images or events.
    """

    rows: DataFrame
    ids: tuple[tuple[int, ...], ...]

    def only(self, concepts: list[int]) -> ScoreBlocks:
        """The blocks cut down to a few concepts, before anything is joined."""
        wanted = set(concepts)
        hits = [(b, [k for k, c in enumerate(ids) if c in wanted]) for b, ids in enumerate(self.ids)]
        hits = [(b, places) for b, places in hits if places]
        if not hits:
            return ScoreBlocks(self.rows.where("false"), ())
        cut, number = F.lit(None).cast("array<double>"), F.lit(None).cast("int")
        for k, (b, places) in enumerate(hits):
            here = F.col("block_id") == b
            cut = F.when(here, F.array(*[F.get("scores", F.lit(p)) for p in places])).otherwise(cut)
            number = F.when(here, F.lit(k)).otherwise(number)
        rows = self.rows.where(F.col("block_id").isin([b for b, _ in hits]))
        return ScoreBlocks(rows.select("image_id", number.alias("block_id"), cut.alias("scores")), tuple(tuple(self.ids[b][p] for p in places) for b, places in hits))

    def long(self) -> DataFrame:
        """(image_id, concept_id, score)."""
        return exploded(self.rows.withColumnRenamed("scores", "score"), self.ids, ["score"])


def exploded(rows: DataFrame, ids: tuple[tuple[int, ...], ...], values: list[str]) -> DataFrame:
    """Block rows with one row per concept: concept_id and the named arrays' values."""
    rest = [c for c in rows.columns if c not in (*values, "block_id")]
    if all(x == tuple(range(b * BLOCK, b * BLOCK + len(x))) for b, x in enumerate(ids)):
        concept = (F.col("block_id") * BLOCK + F.col("pos")).cast("int")
    else:
        concept = F.element_at(F.element_at(F.lit([list(x) for x in ids] or [[0]]).cast("array<array<int>>"), F.col("block_id") + 1), F.col("pos") + 1)
    each = rows.select(*rest, "block_id", F.posexplode(F.arrays_zip(*values)).alias("pos", "v"))
    return each.select(*rest, concept.alias("concept_id"), *[F.col(f"v.{c}").alias(c) for c in values])


def packed(scores: DataFrame) -> ScoreBlocks:
    """Blocks of long scores (image_id, concept_id, score); a cell without a row becomes null."""
    found = sorted(r[0] for r in scores.select("concept_id").distinct().collect())  # the vocabulary
    ids = tuple(tuple(found[i : i + BLOCK]) for i in range(0, len(found), BLOCK))
    if not ids:
        return ScoreBlocks(scores.select("image_id", F.lit(0).alias("block_id"), F.array(F.col("score").cast("double")).alias("scores")).limit(0), ())
    # F.lit of the vocabulary, by bisection of its blocks' first members
    block = F.lit(0)
    for b in range(1, len(ids)):
        block = F.when(F.col("concept_id") >= ids[b][0], F.lit(b)).otherwise(block)
    cells = F.map_from_entries(F.collect_list(F.struct("concept_id", F.col("score").cast("double").alias("s"))))
    rows = scores.groupBy("image_id", block.alias("block_id")).agg(cells.alias("cells"))
    names = F.element_at(F.lit([list(x) for x in ids]).cast("array<array<int>>"), F.col("block_id") + 1)
    return ScoreBlocks(rows.select("image_id", "block_id", F.transform(names, lambda c: F.try_element_at("cells", c)).alias("scores")), ids)


def of(scores) -> ScoreBlocks:
    """Blocks of long scores, of blocks, or of scores still to be made (scoring.PatchScores)."""
    return scores if isinstance(scores, ScoreBlocks) else packed(scores) if isinstance(scores, DataFrame) else scores.blocks()


def some(scores, concepts: list[int]) -> ScoreBlocks:
    """of, cut down to a few concepts; scores still to be made are made of those only."""
    return (packed(scores) if isinstance(scores, DataFrame) else scores).only(concepts)


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as a matrix; null cells are NaN."""
    flat = column.flatten()
    return np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows) if rows else np.zeros(0)))


def summed(rows: DataFrame, keys: list[str], arrays: list[str], number: str) -> DataFrame:
    """Per key the sums of arrays (of one length a key) and of a number.

    Tasks add up what they hold before the shuffle, so a key that a third of all rows have
    reaches its task as a few rows a task.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField(k, kinds[k]) for k in keys] + [T.StructField(number, T.DoubleType())] + [T.StructField(a, T.ArrayType(T.DoubleType())) for a in arrays])

    def batch_of(items: list[tuple[tuple, list]], types: list[pa.DataType]) -> pa.RecordBatch:
        cols = [pa.array([k[i] for k, _ in items], type=t) for i, t in enumerate(types)]
        cols.append(pa.array([v[0] for _, v in items], pa.float64()))
        cols += [lists([v[1 + j] for _, v in items]) for j in range(len(arrays))]
        return pa.RecordBatch.from_arrays(cols, names=[*keys, number, *arrays])

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple, list]]:
        columns = [batch.column(a) for a in arrays]
        names = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
        for r, (key, n) in enumerate(zip(names, batch.column(number).to_pylist(), strict=True)):
            yield key, [n, *(np.array(c[r].values.to_numpy(zero_copy_only=False), np.float64) for c in columns)]

    def add(into: list, values: list) -> None:
        into[0] += values[0]
        for j in range(1, len(values)):
            into[j] += values[j]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        types, size = [], 0
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            for key, values in rows_of(batch):
                if key in held:
                    add(held[key], values)
                else:
                    held[key] = values
                    size += 200 + sum(v.nbytes for v in values[1:])
            if size > HELD_BYTES:
                yield batch_of(list(held.items()), types)
                held, size = {}, 0
        if held:
            yield batch_of(list(held.items()), types)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key."""
        done: list[tuple[tuple, list]] = []
        types, size = [], 0
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            for key, values in rows_of(batch):
                if done and done[-1][0] == key:
                    add(done[-1][1], values)
                    continue
                if size > HELD_BYTES // 4:
                    yield batch_of(done, types)
                    done, size = [], 0
                done.append((key, values))
                size += 200 + sum(v.nbytes for v in values[1:])
        if done:
            yield batch_of(done, types)

    some = rows.select(*keys, F.col(number).cast("double").alias(number), *arrays).mapInArrow(partial, schema)
    return some.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merged, schema)
