"""Estimands from patches and bank, with scores made where they are used.

Images times concepts grow with the square of the input, so no table of scores is shuffled or
written here: the patch vectors of an event's images are brought together, a task makes their
scores tile by tile, and only sums over pairs leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators import blocks
from tessella.operators.scoring import PatchScores, unit_rows, vectors
from tessella.sources.scratch import Scratch

#: Concepts and pairs of one step of a task.
TILE, PAIRS = 1024, 1024
#: A prompt of up to this number of units is finished by one task, a larger one by up to SHARES.
UNITS, SHARES = 512, 64
MOMENTS = ("e1", "e2", "p1", "p2", "r1", "r2", "o1")
SUMS = ("preferred", "rejected", "ordering")


def units(comparisons: DataFrame, patches: DataFrame, key: list[str], each_pair: bool = False) -> DataFrame:
    """(key, part, whole, pairs, images): the pairs of all events of a prompt that have the same
    images, a pair's weight being the sum of one over the number of pairs of its events (or the
    number of its rows), and those images' vectors.

    Pairs of images without patches are left out.  whole: all units of the prompt have this part.
    """
    scratch = Scratch(comparisons.sparkSession, "units")
    c = comparisons.select(*key, "event_id", F.col("preferred_image_id").alias("w"), F.col("rejected_image_id").alias("l"))
    known = patches.select("image_id").distinct()
    for end in ("w", "l"):
        c = c.join(known.withColumnRenamed("image_id", end), end, "left_semi")
    events = c.groupBy(*key, "event_id").agg(F.collect_list(F.struct("w", "l")).alias("pairs"))
    events = events.withColumn("images", F.array_sort(F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p["w"], p["l"]))))))
    weight = F.lit(1.0) if each_pair else 1.0 / F.size("pairs")
    each = events.select(*key, "images", weight.alias("x"), F.explode("pairs").alias("p")).groupBy(*key, "images", "p").agg(F.sum("x").alias("x"))
    place = [(F.array_position("images", F.col("p")[e]) - 1).cast("int").alias(e) for e in ("w", "l")]
    got = each.groupBy(*key, "images").agg(F.collect_list(F.struct(*place, "x")).alias("pairs"))
    got = scratch.write(got.withColumn("uid", F.monotonically_increasing_id()))
    size = got.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.count("*").alias("_n"))
    parts = F.least(F.ceil(F.col("_n") / UNITS), F.lit(SHARES))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    got = got.join(size, same).withColumns({"part": F.pmod(F.xxhash64("images"), parts).cast("int"), "whole": parts == 1})
    images = got.select("uid", F.posexplode("images").alias("pos", "image_id")).join(vectors(patches), "image_id")
    images = images.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pos", "vectors"))).alias("images"))
    got = got.select(*key, "part", "whole", "pairs", "uid").join(images, "uid")
    return got.repartition(*key, "part").sortWithinPartitions(*key, "part", "uid")


def _unit(pairs: pa.Array, images: pa.Array, dim: int) -> tuple:
    """(w, l, x, unit vectors, patches of each image) of a row."""
    w, x, k = (pairs.field(n).to_numpy(zero_copy_only=False) for n in ("w", "l", "x"))
    held = images.field("vectors")
    sizes = np.diff(held.offsets.to_numpy(zero_copy_only=False)) // dim
    if not sizes.all():
        raise ValueError("an invalid image score reached statistics")
    return w, x, k, unit_rows(held.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64), "a valid patch"), sizes


def _tiles(rows: list[tuple], starts: list[int], bank: np.ndarray, tolerance: float, digits: int | None, tile: int) -> Iterator[tuple]:
    """(first concept, preferred, rejected, ordering): the weighted sums of each run of rows."""
    patches = np.concatenate([r[3] for r in rows])
    sizes = np.concatenate([r[4] for r in rows])
    first = np.cumsum(sizes) - sizes
    counts = np.array([len(r[4]) for r in rows])
    base = np.repeat(np.cumsum(counts) - counts, [len(r[0]) for r in rows])
    w, x = (np.concatenate([r[k] for r in rows]) + base for k in (0, 1))
    weight = np.concatenate([r[2] for r in rows])[:, None]
    pairs = np.array([len(r[0]) for r in rows])
    runs = (np.cumsum(pairs) - pairs)[starts]
    for t in range(0, len(bank), tile):
        scores = np.maximum.reduceat(patches @ bank[t : t + tile].T, first, axis=0)
        a, b = scores[w], scores[x]
        d = a - b
        if digits is not None:
            d = np.round(d, digits)
        order = (np.sign(d) + 1) * 0.5 if not tolerance else np.where(d > tolerance, 1.0, np.where(np.abs(d) <= tolerance, 0.5, 0.0))
        yield t, *(np.add.reduceat(np.multiply(v, weight, out=v), runs, axis=0) for v in (a, b, order))


def _sums(comparisons: DataFrame, scores: PatchScores, key: list[str], by: int, finish: bool, tolerance: float, digits: int | None, each_pair: bool) -> tuple[DataFrame, tuple]:
    """Rows (key, block_id, whole, n, arrays) and the concepts of the blocks: sums of prompts, or
    where finish is set and a task has all of a prompt, sums over prompts (whole, MOMENTS)."""
    source = units(comparisons, scores.patches, key, each_pair)
    kinds = {f.name: f.dataType for f in source.schema}
    schema = T.StructType([*(T.StructField(k, kinds[k]) for k in key), T.StructField("block_id", T.IntegerType()), T.StructField("whole", T.BooleanType()), T.StructField("n", T.DoubleType()), *(T.StructField(a, T.ArrayType(T.DoubleType())) for a in MOMENTS)])
    out, ids = None, []
    for block, names, bank in scores.slices():
        shared = comparisons.sparkSession.sparkContext.broadcast(bank)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, block=block) -> Iterator[pa.RecordBatch]:
            bank = shared.value
            moments: dict[tuple, list] = {}
            types: list[pa.DataType] = []
            pending: list[tuple] = []  # (key, rows) of prompts that a task has whole
            waiting = 0

            def batch_of(name: tuple, whole: bool, n: float, arrays: list[np.ndarray]) -> pa.RecordBatch:
                cuts = list(range(0, len(bank), blocks.BLOCK))
                cols = [pa.array([v] * len(cuts), t) for v, t in zip(name, types, strict=True)]
                cols += [pa.array([block + k for k in range(len(cuts))], pa.int32()), pa.array([whole] * len(cuts)), pa.array([n] * len(cuts), pa.float64())]
                cols += [blocks.lists([a[c : c + blocks.BLOCK] for c in cuts]) for a in arrays]
                cols += [blocks.lists([np.zeros(0)] * len(cuts))] * (len(MOMENTS) - len(arrays))
                return pa.RecordBatch.from_arrays(cols, names=[*key, "block_id", "whole", "n", *MOMENTS])

            def flush() -> None:
                nonlocal pending, waiting
                rows = [r for _, some in pending for r in some]
                if not rows:
                    return
                lens = np.array([len(some) for _, some in pending])
                weight = np.array([sum(r[2].sum() for r in some) for _, some in pending])[:, None]
                groups = [name[:by] for name, _ in pending]
                heads = [k for k in range(len(groups)) if k == 0 or groups[k] != groups[k - 1]]
                for g, k in zip(heads, [*heads[1:], len(groups)], strict=True):
                    moments.setdefault(groups[g], [0, np.zeros((len(MOMENTS), len(bank)))])[0] += k - g
                for t, p, r, o in _tiles(rows, list(np.cumsum(lens) - lens), bank, tolerance, digits, TILE):
                    p, r, o = p / weight, r / weight, o / weight
                    e = p - r
                    for m, v in enumerate((e, e * e, p, p * p, r, r * r, o)):
                        for g, some in zip(heads, np.add.reduceat(v, heads, axis=0), strict=True):
                            moments[groups[g]][1][m, t : t + TILE] += some
                pending, waiting = [], 0

            now, held, size, carry, whole = None, [], 0, None, False

            def add() -> None:
                """The held rows of the present prompt to its sums."""
                nonlocal held, size, carry
                if held:
                    carry = carry or [0.0, np.zeros((3, len(bank)))]
                    carry[0] += sum(r[2].sum() for r in held)
                    for t, *sums in _tiles(held, [0], bank, tolerance, digits, TILE):
                        for m, v in enumerate(sums):
                            carry[1][m, t : t + TILE] += v[0]
                held, size = [], 0

            def close() -> Iterator[pa.RecordBatch]:
                nonlocal carry, held, size, waiting
                if now is None:
                    return
                if finish and whole and carry is None:
                    pending.append((now, held))
                    waiting += size
                    held, size = [], 0
                    if waiting >= PAIRS:
                        flush()
                    return
                add()
                yield batch_of(now, False, carry[0], list(carry[1]))
                carry = None

            for batch in batches:
                types = [batch.schema.field(k).type for k in key]
                names = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
                parts, wholes = batch.column("part").to_pylist(), batch.column("whole").to_pylist()
                pairs, images = batch.column("pairs"), batch.column("images")
                for k, name in enumerate(names):
                    if now is None or (name, parts[k]) != (now, part):
                        yield from close()
                        now, part, whole = name, parts[k], wholes[k]
                    held.append(_unit(pairs[k].values, images[k].values, bank.shape[1]))
                    size += len(held[-1][0])
                    if size >= PAIRS:
                        add()
            yield from close()
            flush()
            for group, (n, arrays) in moments.items():
                yield batch_of((*group, *[None] * (len(key) - by)), True, n, list(arrays))

        part = source.select(*key, "part", "whole", "pairs", "images").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
        ids += names
    if out is None:
        out = comparisons.sparkSession.createDataFrame([], schema)
    return out, tuple(ids)


def _prompts(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, block_id, n and SUMS, means of each prompt) of sums that several tasks made."""
    part = rows.where("not whole").withColumnsRenamed(dict(zip(MOMENTS, SUMS, strict=False)))
    total = blocks.summed(part.select(*key, "block_id", "n", *SUMS), [*key, "block_id"], list(SUMS), "n")
    return total.select(*key, "block_id", *[F.transform(a, lambda x: x / F.col("n")).alias(a) for a in SUMS])


def prompt_blocks(comparisons: DataFrame, scores: PatchScores, tolerance: float, by: tuple[str, ...]) -> tuple[DataFrame, tuple]:
    """(by, prompt_group_id, dependency_cluster_id, block_id, SUMS) and the concepts of blocks."""
    key = [*by, "prompt_group_id", "dependency_cluster_id"]
    rows, ids = _sums(comparisons, scores, key, len(by), False, tolerance, None, False)
    return _prompts(rows, key), ids


def effects(comparisons: DataFrame, scores: PatchScores, tolerance: float, by: tuple[str, ...]) -> DataFrame:
    """Means and deviations over prompts; the only rows shuffled are sums of large prompts and of
    whole tasks, an array a block of concepts each."""
    key = [*by, "prompt_group_id", "dependency_cluster_id"]
    rows, ids = _sums(comparisons, scores, key, len(by), True, tolerance, None, False)
    rows = Scratch(comparisons.sparkSession, "effects").write(rows)
    p = _prompts(rows, key)
    e = F.zip_with("preferred", "rejected", lambda a, b: a - b)
    square = lambda c: F.transform(c, lambda v: v * v)
    one = p.withColumn("e1", e).select(*by, "block_id", F.lit(1.0).alias("n"), "e1", square("e1").alias("e2"), F.col("preferred").alias("p1"), square("preferred").alias("p2"), F.col("rejected").alias("r1"), square("rejected").alias("r2"), F.col("ordering").alias("o1"))
    whole = rows.where("whole").select(*by, "block_id", "n", *MOMENTS)
    total = blocks.summed(whole.unionByName(one), [*by, "block_id"], list(MOMENTS), "n")
    each = blocks.exploded(total, ids, list(MOMENTS))
    n = F.col("n")

    def deviation(k: str):
        return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col(f"{k}2") - F.col(f"{k}1") * F.col(f"{k}1") / n) / (n - 1))))

    return each.select(
        *by,
        "concept_id",
        (F.col("e1") / n).alias("effect"),
        (F.col("p1") / n).alias("preferred_mean"),
        (F.col("r1") / n).alias("rejected_mean"),
        (F.col("o1") / n).alias("concordance"),
        deviation("e").alias("prompt_effect_sd"),
        deviation("p").alias("preferred_prompt_sd"),
        deviation("r").alias("rejected_prompt_sd"),
        F.round(n).cast("bigint").alias("prompts"),
    )


def pair_wins(comparisons: DataFrame, scores: PatchScores, tolerance: float, digits: int | None) -> DataFrame:
    """(concept_id, wins, pairs) over all pairs, differences rounded to digits first."""
    key = ["_all"]
    rows, ids = _sums(comparisons.withColumn("_all", F.lit(0)), scores, key, 0, False, tolerance, digits, True)
    part = rows.select("block_id", "n", F.col(MOMENTS[2]).alias("wins"))
    total = blocks.summed(part, ["block_id"], ["wins"], "n")
    return blocks.exploded(total, ids, ["wins"]).select("concept_id", "wins", F.round("n").cast("bigint").alias("pairs"))


def weighted(net: DataFrame, scores: PatchScores) -> DataFrame:
    """(concept_id, effect): the sum over images of net weight times score."""
    rows = net.join(vectors(scores.patches), "image_id").select("net", "vectors")
    schema = "block_id int, n double, effect array<double>"
    out, ids = None, []
    for block, names, bank in scores.slices():
        shared = net.sparkSession.sparkContext.broadcast(bank)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, block=block) -> Iterator[pa.RecordBatch]:
            bank = shared.value
            total = np.zeros(len(bank))
            dim, live = bank.shape[1], False
            for batch in batches:
                for at in range(0, batch.num_rows, PAIRS):
                    some = batch.slice(at, PAIRS)
                    held = some.column("vectors")
                    sizes = np.diff(held.offsets.to_numpy(zero_copy_only=False)) // dim
                    if not sizes.all():
                        raise ValueError("an invalid image score reached statistics")
                    patches = unit_rows(held.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64), "a valid patch")
                    net, first, live = some.column("net").to_numpy(), np.cumsum(sizes) - sizes, True
                    for t in range(0, len(bank), TILE):
                        total[t : t + TILE] += net @ np.maximum.reduceat(patches @ bank[t : t + TILE].T, first, axis=0)
            if live:
                cuts = range(0, len(bank), blocks.BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([block + k for k in range(len(cuts))], pa.int32()), pa.array(np.ones(len(cuts))), blocks.lists([total[c : c + blocks.BLOCK] for c in cuts])], names=["block_id", "n", "effect"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
        ids += names
    if out is None:
        out = net.sparkSession.createDataFrame([], schema)
    return blocks.exploded(blocks.summed(out, ["block_id"], ["effect"], "n").select("block_id", "effect"), tuple(ids), ["effect"])
