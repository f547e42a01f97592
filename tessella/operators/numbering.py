"""Row numbers over a whole table in a given order, without a task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.scratch import Scratch

_BITS = 33  # of monotonically_increasing_id, for a row's place in its partition


def row_numbers(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with a number from 0 in the given (total) order.

    Rows are dealt by ranges of the order and sorted within them; a partition's first number is
    the count of all rows before it, so the driver sees one count a partition.
    """
    spark = df.sparkSession
    keys = {f"_o{k}": c if not isinstance(c, str) else F.col(c) for k, c in enumerate(order)}
    sorted_ = df.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    rows = Scratch(spark, "numbers").write(sorted_.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", _BITS)
    counts = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    first, total = [], 0
    for p in sorted(counts):
        first += [F.lit(p), F.lit(total)]
        total += counts[p]
    start = F.element_at(F.create_map(*first), part) if first else F.lit(0)
    return rows.withColumn(name, (start + F.col("_m").bitwiseAND((1 << _BITS) - 1)).cast("bigint")).drop("_m")


def running_sums(df: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """df with running sums (column: name) over the whole table in order of a column without
    ties, by ranges like row_numbers."""
    spark = df.sparkSession
    sorted_ = df.repartitionByRange(order).sortWithinPartitions(order)
    rows = Scratch(spark, "sums").write(sorted_.withColumn("_p", F.spark_partition_id()))
    before = {c: F.lit(0) for c in sums}
    totals = sorted(rows.groupBy("_p").agg(*[F.sum(c).alias(c) for c in sums]).collect(), key=lambda r: r._p)
    for c in sums:
        first, total = [], 0
        for r in totals:
            first += [F.lit(r._p), F.lit(total)]
            total += r[c] or 0
        if first:
            before[c] = F.element_at(F.create_map(*first), F.col("_p"))
    window = Window.partitionBy("_p").orderBy(order)
    return rows.withColumns({name: before[c] + F.sum(c).over(window) for c, name in sums.items()}).drop("_p")
