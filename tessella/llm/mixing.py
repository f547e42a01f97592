"""Mixing sources to target weights by iterative proportional fitting; DataFrame operations only.

Documents fall into cells (source, language, topic).  The cells' token weights are raked
until their source, language and topic marginals equal the targets; the ratio of a raked
cell weight to the cell's own share is the rate of its documents.  A document is kept with
probability ``min(1, rate / reference rate)``, decided by a hash of its id, so the same
document is decided alike on every run and every cluster.  Where the rate is above the
reference (documents that cannot be kept more than once) the excess is returned as a weight
above 1, so weighted token totals meet the targets in expectation.

Only one aggregation sees documents, with partial sums before its shuffle, so a hot source
costs one row per map task.  The raking itself works on the cell table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, small

DIMENSIONS = ("source", "lang", "topic")
#: Default targets: the marginals of the cells' tokens to this power, which flattens them and,
#: having the cells' own support, can always be met.
TEMPER = 0.6
#: Raking ends when no marginal misses its target by more than TOLERANCE; targets missed after
#: all rounds are an error.
MAX_ROUNDS, TOLERANCE = 1200, 1e-7
#: The reference rate is the largest among cells with at least this share of all tokens.
MIN_CELL_SHARE = 0.001
#: Cells up to this number are raked as arrays of one row and broadcast; beyond, by shuffles and joins.
MAX_SMALL_CELLS = 15_000
SEED = 20
#: Marker strings of the topics; a text's topic is the marker it has most.
#: Topics that follow from the language make its and their targets nearly one, so raking takes
#: hundreds of rounds.
TOPIC_MARKERS = ("tion", "ment", "heit", "ung", "ción", "eau", "ing", "able", "ado", "sch")


def token_count(text: Column) -> Column:
    """Number of words, the runs outside ``[\\x20\\x09-\\x0D]``."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def topic_of(text: Column, markers: tuple[str, ...] = TOPIC_MARKERS) -> Column:
    """The marker that occurs most, the first of equals; 'none' without any."""
    text = F.coalesce(text, F.lit(""))
    counts = [((F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m)).cast("bigint") for m in markers]
    most = F.greatest(*counts)
    out = F.when(most == 0, F.lit("none"))
    for m, c in zip(markers, counts, strict=True):
        out = out.when(c == most, F.lit(m))
    return out


def measured(docs: DataFrame, text_col: str = "text") -> list[Column]:
    """The columns that mixing needs of a document; null source and language count as ''."""
    text = F.col(text_col)
    return [
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        topic_of(text).alias("topic"),
        token_count(text).alias("n_tokens"),
    ]


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None, ws: Workspace) -> DataFrame:
    """Cells (source, lang, topic, tokens) with column w, their raked shares.

    targets: per dimension a table (name, target); values it lacks get none.  Without it the
    marginals of the tempered cells are the targets.  Raises ValueError when the targets
    cannot be met.
    """
    if not small(cells, MAX_SMALL_CELLS):
        return _rake_many(cells, targets, ws)
    cells = cells.coalesce(1)  # at most MAX_SMALL_CELLS rows
    for d in DIMENSIONS:
        if targets and d in targets:
            cells = _with_targets(cells, targets[d], d)
        else:
            part = F.sum(_tempered()).over
            cells = cells.withColumn(f"t_{d}", part(Window.partitionBy(d)) / part(Window.partitionBy(F.lit(1))))
    numbers = {f"v_{d}": F.dense_rank().over(Window.orderBy(d)) - 1 for d in DIMENSIONS}
    cells = cells.withColumns({"cell": F.row_number().over(Window.orderBy(*DIMENSIONS)) - 1, **numbers})
    cells = ws.write(cells.coalesce(1), "cells")
    fit = ws.write(_fitted_row(cells), "fit")
    gap = fit.select("fit.gap").first()[0]
    if gap > TOLERANCE:
        raise ValueError(f"mixing targets are missed by {gap} after {MAX_ROUNDS} rounds")
    weights = fit.select(F.posexplode("fit.w").alias("cell", "w"))
    return cells.join(weights, "cell").select(*DIMENSIONS, "tokens", "w")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _fitted_row(cells: DataFrame) -> DataFrame:
    """One row, fit (w, gap, rounds): the weights of the numbered cells after raking.

    The row holds the cells and, per dimension, each value's cells and target as arrays, so
    that a round costs a few array passes and all rounds are one projection.
    """
    long = cells.select(F.lit(-1).alias("part"), F.col("cell").alias("k"), F.array(*[f"v_{d}" for d in DIMENSIONS]).alias("at"), F.col("tokens").cast("double").alias("x"))
    for n, d in enumerate(DIMENSIONS):
        long = long.unionByName(cells.groupBy(F.col(f"v_{d}").alias("k")).agg(F.lit(n).alias("part"), F.sort_array(F.collect_list("cell")).alias("at"), F.max(f"t_{d}").alias("x")))
    names = {-1: "cells", **{n: f"p{n}" for n in range(len(DIMENSIONS))}}
    one = long.agg(*[F.sort_array(F.collect_list(F.when(F.col("part") == n, F.struct("k", "at", "x")))).alias(c) for n, c in names.items()])
    one = one.withColumn("total", F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["x"]))

    def sums(n: int, w: Column) -> Column:
        return F.transform(f"p{n}", lambda g: F.aggregate(g["at"], F.lit(0.0), lambda s, i: s + F.get(w, i)))

    def scaled(n: int, w: Column, over: Column) -> Column:
        factors = F.zip_with(f"p{n}", over, lambda g, s: F.when(s > 0, g["x"] / s).otherwise(0.0))
        return _let(factors, lambda f: F.zip_with(w, "cells", lambda x, c: x * F.get(f, c["at"][n])))

    def missed(n: int, over: Column) -> Column:
        return F.coalesce(F.array_max(F.zip_with(f"p{n}", over, lambda g, s: F.abs(g["x"] - s))), F.lit(0.0))

    def state(w: Column, gap: Column, rounds: Column) -> Column:
        return F.struct(w.alias("w"), gap.alias("gap"), rounds.alias("rounds"))

    def dimension(n: int, w: Column, gap: Column, rounds: Column) -> Column:
        if n == len(DIMENSIONS):
            return state(w, gap, rounds + 1)
        return _let(sums(n, w), lambda over: _let(scaled(n, w, over), lambda new: dimension(n + 1, new, F.greatest(gap, missed(n, over)), rounds)))

    start = state(F.transform("cells", lambda c: c["x"] / F.col("total")), F.lit(float("inf")), F.lit(0))
    # the gap is taken before the round's changes, which do not widen it
    fit = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_ROUNDS)), start, lambda s, _: F.when(s["gap"] <= TOLERANCE, s).otherwise(dimension(0, s["w"], F.lit(0.0), s["rounds"])))
    return one.select(fit.alias("fit"))


def _tempered() -> Column:
    return F.pow(F.col("tokens") / 1.0, F.lit(TEMPER))


def _with_targets(cells: DataFrame, target: DataFrame, d: str) -> DataFrame:
    return cells.join(target.select(F.col(d), F.col("target").cast("double").alias(f"t_{d}")), d, "left").fillna({f"t_{d}": 0.0})


def _rake_many(cells: DataFrame, targets: dict[str, DataFrame] | None, ws: Workspace) -> DataFrame:
    """The same for any number of cells: marginals are aggregations with partial sums, joined
    back by broadcast while they are small; a step is written before the next reads it twice."""
    sums = cells.agg(F.sum("tokens").alias("all"), F.sum(_tempered()).alias("tempered")).first()
    for d in DIMENSIONS:
        if targets and d in targets:
            cells = _with_targets(cells, targets[d], d)
        else:
            part = cells.groupBy(d).agg((F.sum(_tempered()) / sums.tempered).alias(f"t_{d}"))
            cells = cells.join(part, d)
    current = ws.write(cells.withColumn("w", F.col("tokens") / F.lit(float(sums["all"]))), "many_0")
    worst, step = 0.0, 0
    for _ in range(MAX_ROUNDS):
        worst = 0.0
        for d in DIMENSIONS:
            over = ws.write(current.groupBy(d).agg(F.sum("w").alias("over"), F.max(f"t_{d}").alias("t")), f"over_{step}")
            gap = over.agg(F.max(F.abs(F.col("over") - F.col("t")))).first()[0] or 0.0
            worst = max(worst, gap)
            over = over.select(d, "over")
            joined = current.join(F.broadcast(over) if small(over, MAX_SMALL_CELLS) else over, d)
            following = ws.write(joined.withColumn("w", F.when(F.col("over") > 0, F.col("w") * F.col(f"t_{d}") / F.col("over")).otherwise(0.0)).drop("over"), f"many_{step + 1}")
            ws.drop(f"many_{step}", f"over_{step}")
            current, step = following, step + 1
        if worst <= TOLERANCE:  # before this round's changes, so after them too
            return current.select(*DIMENSIONS, "tokens", "w")
    raise ValueError(f"mixing targets are missed by {worst} after {MAX_ROUNDS} rounds")


def cell_rates(docs_measured: DataFrame, targets: dict[str, DataFrame] | None, ws: Workspace) -> DataFrame:
    """(source, lang, topic, probability, weight) of each cell."""
    cells = docs_measured.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    raked = rake(ws.write(cells, "tokens"), targets, ws)
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    raked = raked.withColumn("rate", F.col("w") * F.lit(float(total)) / F.col("tokens"))
    reference = raked.where(F.col("tokens") >= MIN_CELL_SHARE * total).agg(F.max("rate")).first()[0] or 1.0
    share = F.col("rate") / F.lit(float(reference))
    return ws.write(raked.select(*DIMENSIONS, F.least(share, F.lit(1.0)).alias("probability"), F.greatest(share, F.lit(1.0)).alias("weight")), "rates")


def uniform(id_col: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) by hash of the id."""
    return F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def _with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows with probability, weight and sampled; those without tokens stay."""
    if small(rates, MAX_SMALL_CELLS):
        rates = F.broadcast(rates)
    empty = F.col("n_tokens") == 0
    out = rows.join(rates, list(DIMENSIONS), "left")
    for c in ("probability", "weight"):
        out = out.withColumn(c, F.when(empty, 1.0).otherwise(F.coalesce(F.col(c), F.lit(1.0))))
    return out.withColumn("sampled", empty | (uniform(F.col("doc_id")) < F.col("probability")))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, probability, weight, sampled.

    Null source or language is a value of its own (''); a document without tokens lies in no
    cell and is kept with probability 1.  Rows repeated with one id are decided alike.  An
    empty table gives no rows.  Other columns are ignored.  A rate above the reference rate, as
    small cells may have, becomes a weight above 1.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    rows = ws.write(docs.select(F.col(id_col).alias("doc_id"), *measured(docs, text_col)), "measured")
    return _with_rates(rows, cell_rates(rows, targets, ws)).select("doc_id", *DIMENSIONS, "n_tokens", "probability", "weight", "sampled")


def mixed_documents(docs: DataFrame, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sampled documents, all their columns kept, with mix_probability and mix_weight.

    Columns that have these names already are replaced.  Cells are measured again beside the
    text rather than joined by id, so no text is shuffled; rows without an id share a draw.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    rates = cell_rates(docs.select(*measured(docs, text_col)), targets, ws)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("mix_probability", "mix_weight")]).alias("own")
    rows = docs.select(own, F.col(id_col).alias("doc_id"), *measured(docs, text_col))
    return _with_rates(rows, rates).where("sampled").select("own.*", F.col("probability").alias("mix_probability"), F.col("weight").alias("mix_weight"))
