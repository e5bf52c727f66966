"""Row order within a key: neighbours, islands and carried values.

A key (a user, a player, a browser) may hold a large part of all rows, so its rows are not left to one task. Keys above a row bound are
cut into chunks of equal numbers of rows: a sample of their rows, in the same order that the windows use, gives the cuts. Windows run
inside a chunk, and one summary row per chunk carries what has to cross the cut. As cuts are places in that order and not only times, a burst of
rows at one time, or rows without a time, are cut as well; rows alike in the whole order are told apart by a hash of the row. Other
keys have the chunk NULL, so that they cost no more than a plain window, and without hot keys the adaptive planner drops the branches that
deal with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrail.functions.timeparts import epoch_us

# A key is hot above this many rows, or above one in HOT_SHARE of all rows. The share bounds
# the number of hot keys and of cuts, and so the size of the broadcast table, to HOT_SHARE.
HOT_ROWS = 1_000_000
HOT_SHARE = 100_000
SAMPLES = 64  # of each chunk, so that sizes differ by little

_CHUNK, _TIE = "_chunk", "_tie_hash"


def _listed(columns: Sequence[str] | str) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def _place(order: Sequence[str], tie: Column) -> Column:
    """A row's place in the order; NULL comes first, as in a window."""
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], tie.alias("tie"))


def hot_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str] | str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hot keys with the cuts between their chunks (`_cuts`, in groups): at most HOT_SHARE cuts.

    To be called on the frame as it is read, where counting costs a scan of a few columns. `order` is that of the windows to come.
    """
    order = _listed(order)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_all")).scalar()
    bound = F.greatest(F.lit(hot_rows), F.ceil(total / F.lit(HOT_SHARE)))
    hot = sizes.where(F.col("_n") > bound).select(*keys, F.least(F.lit(SAMPLES), bound).alias("_m"), bound.alias("_bound"))
    tie = F.xxhash64(*df.columns)
    # Which rows are sampled depends on the rows alone, so the same cuts come out wherever this is run.
    drawn = F.pmod(F.xxhash64(tie, F.lit("sample")), F.ceil(F.col("_bound") / F.col("_m"))) == 0
    sample = df.join(F.broadcast(hot), list(keys)).where(drawn).groupBy(*keys, "_m").agg(
        F.array_sort(F.collect_list(_place(order, tie))).alias("_sample"))
    cuts = F.filter("_sample", lambda x, i: (i > 0) & (i % F.col("_m") == 0))
    listed = sample.select(*keys, cuts.alias("_all")).where(F.size("_all") > 0)
    width = F.ceil(F.sqrt(F.size("_all").cast("double"))).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / width).cast("int")),
                         lambda g: F.slice("_all", g * width + 1, width))
    return listed.select(*keys, groups.alias("_cuts"))


def with_chunk(df: DataFrame, hot: DataFrame, order: Sequence[str] | str, hot_only: bool = False) -> DataFrame:
    """Add the chunk of hot keys' rows and their hash, which comes last in the order; both are NULL for other keys' rows.

    `hot` may go by some of the keys only; then all keys that share a hot one are cut alike.
    """
    keys = [c for c in hot.columns if c != "_cuts"]
    joined = df.join(F.broadcast(hot), keys, "inner" if hot_only else "left")  # at most HOT_SHARE cuts
    is_hot = F.col("_cuts").isNotNull()
    rows = joined.withColumn(_TIE, F.when(is_hot, F.xxhash64(*df.columns)))
    here = _place(_listed(order), F.col(_TIE))
    group = F.size(F.filter("_cuts", lambda g: g[0] <= here))
    within = F.size(F.filter(F.get("_cuts", group - 1), lambda c: c <= here))
    chunk = F.when(group == 0, F.lit(0)).otherwise(group * (1 << 16) + within)
    return rows.withColumn(_CHUNK, F.when(is_hot, chunk)).drop("_cuts")


def _window(keys: Sequence[str], order: Sequence[Column]) -> Window:
    return Window.partitionBy(*keys, _CHUNK).orderBy(*order)


def _carry_over(chunks: DataFrame, keys: Sequence[str], value: Column, ascending: bool) -> DataFrame:
    """For each chunk of a hot key, the last non-null value of the chunks before it."""
    order = F.col(_CHUNK) if ascending else F.col(_CHUNK).desc()
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.select(*keys, _CHUNK, F.last(value, ignorenulls=True).over(before).alias("_carry"))


def neighbour_row(df: DataFrame, hot: DataFrame, keys: Sequence[str], order: Sequence[str],
                  columns: Sequence[str], name: str = "_prev", following: bool = False) -> DataFrame:
    """Add struct `name` with `columns` of the previous (or following) row, NULL at the end."""
    picked = F.struct(*columns)
    place = F.struct(*order, _TIE)
    ordering = [F.col(c).desc() if following else F.col(c) for c in (*order, _TIE)]
    nearest = F.min_by if following else F.max_by
    edges = with_chunk(df, hot, order, hot_only=True).groupBy(*keys, _CHUNK).agg(
        nearest(picked, place).alias("_edge"))
    carried = _carry_over(edges, keys, F.col("_edge"), ascending=not following)
    rows = with_chunk(df, hot, order).withColumn(
        "_near", F.lag(picked).over(_window(keys, ordering)))
    return rows.join(carried, [*keys, _CHUNK], "left").withColumn(
        name, F.coalesce("_near", "_carry")).drop("_near", "_carry", _CHUNK, _TIE)


def carry_last(df: DataFrame, hot: DataFrame, keys: Sequence[str], order: Sequence[str],
               value: str, name: str) -> DataFrame:
    """Add the last non-null `value` at or before each row."""
    place = F.struct(*order, _TIE)
    until = _window(keys, [F.col(c) for c in (*order, _TIE)]).rowsBetween(Window.unboundedPreceding, 0)
    tails = with_chunk(df, hot, order, hot_only=True).groupBy(*keys, _CHUNK).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), place)).alias("_tail"))
    carried = _carry_over(tails, keys, F.col("_tail"), ascending=True)
    rows = with_chunk(df, hot, order).withColumn(
        "_last", F.last(value, ignorenulls=True).over(until))
    return rows.join(carried, [*keys, _CHUNK], "left").withColumn(
        name, F.coalesce("_last", "_carry")).drop("_last", "_carry", _CHUNK, _TIE)


def _breaks(same: Sequence[str], previous: Column, start: Column, max_gap_us: int | None) -> Column:
    """1 where a row does not go on with the island before it."""
    goes_on = previous.isNotNull()
    for c in same:
        goes_on = goes_on & F.col(c).eqNullSafe(previous[c])
    if max_gap_us is not None:
        goes_on = goes_on & (epoch_us(start) - epoch_us(previous["_end"]) <= max_gap_us)
    return F.when(goes_on, F.lit(0)).otherwise(F.lit(1))


def islands(df: DataFrame, hot: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str],
            same: Sequence[str], max_gap_us: int | None = None, sums: Sequence[str] = ()) -> DataFrame:
    """One row per run of consecutive rows that agree in `same`.

    A gap above `max_gap_us` ends a run. Result: keys, `same`, `started_at`, `ended_at`,
    `n_events` and the totals of `sums`.
    """
    def runs(rows: DataFrame) -> DataFrame:
        w = _window(keys, [F.col(c) for c in (*order, _TIE)])
        previous = F.lag(F.struct(*same, F.col(ts).alias("_end"))).over(w)
        marked = rows.withColumn("_prev", previous).withColumn(
            "_break", _breaks(same, F.col("_prev"), F.col(ts), max_gap_us))
        numbered = marked.withColumn("_run", F.sum("_break").over(
            w.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(*keys, _CHUNK, "_run").agg(
            *[F.first(c).alias(c) for c in same],
            F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"),
            F.count("*").alias("n_events"), *[F.sum(c).alias(c) for c in sums])

    result = [*keys, *same, "started_at", "ended_at", "n_events", *sums]

    # Runs at a chunk's ends may be parts of one run; there are at most two of them per chunk.
    def at_edge(parts: DataFrame) -> DataFrame:
        chunk = Window.partitionBy(*keys, _CHUNK)
        last = F.max("_run").over(chunk)
        return parts.withColumn("_edge", F.col(_CHUNK).isNotNull()
                                & ((F.col("_run") == 1) | (F.col("_run") == last)))

    parts = at_edge(runs(with_chunk(df, hot, order)))
    inner = parts.where(~F.col("_edge")).select(*result)
    edges = at_edge(runs(with_chunk(df, hot, order, hot_only=True))).where("_edge")
    w = Window.partitionBy(*keys).orderBy(_CHUNK, "_run")
    before = F.lag(F.struct(*same, F.col("ended_at").alias("_end"), _CHUNK)).over(w)
    marked = edges.withColumn("_prev", before).withColumn("_break", F.when(
        F.col(f"_prev.{_CHUNK}") == F.col(_CHUNK), F.lit(1)
    ).otherwise(_breaks(same, F.col("_prev"), F.col("started_at"), max_gap_us)))
    merged = marked.withColumn("_run", F.sum("_break").over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = merged.groupBy(*keys, "_run").agg(
        *[F.first(c).alias(c) for c in same],
        F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"),
        F.sum("n_events").alias("n_events"), *[F.sum(c).alias(c) for c in sums])
    return inner.unionByName(joined.select(*result))
