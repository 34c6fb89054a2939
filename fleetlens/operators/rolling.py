"""Rolling statistics over row-count windows.

Windows of up to ``DENSE_ROWS`` rows are computed with numpy: Spark deals out
and sorts the chunks, a task takes its rows batch by batch and keeps the last
rows of the batch before.  States of the last 1, 2, 4, ... rows are merged to
those of a window, which costs O(rows x log window).  Longer windows are split
at multiples of the window length: a window is the tail of one block plus the head of the next, and both
parts come from running frames (one ascending, one descending) whose moments
are merged with the pairwise update of Chan, Golub and LeVeque.  Columns that
numpy's doubles cannot hold use Spark's own sliding frames.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators.ordering import INDEX, Chunks, Series

NATIVE_ROWS = 24
#: Longest window of the dense path; so many rows of the batch before are kept.
DENSE_ROWS = 16384
POSITION = "__pos"

# A spread this small against the level is rounding residue of a constant.
ZERO_SPREAD = 1e-20


@dataclass(frozen=True)
class Roll:
    """One rolling output column.

    kind: mean, std, min, max, range, count, slope (of ``col`` on the row
    number) or corr (of ``col`` and ``other``).  Fewer than ``min_obs``
    usable rows give null, or ``fill`` when set.
    """

    kind: str
    col: str
    window: int
    out: str
    min_obs: int = 1
    other: str | None = None
    fill: float | None = None


def is_flat(second_moment: Column, mean: Column) -> Column:
    return second_moment <= F.lit(ZERO_SPREAD) * mean * mean


def _need(roll: Roll) -> tuple:
    if roll.kind in ("mean", "std", "count"):
        return ("moments", roll.col, None)
    if roll.kind in ("min", "max", "range"):
        return ("extremes", roll.col, None)
    if roll.kind == "slope":
        return ("pair", "__x", roll.col)
    if roll.kind == "corr":
        return ("pair", roll.col, roll.other)
    raise ValueError(f"unknown rolling kind {roll.kind!r}")


def _state(need: tuple, over, only=lambda c: c) -> Column:
    """Aggregates that describe a set of rows and can be merged.

    ``over`` turns an aggregate into a window column (or leaves it alone in a
    ``groupBy``); ``only`` restricts a column to the rows that count.
    """
    kind, a, b = need
    if kind == "moments":
        c = only(F.col(a))
        return F.struct(
            over(F.count(c)).alias("n"), over(F.avg(c)).alias("m"), over(F.var_pop(c)).alias("v"),
        )
    if kind == "extremes":
        c = only(F.col(a))
        return F.struct(
            over(F.count(c)).alias("n"), over(F.min(c)).alias("lo"), over(F.max(c)).alias("hi"),
        )
    x = only(F.when(F.col(b).isNotNull(), F.col(a)))
    y = only(F.when(F.col(a).isNotNull(), F.col(b)))
    return F.struct(
        over(F.count(x)).alias("n"),
        over(F.avg(x)).alias("ma"), over(F.avg(y)).alias("mb"),
        over(F.var_pop(x)).alias("va"), over(F.var_pop(y)).alias("vb"),
        over(F.covar_pop(x, y)).alias("cab"),
    )


def _framed(need: tuple, frame) -> Column:
    return _state(need, lambda agg: agg.over(frame))


def _merge(need: tuple, p: Column, s: Column) -> Column:
    """Combine the states of two disjoint row sets; ``s`` may be null."""
    n1, n2 = p["n"], F.coalesce(s["n"], F.lit(0))
    n = n1 + n2
    if need[0] == "extremes":
        return F.struct(
            n.alias("n"),
            F.least(p["lo"], s["lo"]).alias("lo"),
            F.greatest(p["hi"], s["hi"]).alias("hi"),
        )
    only_first, only_second = n2 == 0, n1 == 0

    def mean(m):
        merged = (n1 * p[m] + n2 * s[m]) / n
        return F.when(only_first, p[m]).when(only_second, s[m]).when(p[m] == s[m], p[m]).otherwise(merged)

    def co(v, a, b):
        within = (n1 * p[v] + n2 * s[v]) / n
        between = (p[a] - s[a]) * (p[b] - s[b]) * n1 / n * n2 / n
        return F.when(only_first, p[v]).when(only_second, s[v]).otherwise(within + between)

    if need[0] == "moments":
        return F.struct(n.alias("n"), mean("m").alias("m"), co("v", "m", "m").alias("v"))
    return F.struct(
        n.alias("n"), mean("ma").alias("ma"), mean("mb").alias("mb"),
        co("va", "ma", "ma").alias("va"), co("vb", "mb", "mb").alias("vb"),
        co("cab", "ma", "mb").alias("cab"),
    )


def _value(roll: Roll, s: Column) -> Column:
    n = s["n"]
    enough = n >= roll.min_obs
    if roll.kind == "count":
        out = F.when(enough, n)
    elif roll.kind == "mean":
        out = F.when(enough, s["m"])
    elif roll.kind == "std":
        spread = F.when(is_flat(s["v"], s["m"]), F.lit(0.0)).otherwise(
            F.sqrt(s["v"] * n / F.greatest(n - 1, F.lit(1)))
        )
        out = F.when(enough & (n > 1), spread)
    elif roll.kind == "min":
        out = F.when(enough, s["lo"])
    elif roll.kind == "max":
        out = F.when(enough, s["hi"])
    elif roll.kind == "range":
        out = F.when(enough, s["hi"] - s["lo"])
    elif roll.kind == "slope":
        out = F.when(enough & (n > 1), s["cab"] / s["va"])
    else:
        flat = is_flat(s["va"], s["ma"]) | is_flat(s["vb"], s["mb"])
        out = F.when(enough & ~flat, s["cab"] / F.sqrt(s["va"]) / F.sqrt(s["vb"]))
    return out if roll.fill is None else F.coalesce(out, F.lit(roll.fill))


def _fits_double(df: DataFrame, roll: Roll) -> bool:
    fits = (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType)
    return all(isinstance(df.schema[c].dataType, fits) for c in _need(roll)[1:] if c is not None)


def _joined(kind: str, p: tuple, q: tuple) -> tuple:
    """States of two disjoint row sets together, ``p`` the older rows; arrays of what ``_state`` holds, second moments as sums."""
    n1, n2 = p[0], q[0]
    n = n1 + n2
    if kind == "extremes":
        return n, np.fmin(p[1], q[1]), np.maximum(p[2], q[2])
    share = n2 / np.maximum(n, 1)
    first, second = n2 == 0, n1 == 0
    means = 1 if kind == "moments" else 2
    gaps = [q[i] - p[i] for i in range(1, means + 1)]

    def either(x, y, both):
        return np.where(first, x, np.where(second, y, both))

    merged = [either(p[i], q[i], p[i] + gap * share) for i, gap in enumerate(gaps, 1)]
    products = [(0, 0)] if means == 1 else [(0, 0), (1, 1), (0, 1)]
    sums = [either(p[i], q[i], p[i] + q[i] + gaps[a] * gaps[b] * n1 * share) for i, (a, b) in enumerate(products, means + 1)]
    return n, *merged, *sums


def _doubled(need: tuple, data: dict, longest: int) -> list[tuple]:
    """States of the last 1, 2, 4, ... rows that end at each row."""
    kind, a, b = need
    there = data[a][1] if b is None else data[a][1] & data[b][1]
    n, none = there.astype(np.float64), np.zeros(len(there))
    if kind == "extremes":
        empty = (0.0, np.inf, -np.inf)
        levels = [(n, np.where(there, data[a][0], np.inf), np.where(there, data[a][0], -np.inf))]
    else:
        empty = (0.0,) * (3 if b is None else 6)
        levels = [(n, *[np.where(there, data[c][0], 0.0) for c in (a, b) if c is not None], *[none] * (1 if b is None else 3))]
    reach = 1
    while 2 * reach <= longest:
        last = levels[-1]
        older = tuple(np.concatenate([np.full(min(reach, len(x)), e), x[:len(x) - reach] if len(x) > reach else x[:0]]) for x, e in zip(last, empty))
        levels.append(_joined(kind, older, last))
        reach *= 2
    return levels


def _dense_state(need: tuple, levels: list[tuple], ends, rows) -> tuple:
    """The state of ``_state`` for the last ``rows`` rows up to each of ``ends``, put together from doubled ones."""
    kind, (ends, left) = need[0], (ends.copy(), rows)
    state = None
    for k, level in enumerate(levels):
        taken = (left >> k) & 1 == 1
        if not taken.any():
            continue
        part = [x[ends] for x in level]
        part[0] = np.where(taken, part[0], 0.0)
        if kind == "extremes":
            part[1:] = [np.where(taken, part[1], np.inf), np.where(taken, part[2], -np.inf)]
        else:
            part[1:] = [np.where(taken, x, 0.0) for x in part[1:]]
        state = tuple(part) if state is None else _joined(kind, tuple(part), state)
        ends = np.maximum(ends - (taken.astype(np.int64) << k), 0)
    if kind == "extremes":
        return state
    means = 1 if kind == "moments" else 2
    return *state[:means + 1], *[x / state[0] for x in state[means + 1:]]


def _dense_value(roll: Roll, s: tuple) -> tuple:
    """What ``_value`` makes of a state: values and which of them are there."""
    n = s[0]
    enough = (n >= roll.min_obs) & (n > 0)
    flat = lambda v, m: v <= ZERO_SPREAD * m * m
    if roll.kind == "count":
        return n, n >= roll.min_obs
    if roll.kind == "mean":
        return s[1], enough
    if roll.kind == "std":
        return np.where(flat(s[2], s[1]), 0.0, np.sqrt(s[2] * n / np.maximum(n - 1, 1))), enough & (n > 1)
    if roll.kind in ("min", "max", "range"):
        return {"min": s[1], "max": s[2]}[roll.kind] if roll.kind != "range" else s[2] - s[1], enough
    if roll.kind == "slope":
        return s[5] / s[3], enough & (n > 1)
    return s[5] / np.sqrt(s[3]) / np.sqrt(s[4]), enough & ~flat(s[3], s[1]) & ~flat(s[4], s[2])


def _dense_batches(rolls: list[Roll], newest: str | None = None):
    columns = list(dict.fromkeys(c for r in rolls for c in _need(r)[1:] if c is not None))
    needs: dict = {}
    for r in rolls:
        needs.setdefault(_need(r), {}).setdefault(r.window, []).append(r)
    longest = max(r.window for r in rolls)

    def run(batches):
        old = {c: (np.zeros(longest - 1), np.zeros(longest - 1, bool)) for c in columns}
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            position = batch.column(POSITION).to_numpy(zero_copy_only=False).astype(np.int64)
            data = {}
            for c in columns:
                values = batch.column(c).cast(pa.float64())
                there = values.is_valid().to_numpy(zero_copy_only=False)
                values = values.fill_null(0.0).to_numpy(zero_copy_only=False)
                data[c] = np.concatenate([old[c][0], values]), np.concatenate([old[c][1], there])
                old[c] = tuple(x[size:] for x in data[c])
            out = {}
            ends = np.arange(longest - 1, longest - 1 + size)
            if newest is not None:
                chosen = np.flatnonzero(batch.column(newest).to_numpy(zero_copy_only=False) == 1)
                ends, position, batch = ends[chosen], position[chosen], batch.take(pa.array(chosen))
                size = len(chosen)
                if not size:
                    continue
            with np.errstate(all="ignore"):
                for need, by_window in needs.items():
                    levels = _doubled(need, data, max(by_window))
                    for w, wanted in by_window.items():
                        # A row reaches back to the first row of its chunk at most.
                        state = _dense_state(need, levels, ends, np.minimum(position, w))
                        out |= {r.out: _dense_value(r, state) for r in wanted}
            made = []
            for r in rolls:
                values, there = out[r.out]
                if r.fill is not None:
                    values, there = np.where(there, values, r.fill), np.ones(size, bool)
                made.append(pa.array(values, mask=~there))
            kept = [i for i, name in enumerate(batch.schema.names) if name != POSITION]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], *made], [*[batch.schema.names[i] for i in kept], *[r.out for r in rolls]])

    return run


def _add_dense(df: DataFrame, along: Window, rolls: list[Roll], newest: str | None = None) -> DataFrame:
    """Adds rolls over the rows of ``along``; its sort is the order in which a task gets its rows.

    With ``newest`` only rows where that column is 1 come out.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(r.out, T.DoubleType()) for r in rolls]])
    placed = df.select("*", F.row_number().over(along).alias(POSITION))
    out = placed.mapInArrow(_dense_batches(rolls, newest), schema)
    typed = {r.out: "bigint" if r.kind == "count" else df.schema[r.col].dataType
             for r in rolls if r.fill is None and r.kind in ("count", "min", "max", "range")}
    return out.withColumns({c: F.col(c).cast(t) for c, t in typed.items() if t != T.DoubleType()})


def add_rolls(chunks: Chunks, rolls: list[Roll], native_rows: int = NATIVE_ROWS, dense_rows: int = DENSE_ROWS) -> Chunks:
    """Add every rolling column to the chunked rows.

    All windows of up to ``dense_rows`` rows share one pass.  Without it, all
    short windows share one and each long window takes one more, which keeps
    only its results, so that the following sorts stay narrow.
    """
    slopes = any(r.kind == "slope" for r in rolls)
    if slopes:
        # Slopes do not change when the row number is counted from the chunk start.
        chunks.add(__x=(F.col(INDEX) - F.col(Chunks.CHUNK) * chunks.size).cast("double"))
    before = chunks.df.columns
    dense = [r for r in rolls if r.window <= dense_rows and _fits_double(chunks.df, r)]
    rest = [r for r in rolls if r not in dense]
    for w in sorted({r.window for r in rest if r.window > native_rows}):
        _add_long(chunks, w, [r for r in rest if r.window == w])
    short = [r for r in rest if r.window <= native_rows]
    if short:
        keep = chunks.df.columns
        needs = list(dict.fromkeys((r.window, _need(r)) for r in short))
        names = {need: f"__s{i}" for i, need in enumerate(needs)}
        chunks.add(**{name: _framed(need, chunks.rows(w)) for (w, need), name in names.items()})
        chunks.df = chunks.df.select(
            *keep, *[_value(r, F.col(names[r.window, _need(r)])).alias(r.out) for r in short]
        )
    if dense:
        chunks.df = _add_dense(chunks.df, chunks.window, dense)
    made = sorted(rolls, key=lambda r: r.window if r.window > native_rows else float("inf"))
    chunks.df = chunks.df.select(*[c for c in before if c != "__x"], *[r.out for r in made])
    return chunks


def _add_long(chunks: Chunks, w: int, rolls: list[Roll]) -> None:
    keep = chunks.df.columns
    needs = list(dict.fromkeys(_need(r) for r in rolls))
    names = {need: f"s{i}" for i, need in enumerate(needs)}
    number = F.floor(F.col(INDEX) / w)
    block = Window.partitionBy(*chunks.parts, "__block")
    up = block.orderBy(F.asc(INDEX)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = block.orderBy(F.desc(INDEX)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The same order as the row number, and the sort that ``up`` needs anyway.
    along = Window.partitionBy(*chunks.parts).orderBy("__block", INDEX)
    chunks.df = chunks.df.select("*", number.alias("__block")).select(
        "*", F.struct(*[_framed(n, down).alias(names[n]) for n in needs]).alias("__back")
    )
    reaches_back = F.col(INDEX) % w != w - 1
    chunks.df = chunks.df.select(
        *keep,
        F.struct(*[_framed(n, up).alias(names[n]) for n in needs]).alias("__head"),
        F.when(reaches_back, F.lag("__back", w - 1).over(along)).alias("__tail"),
    )
    head, tail = F.col("__head"), F.col("__tail")
    chunks.df = chunks.df.select(*keep, *[_merge(n, head[names[n]], tail[names[n]]).alias(f"__{names[n]}") for n in needs])
    chunks.df = chunks.df.select(*keep, *[_value(r, F.col(f"__{names[_need(r)]}")).alias(r.out) for r in rolls])


def rolling(
    df: DataFrame,
    rolls: list[Roll],
    series: Series | None = None,
    chunk_rows: int | None = None,
    native_rows: int = NATIVE_ROWS,
) -> DataFrame:
    """Add rolling columns to a table."""
    longest = max(r.window for r in rolls)
    chunks = Chunks(df, before=longest - 1, series=series, chunk_rows=chunk_rows)
    return add_rolls(chunks, rolls, native_rows).finish()


def newest_rolls(df: DataFrame, rolls: list[Roll], recency: str, keys: tuple = ("miner_id",)) -> DataFrame:
    """The rolling columns of the newest row only, one row per key.

    ``recency`` numbers the rows from 1 (newest).  A window that ends at the
    newest row is "recency <= window", so every value is a conditional
    aggregate and no frame slides.
    """
    df = df.withColumn("__x", -F.col(recency).cast("double"))
    if all(r.window <= DENSE_ROWS and _fits_double(df, r) for r in rolls):
        # Newest row last, so that its windows end with it; older rows than the longest window do not count.
        columns = list(dict.fromkeys(c for r in rolls for c in _need(r)[1:] if c is not None))
        slim = df.where(F.col(recency) <= max(r.window for r in rolls)).select(*keys, recency, *[c for c in columns if c not in (*keys, recency)])
        along = Window.partitionBy(*keys).orderBy(F.desc(recency))
        return _add_dense(slim, along, rolls, newest=recency).select(*keys, *[r.out for r in rolls])
    needs = list(dict.fromkeys((r.window, _need(r)) for r in rolls))
    names = {need: f"__s{i}" for i, need in enumerate(needs)}

    def within(w):
        return lambda c: F.when(F.col(recency) <= w, c)

    states = df.groupBy(*keys).agg(*[
        _state(need, lambda agg: agg, within(w)).alias(names[w, need]) for w, need in needs
    ])
    return states.select(*keys, *[_value(r, F.col(names[r.window, _need(r)])).alias(r.out) for r in rolls])
