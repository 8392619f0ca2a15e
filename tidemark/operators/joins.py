"""Joins in time: as-of, and the first hit of a barrier in a range."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Seconds of the pieces of time that are ordered by themselves.
PIECE_S = 86400
#: Rows that a search for first hits takes at once.
ROWS = 65536


def piece_of(at: Column, kind: str, seconds: int = PIECE_S) -> Column:
    """The number of the piece of time that holds a moment; one piece for what is no time."""
    if kind.startswith("timestamp"):
        return F.floor(F.unix_micros(at.cast("timestamp")) / (seconds * 1_000_000))
    return F.unix_date(at).cast("bigint") if kind == "date" else F.lit(0).cast("bigint")


def asof(left: DataFrame, right: DataFrame, by: str, on: str, values: dict[str, str], forward: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """Each left row with the last right row at or before it (the first at or after it, if forward).

    A union in order of time and the last value that is not null, within pieces
    of time; a piece that begins without one takes it from the pieces before,
    of which there is a row each. So a key of all rows is as many tasks as it
    has pieces. Rows of the left stay as they are, ties included; right rows of
    equal time are in order of `ties`. values: right column -> name in the result.
    """
    side = F.struct(*[F.col(c).alias(n) for c, n in values.items()]).alias("_v")
    none = F.lit(None).cast(right.select(side).schema["_v"].dataType).alias("_v")
    tie = F.struct(*[F.col(c) for c in ties]) if ties else F.lit(0)
    more = right.select(by, on, tie.alias("_tie"), side)
    rows = left.select(by, on, F.lit(None).cast(more.schema["_tie"].dataType).alias("_tie"), F.struct(*left.columns).alias("_row"), none)
    more = more.select(by, on, "_tie", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_v")
    every = rows.unionByName(more).withColumn("_piece", piece_of(F.col(on), left.schema[on].dataType.simpleString()))
    # At equal times the right side comes first (last, if forward is scanned backwards).
    mine = F.col("_row").isNotNull().cast("int")
    way = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    w = Window.partitionBy(by, "_piece").orderBy(way(on), mine, way("_tie"))
    found = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    at = F.when(F.col("_v").isNotNull(), F.struct(on, "_tie"))
    pieces = every.groupBy(by, "_piece").agg((F.min_by if forward else F.max_by)("_v", at).alias("_own"))
    before = Window.partitionBy(by).orderBy(way("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(F.col(by).alias("_by"), F.col("_piece").alias("_p"), F.last("_own", ignorenulls=True).over(before).alias("_carried"))
    hit = every.withColumn("_hit", found).filter("_row is not null")
    hit = hit.join(pieces, hit[by].eqNullSafe(F.col("_by")) & F.col("_piece").eqNullSafe(F.col("_p")), "left")
    return hit.withColumn("_hit", F.coalesce("_hit", "_carried")).select("_row.*", "_hit.*")


class Ticks:
    """Ticks in order of time, with maxima over blocks of 1, 2, 4, ... of them, for the first one at or beyond a level."""

    def __init__(self, at: np.ndarray, price: np.ndarray) -> None:
        self.at = at
        key = order_key(price)
        self.rising, self.falling = self.blocks(key), self.blocks(~key)

    @staticmethod
    def blocks(key: np.ndarray) -> list[np.ndarray]:
        out = [key]
        while len(out[-1]) > 1:
            if len(out[-1]) % 2:
                out[-1] = np.append(out[-1], np.iinfo(np.int64).min)
            out.append(np.maximum(out[-1][::2], out[-1][1::2]))
        return out

    @staticmethod
    def first(tree: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The first place in [lo, hi) whose key is at least the level, or -1."""
        out = np.full(len(lo), -1)
        open_, pos, met = np.arange(len(lo)), lo, []
        # Up: blocks that begin at the place, each as large as may be, until one holds the level.
        for k, keys in enumerate(tree):
            go = pos << k < hi[open_]
            open_, pos = open_[go], pos[go]
            if not len(open_):
                break
            ask = np.full(len(pos), k == len(tree) - 1) | (pos & 1 == 1)
            hit = ask.copy()
            hit[ask] = keys[pos[ask]] >= level[open_[ask]]
            met.append((open_[hit], pos[hit]))
            open_, pos = open_[~hit], (pos[~hit] + 1) >> 1
        # Down: the first half that holds it.
        own = at = np.zeros(0, np.int64)
        for k in range(len(met) - 1, -1, -1):
            own, at = np.append(own, met[k][0]), np.append(at, met[k][1])
            if k:
                at = at << 1
                at += tree[k - 1][at] < level[own]
        out[own] = np.where(at < hi[own], at, -1)
        return out


def order_key(x: np.ndarray) -> np.ndarray:
    """Whole numbers in Spark's order of doubles: zeros alike, NaN above all."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    bits[np.isnan(x)] = np.iinfo(np.int64).max
    return np.where(bits < 0, bits ^ np.iinfo(np.int64).max, bits)


def _find(step: int, rises: list[bool]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over key, piece, time and price of ticks, then of bets with their row and levels, in order of all of these.

    Groups are taken together, as many as a batch holds; of the last one the
    ticks stay for the next batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, ticks = None, [], None
        for batch in _gather(batches, max(1, min(ROWS, 2**62 // (2 * step)))):
            key, piece, n = batch.column(0), batch.column(1), batch.num_rows
            new = np.ones(n, bool)
            same = pc.and_(pc.equal(key[1:], key[:-1]), pc.equal(piece[1:], piece[:-1]))
            new[1:] = ~pc.fill_null(same, False).to_numpy(zero_copy_only=False)
            new[0] = last is None or None in last or last != (key[0].as_py(), piece[0].as_py())
            last = key[n - 1].as_py(), piece[n - 1].as_py()
            group = np.cumsum(new)
            # Microseconds from the piece's begin, groups one behind the other; no tick is over two pieces from it.
            at = batch.column(3).fill_null(0).to_numpy() - piece.fill_null(0).to_numpy() * step
            bet = batch.column(2).to_numpy(zero_copy_only=False)
            # The group of number 0 is the one that the last batch began.
            if new[0]:
                held, ticks = [], None
            if not bet.all():
                held.append((group[~bet] * (2 * step) + at[~bet], batch.column(4).filter(pa.array(~bet)).to_numpy()))
                ticks = None
            if bet.any():
                if ticks is None:
                    held = [tuple(map(np.concatenate, zip(*held)))] if held else [(np.zeros(0, np.int64), np.zeros(0))]
                    ticks = Ticks(*held[0])
                own = batch.filter(pa.array(bet))
                begin = group[bet] * (2 * step) + at[bet]
                lo, hi = (np.searchsorted(ticks.at, x, "right") for x in (begin, begin + step))
                hi = np.where(own.column(3).is_valid().to_numpy(zero_copy_only=False), hi, lo)
                out = [own.column(5)]
                for rise, level in zip(rises, own.columns[6:]):
                    known = level.is_valid().to_numpy(zero_copy_only=False)
                    want = order_key(level.fill_null(0.0).to_numpy())
                    place = Ticks.first(ticks.rising if rise else ticks.falling, lo, np.where(known, hi, lo), want if rise else ~want)
                    wait = ticks.at[place] - begin if len(ticks.at) else place
                    out.append(pa.array(own.column(3).fill_null(0).to_numpy() + wait, mask=place < 0))
                yield pa.RecordBatch.from_arrays(out, ["_row", *own.schema.names[6:]])
            if group[-1]:
                # Of the last group alone, which is number 0 from now on.
                mine = [(t - group[-1] * (2 * step), p, t >= group[-1] * (2 * step)) for t, p in held]
                held = [(t[m], p[m]) for t, p, m in mine if m.any()]
                ticks = None

    return run


def _gather(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many at most, and not many fewer."""
    some, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            batch = batch.slice(part.num_rows)
            some.append(part)
            n += part.num_rows
            if n == rows:
                yield pa.concat_batches(some)
                some, n = [], 0
    if n:
        yield pa.concat_batches(some)


def first_hits(bets: DataFrame, ticks: DataFrame, horizon_s: int, levels: dict[str, tuple[bool, Column]], by: str = "symbol") -> DataFrame:
    """For each bet (id, symbol, t0) the first tick in (t0, t0 + horizon] at or beyond each level.

    levels: name -> whether the price must rise to it (or fall), and the level
    over bet columns. Time is cut into pieces of one horizon; a piece of bets
    meets its ticks and those of the next, in order, so that a search in blocks
    of doubling size finds each hit: n log n of the ticks in a horizon, not
    their square. A worker holds the ticks of two pieces, some 48 bytes each.
    Equal bets are one.
    """
    step = horizon_s * 1_000_000
    at = F.unix_micros("t0")
    number = lambda c: F.floor((c - F.pmod(c, F.lit(step))) / step)
    level = [c.cast("double").alias(name) for name, (_, c) in levels.items()]
    left = bets.distinct().select(F.col(by).alias("_key"), number(at).alias("_piece"), F.lit(True).alias("_bet"), at.alias("_at"), F.lit(None).cast("double").alias("_price"), F.struct(*bets.columns).alias("_row"), *level)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema[5:]]
    right = ticks.select(F.col(by).alias("_key"), F.unix_micros("ts").alias("_at"), F.col("price").cast("double").alias("_price"))
    right = right.filter("_key is not null and _at is not null and _price is not null")
    own = number(F.col("_at"))
    right = right.select("_key", F.explode(F.array(own - 1, own)).alias("_piece"), F.lit(False).alias("_bet"), "_at", "_price", *none)
    rows = left.unionByName(right).repartition("_key", "_piece").sortWithinPartitions("_key", "_piece", "_bet", "_at")
    kind = T.StructType([left.schema["_row"], *[T.StructField(name, T.LongType()) for name in levels]])
    found = rows.mapInArrow(_find(step, [rise for rise, _ in levels.values()]), kind)
    return found.select("_row.*", *[F.timestamp_micros(name).alias(name) for name in levels])


def _barriers(target: float | Column, stop: float | Column, spread: float) -> dict[str, tuple[bool, Column]]:
    c, a = F.col("close"), F.col("atr")
    return {
        "long_pt": (True, c + a * target + spread),
        "long_sl": (False, c - a * stop + spread),
        "short_pt": (False, c - a * target - spread),
        "short_sl": (True, c + a * stop - spread),
    }


def _labels(hits: DataFrame, horizon_s: int) -> DataFrame:
    out = hits
    for side in ("long", "short"):
        pt, sl = F.col(f"{side}_pt"), F.col(f"{side}_sl")
        won = pt.isNotNull() & (sl.isNull() | (pt < sl))
        end = F.when(won, pt).otherwise(sl)
        minutes = F.coalesce((F.unix_micros(end) - F.unix_micros("t0")) / 60e6, F.lit(horizon_s / 60.0))
        out = out.withColumns({f"label_{side}": won.cast("int"), f"duration_{side}": minutes})
    return out.drop("long_pt", "long_sl", "short_pt", "short_sl")


def triple_barrier(bets: DataFrame, ticks: DataFrame, horizon_s: int, target: float, stop: float, spread: float) -> DataFrame:
    """Labels and durations (minutes) of long and short bets (id, symbol, t0, close, atr).

    A bet wins if its target is hit before its stop, and before the horizon ends.
    """
    return _labels(first_hits(bets, ticks, horizon_s, _barriers(target, stop, spread)), horizon_s)


def barrier_grid(bets: DataFrame, ticks: DataFrame, horizon_s: int, grid: list[tuple[float, float]], spread: float) -> DataFrame:
    """triple_barrier of every bet with each target and stop (columns pt, sl) of the grid, in one pass over the ticks."""
    levels = {f"_{i}_{name}": level for i, (pt, sl) in enumerate(grid) for name, level in _barriers(pt, sl, spread).items()}
    hits = first_hits(bets, ticks, horizon_s, levels)
    sets = [
        F.struct(F.lit(float(pt)).alias("pt"), F.lit(float(sl)).alias("sl"), *[F.col(f"_{i}_{name}").alias(name) for name in _barriers(pt, sl, spread)])
        for i, (pt, sl) in enumerate(grid)
    ]
    return _labels(hits.select(*bets.columns, F.explode(F.array(*sets)).alias("_set")).select(*bets.columns, "_set.*"), horizon_s)


def concurrency(bets: DataFrame) -> DataFrame:
    """How many intervals [t0, t1] of a symbol are open at each start, and the weight 1 / that.

    A sweep over starts (+1) and ends (-1); at equal times starts come first.
    """
    events = bets.select("symbol", F.col("t0").alias("at"), F.lit(1).alias("step")).unionAll(
        bets.select("symbol", F.col("t1").alias("at"), F.lit(-1).alias("step"))
    )
    events = events.withColumn("_piece", piece_of(F.col("at"), events.schema["at"].dataType.simpleString()))
    # Within pieces of time, on top of what the pieces before them leave open.
    pieces = events.groupBy("symbol", "_piece").agg(F.sum("step").alias("left"))
    before = Window.partitionBy("symbol").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("symbol", "_piece", F.coalesce(F.sum("left").over(before), F.lit(0)).alias("open"))
    w = Window.partitionBy("symbol", "_piece").orderBy("at", F.desc("step"))
    level = events.withColumn("level", F.sum("step").over(w)).filter("step = 1").join(pieces, ["symbol", "_piece"])
    level = level.withColumn("level", F.col("level") + F.col("open"))
    level = level.groupBy("symbol", "at").agg(F.max("level").alias("concurrency"))
    out = bets.join(level, (bets["symbol"] == level["symbol"]) & (bets["t0"] == level["at"]), "left").drop(level["symbol"]).drop("at")
    return out.withColumn("uniqueness", F.coalesce(F.try_divide(F.lit(1.0), F.col("concurrency")), F.lit(0.0)))
