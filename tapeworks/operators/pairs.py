"""Pair screening. Statistics of all pairs come from products of blocks of symbols, and what is asked of the pairs that pass
is computed in the same task, where both series are; so no series travels once for each pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators.ordered import stored

#: Symbols and cells (symbols x dates) of a block at most, fewest blocks of a large table, symbols of a tile,
#: pairs that are measured at once.
BLOCK, CELLS, SPREAD, TILE, BATCH = 8192, 4_000_000, 12, 512, 1024


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a column of lists; nulls are NaN."""
    one = column.combine_chunks()
    one = one.combine_chunks() if isinstance(one, pa.ChunkedArray) else one
    return np.diff(one.offsets.to_numpy()), one.flatten().to_numpy(zero_copy_only=False)


class Block:
    """A task's symbols in the order of their names, and values as a matrix of symbols and dates, NaN where there is none."""

    def __init__(self, table: pa.Table) -> None:
        name = np.array(table.column("symbol").to_pylist(), dtype=object)
        order = np.argsort(name, kind="stable")
        self.names = name[order]
        self.labels = pa.array(self.names, pa.string())
        self.side = table.column("own").to_numpy()[order] != table.column("one")[0].as_py()
        self.one_block = table.column("one")[0].as_py() == table.column("two")[0].as_py()
        count, day = _lists(table.column("days"))
        place = np.argsort(order, kind="stable")
        row = np.repeat(place, count)
        when, at = np.unique(day, return_inverse=True)
        self.values = {}
        for c in ("x", "y"):
            if c in table.column_names:
                self.values[c] = np.full((len(name), len(when)), np.nan)
                self.values[c][row, at] = _lists(table.column(c))[1].astype(float)

    def _tile(self, at: np.ndarray, single: bool) -> tuple[np.ndarray, ...]:
        x = self.values["x"][at]
        here = ~np.isnan(x)
        n = np.maximum(here.sum(1), 1)
        x = np.where(here, x - (np.where(here, x, 0).sum(1) / n)[:, None], 0)  # less their mean, so that sums keep their digits
        if single:
            sd = np.sqrt((x * x).sum(1) / n)
            x = (x / np.where(sd > 0, sd, 1)[:, None]).astype(np.float32)
        return here.astype(x.dtype), x, x * x

    def _tiles(self, single: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """(left, right, wanted, n, covariance, variances, mean squares) of two tiles of symbols on their common dates."""
        one, two = np.flatnonzero(~self.side), np.flatnonzero(self.side)
        tiles = lambda at: [at[k : k + TILE] for k in range(0, len(at), TILE)]
        for p, left in enumerate(tiles(one)):
            ha, va, qa = self._tile(left, single)
            for q, right in enumerate(tiles(one if self.one_block else two)):
                if self.one_block and q < p:
                    continue
                hb, vb, qb = self._tile(right, single)
                wanted = np.triu(np.ones((len(left), len(right)), bool), 1) if self.one_block and q == p else np.ones((len(left), len(right)), bool)
                with np.errstate(divide="ignore", invalid="ignore"):
                    n = ha @ hb.T
                    ma, mb, sa, sb = (va @ hb.T) / n, (ha @ vb.T) / n, (qa @ hb.T) / n, (ha @ qb.T) / n
                    yield left, right, wanted, n, (va @ vb.T) / n - ma * mb, sa - ma * ma, sb - mb * mb, sa, sb

    def pairs(self, least_common: int, least_corr: float | None) -> Iterator[tuple[np.ndarray, ...]]:
        """(i, j, n, corr) by tiles: positions i < j of the pairs that pass, of one symbol of each block."""
        for left, right, good, n, cov, ra, rb, _, _ in self._tiles(single=False):
            with np.errstate(divide="ignore", invalid="ignore"):
                corr = cov / np.sqrt(ra * rb)
            good &= n >= least_common
            if least_corr is not None:
                good &= np.nan_to_num(corr, nan=-2.0) >= least_corr
            i, j = np.nonzero(good)
            a, b = left[i], right[j]
            yield np.minimum(a, b), np.maximum(a, b), n[i, j].astype(np.int64), corr[i, j]

    def near(self, least_common: int, least_corr: float | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j), BATCH at most, of all pairs that may pass: products in single precision leave out only what is clearly
        below the correlation, and nothing where they lose digits."""
        for left, right, good, n, cov, ra, rb, sa, sb in self._tiles(single=True):
            good &= n >= least_common
            if least_corr is not None:
                with np.errstate(invalid="ignore"):
                    good &= (ra <= 0.05 * sa) | (rb <= 0.05 * sb) | (cov >= (least_corr - 0.001) * np.sqrt(ra * rb))
            i, j = np.nonzero(good)
            a, b = left[i], right[j]
            for k in range(0, len(i), BATCH):
                yield np.minimum(a[k : k + BATCH], b[k : k + BATCH]), np.maximum(a[k : k + BATCH], b[k : k + BATCH])

    def measured(self, least_common: int, least_corr: float | None) -> Iterator[Pairs]:
        """The pairs that pass, by batches, each with its series on the common dates."""
        for i, j in self.near(least_common, least_corr):
            found = Pairs(self, i, j, "x")
            found.measure()
            good = found.n >= least_common
            if least_corr is not None:
                good &= np.nan_to_num(found.corr, nan=-2.0) >= least_corr
            if good.any():
                yield found.where(good)


class Pairs:
    """Pairs of a block by rows: y and x are both series on their common dates, at the right end of the row (`here`)."""

    def __init__(self, of: Block, i: np.ndarray, j: np.ndarray, c: str) -> None:
        self.of, self.i, self.j = of, i, j
        a, b = of.values[c][i], of.values[c][j]
        both = ~np.isnan(a + b)
        self.n = both.sum(1)
        width = int(self.n.max(initial=0))
        self.here = np.arange(width) >= width - self.n[:, None]
        self.y, self.x = np.zeros(self.here.shape), np.zeros(self.here.shape)
        self.y[self.here], self.x[self.here] = a[both], b[both]

    def measure(self) -> None:
        (dy, my), (dx, mx) = less_mean(self.y, self.here), less_mean(self.x, self.here)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.corr = products(dy, dx) / np.sqrt(products(dy, dy) * products(dx, dx))
        self.beta = slopes(dy, dx)
        self.alpha = my - self.beta * mx

    def where(self, good: np.ndarray) -> Pairs:
        if not good.all():
            for c, x in vars(self).items():
                if c != "of":
                    setattr(self, c, x[good])
        return self

    def names(self) -> dict[str, pa.Array]:
        return {"a": self.of.labels.take(pa.array(self.i)), "b": self.of.labels.take(pa.array(self.j))}

    def spread(self) -> np.ndarray:
        return self.y - self.beta[:, None] * self.x


def products(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", y, x)


def less_mean(x: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows less their mean over `here`, 0 elsewhere, and the means."""
    with np.errstate(invalid="ignore"):
        mean = (x * here).sum(1) / here.sum(1)
        return (x - mean[:, None]) * here, mean


def slopes(dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """Slopes of rows on rows, both less their mean; NaN without spread, exactly 1 for equal rows."""
    v = products(dx, dx)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(v > 0, products(dy, dx) / v, np.nan)


def known(x: np.ndarray) -> pa.Array:
    """Nulls for NaN."""
    return pa.array(x, mask=np.isnan(x))


def over_pairs(rows: DataFrame, run: Callable[[Block], Iterator[dict[str, list]]], schema: str, least: int, block: int | None = None) -> DataFrame:
    """What `run` yields for each two blocks of the symbols that have x on `least` dates or more; rows: symbol, date, x and,
    if wanted, y.

    A symbol is one row with its dates and values. Symbols are dealt into blocks of `block`, or as few as a task can hold, so
    a series travels once for each block; tables of less than one block are still dealt over some tasks."""
    cols = [c for c in ("x", "y") if c in rows.columns]
    cells = F.struct(F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day"), *[F.col(c).cast("double").alias(c) for c in cols])
    series = rows.where("symbol is not null and date is not null").groupBy("symbol").agg(F.array_sort(F.collect_list(cells)).alias("s"), F.count("x").alias("k")).where(F.col("k") >= least)
    series = stored(series.select("symbol", F.col("s.day").alias("days"), *[F.col(f"s.{c}").alias(c) for c in cols]))
    n, days = series.count(), series.select(F.explode("days")).distinct().count()  # two numbers
    blocks = 1 + n // block if block else max(min(SPREAD, 1 + n // 64), 1 + n // BLOCK, 1 + n * days // CELLS)
    dealt = series.withColumn("own", F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "symbol", "days", *cols)
    types = [x.split()[1] for x in schema.split(", ")]
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[t]) for c, t in zip(names, types, strict=True)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in run(Block(pa.Table.from_batches(list(batches)))):
            yield pa.RecordBatch.from_pydict({c: found[c] if isinstance(found[c], pa.Array) else pa.array(found[c], t) for c, t in zip(names, arrow.types, strict=True)}, schema=arrow)

    return dealt.groupBy("one", "two").applyInArrow(task, schema)


def pair_statistics(bars: DataFrame, value: str = "close", least_bars: int = 250, least_common: int = 100, least_corr: float | None = None, block: int | None = None) -> DataFrame:
    """a, b (a < b), n, corr, beta, alpha of b's and a's values on common dates: a = alpha + beta * b; the pairs that have
    enough common dates and, if asked, correlation."""

    def run(of: Block) -> Iterator[dict[str, list]]:
        for p in of.measured(least_common, least_corr):
            yield p.names() | {"n": p.n, "corr": p.corr, "beta": p.beta, "alpha": p.alpha}

    return over_pairs(bars.select("symbol", "date", F.col(value).alias("x")), run, "a string, b string, n long, corr double, beta double, alpha double", least_bars, block)


def pair_correlations(bars: DataFrame, value: str = "close", least_bars: int = 250, least_common: int = 100, least_corr: float | None = None, block: int | None = None) -> DataFrame:
    """a, b, n, corr of pair_statistics() only, which the block products give."""

    def run(of: Block) -> Iterator[dict[str, list]]:
        for i, j, n, corr in of.pairs(least_common, least_corr):
            yield {"a": of.names[i], "b": of.names[j], "n": n, "corr": corr}

    return over_pairs(bars.select("symbol", "date", F.col(value).alias("x")), run, "a string, b string, n long, corr double", least_bars, block)


def each_correlated_pair(bars: DataFrame, corr: float, each: Callable[[Pairs], dict], schema: str, least_bars: int = 250, least_common: int = 100, block: int | None = None) -> DataFrame:
    """a, b and the columns that `each` returns for a batch of the pairs of correlated_pairs(), with both closes."""

    def run(of: Block) -> Iterator[dict]:
        for p in of.measured(least_common, corr):
            yield p.names() | each(p)

    return over_pairs(bars.select("symbol", "date", F.col("close").alias("x")), run, f"a string, b string, {schema}", least_bars, block)


def correlated_pairs(bars: DataFrame, corr: float = 0.7, **how: int) -> DataFrame:
    return pair_statistics(bars, least_corr=corr, **how)


def pair_signals(bars: DataFrame, corr: float = 0.7, window: int = 90, limit: float = 2.0) -> DataFrame:
    """pair_signal() of pair_spread() of the correlated pairs, each in one task with its series."""

    def each(p: Pairs) -> dict:
        last = p.spread()[:, -window:]
        with np.errstate(divide="ignore", invalid="ignore"):
            sd = last.std(1, ddof=1)
            z = np.where((p.n >= window) & (sd > 0), (last[:, -1] - last.mean(1)) / sd, np.nan)
            return {"z": known(z), "signal": np.where(z <= -limit, "LONG", np.where(z >= limit, "SHORT", "NONE")).astype(object)}

    return each_correlated_pair(bars, corr, each, "z double, signal string")


def pair_half_lives(bars: DataFrame, corr: float = 0.7) -> DataFrame:
    """half_life() of pair_spread() of the correlated pairs, each in one task with its series."""

    def each(p: Pairs) -> dict:
        spread, here = p.spread(), p.here[:, :-1]
        phi = slopes(less_mean(spread[:, 1:], here)[0], less_mean(spread[:, :-1], here)[0])
        with np.errstate(divide="ignore", invalid="ignore"):
            return {"phi": known(phi), "half_life": known(np.where((phi > 0) & (phi < 1), -np.log(2.0) / np.log(phi), np.nan))}

    return each_correlated_pair(bars, corr, each, "phi double, half_life double")


def pair_unit_roots(bars: DataFrame, corr: float = 0.7, least: int = 30) -> DataFrame:
    """pair_adf() of pair_spread() of the correlated pairs, each in one task with its series."""
    return each_correlated_pair(bars, corr, lambda p: unit_root_tests(p.spread(), p.here, least), "adf double, p_value double, cointegrated boolean")


def pair_spread(pairs: DataFrame, bars: DataFrame, window: int = 90) -> DataFrame:
    """Spread a - beta * b by date of the chosen pairs, and its z against the last `window` (sample deviation)."""
    one = bars.select(F.col("symbol").alias("a"), "date", F.col("close").alias("y"))
    two = bars.select(F.col("symbol").alias("b"), "date", F.col("close").alias("x"))
    rows = pairs.select("a", "b", "beta").join(one, "a").join(two, ["b", "date"]).withColumn("spread", F.col("y") - F.col("beta") * F.col("x"))
    f = Window.partitionBy("a", "b").orderBy("date").rowsBetween(-(window - 1), 0)
    sd = F.stddev_samp("spread").over(f)
    return rows.select("a", "b", "date", "spread", F.when((F.count("spread").over(f) == window) & (sd > 0), (F.col("spread") - F.avg("spread").over(f)) / sd).alias("z"))


def pair_signal(spread: DataFrame, limit: float = 2.0) -> DataFrame:
    """LONG below -limit, SHORT above limit, else NONE, at each pair's last date."""
    last = spread.groupBy("a", "b").agg(F.max_by("z", "date").alias("z"))
    return last.withColumn("signal", F.when(F.col("z") <= -limit, "LONG").when(F.col("z") >= limit, "SHORT").otherwise("NONE"))


def half_life(spread: DataFrame) -> DataFrame:
    """-ln 2 / ln phi of the spread's first-order autoregression; null unless 0 < phi < 1."""
    w = Window.partitionBy("a", "b").orderBy("date")
    rows = spread.withColumn("back", F.lag("spread").over(w)).where("back is not null")
    out = rows.groupBy("a", "b").agg(F.regr_slope("spread", "back").alias("phi"))
    return out.withColumn("half_life", F.when((F.col("phi") > 0) & (F.col("phi") < 1), -F.log(F.lit(2.0)) / F.log("phi")))


#: Response surface of the constant-only unit-root test with one variable (published tables).
_TAU_STAR, _TAU_MIN, _TAU_MAX = -1.61, -18.83, 2.74
_SMALL = (2.1659, 1.4412, 0.038269)
_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def _normal(x: float) -> float:
    from math import erf, sqrt

    return 0.5 * (1 + erf(x / sqrt(2)))


def unit_root_p(tau: float) -> float:
    if tau > _TAU_MAX:
        return 1.0
    if tau < _TAU_MIN:
        return 0.0
    coef = _SMALL if tau <= _TAU_STAR else _LARGE
    return _normal(sum(c * tau**i for i, c in enumerate(coef)))


def adf_statistic(x: np.ndarray) -> float:
    """Unit-root t statistic with a constant; no or one lagged difference, by AIC on the common sample."""
    d = np.diff(x)
    best = None
    for lags in (0, 1):
        y = d[1:]
        cols = [x[1:-1], np.ones(len(y))] + ([d[:-1]] if lags else [])
        m = np.stack(cols, 1)
        coef, *_ = np.linalg.lstsq(m, y, rcond=None)
        rss = float(((y - m @ coef) ** 2).sum())
        aic = len(y) * np.log(max(rss, 1e-300) / len(y)) + 2 * m.shape[1]
        best = min(best, (aic, lags)) if best else (aic, lags)
    lags = best[1]
    y = d[lags:]
    m = np.stack([x[lags:-1], np.ones(len(y))] + ([d[:-1]] if lags else []), 1)
    coef, *_ = np.linalg.lstsq(m, y, rcond=None)
    s2 = ((y - m @ coef) ** 2).sum() / max(len(y) - m.shape[1], 1)
    return float(coef[0] / np.sqrt(s2 * np.linalg.pinv(m.T @ m)[0, 0]))


def unit_root_test(x: np.ndarray, least: int = 30) -> tuple[float, float, bool]:
    """(statistic, p-value, p < 0.05); NaN with fewer values or no spread."""
    t = adf_statistic(x) if len(x) >= least and x.std() > 0 else np.nan
    p = unit_root_p(t) if t == t else np.nan
    return t, p, bool(p < 0.05)


def unit_root_tests(x: np.ndarray, here: np.ndarray, least: int = 30) -> dict[str, np.ndarray]:
    """unit_root_test() of rows at once, by sums of products; rows whose columns nearly depend on each other go through it."""
    n = here.sum(1)
    d, one, two = x[:, 1:] - x[:, :-1], here[:, :-1], here[:, :-2]
    with np.errstate(divide="ignore", invalid="ignore"):
        y, u, v = (less_mean(c, two)[0] for c in (d[:, 1:], x[:, 1:-1], d[:, :-1]))
        uu, uv, vv, uy, vy = products(u, u), products(u, v), products(v, v), products(u, y), products(v, y)
        det = uu * vv - uv * uv
        b = (vv * uy - uv * vy) / det
        rss = [((y - beta[:, None] * u - lag[:, None] * v) ** 2).sum(1) for beta, lag in ((uy / uu, np.zeros(len(x))), (b, (uu * vy - uv * uy) / det))]
        aic = [(n - 2) * np.log(np.maximum(r, 1e-300) / (n - 2)) + 2 * k for k, r in enumerate(rss, 2)]
        lagged = b / np.sqrt(rss[1] / np.maximum(n - 5, 1) * vv / det)
        y, u = (less_mean(c, one)[0] for c in (d, x[:, :-1]))
        b, w = slopes(y, u), products(u, u)
        plain = b / np.sqrt(((y - b[:, None] * u) ** 2).sum(1) / np.maximum(n - 3, 1) / w)
        spread = less_mean(x, here)[0]
        some = (n >= least) & (products(spread, spread) > 0)
        clear = (det > 1e-10 * uu * vv) & (w > 0)
    t = np.where(some, np.where(aic[1] < aic[0], lagged, plain), np.nan)
    for k in np.flatnonzero(some & ~clear).tolist():
        t[k] = adf_statistic(x[k][here[k]])
    p = np.array([unit_root_p(k) if k == k else np.nan for k in t.tolist()])
    return {"adf": t, "p_value": p, "cointegrated": p < 0.05}


def pair_adf(spread: DataFrame, least: int = 30) -> DataFrame:
    """Unit-root test of each pair's spread: statistic, p-value, cointegrated (p < 0.05)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        t, p, hit = unit_root_test(g.sort_values("date")["spread"].to_numpy(float), least)
        return pd.DataFrame({"a": [g["a"].iat[0]], "b": [g["b"].iat[0]], "adf": [t], "p_value": [p], "cointegrated": [hit]})

    return spread.select("a", "b", "date", "spread").groupBy("a", "b").applyInPandas(run, "a string, b string, adf double, p_value double, cointegrated boolean")


def top_return_pairs(returns: DataFrame, least: int = 120, k: int = 12) -> DataFrame:
    """The k pairs with the highest correlation, equal to nine decimals by a and b; a task passes on its own k only."""

    def run(of: Block) -> Iterator[dict[str, list]]:
        best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        for i, j, n, corr in of.pairs(least, None):
            rank = np.round(corr, 9)
            some = ~np.isnan(rank)
            if len(best[0]) == k:
                some &= rank >= np.round(best[3][-1], 9)
            best = [np.concatenate([old, new[some]]) for old, new in zip(best, (i, j, n, corr), strict=True)]
            first = np.lexsort((best[1], best[0], -np.round(best[3], 9)))[:k]
            best = [c[first] for c in best]
        yield {"a": of.names[best[0]], "b": of.names[best[1]], "n": best[2], "corr": best[3]}

    rows = over_pairs(returns.select("symbol", "date", F.col("ret").alias("x")), run, "a string, b string, n long, corr double", least)
    return rows.orderBy(F.round("corr", 9).desc(), "a", "b").limit(k)


def lead_lag_market(returns: DataFrame) -> DataFrame:
    """Per symbol: correlation with the market, with the market of the day before, and with its own day before."""
    market = returns.groupBy("date").agg(F.avg("ret").alias("m"))
    back = market.withColumn("m1", F.lag("m").over(Window.orderBy("date")))
    rows = returns.join(back, "date").withColumn("r1", F.lag("ret").over(Window.partitionBy("symbol").orderBy("date")))
    return rows.groupBy("symbol").agg(F.corr("ret", "m").alias("market_corr"), F.corr("ret", "m1").alias("lead_corr"), F.corr("ret", "r1").alias("auto_corr"), F.count("*").alias("n"))


def backtest_pair_series(z: np.ndarray, ratio: np.ndarray, enter: float, leave: float, stop: float, mark: bool = False) -> list[tuple[int, int, int, float, str]]:
    """(entry, exit, side, log profit, reason) of trades that sell a high ratio and buy a low one; with mark, one still open
    ends at the last bar."""
    out, side, at = [], 0, 0
    for i, v in enumerate(z.tolist()):
        if v != v:
            continue
        if side == 0:
            if abs(v) >= enter:
                side, at = (-1 if v > 0 else 1), i
        elif abs(v) >= stop or abs(v) <= leave:
            out.append((at, i, side, float(side * (ratio[i] - ratio[at])), "stop" if abs(v) >= stop else "exit"))
            side = 0
    if mark and side:
        out.append((at, len(z) - 1, side, float(side * (ratio[-1] - ratio[at])), "open"))
    return out


def ratio_z(ratio: np.ndarray, n: int) -> np.ndarray:
    """z of a series against its last n values (population deviation); NaN before and without spread."""
    z = np.full(len(ratio), np.nan)
    if len(ratio) >= n:
        w = np.lib.stride_tricks.sliding_window_view(ratio, n)
        mean, sd = w.mean(1), w.std(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            z[n - 1 :] = np.where(w.max(1) > w.min(1), (ratio[n - 1 :] - mean) / sd, np.nan)
    return z


def ratio_zs(ratio: np.ndarray, here: np.ndarray, n: int) -> np.ndarray:
    """ratio_z() of rows whose values are at the right end."""
    z = np.full(ratio.shape, np.nan)
    m = ratio.shape[1] - n + 1
    if m < 1:
        return z
    mean, square = np.zeros((len(ratio), m)), np.zeros((len(ratio), m))
    for k in range(n):
        mean += ratio[:, k : k + m]
    mean /= n
    for k in range(n):
        d = ratio[:, k : k + m] - mean
        d *= d
        square += d
    moves = np.zeros(ratio.shape, np.int32)
    np.cumsum(ratio[:, 1:] != ratio[:, :-1], axis=1, out=moves[:, 1:])
    with np.errstate(divide="ignore", invalid="ignore"):
        z[:, n - 1 :] = np.where(here[:, :m] & (moves[:, n - 1 :] > moves[:, :m]), (ratio[:, n - 1 :] - mean) / np.sqrt(square / n), np.nan)
    return z


def backtest_rows(z: np.ndarray, enter: float, leave: float, stop: float, mark: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """backtest_pair_series() of rows at once: (rows, entry, exit, side) of the trades that end at a bar, bar by bar."""
    side, at = np.zeros(len(z), np.int8), np.zeros(len(z), np.int64)
    level = np.abs(z)
    enters, leaves = np.ascontiguousarray((level >= enter).T), np.ascontiguousarray(((level >= stop) | (level <= leave)).T)
    for k in range(z.shape[1]):
        flat = side == 0
        end = np.flatnonzero(leaves[k] & ~flat)
        start = np.flatnonzero(enters[k] & flat)
        if len(end):
            yield end, at[end], np.full(len(end), k), side[end]
            side[end] = 0
        if len(start):
            side[start], at[start] = np.where(z[start, k] > 0, -1, 1), k
    end = np.flatnonzero(side) if mark else []
    if len(end):
        yield end, at[end], np.full(len(end), z.shape[1] - 1), side[end]


def backtest_pairs(bars: DataFrame, corr: float = 0.7, n: int = 20, enter: float = 2.0, leave: float = 0.5, stop: float = 4.0) -> DataFrame:
    """Summary of each correlated pair's trades on the z of its log price ratio (population deviation), where both closes are
    positive; pairs without such a date have no row."""

    def run(of: Block) -> Iterator[dict]:
        close = of.values["x"]
        of.values["log"] = np.log(np.where(close > 0, close, np.nan))
        for p in of.measured(100, corr):
            p = Pairs(of, p.i, p.j, "log")
            p = p.where(p.n > 0)
            ratio = p.y - p.x
            count, wins, total = np.zeros(len(ratio), np.int64), np.zeros(len(ratio), np.int64), np.zeros(len(ratio))
            for rows, start, end, side in backtest_rows(ratio_zs(ratio, p.here, n), enter, leave, stop):
                gain = side * (ratio[rows, end] - ratio[rows, start])
                count[rows] += 1
                wins[rows] += gain > 0
                total[rows] += gain
            with np.errstate(invalid="ignore"):
                yield p.names() | {"trades": count, "win_rate": wins / count, "total": total}

    return over_pairs(bars.select("symbol", "date", F.col("close").alias("x")), run, "a string, b string, trades long, win_rate double, total double", 250)


def scan_pairs(bars: DataFrame, least_corr: float = 0.5, overlap: int = 120, n: int = 20, enter: float = 2.0, leave: float = 0.5, stop: float = 4.0, trades: int = 5, top: int = 20) -> DataFrame:
    """The `top` pairs by total profit of the spread strategy, among pairs whose returns correlate by `least_corr` over at
    least `overlap` common sessions and that traded `trades` times or more.

    A trade sells the dearer and buys the cheaper symbol at abs(z) >= enter of the log ratio (population deviation of n
    bars), leaves at abs(z) <= leave or >= stop, or at the last bar; its profit is the difference of both simple returns. Returns
    are those between a symbol's own positive closes. Pairs come from block products and are traded in the same task."""
    back = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    rows = bars.where("close > 0").select("symbol", "date", (F.col("close") / back - 1).alias("x"), F.col("close").alias("y"))

    names = ("corr", "bars", "trades", "win_rate", "mean_profit", "total_profit", "mean_bars")

    def run(of: Block) -> Iterator[dict]:
        best = [np.empty(0, np.int64), np.empty(0, np.int64), *[np.empty(0)] * len(names)]
        for of_returns in of.measured(overlap - 1, least_corr):
            p = Pairs(of, of_returns.i, of_returns.j, "y")
            y, x = np.where(p.here, p.y, 1), np.where(p.here, p.x, 1)
            ratio = np.log(y) - np.log(x)
            count, wins, total, held = (np.zeros(len(ratio)) for _ in range(4))
            for rows, start, end, side in backtest_rows(ratio_zs(ratio, p.here, n), enter, leave, stop, mark=True):
                gain = (side * ((y[rows, end] / y[rows, start] - 1) - (x[rows, end] / x[rows, start] - 1))).round(4)
                count[rows] += 1
                wins[rows] += gain > 0
                total[rows] += gain
                held[rows] += end - start
            good = (p.n >= max(overlap, n + 5)) & (count >= max(trades, 1))
            if len(best[0]) == top:
                good &= np.round(total, 4) >= np.round(best[7][-1], 4)
            k = count[good]
            new = (p.i[good], p.j[good], of_returns.corr[good], p.n[good], k, wins[good] / k, total[good] / k, total[good], held[good] / k)
            best = [np.concatenate([old, c]) for old, c in zip(best, new, strict=True)]
            first = np.lexsort((best[1], best[0], -np.round(best[7], 4)))[:top]  # a task passes on its own `top` only
            best = [c[first] for c in best]
        yield {"a": of.names[best[0]], "b": of.names[best[1]]} | dict(zip(names, (c.astype(np.int64) if name in ("bars", "trades") else c for name, c in zip(names, best[2:], strict=True)), strict=True))

    out = over_pairs(rows, run, "a string, b string, corr double, bars long, trades long, win_rate double, mean_profit double, total_profit double, mean_bars double", overlap - 1)
    return out.orderBy(F.round("total_profit", 4).desc(), "a", "b").limit(top)
