"""Operators as SQL table functions with typed parameters.

``register(spark)`` makes them known to SQL, where a table argument names its series by PARTITION BY:

    SELECT * FROM motion_windows(TABLE(samples) PARTITION BY series_id, k => 2.0)

Columns and parameters are checked when a statement is analysed, before any row is read, and a wrong one is named in the error. The key
keeps its own type. ``series_id`` must be the partition's key: a partition with two of them is refused when it is read.

A function sees one series as a stream of rows. ``session_clusters`` keeps one row; the others need a median or a count first and keep the two
numbers of each sample, 16 bytes a row. Rows without a time are passed over. For series beyond an executor's memory use the operators in ``operators.signals``,
which these functions equal.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DataType, DoubleType, IntegerType, LongType, NumericType, StructField, StructType


class Param:
    """A parameter: its type, default and range. ``choices`` limits texts."""

    def __init__(self, kind: type, default, least=None, most=None, above=None, choices: tuple[str, ...] = ()):
        self.kind, self.default, self.least, self.most, self.above, self.choices = kind, default, least, most, above, choices

    def problem(self, value) -> str | None:
        """What is wrong with a given value."""
        if isinstance(value, bool) or not isinstance(value, (str,) if self.kind is str else (int,) if self.kind is int else (int, float)):
            return f"must be {'a text' if self.kind is str else 'a whole number' if self.kind is int else 'a number'}"
        if self.kind is str:
            return None if value in self.choices else f"must be one of {', '.join(self.choices)}"
        if not math.isfinite(value):
            return "must be finite"
        if self.least is not None and value < self.least or self.most is not None and value > self.most or self.above is not None and value <= self.above:
            edges = [f"{word} {edge}" for word, edge in (("at least", self.least), ("at most", self.most), ("above", self.above)) if edge is not None]
            return f"must be {' and '.join(edges)}"
        return None


class _Tool:
    """Analysis and reading that all table functions share; each has TABLE (columns by name), PARAMS and RESULT (columns behind the key)."""

    TABLE: tuple[str, ...] = ("t", "x")
    PARAMS: dict[str, Param] = {}
    RESULT: tuple[tuple[str, DataType], ...] = ()

    @classmethod
    def checked(cls, table: AnalyzeArgument, given: dict[str, AnalyzeArgument]) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument must be a table: TABLE(...) PARTITION BY series_id")
        kinds = {f.name: f.dataType for f in table.dataType.fields}
        for name in ("series_id", *cls.TABLE):
            if name not in kinds:
                raise ValueError(f"the table has no column {name}; it has {', '.join(kinds)}")
            if name != "series_id" and not isinstance(kinds[name], NumericType):
                raise ValueError(f"column {name} must be a number, it is {kinds[name].simpleString()}")
        for name, argument in given.items():
            if name not in cls.PARAMS:
                raise ValueError(f"there is no parameter {name}; there are {', '.join(cls.PARAMS)}")
            if argument.isTable or not argument.isConstantExpression:
                raise ValueError(f"{name} must be a constant")
            value = float(argument.value) if argument.dataType.typeName() == "decimal" and argument.value is not None else argument.value
            if value is not None and (problem := cls.PARAMS[name].problem(value)):
                raise ValueError(f"{name} {problem}, it is {value!r}")
        return AnalyzeResult(schema=StructType([StructField("series_id", kinds["series_id"]), *(StructField(n, t) for n, t in cls.RESULT)]))

    def __init__(self):
        self.key, self.rows, self.given = None, 0, {}
        self.begin()

    def begin(self) -> None:
        self.t, self.x = array("d"), array("d")

    def eval(self, row, **given):
        key = row["series_id"]
        if self.rows and key != self.key:
            raise ValueError("one partition has several values of series_id: partition the table by it")
        if not self.rows:
            self.key = key
            self.given = {n: p.default if given.get(n) is None else p.kind(given[n]) for n, p in self.PARAMS.items()}
        self.rows += 1
        yield from self.take(*(row[c] for c in self.TABLE))

    def take(self, t, x) -> Iterator[tuple]:
        if t is not None:
            self.t.append(t)
            self.x.append(math.nan if x is None else x)
        return iter(())

    def terminate(self):
        if self.rows:
            for row in self.finish(**self.given):
                yield (self.key, *row)

    def finish(self, **given) -> Iterator[tuple]:
        return iter(())

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        t, x = np.frombuffer(self.t), np.frombuffer(self.x)
        order = np.argsort(t, kind="stable")
        return t[order], x[order]


def _upper_median(x: np.ndarray) -> float:
    return float(np.partition(x, len(x) // 2)[len(x) // 2])


def _rounded(x: float, digits: int = 3) -> float:
    return math.floor(x * 10**digits + 0.5) / 10**digits


def _robust(x: np.ndarray, floor: float) -> tuple[float, float] | None:
    x = x[~np.isnan(x)]
    if not len(x):
        return None
    middle = _upper_median(x)
    return middle, max(floor, _upper_median(np.abs(x - middle)))


def _window_means(x: np.ndarray, half: int, narrow: bool = False) -> np.ndarray:
    """Means over each row and ``half`` rows on either side, of the values that are there; values that are not finite make the means around them NaN.

    ``narrow`` windows add up their own values in turn. For others values are split at a bit that all share, as ``signals.motion_windows`` does: running
    sums of the upper parts are exact."""
    bad = ~np.isfinite(x)
    value = np.where(bad, 0.0, x)
    most = float(np.abs(value).max(initial=0.0)) * len(x)
    bits = 2.0 ** (math.ceil(math.log2(most)) + 2) if 0 < most <= 2.0**1021 else 0.0
    upper = (value + bits) - bits
    total, rest, many, broken = (np.concatenate([[0], np.cumsum(c)]) for c in (upper, value - upper, ~bad, bad & ~np.isnan(x)))
    lo, hi = np.maximum(np.arange(len(x)) - half, 0), np.minimum(np.arange(len(x)) + half + 1, len(x))
    with np.errstate(invalid="ignore"):
        sums = (total[hi] - total[lo]) + (rest[hi] - rest[lo])
        if narrow:
            near = np.concatenate([np.zeros(half), value, np.zeros(half)])
            sums = np.zeros(len(x))
            for k in range(2 * half + 1):
                sums += near[k : k + len(x)]
        mean = sums / (many[hi] - many[lo])
    return np.where(broken[hi] > broken[lo], math.nan, mean)


class MotionWindows(_Tool):
    """(series_id, win_id, start_s, end_s, intensity) of rows (series_id, t, x): runs whose rolling mean exceeds median + k * MAD. A null x counts in
    no mean and no median."""

    PARAMS = {
        "min_rows": Param(int, 8, least=1),
        "k": Param(float, 1.5, least=0),
        "mad_floor": Param(float, 0.5, above=0),
        "half": Param(int, 2, least=0),
        "join_gap": Param(float, 1.0, least=0),
        "min_length": Param(float, 0.4, least=0),
        "pad": Param(float, 0.1, least=0),
        "tail": Param(float, 0.5, least=0),
    }
    RESULT = (("win_id", IntegerType()), ("start_s", DoubleType()), ("end_s", DoubleType()), ("intensity", DoubleType()))

    @staticmethod
    def analyze(table: AnalyzeArgument, **given: AnalyzeArgument) -> AnalyzeResult:
        return MotionWindows.checked(table, given)

    def finish(self, min_rows, k, mad_floor, half, join_gap, min_length, pad, tail):
        t, x = np.frombuffer(self.t), np.frombuffer(self.x)
        order = np.lexsort((x, t))  # of equal times the smaller value first, as the operator takes them
        t, x = t[order], x[order]
        stats = _robust(x, mad_floor)
        if len(t) < min_rows or stats is None:
            return
        duration = float(t[-1])
        width = max(half, math.floor(len(t) / max(1.0, duration) / 2 + 0.5))
        smooth = _window_means(x, width, narrow=width == half)
        hot = np.flatnonzero(smooth > stats[0] + k * stats[1])
        if not len(hot):
            return
        apart = np.flatnonzero((np.diff(hot) > 1) & (np.diff(t[hot]) > join_gap)) + 1
        number = 0
        for run in np.split(hot, apart):
            a, b = float(t[run[0]]), float(t[run[-1]])
            if b - a < min_length:
                continue
            start, end = max(0.0, a - pad), min(max(0.0, duration - tail), b + pad)
            if end - start >= min_length:
                number += 1
                means = smooth[run[0] : run[-1] + 1]
                means = means[~np.isnan(means)]
                yield number, _rounded(start), _rounded(end), _rounded(float(np.cumsum(means)[-1]) / len(means), 1)  # added up in order, as SQL does


class RobustStats(_Tool):
    """(series_id, n, med, mad) of rows (series_id, x): the upper median and the upper median of deviations from it, at least ``floor``."""

    TABLE = ("x",)
    PARAMS = {"floor": Param(float, 1.0, least=0)}
    RESULT = (("n", LongType()), ("med", DoubleType()), ("mad", DoubleType()))

    @staticmethod
    def analyze(table: AnalyzeArgument, **given: AnalyzeArgument) -> AnalyzeResult:
        return RobustStats.checked(table, given)

    def take(self, x):
        self.x.append(math.nan if x is None else x)
        return iter(())

    def finish(self, floor):
        stats = _robust(np.frombuffer(self.x), floor)
        if stats:
            yield self.rows, *stats


class SessionClusters(_Tool):
    """(series_id, cluster, t, score, n_rows) of rows (series_id, t, score) in order of t, as ORDER BY t gives them: of rows at most ``gap`` apart that with the
    highest score, the earliest of equals. Nothing but the open cluster is kept. A null score is below all others."""

    TABLE = ("t", "score")
    PARAMS = {"gap": Param(float, 0.5, least=0)}
    RESULT = (("cluster", LongType()), ("t", DoubleType()), ("score", DoubleType()), ("n_rows", LongType()))

    @staticmethod
    def analyze(table: AnalyzeArgument, **given: AnalyzeArgument) -> AnalyzeResult:
        return SessionClusters.checked(table, given)

    def begin(self):
        self.number, self.last, self.best, self.size = 0, None, None, 0

    def take(self, t, score):
        if t is None:
            return
        if self.last is not None and t < self.last:
            raise ValueError("rows must come in order: add ORDER BY t to the table argument")
        if self.last is None or t - self.last > self.given["gap"]:
            yield from ((self.key, *row) for row in self.finish(**self.given))
            self.number, self.best, self.size = self.number + 1, None, 0
        if self.best is None or score is not None and (self.best[1] is None or score > self.best[1]):
            self.best = t, score
        self.last, self.size = t, self.size + 1

    def finish(self, gap):
        if self.best is not None:
            yield self.number, float(self.best[0]), None if self.best[1] is None else float(self.best[1]), self.size


class EvenSample(_Tool):
    """(series_id, pos, t, x): ``count`` evenly spaced rows of each series, or all; 'round' reaches both ends, 'floor' steps from the first."""

    PARAMS = {"count": Param(int, 20, least=1), "stride": Param(str, "round", choices=("round", "floor"))}
    RESULT = (("pos", IntegerType()), ("t", DoubleType()), ("x", DoubleType()))

    @staticmethod
    def analyze(table: AnalyzeArgument, **given: AnalyzeArgument) -> AnalyzeResult:
        return EvenSample.checked(table, given)

    def finish(self, count, stride):
        t, x = self.sorted()
        n = len(t)
        if n <= count:
            places = range(n)
        elif stride == "round" and count > 1:
            places = sorted({math.floor(i * (n - 1) / (count - 1) + 0.5) for i in range(count)})
        else:
            places = sorted({math.floor(i * n / count) for i in range(count)})
        for k in places:
            yield k, float(t[k]), None if math.isnan(x[k]) else float(x[k])


TOOLS = {"motion_windows": MotionWindows, "robust_stats": RobustStats, "session_clusters": SessionClusters, "even_sample": EvenSample}


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL under their names."""
    for name, tool in TOOLS.items():
        spark.udtf.register(name, udtf(tool))
