"""Expanding-window forecasts of many series at once.

Least squares: cross products of [1, x, y] are summed for each block of ``refit`` rows and
accumulated over *earlier* blocks only, so no forecast can see its own block or a later
one.  The work is one pass over the rows; only the small cumulated matrices go to an
Arrow function that solves them (with a pseudo-inverse: a regressor without
variation gets coefficient 0).  Both nested models share one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .timeseries import series

MIN_TRAIN, REFIT, REFIT_TREES = 750, 21, 63
#: Eigenvalues below this share of the largest count as zero.
RANK_TOLERANCE = 1e-12


def with_blocks(features: DataFrame, keys: Sequence[str], order: str = "d", min_train: int = MIN_TRAIN, refit: int = REFIT) -> DataFrame:
    """Position ``rn`` (from 1) and ``block``: -1 in the burn-in, then 0, 1, ... by ``refit`` rows."""
    rn = F.row_number().over(series(keys, order))
    df = features.withColumn("rn", rn)
    return df.withColumn("block", F.when(F.col("rn") <= min_train, -1).otherwise(F.floor((F.col("rn") - 1 - min_train) / refit).cast("int")))


def solve(gram: np.ndarray, size: int, columns: Sequence[int]) -> list[float]:
    """Coefficients on ``columns`` (0 is the constant) from the packed upper triangle of [1, x, y]."""
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = gram
    full = full + np.triu(full, 1).T
    use = list(columns)
    a, b = full[np.ix_(use, use)], full[use, -1]
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    beta = np.linalg.pinv(a / np.outer(scale, scale), rcond=RANK_TOLERANCE, hermitian=True) @ (b / scale) / scale
    out = np.zeros(size - 1)
    out[use] = beta
    return out.tolist()


def _coefficients(gram: DataFrame, size: int, base: Sequence[int], alt: Sequence[int]) -> DataFrame:
    kind = StructType([StructField("base", ArrayType(DoubleType())), StructField("alt", ArrayType(DoubleType()))])

    def fit(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"base": [solve(np.asarray(g), size, base) for g in part], "alt": [solve(np.asarray(g), size, alt) for g in part]})

    return gram.withColumn("beta", F.pandas_udf(fit, kind)("gram"))


def walk_forward_ols(features: DataFrame, keys: Sequence[str], base: Sequence[str], alt: Sequence[str], y: str = "y", order: str = "d", min_train: int = MIN_TRAIN, refit: int = REFIT) -> DataFrame:
    """Out-of-sample rows of ``features`` with ``rn, block, yhat_base, yhat_alt``."""
    keys = list(keys)
    xs = list(dict.fromkeys([*base, *alt]))
    z = [F.lit(1.0), *(F.col(c).cast("double") for c in xs), F.col(y)]
    size = len(z)
    rows = with_blocks(features, keys, order, min_train, refit)
    products = [F.sum(z[i] * z[j]).alias(f"_g{i}_{j}") for i in range(size) for j in range(i, size)]
    names = [f"_g{i}_{j}" for i in range(size) for j in range(i, size)]
    sums = rows.groupBy(*keys, "block").agg(*products)
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    gram = sums.select(*keys, "block", F.array(*(F.sum(c).over(before) for c in names)).alias("gram")).where("block >= 0")
    place = {c: i + 1 for i, c in enumerate(xs)}
    beta = _coefficients(gram, size, [0, *(place[c] for c in base)], [0, *(place[c] for c in alt)]).select(*keys, "block", "beta")
    joined = rows.where("block >= 0").join(beta, [*keys, "block"])

    def dot(which: str):
        out = F.col(f"beta.{which}")[0]
        for c in xs:
            out = out + F.col(f"beta.{which}")[place[c]] * F.col(c).cast("double")
        return out

    return joined.withColumns({"yhat_base": dot("base"), "yhat_alt": dot("alt")}).drop("beta")


def first_window_coefficient(features: DataFrame, keys: Sequence[str], columns: Sequence[str], of: str, y: str = "y", order: str = "d", min_train: int = MIN_TRAIN) -> DataFrame:
    """Coefficient of ``of`` in the burn-in window of each series."""
    z = [F.lit(1.0), *(F.col(c).cast("double") for c in columns), F.col(y)]
    size = len(z)
    rows = with_blocks(features, keys, order, min_train).where("block = -1")
    gram = rows.groupBy(*keys).agg(F.count("*").alias("n_train"), F.array(*(F.sum(z[i] * z[j]) for i in range(size) for j in range(i, size))).alias("gram"))
    fitted = _coefficients(gram, size, [0], range(size - 1))
    return fitted.select(*keys, "n_train", F.col("beta.alt")[list(columns).index(of) + 1].alias(f"coef_{of}"))


class BoostedTrees:
    """Squared-error gradient boosting on histogram bins: shallow trees, fixed shrinkage, deterministic."""

    def __init__(self, depth: int = 3, rate: float = 0.05, rounds: int = 150, leaf: int = 20, bins: int = 255):
        self.depth, self.rate, self.rounds, self.leaf, self.bins = depth, rate, rounds, leaf, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        self.start, self.trees = float(y.mean()), []
        left = y - self.start
        for _ in range(self.rounds):
            tree, leaf_of = self._grow(binned, left)
            self.trees.append(tree)
            left = left - self.rate * leaf_of
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], 1)

    def _split(self, x: np.ndarray, g: np.ndarray):
        best = (1e-12, None)
        n, total = len(g), g.sum()
        for f in range(x.shape[1]):
            size = len(self.cuts[f]) + 1
            c = np.cumsum(np.bincount(x[:, f], minlength=size))[:-1]
            s = np.cumsum(np.bincount(x[:, f], g, minlength=size))[:-1]
            ok = (c >= self.leaf) & (n - c >= self.leaf)
            if ok.any():
                gain = np.where(ok, s**2 / np.maximum(c, 1) + (total - s) ** 2 / np.maximum(n - c, 1) - total**2 / n, -1)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], (f, at))
        return best[1]

    def _grow(self, x: np.ndarray, g: np.ndarray):
        value = np.zeros(len(g))

        def node(rows: np.ndarray, depth: int):
            cut = self._split(x[rows], g[rows]) if depth < self.depth and len(rows) >= 2 * self.leaf else None
            if cut is None:
                value[rows] = mean = float(g[rows].mean())
                return mean
            low = x[rows, cut[0]] <= cut[1]
            return (*cut, node(rows[low], depth + 1), node(rows[~low], depth + 1))

        return node(np.arange(len(g)), 0), value

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned, out = self._bin(x), np.full(len(x), self.start)

        def add(tree, rows):
            if isinstance(tree, float):
                out[rows] += self.rate * tree
            elif len(rows):
                low = binned[rows, tree[0]] <= tree[1]
                add(tree[2], rows[low])
                add(tree[3], rows[~low])

        for tree in self.trees:
            add(tree, np.arange(len(x)))
        return out


def walk_forward_trees(features: DataFrame, keys: Sequence[str], base: Sequence[str], alt: Sequence[str], y: str = "y", order: str = "d", min_train: int = MIN_TRAIN, refit: int = REFIT_TREES, rounds: int = 150) -> DataFrame:
    """As ``walk_forward_ols`` with boosted trees; the fits of a series and block are one task's work.

    A row goes to the fit of its own block, which forecasts it, and to those of all
    later blocks, which learn from it: the rows moved are the rows the fits read.
    """
    keys = list(keys)
    xs = list(dict.fromkeys([*base, *alt]))
    rows = with_blocks(features, keys, order, min_train, refit).select(*keys, order, "rn", "block", y, *xs)
    schema = rows.select(*keys, order, "rn", "block", y).schema
    out = StructType([*schema.fields, StructField("yhat_base", DoubleType()), StructField("yhat_alt", DoubleType())])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rn")
        own = (part["block"] == part["fit"]).to_numpy()
        before, here = part[~own], part[own]
        target = before[y].to_numpy(float)
        model = lambda c: BoostedTrees(rounds=rounds).fit(before[list(c)].to_numpy(float), target).predict(here[list(c)].to_numpy(float))
        return here.assign(yhat_base=model(base), yhat_alt=model(alt))[out.names]

    last = F.max("block").over(Window.partitionBy(*keys))
    dealt = rows.withColumn("last", last).where("last >= 0").withColumn("fit", F.explode(F.sequence(F.greatest(F.col("block"), F.lit(0)), F.col("last")))).drop("last")
    # A count of its own: adaptive execution would merge small partitions, and the fits are costly, not large.
    parts = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *keys, "fit").groupBy(*keys, "fit").applyInPandas(run, out)
