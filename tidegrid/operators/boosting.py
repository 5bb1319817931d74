"""Second-order boosted trees on histograms, with missing values routed where they fit better.

Inputs are cut into bins once, by the JVM's bucketizer, and written; from then on a level of a tree costs one pass:
the sums of gradient and hessian of each (node, input, bin) are a grouped aggregate with partial sums, so what leaves
a task, and what the driver gets, is bounded by nodes x inputs x bins, whatever the number of rows. The driver only
picks splits. For each cut both ways for missing rows are tried, with L2 on leaf values; the better one is the
node's default.

Rows' margins are rewritten every few trees, so that neither lineage nor expressions grow with the number of trees,
and a lost executor repeats one task. Rows and inputs are sampled for each tree by hashes of a written row number.

Defined results: null, NaN and ``missing`` are missing; rows without a label aren't learned from; of equally good splits the first
input, then the lowest cut, then missing rows to the right; an input without two values isn't split; without rows the model predicts null.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.sources.io import remove, scratch


@dataclass(frozen=True)
class Settings:
    """``rate``: share of each tree that counts; ``rows``, ``columns``: shares sampled for each tree; ``least_weight``: hessian that each side of a split needs."""

    trees: int = 40
    depth: int = 5
    rate: float = 0.05
    rows: float = 1.0
    columns: float = 1.0
    l2: float = 1.0
    least_gain: float = 0.0
    least_weight: float = 1.0
    bins: int = 256
    seed: int = 42
    missing: float | None = None


@dataclass
class Node:
    """A split (rows below ``cut`` of ``feature`` go left, to node 2i + 1) or, without a feature, a leaf."""

    value: float
    rows: float
    feature: int | None = None
    cut: float | None = None
    at: int = 0
    missing_left: bool = False
    gain: float = 0.0


Tree = dict[int, Node]


@dataclass
class Boosted:
    inputs: list[str]
    base: float | None
    settings: Settings
    trees: list[Tree] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions for rows of inputs, NaN where missing."""
        out = np.full(len(x), np.nan if self.base is None else self.base)
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            for i in sorted(tree):  # parents come before their children
                node = tree[i]
                own = at == i
                if node.feature is None:
                    out[own] += self.settings.rate * node.value
                else:
                    v = x[own, node.feature]
                    at[own] = np.where(np.where(np.isnan(v), node.missing_left, v < node.cut), 2 * i + 1, 2 * i + 2)
        return out


def _value(c: str, missing: float | None) -> Column:
    """An input as double, NaN where it is missing."""
    v = F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    return v if missing is None else F.when(v == missing, F.lit(float("nan"))).otherwise(v)


def cuts_of(rows: DataFrame, inputs: Sequence[str], bins: int) -> list[list[float]]:
    """Cuts of each input: all its values but the smallest where there are at most ``bins``, else quantiles (to 1 in 10 ``bins``)."""
    held = {c: F.when(~F.isnan(c), F.col(c)) for c in inputs}
    few = rows.agg(*[F.approx_count_distinct(v, 0.02).alias(c) for c, v in held.items()]).first()
    probs = [i / bins for i in range(bins + 1)]
    # An estimate near the bound may hold some more values than ``bins``; they are all kept.
    found = rows.agg(*[(F.sort_array(F.collect_set(v)) if few[c] <= bins else F.percentile_approx(v, probs, 10 * bins)).alias(c) for c, v in held.items()]).first()
    return [sorted(set(found[c] or []))[1:] for c in inputs]


def binned(df: DataFrame, inputs: Sequence[str], label: str, settings: Settings, cuts: list[list[float]] | None) -> tuple[DataFrame, list[list[float]]]:
    """Rows as b0.. (the bin, -1 where missing), y and u, and the cuts used."""
    names = [f"x{i}" for i in range(len(inputs))]
    rows = df.where(F.col(label).isNotNull()).select(*[_value(c, settings.missing).alias(n) for c, n in zip(inputs, names, strict=True)], F.col(label).cast("double").alias("y"))
    cuts = cuts_of(rows, names, settings.bins) if cuts is None else cuts
    edges = [[float("-inf"), *c, float("inf")] for c in cuts]
    wide = [i for i, e in enumerate(edges) if len(e) > 2]  # the bucketizer takes no single bucket
    if wide:
        rows = Bucketizer(inputCols=[names[i] for i in wide], outputCols=[f"c{i}" for i in wide], splitsArray=[edges[i] for i in wide], handleInvalid="keep").transform(rows)
    bins = [F.when(F.isnan(n), -1).otherwise(F.col(f"c{i}") if i in wide else 0).cast("short").alias(f"b{i}") for i, n in enumerate(names)]
    return rows.select(*bins, "y", F.monotonically_increasing_id().alias("u")), cuts


def _place(tree: Tree, i: int = 0) -> Column:
    """The node of ``tree`` that a binned row is in."""
    node = tree.get(i)
    if node is None or node.feature is None:
        return F.lit(i)
    b = F.col(f"b{node.feature}")
    left = (b < node.at) & (b >= 0) if not node.missing_left else b < node.at
    return F.when(left, _place(tree, 2 * i + 1)).otherwise(_place(tree, 2 * i + 2))


def _leaf(tree: Tree, rate: float, i: int = 0) -> Column:
    node = tree[i]
    if node.feature is None:
        return F.lit(rate * node.value)
    b = F.col(f"b{node.feature}")
    left = (b < node.at) & (b >= 0) if not node.missing_left else b < node.at
    return F.when(left, _leaf(tree, rate, 2 * i + 1)).otherwise(_leaf(tree, rate, 2 * i + 2))


def histogram(rows: DataFrame, tree: Tree, features: Sequence[int], open_: Sequence[int]) -> pd.DataFrame:
    """(node, feature, bin, g, h): sums over the rows, which have g and h, of each open node."""
    bins = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"b{i}").alias("bin")) for i in features])
    own = rows.select(_place(tree).alias("node"), "g", "h", *[f"b{i}" for i in features]).where(F.col("node").isin(list(open_)))
    return own.select("node", "g", "h", F.explode(bins).alias("e")).groupBy("node", "e.feature", "e.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()


def best_split(own: pd.DataFrame, cuts: list[list[float]], s: Settings) -> tuple | None:
    """(gain, feature, at, missing left, left g and h, right g and h) of one node's histogram, None where nothing is gained."""
    best = None
    for f, part in own.groupby("feature"):
        n = len(cuts[f]) + 1
        g, h = np.zeros(n + 1), np.zeros(n + 1)
        g[part["bin"].to_numpy() + 1], h[part["bin"].to_numpy() + 1] = part["g"], part["h"]
        all_g, all_h = g.sum(), h.sum()
        low_g, low_h = np.cumsum(g[1:])[:-1], np.cumsum(h[1:])[:-1]
        gains = []
        for miss_g, miss_h in ((0.0, 0.0), (g[0], h[0])):
            left_g, left_h = low_g + miss_g, low_h + miss_h
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = 0.5 * (left_g**2 / (left_h + s.l2) + right_g**2 / (right_h + s.l2) - all_g**2 / (all_h + s.l2))
            gains.append(np.where((left_h < s.least_weight) | (right_h < s.least_weight), -np.inf, gain))
        both = np.stack(gains, axis=1).reshape(-1)  # by cut, missing to the right first
        if len(both) and both.max() > max(s.least_gain, 1e-12) and (best is None or both.max() > best[0]):
            k = int(both.argmax())
            left = np.array([low_g[k // 2], low_h[k // 2]]) + (k % 2) * np.array([g[0], h[0]])
            best = (float(both[k]), int(f), k // 2 + 1, bool(k % 2), left, np.array([all_g, all_h]) - left)
    return best


def grow(rows: DataFrame, cuts: list[list[float]], features: Sequence[int], s: Settings) -> Tree:
    """One tree, level by level, over rows with bins, g and h; nodes that aren't split are leaves."""
    tree: Tree = {0: Node(0.0, 0.0)}
    open_ = [0]
    for _ in range(s.depth):
        found = histogram(rows, tree, features, open_)
        if 0 in open_ and len(found):
            g, h = found[found["feature"] == features[0]][["g", "h"]].sum()
            tree[0] = Node(-float(g) / (float(h) + s.l2), float(h))
        open_ = []
        for i, own in found.groupby("node"):
            split = best_split(own, cuts, s)
            if split is None:
                continue
            node = tree[int(i)]
            node.gain, node.feature, node.at, node.missing_left = split[:4]
            node.cut = cuts[node.feature][node.at - 1]
            for k, (g, h) in zip((2 * int(i) + 1, 2 * int(i) + 2), split[4:], strict=True):
                tree[k] = Node(-float(g) / (float(h) + s.l2), float(h))
                open_.append(k)
        if not open_:
            break
    return tree


#: Trees whose sum is left in rows' expressions before margins are rewritten.
_TREES_A_WRITE = 4


def fit(df: DataFrame, inputs: Sequence[str], label: str, settings: Settings = Settings(), cuts: list[list[float]] | None = None) -> Boosted:
    """Boosted trees for squared error; ``cuts``: candidate cuts of each input, otherwise taken from the data."""
    spark, s, rng = df.sparkSession, settings, np.random.default_rng(settings.seed)
    own, cuts = binned(df, inputs, label, s, cuts)
    paths = [scratch(spark, "boost-rows")]
    own.write.parquet(paths[0])
    rows = spark.read.schema(own.schema).parquet(paths[0])
    base = rows.agg(F.avg("y")).first()[0]
    model = Boosted(list(inputs), base, s)
    if base is None:
        return model
    rows, waiting = rows.withColumn("margin", F.lit(base)), 0
    try:
        for k in range(s.trees):
            features = sorted(rng.choice(len(inputs), max(1, round(s.columns * len(inputs))), replace=False).tolist())
            drawn = rows.where(F.pmod(F.xxhash64("u", F.lit(s.seed), F.lit(k)), F.lit(1_000_003)) < s.rows * 1_000_003) if s.rows < 1 else rows
            tree = grow(drawn.select("*", (F.col("margin") - F.col("y")).alias("g"), F.lit(1.0).alias("h")), cuts, features, s)
            model.trees.append(tree)
            rows, waiting = rows.withColumn("margin", F.col("margin") + _leaf(tree, s.rate)), waiting + 1
            if waiting == _TREES_A_WRITE and k + 1 < s.trees:
                paths.append(scratch(spark, "boost-rows"))
                rows.write.parquet(paths[-1])
                rows, waiting = spark.read.schema(rows.schema).parquet(paths[-1]), 0
                remove(spark, paths.pop(0))
    finally:
        for path in paths:
            remove(spark, path)
    return model


def predict(df: DataFrame, model: Boosted, out: str = "prediction") -> DataFrame:
    """``df`` with the model's prediction; the model, whose size its settings bound, goes to all tasks."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(held.value.predict(np.stack([c.to_numpy(float) for c in columns], axis=1)))

    return df.withColumn(out, run(*[_value(c, model.settings.missing) for c in model.inputs]))


def nodes(spark, model: Boosted) -> DataFrame:
    """(tree, node, feature, cut, missing_left, gain, value, rows): the model as a table; leaves have no feature."""
    rows = [(t, i, None if n.feature is None else model.inputs[n.feature], n.cut, n.missing_left if n.feature is not None else None, n.gain, n.value, n.rows) for t, tree in enumerate(model.trees) for i, n in sorted(tree.items())]
    return spark.createDataFrame(rows, "tree int, node int, feature string, cut double, missing_left boolean, gain double, value double, rows double")
