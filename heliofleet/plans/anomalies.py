"""Anomalous days: an isolation forest and a deterministic rule.

The forest follows Liu, Ting and Zhou (2008). Its trees are independent and each sees at
most 256 rows, so they are grown in parallel, one group per tree. The grown trees are the
only thing that reaches the driver: at most 511 nodes per tree.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import ratio
from ..operators.windows import rolling_median, seasonal_ratio
from ..schema import DAY, PRODUCTION, SITE

SAMPLE, EULER = 256, 0.5772156649015329
NODE_SCHEMA = ("tree INT, node INT, feature INT, threshold DOUBLE, yes INT, no INT, length DOUBLE")


def _path_norm(n):
    """Mean path length of an unsuccessful search among n values."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


#: Rows of a node from which on arrays are quicker than lists.
FEW = 48


def _grow(rows: np.ndarray, rng, limit: int):
    """Nodes of one tree as (feature, threshold, left, right, path length); -1 is a leaf.

    Most nodes hold a handful of rows, so these are kept as lists, whose steps cost less than an array's.
    """
    nodes, todo = [None], [(0, rows.T, 0)]
    norms = [_path_norm(n) for n in range(len(rows) + 1)]
    while todo:
        at, part, depth = todo.pop()
        if isinstance(part, np.ndarray) and part.shape[1] < FEW:
            part = part.tolist()
        n = len(part[0]) if isinstance(part, list) else part.shape[1]
        if depth >= limit or n <= 1:
            nodes[at] = (-1, 0.0, -1, -1, depth + norms[n])
            continue
        if isinstance(part, list):
            ends = [(min(c), max(c)) for c in part]
        else:
            ends = list(zip(part.min(axis=1).tolist(), part.max(axis=1).tolist()))
        wide = [i for i, (low, high) in enumerate(ends) if high > low]
        if not wide:
            nodes[at] = (-1, 0.0, -1, -1, depth + norms[n])
            continue
        # the draws of rng.choice(wide) and rng.uniform(low, high)
        feature = wide[int(rng.integers(0, len(wide)))] if len(wide) > 1 else wide[0]
        low, high = ends[feature]
        cut = low + (high - low) * rng.random()
        if isinstance(part, list):
            goes = [v < cut for v in part[feature]]
            yes = [list(compress(c, goes)) for c in part]
            goes = [not v for v in goes]
            no = [list(compress(c, goes)) for c in part]
        else:
            goes = part[feature] < cut
            yes, no = part[:, goes], part[:, ~goes]
        nodes[at] = (feature, cut, len(nodes), len(nodes) + 1, 0.0)
        nodes += [None, None]
        todo += [(len(nodes) - 2, yes, depth + 1), (len(nodes) - 1, no, depth + 1)]
    return nodes


def sample_for_trees(df: DataFrame, trees: int, rows: int, sample=SAMPLE, keys=(SITE, DAY)):
    """At most ``sample`` rows per tree. A hash of the row and the tree decides, so a retried
    task picks the same rows; only chosen (row, tree) pairs are produced."""
    space = 1 << 30
    limit = space if rows <= sample else int(space * min(1.0, 1.5 * sample / rows))

    def drawn(t):
        return F.pmod(F.xxhash64(*keys, t), F.lit(space))

    picked = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: drawn(t) < limit)
    pairs = df.withColumn("tree", F.explode(picked))
    order = Window.partitionBy("tree").orderBy(drawn(F.col("tree")), *keys)
    return pairs.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= sample)


def grow_forest(df: DataFrame, features, trees=100, seed=42, sample=SAMPLE) -> DataFrame:
    """Tree nodes as rows. Counts the rows once to set the sampling rate."""
    rows = df.count()
    limit = int(np.ceil(np.log2(max(2, min(sample, rows)))))
    names = list(features)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        data = pdf.sort_values("_k")[names].to_numpy(float)
        nodes = _grow(data, np.random.default_rng(seed * 1_000_003 + tree), limit)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "yes", "no", "length"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        return out

    drawn = sample_for_trees(df, trees, rows, sample).select("tree", "_k", *names)
    return drawn.groupBy("tree").applyInPandas(one, NODE_SCHEMA)


def tree_scores(data: np.ndarray, forest, sample: int) -> np.ndarray:
    """Negated scores of the paper for rows of ``data``; ``sample`` rows have grown each tree."""
    total = np.zeros(len(data))
    flat, width = np.ascontiguousarray(data).ravel(), data.shape[1]
    base = np.arange(len(data)) * width
    for tree in forest:
        feature, cut, length = tree[:, 0].astype(int), tree[:, 1], tree[:, 4]
        step = np.stack([tree[:, 3], tree[:, 2]], axis=1).astype(int).ravel()  # right, left
        ends = np.zeros(len(data))
        row, at = base, np.zeros(len(data), dtype=int)
        left = np.arange(len(data))
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.all():
                out = ~inner
                ends[left[out]] = length[at[out]]
                left, row, at, f = left[inner], row[inner], at[inner], f[inner]
                if not len(at):
                    break
            at = step[2 * at + (flat[row + f] < cut[at])]
        total += ends
    norm = _path_norm(sample)
    return -np.power(2.0, -total / len(forest) / norm) if norm else np.full(len(data), -1.0)


def score_forest(df: DataFrame, nodes: DataFrame, features, sample=SAMPLE) -> DataFrame:
    """Add ``anomaly_score``: lower is more anomalous, as the negated score of the paper."""
    table = nodes.toPandas()  # trees x 511 nodes at most
    forest = [t.sort_values("node")[["feature", "threshold", "yes", "no", "length"]].to_numpy(float)
              for _, t in table.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(tree_scores(np.column_stack([c.to_numpy(float) for c in columns]), shared.value, sample))

    return df.withColumn("anomaly_score", score(*[F.col(c) for c in features]))


def anomalies(df: DataFrame, features, contamination=0.05, trees=100, seed=42) -> DataFrame:
    """Score and flag rows; each site flags its own share of ``contamination``."""
    data = df.dropna(subset=list(features))
    nodes = grow_forest(data, features, trees, seed)
    scored = score_forest(data, nodes, features, min(SAMPLE, data.count()))
    return flag(scored, contamination)


def flag(scored: DataFrame, contamination: float) -> DataFrame:
    cut = F.percentile("anomaly_score", F.lit(contamination)).over(Window.partitionBy(SITE))
    return scored.withColumn("is_anomaly", (F.col("anomaly_score") < cut).cast("int"))


def site_anomalies(df: DataFrame, features, contamination=0.05, trees=100, seed=42) -> DataFrame:
    """Like ``anomalies``, with a forest of its own for each site, so that a day is held against its site only.

    A site has one row a day, so its rows fit in a task.
    """
    names, data = list(features), df.dropna(subset=list(features))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DAY, kind="stable").reset_index(drop=True)
        x = pdf[names].to_numpy(float)
        size = min(SAMPLE, len(x))
        limit = int(np.ceil(np.log2(max(2, size))))
        rng = np.random.default_rng(seed)
        forest = [np.array(_grow(x[rng.choice(len(x), size, replace=False)], rng, limit), float) for _ in range(trees)]
        return pdf.assign(anomaly_score=tree_scores(x, forest, size))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.schema.fields)
    return flag(data.groupBy(SITE).applyInPandas(one, f"{kinds}, anomaly_score double"), contamination)


def anomaly_summary(scored: DataFrame, value=PRODUCTION) -> DataFrame:
    """Rate of anomalies and the mean of anomalous and normal days."""
    bad = F.col("is_anomaly") == 1
    return scored.groupBy(SITE).agg(
        F.count(F.lit(1)).alias("days"), F.count_if(bad).alias("anomalies"),
        F.avg(F.when(bad, F.col(value))).alias("anomalous_mean"),
        F.avg(F.when(~bad, F.col(value))).alias("normal_mean")).withColumn(
        "anomaly_rate_pct", ratio("anomalies", "days") * F.lit(100.0))


def most_anomalous(scored: DataFrame, n=5) -> DataFrame:
    """The ``n`` lowest scores of each site."""
    place = F.row_number().over(Window.partitionBy(SITE).orderBy("anomaly_score", DAY))
    return scored.where("is_anomaly = 1").withColumn("rank", place).where(F.col("rank") <= n)


def robust_anomalies(daily: DataFrame, value=PRODUCTION, n=7, k=1.5) -> DataFrame:
    """Days whose distance to the rolling median, or seasonal ratio, leaves the site's
    interquartile range by more than ``k`` of it."""
    df = seasonal_ratio(daily, value)
    df = df.withColumn("deviation", F.col(value) - rolling_median(value, n))
    site = Window.partitionBy(SITE)
    watched = {"far_from_median": "deviation", "off_season": "seasonal_ratio"}
    quartiles = F.array(F.lit(0.25), F.lit(0.75))
    df = df.withColumns({f"_{c}": F.percentile(c, quartiles).over(site) for c in watched.values()})

    def outside(c):
        low, high = F.col(f"_{c}")[0], F.col(f"_{c}")[1]
        spread = (high - low) * F.lit(k)
        return F.coalesce((F.col(c) < low - spread) | (F.col(c) > high + spread), F.lit(False))

    flags = {name: outside(c).cast("int") for name, c in watched.items()}
    return df.withColumns(flags).withColumn("is_anomaly", F.greatest(*watched)).drop(
        *[f"_{c}" for c in watched.values()])
