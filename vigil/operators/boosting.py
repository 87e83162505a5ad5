"""Gradient-boosted trees over histograms, as Spark jobs.

Every feature is cut into at most ``BINS`` bins (all its values where there are few, quantiles of all rows
otherwise).  The rows become blocks of bin numbers, a few bytes a row, which are written once and kept in memory
together with the running margin of every row.  A tree grows level by level: each level is one job in which every
task adds up weights and residuals per (node, feature, bin) over its blocks, and only those sums, whose size depends
on the tree and not on the rows, are merged.  Below the root only the lighter child of every split is added up; its
sibling's sums are the parent's less those.  The splits are then exact for the bins.

The rules are those of ``GBTClassifier``: log loss on labels -1 and 1, the first tree fits the labels with weight 1,
later ones the residuals with ``step_size``; variance as impurity; leaves hold weighted means; a value goes left if it
is not above the threshold, NaN and NULL go right.  Where no feature has more than ``BINS`` values the trees are the same.
"""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Model
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.session import scratch_path

BINS = 32
PACKED = 1024            # bins of features that are counted together, as one number
BLOCK_ROWS = 65_536      # rows of a block: many beside the sums of a level, few beside a task's memory
ROWS_A_TASK = 4_000_000  # bin numbers and margins of so many rows stay small beside a task's memory
CHECKPOINT_EVERY = 25    # trees
MERGED_BY_DRIVER = 64    # sums of more tasks than that are merged by tasks first


# ---------------------------------------------------------------- bins

def _between(values: list[float]) -> list[float]:
    """Thresholds between neighbouring values."""
    mids = [(a + b) / 2 if math.isfinite((a + b) / 2) else a for a, b in zip(values, values[1:])]
    return sorted(set(mids))


def bin_thresholds(df: DataFrame, features: list[str], label: str = "label") -> tuple[list[list[float]], int]:
    """(thresholds of each feature, rows); labels other than 0 and 1 are refused."""
    held = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    shares = [i / BINS for i in range(1, BINS)] + [1.0]
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col(label).isin(0.0, 1.0), F.lit(False))).alias("odd"),
                 *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(held.values())]).first()
    if not row["n"] or row["odd"]:
        raise ValueError(f"boosted trees need rows with labels 0 and 1: {row['n']} rows, {row['odd']} with other labels")
    few = [i for i in range(len(features)) if row[f"d{i}"] <= 2 * BINS]  # estimates: at most some more values than that
    sets = df.agg(*[F.collect_set(held[features[i]]).alias(f"s{i}") for i in few]).first() if few else None
    values = {i: sorted(set(sets[f"s{i}"])) for i in few}
    many = [i for i in range(len(features)) if i not in values or len(values[i]) > BINS]
    quantiles = df.agg(*[F.percentile_approx(held[features[i]], shares, 100 * BINS).alias(f"q{i}") for i in many]).first() if many else None
    out = []
    for i in range(len(features)):
        if i in many:
            *inner, top = quantiles[f"q{i}"]
            out.append(sorted({q for q in inner if q < top}))
        else:
            out.append(_between(values[i]))
    return out, row["n"]


class Packing:
    """Features whose bins are numbered together, so that one count serves them all."""

    def __init__(self, thresholds: list[list[float]]):
        self.thresholds = [np.array(t, dtype=np.float64) for t in thresholds]
        self.n_bins = [len(t) + 1 for t in thresholds]
        self.groups: list[list[int]] = []
        for f in sorted(range(len(thresholds)), key=lambda f: -self.n_bins[f]):
            fitting = [g for g in self.groups if math.prod(self.n_bins[i] for i in g) * self.n_bins[f] <= PACKED]
            if fitting:
                fitting[0].append(f)
            else:
                self.groups.append([f])
        self.dims = [tuple(self.n_bins[f] for f in g) for g in self.groups]
        self.sizes = [math.prod(d) for d in self.dims]
        self.place = {f: (g, j) for g, members in enumerate(self.groups) for j, f in enumerate(members)}

    def codes(self, columns: list[np.ndarray]) -> np.ndarray:
        """(groups, rows) of joint bin numbers."""
        out = []
        for members, dims in zip(self.groups, self.dims):
            bins = [np.searchsorted(self.thresholds[f], columns[f], side="left") for f in members]
            out.append(np.ravel_multi_index(bins, dims).astype(np.uint16))
        return np.stack(out)

    def goes_right(self, f: int, cut: int) -> tuple[int, np.ndarray]:
        """(group, for each joint number whether the bin of ``f`` lies above ``cut``)"""
        g, j = self.place[f]
        table = np.zeros(PACKED, dtype=np.uint8)
        table[:self.sizes[g]] = np.unravel_index(np.arange(self.sizes[g]), self.dims[g])[j] > cut
        return g, table

    def by_feature(self, sums: list[np.ndarray], nodes: int) -> list[np.ndarray]:
        """Sums per joint number -> per feature, (nodes, bins)."""
        out = []
        for f in range(len(self.n_bins)):
            g, j = self.place[f]
            others = tuple(1 + k for k in range(len(self.dims[g])) if k != j)
            out.append(sums[g].reshape(nodes, *self.dims[g]).sum(axis=others))
        return out


# ---------------------------------------------------------------- what tasks do with a block

class Paths:
    """Finds the node of every row after ``levels`` levels of a tree (0 is the leftmost).  Up to 64 nodes are a word of
    as many bits: the joint number of each group of features clears the nodes that it rules out, and the one bit that
    stays is the node; deeper trees are walked."""

    CHUNK = 8192

    def __init__(self, group: np.ndarray, right: np.ndarray, levels: int, groups: int):
        self.levels, nodes = levels, 1 << levels
        if nodes > 64:
            self.group, self.right = group[:nodes - 1].copy(), right[:nodes - 1].copy()
            return
        every = (1 << nodes) - 1
        word = next(t for bits, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if nodes <= bits)
        masks = np.full((groups, PACKED), every, dtype=word)
        for i in range(nodes - 1):
            level = (i + 1).bit_length() - 1
            width = nodes >> (level + 1)
            first = (i + 1 - (1 << level)) * 2 * width
            lefts, rights = (((1 << width) - 1) << first), (((1 << width) - 1) << (first + width))
            masks[group[i]] &= np.where(right[i], word(every & ~lefts), word(every & ~rights))
        self.masks = {g: m for g, m in enumerate(masks) if (m != every).any()}

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        n = codes.shape[1]
        out = np.zeros(n, dtype=np.intp)
        for i in range(0, n if self.levels else 0, self.CHUNK):
            part = codes[:, i:i + self.CHUNK]
            out[i:i + self.CHUNK] = self._walk(part) if self.levels > 6 else self._meet(part)
        return out

    def _meet(self, codes: np.ndarray) -> np.ndarray | int:
        left = None
        for g, m in self.masks.items():
            one = m.take(codes[g])
            left = one if left is None else np.bitwise_and(left, one, out=left)
        if left is None:  # no split so far: all rows are leftmost
            return 0
        return (left.astype(np.float64).view(np.int64) >> 52) - 1023

    def _walk(self, codes: np.ndarray) -> np.ndarray:
        n = codes.shape[1]
        flat, at, tables, node = codes.ravel(), np.arange(n), self.right.ravel(), np.zeros(n, dtype=np.intp)
        for level in range(self.levels):
            inner = node + ((1 << level) - 1)
            code = flat.take(self.group.take(inner) * n + at)
            node = 2 * node + tables.take(inner * PACKED + code)
        return node


def level_sums(blocks, pack: Packing, paths: Paths, wanted: np.ndarray, first: bool, pos_weight: float, bag: tuple | None):
    """Weights and weighted residuals per (node, feature, bin) of a task's blocks, for the ``wanted`` nodes only:
    (2, wanted nodes, all bins)."""
    nodes, whole = len(wanted), len(wanted) == 1 << paths.levels
    number = np.full(1 << paths.levels, -1, dtype=np.intp)
    number[wanted] = np.arange(nodes)
    sums = [[np.zeros(nodes * size) for size in pack.sizes] for _ in range(2)]
    for codes, y, margin in blocks:
        in_bag = np.random.default_rng([bag[0], zlib.crc32(codes.tobytes())]).random(len(y)) < bag[1] if bag else None
        node = paths.nodes(codes)
        if not whole:
            node = number.take(node)
            rows = np.flatnonzero(node >= 0)
            node, codes, y, margin = node.take(rows), codes.take(rows, axis=1), y.take(rows), margin.take(rows)
            in_bag = in_bag.take(rows) if bag else None
        w = np.where(y, pos_weight, 1.0)
        if bag:
            w *= in_bag
        wr = np.empty(len(y))
        for i in range(0, len(y), Paths.CHUNK):  # temporary arrays of that size stay in the processor's cache
            part = slice(i, i + Paths.CHUNK)
            sign = np.where(y[part], 1.0, -1.0)
            wr[part] = w[part] * (sign if first else 4.0 * sign / (1.0 + np.exp(np.minimum(2.0 * sign * margin[part], 700.0))))
        for g, size in enumerate(pack.sizes):
            at = node * size + codes[g]
            sums[0][g] += np.bincount(at, w, nodes * size)
            sums[1][g] += np.bincount(at, wr, nodes * size)
    yield np.stack([np.concatenate(pack.by_feature(s, nodes), axis=1) for s in sums])


# ---------------------------------------------------------------- trees

def subset_size(strategy: str, n: int) -> int:
    """How many features a node may choose from, by the names that Spark ML knows."""
    named = {"all": n, "auto": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n))) if n > 1 else 1, "onethird": math.ceil(n / 3)}
    if strategy in named:
        return named[strategy]
    return max(1, min(n, int(strategy) if strategy.isdigit() else math.ceil(float(strategy) * n)))


def best_splits(sums: np.ndarray, pack: Packing, k: int, rng) -> tuple[np.ndarray, ...]:
    """Per node: gain, feature and bin of the best cut, the means left and right of it, and which child is lighter (1:
    the right one).  Ties go to the first feature and the lowest bin."""
    nodes, n = sums.shape[1], len(pack.n_bins)
    gain, feature, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, dtype=int)
    means, lighter = np.zeros((nodes, 2)), np.zeros(nodes, dtype=int)
    allowed = np.ones((nodes, n), dtype=bool) if k >= n else np.argsort(rng.random((nodes, n)), axis=1).argsort(axis=1) < k
    offset = 0
    for f, bins in enumerate(pack.n_bins):
        below = np.cumsum(sums[:, :, offset:offset + bins], axis=2)
        offset += bins
        w, s = below[0][:, -1:], below[1][:, -1:]
        wl, sl = below[0][:, :-1], below[1][:, :-1]
        wr, sr = w - wl, s - sl
        good = (wl > 0) & (wr > w * 1e-12) & allowed[:, f:f + 1]
        if not good.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            left, right = sl / wl, sr / wr
            gains = np.where(good, sl * left + sr * right - s * s / w, -np.inf)
        at = gains.argmax(axis=1)
        best = gains[np.arange(nodes), at]
        for i in np.flatnonzero(best > np.maximum(gain * (1 + 1e-12), 1e-12 * w[:, 0])):
            gain[i], feature[i], cut[i] = best[i], f, at[i]
            means[i] = left[i, at[i]], right[i, at[i]]
            lighter[i] = wr[i, at[i]] < wl[i, at[i]]
    return gain, feature, cut, means, lighter


def with_siblings(light: np.ndarray, wanted: np.ndarray, parents: np.ndarray) -> np.ndarray:
    """Sums of all nodes of a level from those of the lighter children and of the level above.  Bins that the sibling
    leaves empty are empty, whatever the rounding of weights left there."""
    sums = np.zeros((2, 2 * parents.shape[1], parents.shape[2]))
    above = parents[:, wanted >> 1]
    rest = above - light
    rest[:, rest[0] <= 1e-11 * above[0]] = 0.0
    sums[:, wanted], sums[:, wanted ^ 1] = light, rest
    return sums


def fit(df: DataFrame, features: list[str], max_iter: int, max_depth: int, step_size: float, pos_weight: float, seed: int,
        subsampling_rate: float = 1.0, feature_subset: str = "all") -> "BoostedTrees":
    spark = df.sparkSession
    sc = spark.sparkContext
    data = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col("label").cast("double").alias("label"))
    thresholds, n = bin_thresholds(data, [f"f{i}" for i in range(len(features))])
    pack = Packing(thresholds)

    def to_blocks(batches):
        import pyarrow as pa

        def block(parts):
            codes, y = (np.concatenate(p, axis=-1) for p in zip(*parts))
            return pa.RecordBatch.from_arrays([pa.array([codes.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["codes", "y"])

        parts, rows = [], 0
        for b in batches:
            if b.num_rows:
                # NULL becomes NaN
                columns = [np.asarray(b.column(i).to_numpy(zero_copy_only=False), dtype=np.float64) for i in range(b.num_columns)]
                parts.append((pack.codes(columns[:-1]), (columns[-1] == 1.0).astype(np.uint8)))
                rows += b.num_rows
                if rows >= BLOCK_ROWS:
                    yield block(parts)
                    parts, rows = [], 0
        if parts:
            yield block(parts)

    tasks = sc.defaultParallelism
    tasks *= -(-n // (ROWS_A_TASK * tasks))
    path = scratch_path(spark, "boosting-blocks")
    data.mapInArrow(to_blocks, "codes binary, y binary").repartition(tasks).write.parquet(path)  # blocks are the same whenever they are read

    def opened(row):
        y = np.frombuffer(row["y"], dtype=np.uint8)
        return np.frombuffer(row["codes"], dtype=np.uint16).reshape(len(pack.groups), -1), y, np.zeros(len(y))

    state = spark.read.parquet(path).rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    before, saved, trees, rng = None, None, [], np.random.default_rng(seed)
    k = subset_size(feature_subset, len(features))
    for m in range(max_iter):
        inner = (1 << max_depth) - 1
        feature, threshold, gains = np.full(inner, -1), np.zeros(inner), np.zeros(inner)
        group, right = np.zeros(inner, dtype=np.intp), np.zeros((inner, PACKED), dtype=np.uint8)
        value, is_open, wanted, sums = None, np.array([True]), np.array([0]), None
        bag = (seed + m, subsampling_rate) if subsampling_rate < 1.0 else None
        for level in range(max_depth):
            nodes, at = 1 << level, (1 << level) - 1
            children = np.repeat(value, 2) if value is not None else None
            if is_open.any():
                parts = state.mapPartitions(_sums(pack, Paths(group, right, level, len(pack.groups)), wanted, m == 0, pos_weight, bag))
                found = parts.treeReduce(np.add) if parts.getNumPartitions() > MERGED_BY_DRIVER else sum(parts.collect())
                sums = with_siblings(found, wanted, sums) if level else found
                if before is not None:
                    before.unpersist()
                    before = None
                    if m % CHECKPOINT_EVERY == 0:
                        if saved:
                            _delete(spark, saved)
                        saved = state.getCheckpointFile()
                if value is None:
                    w, s = sums[0, :, :pack.n_bins[0]].sum(axis=1), sums[1, :, :pack.n_bins[0]].sum(axis=1)
                    value = np.where(w > 0, s / np.where(w > 0, w, 1.0), 0.0)
                    children = np.repeat(value, 2)
                gain, best, cut, means, lighter = best_splits(sums, pack, k, rng)
                now_open = np.zeros(2 * nodes, dtype=bool)
                split = np.flatnonzero(is_open & (best >= 0))
                wanted = 2 * split + lighter[split]
                for i in split:
                    feature[at + i], threshold[at + i], gains[at + i] = best[i], pack.thresholds[best[i]][cut[i]], gain[i]
                    group[at + i], right[at + i] = pack.goes_right(best[i], cut[i])
                    children[2 * i:2 * i + 2] = means[i]
                    now_open[2 * i:2 * i + 2] = True
                is_open = now_open
            else:
                is_open = np.zeros(2 * nodes, dtype=bool)
            value = children
        trees.append({"feature": feature.tolist(), "threshold": threshold.tolist(), "gain": gains.tolist(), "value": value.tolist()})
        if m + 1 < max_iter:
            # the first level of the next tree carries the margins on and keeps them
            before, state = state, state.map(_advance(Paths(group, right, max_depth, len(pack.groups)), value * (1.0 if m == 0 else step_size))).persist(StorageLevel.MEMORY_AND_DISK_DESER)
            if (m + 1) % CHECKPOINT_EVERY == 0:
                state.checkpoint()
    state.unpersist()
    for old in (saved, path):
        if old:
            _delete(spark, old)
    return BoostedTrees(inputCols=list(features), depth=max_depth, stepSize=float(step_size), trees=json.dumps(trees))


def _sums(pack, paths, wanted, first, pos_weight, bag):
    return lambda blocks: level_sums(blocks, pack, paths, wanted, first, pos_weight, bag)


def _advance(paths, value):
    """Adds a tree's values to the margins."""
    return lambda b: (b[0], b[1], b[2] + value.take(paths.nodes(b[0])))


def _delete(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------- the model

class Scorer:
    """Margins of rows.  A tree of at most 64 leaves is a word of as many bits a row: the joint number of each group of features
    clears the leaves that it rules out, and the one bit that stays is the leaf; deeper trees are walked."""

    CHUNK = 256

    def __init__(self, trees: list[dict], step_size: float, depth: int, n_features: int):
        self.depth, leaves = depth, 1 << depth
        self.feature = np.array([t["feature"] for t in trees], dtype=np.intp)
        self.threshold = np.array([t["threshold"] for t in trees])
        weights = np.array([1.0] + [step_size] * (len(trees) - 1))
        self.value = np.array([t["value"] for t in trees]) * weights[:, None]
        if depth > 6:
            return
        word = np.uint32 if depth <= 5 else np.uint64
        every = (1 << leaves) - 1
        self.pack = Packing([np.unique(self.threshold[self.feature == f]).tolist() for f in range(n_features)])
        masks = [np.full((size, len(trees)), every, dtype=word) for size in self.pack.sizes]
        for t in range(len(trees)):
            for i in range(leaves - 1):
                level = (i + 1).bit_length() - 1
                width = leaves >> (level + 1)
                first = (i + 1 - (1 << level)) * 2 * width
                lefts, rights = (((1 << width) - 1) << first), (((1 << width) - 1) << (first + width))
                f = self.feature[t, i]
                if f < 0:
                    masks[0][:, t] &= word(every & ~rights)
                    continue
                g, right = self.pack.goes_right(f, int(np.searchsorted(self.pack.thresholds[f], self.threshold[t, i])))
                masks[g][:, t] &= np.where(right[:self.pack.sizes[g]], word(every & ~lefts), word(every & ~rights))
        self.masks = masks

    def margins(self, columns: list[np.ndarray]) -> np.ndarray:
        n, t = len(columns[0]), len(self.value)
        out = np.zeros(n)
        if self.depth > 6:
            for i in range(0, n, self.CHUNK):
                out[i:i + self.CHUNK] = self._walk([c[i:i + self.CHUNK] for c in columns])
            return out
        codes = self.pack.codes(columns)
        first_leaf = np.arange(t) * (1 << self.depth) - 1023  # 1023: what a float adds to an exponent
        # the arrays of a chunk are taken once
        left, one = (np.empty((min(n, self.CHUNK), t), dtype=self.masks[0].dtype) for _ in range(2))
        bits, value = (np.empty((min(n, self.CHUNK), t)) for _ in range(2))
        for i in range(0, n, self.CHUNK):
            m = min(self.CHUNK, n - i)
            for g, masks in enumerate(self.masks):
                masks.take(codes[g, i:i + m], axis=0, out=one[:m] if g else left[:m], mode="clip")
                if g:
                    np.bitwise_and(left[:m], one[:m], out=left[:m])
            bits[:m] = left[:m]
            leaf = bits[:m].view(np.int64)
            leaf >>= 52
            leaf += first_leaf
            self.value.ravel().take(leaf, out=value[:m], mode="clip")
            out[i:i + m] = value[:m].sum(axis=1)
        return out

    def _walk(self, columns: list[np.ndarray]) -> np.ndarray:
        n, t = len(columns[0]), len(self.value)
        x, tree, node = np.stack(columns), np.arange(t)[None, :], np.zeros((n, t), dtype=np.intp)
        for _ in range(self.depth):
            f = self.feature[tree, node]
            node = 2 * node + 1 + ((f >= 0) & ~(x[f, np.arange(n)[:, None]] <= self.threshold[tree, node]))
        return self.value[tree, node - ((1 << self.depth) - 1)].sum(axis=1)


class BoostedTrees(Model, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted trees: ``transform`` adds ``probability``, P(class 1)."""

    inputCols = Param(Params._dummy(), "inputCols", "feature columns, in the order of the trees", TypeConverters.toListString)
    depth = Param(Params._dummy(), "depth", "levels of every tree", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "weight of all trees but the first", TypeConverters.toFloat)
    treesJson = Param(Params._dummy(), "treesJson", "trees as complete ones: feature (-1: all rows go left), threshold, gain, value by node", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, depth=None, stepSize=None, trees=None):
        super().__init__()
        given = {"inputCols": inputCols, "depth": depth, "stepSize": stepSize, "treesJson": trees}
        self._set(**{k: v for k, v in given.items() if v is not None})

    @property
    def trees(self) -> list[dict]:
        return json.loads(self.getOrDefault("treesJson"))

    @property
    def featureImportances(self):
        """Gains by feature, as shares of all gains."""
        total = np.zeros(len(self.getOrDefault("inputCols")))
        for t in self.trees:
            feature, gain = np.array(t["feature"]), np.array(t["gain"])
            np.add.at(total, feature[feature >= 0], gain[feature >= 0])
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = self.getOrDefault("inputCols")
        scorer = Scorer(self.trees, self.getOrDefault("stepSize"), self.getOrDefault("depth"), len(names))

        @F.pandas_udf("double")
        def probability(features: pd.DataFrame) -> pd.Series:
            columns = [features[c].to_numpy(dtype=np.float64, na_value=np.nan) for c in features.columns]
            return pd.Series(1.0 / (1.0 + np.exp(np.clip(-2.0 * scorer.margins(columns), -700.0, 700.0))))

        return dataset.withColumn("probability", probability(F.struct(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(names)])))
