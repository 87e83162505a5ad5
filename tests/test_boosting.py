import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vigil.operators import boosting as B
from vigil.operators import models as ML
from vigil.session import scratch_path

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def frame(spark):
    """few values a feature, and a label that depends on several of them, with noise"""
    rng = np.random.RandomState(3)
    rows = []
    for i in range(3000):
        a, b, c, d = rng.randint(0, 20), rng.randint(0, 7), rng.randint(0, 2), rng.randint(0, 30)
        y = float((a > 11) ^ (b < 2) if rng.rand() < 0.85 else rng.rand() < 0.3 + 0.01 * d)
        rows.append((i, float(a) / 7, float(b), float(c), None if i % 50 == 0 else float(d), y))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label double").cache()


def by_spark(df, iters, depth, pos_weight):
    data = df.withColumn("w", F.when(F.col("label") == 1.0, F.lit(pos_weight)).otherwise(F.lit(1.0)))
    gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="w", maxIter=iters, maxDepth=depth, stepSize=0.1, seed=1)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep"), gbt]).fit(data)


@pytest.mark.parametrize("depth,pos_weight", [(3, 1.0), (5, 15.0)])
def test_the_same_trees_as_gbt_classifier(spark, frame, depth, pos_weight):
    whole = frame.where(F.col("d").isNotNull())
    theirs = by_spark(whole, 6, depth, pos_weight)
    ours = ML.train_gbt(whole.repartition(5), FEATURES, max_iter=6, max_depth=depth, pos_weight=pos_weight)
    want = {r.id: r.p for r in theirs.transform(whole).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    got = {r.id: r.p for r in ML.score_batch(ours, whole).select("id", "p").collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-9
    assert ours.stages[-1].featureImportances.toArray() == pytest.approx(theirs.stages[-1].featureImportances.toArray(), abs=1e-9)
    assert len(ours.stages[-1].trees) == 6


def test_saved_and_read_again(spark, frame):
    model = ML.train_gbt(frame, FEATURES, max_iter=4, max_depth=3)
    again = ML.load_model(ML.save_model(model, scratch_path(spark, "boosted")))
    a, b = (sorted(ML.score_batch(m, frame).select("id", "p").collect()) for m in (model, again))
    assert a == b and len(a) == 3000
    assert ML.score_batch(model, frame).columns == [*frame.columns, "p"]


def test_margins_of_the_tasks_and_of_the_scorer_agree(spark, frame):
    """words of leaves, and trees too deep for them, against a walk in plain Python"""
    for depth in (4, 6, 7):
        model = ML.train_gbt(frame, FEATURES, max_iter=3, max_depth=depth, step_size=0.3).stages[-1]
        rows = frame.select(*FEATURES).limit(300).collect()
        columns = [np.array([np.nan if r[f] is None else r[f] for r in rows]) for f in FEATURES]
        got = B.Scorer(model.trees, 0.3, depth, len(FEATURES)).margins(columns)
        for j in range(len(rows)):
            margin = 0.0
            for m, t in enumerate(model.trees):
                i = 0
                for _ in range(depth):
                    f = t["feature"][i]
                    i = 2 * i + 1 + int(f >= 0 and not columns[f][j] <= t["threshold"][i])
                margin += t["value"][i - (2 ** depth - 1)] * (1.0 if m == 0 else 0.3)
            assert got[j] == pytest.approx(margin, abs=1e-12)


def test_many_values_fall_into_quantile_bins_of_all_rows(spark):
    df = spark.range(20_000).select((F.col("id") * 1.5).alias("x"), F.lit(None).cast("double").alias("none"), F.when(F.col("id") % 2 == 0, F.lit(3.0)).otherwise(F.lit(float("nan"))).alias("half"),
                                    (F.col("id") >= 15_000).cast("double").alias("label"))
    (x, none, half), n = B.bin_thresholds(df, ["x", "none", "half"])
    assert n == 20_000 and len(x) == B.BINS - 1 and none == half == []
    assert all(abs(t - 30_000 * (i + 1) / B.BINS) < 30_000 * 0.002 for i, t in enumerate(x))
    model = ML.train_gbt(df, ["x", "none", "half"], max_iter=2, max_depth=2)
    wrong = ML.score_batch(model, df).where((F.col("p") > 0.5) != (F.col("label") == 1.0)).count()
    assert wrong < 20_000 / B.BINS


def test_long_boosting_cuts_its_lineage_and_leaves_no_files(spark, frame):
    import os
    base = spark.sparkContext.getCheckpointDir().replace("file:", "")
    few = frame.limit(400)
    model = ML.train_gbt(few, FEATURES, max_iter=2 * B.CHECKPOINT_EVERY + 2, max_depth=2)
    assert len(model.stages[-1].trees) == 2 * B.CHECKPOINT_EVERY + 2
    assert not [d for d in os.listdir(base) if d.startswith(("boosting-blocks", "rdd-"))]


def test_samples_of_rows_and_features(spark, frame):
    one, two = (ML.train_gbt(frame, FEATURES, max_iter=4, max_depth=3, seed=5, subsampling_rate=0.5, feature_subset="sqrt").stages[-1] for _ in range(2))
    assert one.trees == two.trees
    assert one.trees != ML.train_gbt(frame, FEATURES, max_iter=4, max_depth=3, seed=5).stages[-1].trees


def test_no_rows_or_odd_labels_are_refused(spark, frame):
    with pytest.raises(ValueError):
        ML.train_gbt(frame.where("false"), FEATURES, max_iter=1, max_depth=1)
    with pytest.raises(ValueError):
        ML.train_gbt(frame.withColumn("label", F.col("label") + 1), FEATURES, max_iter=1, max_depth=1)


@pytest.mark.parametrize("pos_weight", [15.0, 0.3])
def test_lighter_children_give_the_sums_of_all_nodes(pos_weight):
    """rows of the other children are not added up, and empty bins stay empty"""
    rng = np.random.default_rng(8)
    bins, n = [32, 9, 32, 7, 2], 5000
    pack = B.Packing([list(range(b - 1)) for b in bins])
    columns = [rng.integers(0, b, n) - 0.5 for b in bins]
    block = pack.codes(columns), (rng.random(n) < 0.2).astype(np.uint8), rng.normal(size=n)
    group, right, tree = np.zeros(127, dtype=np.intp), np.zeros((127, B.PACKED), dtype=np.uint8), {}
    for i in range(127):
        if i < 3 or rng.random() < 0.8:
            f = int(rng.integers(0, len(bins)))
            tree[i] = f, int(rng.integers(0, bins[f] - 1))
            group[i], right[i] = pack.goes_right(*tree[i])
    above = None
    for level in range(8):
        node = np.zeros(n, dtype=int)
        for l in range(level):
            node = np.array([2 * i + int((i + (1 << l) - 1) in tree and columns[tree[i + (1 << l) - 1][0]][j] > tree[i + (1 << l) - 1][1]) for j, i in enumerate(node)])
        paths = B.Paths(group, right, level, len(pack.groups))
        assert (paths.nodes(block[0]) == node).all()
        (want,) = B.level_sums([block], pack, paths, np.arange(1 << level), False, pos_weight, None)
        weight = np.where(block[1], pos_weight, 1.0)
        for f, (offset, b) in enumerate(zip(np.cumsum([0, *bins]), bins)):
            by_hand = np.bincount(node * b + (columns[f] + 0.5).astype(int), weight, (1 << level) * b).reshape(-1, b)
            assert np.allclose(want[0][:, offset:offset + b], by_hand, rtol=1e-12)
        if level:
            wanted = np.array([2 * i + int((node == 2 * i + 1).sum() < (node == 2 * i).sum()) for i in range(1 << (level - 1))])
            (light,) = B.level_sums([block], pack, paths, wanted, False, pos_weight, None)
            whole = B.with_siblings(light, wanted, above)
            assert np.allclose(whole, want, atol=1e-9) and ((whole == 0) == (want == 0)).all()
        above = want


def test_blocks_are_large_and_neither_packed_nor_copied_in_memory(spark, monkeypatch):
    """25,000 rows of one file: one block, kept as it is"""
    from pyspark import RDD
    kept = []
    monkeypatch.setattr(RDD, "persist", lambda self, level, persist=RDD.persist: kept.append((persist(self, level), level, self.count())) or self)
    df = spark.range(0, 25_000, 1, 1).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("label"))
    ML.train_gbt(df, ["x"], max_iter=2, max_depth=1)
    assert [(level.deserialized, blocks) for _, level, blocks in kept] == [(True, 1), (True, 1)]
