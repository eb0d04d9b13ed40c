"""Classifiers of the attack: nearest neighbours as a join, and per-job models for many small problems.

A job has a few dozen training vectors, so fitting one Spark ML model per job would cost far more in
scheduling than in work: the per-job models run inside one grouped task each, in numpy, and thousands of
jobs share one stage. :func:`spark_forest` and :func:`spark_logistic` are the cluster-wide counterparts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privlens.sources.shared import materialize

K = 5
TREES = 100


#: Vectors of a block of test or training vectors that meet in one task.
KNN_BLOCK = 2048


def knn_predict(train: DataFrame, test: DataFrame, by: Sequence[str] = (), key: str = "id", features: str = "features", label: str = "label", k: int = K) -> DataFrame:
    """``(by, key, predicted, confidence)`` by the ``k`` nearest training vectors of the same job (squared distance, ties to the smaller key).

    The most frequent label wins, ties to the smaller label; confidence is its share. Test and training vectors are
    cut into blocks of about ``KNN_BLOCK``; each test block meets each training block of its job in a task, and only
    the ``k`` nearest of a block move on. Keys and labels are integers; vectors of a job have one length.
    """
    keys = [*by, "__i", "__j"]
    blocks = lambda df: df.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / KNN_BLOCK)).cast("int").alias("__n"))
    cuts = blocks(test).withColumnRenamed("__n", "__m")
    cuts = cuts.join(blocks(train), list(by)) if by else cuts.crossJoin(F.broadcast(blocks(train)))  # one row
    cuts = materialize(cuts, "cuts")  # a row per job: its own numbers of blocks, however many jobs there are
    cut = lambda df: df.join(cuts, list(by)) if by else df.crossJoin(F.broadcast(cuts))
    own = lambda name, n: F.pmod(F.xxhash64(F.col(name)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = cut(test.select(*by, F.col(key).cast("long").alias("__q"), F.col(features).cast("array<double>").alias("__x"))).withColumn("__i", own("__q", "__m")).withColumn("__j", each("__n")).drop("__m", "__n")
    b = cut(train.select(*by, F.col(key).cast("long").alias("__t"), F.col(features).cast("array<double>").alias("__y"), F.col(label).cast("long").alias("__l"))).withColumn("__j", own("__t", "__n")).withColumn("__i", each("__m")).drop("__m", "__n")
    b = b.select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], "__i", "__j", "__t", "__y", "__l")

    def near(asks: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        found = {"__q": [], "__t": [], "__l": [], "__d": []}
        if len(asks) and len(known):
            known = known.sort_values("__t", kind="stable")
            y, t, l = np.stack(known["__y"].to_numpy()), known["__t"].to_numpy(), known["__l"].to_numpy()
            squares = (y * y).sum(axis=1)
            for q, x in zip(asks["__q"].to_numpy(), asks["__x"].to_numpy()):
                on = np.arange(len(t))
                if len(t) > k:
                    # a quick estimate rules out what cannot be among the nearest; the rest is measured
                    rough = squares - 2.0 * (y @ x)
                    scale = 1e-9 * (squares.max() + x @ x)
                    on = np.flatnonzero(rough <= np.partition(rough, k - 1)[k - 1] + scale)
                d = ((y[on] - x) ** 2).sum(axis=1)
                best = np.lexsort((t[on], d))[:k]
                for name, v in (("__q", np.full(len(best), q)), ("__t", t[on][best]), ("__l", l[on][best]), ("__d", d[best])):
                    found[name].append(v)
        out = pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in found.items()})
        for i, c in enumerate(by):
            out.insert(i, c, asks[c].iloc[0] if len(asks) else None)
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in a.select(*by).schema.fields) + ", " * bool(by) + "__q long, __t long, __l long, __d double"
    met = a.groupBy(*keys).cogroup(b.groupBy(*[f"__b{i}" for i in range(len(by))], "__i", "__j")).applyInPandas(near, schema)
    w = Window.partitionBy(*by, "__q").orderBy("__d", "__t")
    votes = met.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).groupBy(*by, "__q", "__l").agg(F.count("*").alias("__n"))
    order = F.struct(F.col("__n"), -F.col("__l"))
    out = votes.groupBy(*by, "__q").agg(F.max_by("__l", order).alias("predicted"), (F.max("__n") / F.sum("__n")).alias("confidence"))
    return out.select(*by, F.col("__q").cast(test.schema[key].dataType).alias(key), F.col("predicted").cast(train.schema[label].dataType).alias("predicted"), "confidence")


# --- models of one job, in numpy -------------------------------------------------------------------


class Knn:
    def __init__(self, k: int = K):
        self.k = k

    def fit(self, x: np.ndarray, y: np.ndarray, rng) -> Knn:
        self.x, self.y = x, y
        return self

    def member(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        d = ((x[:, None, :] - self.x[None, :, :]) ** 2).sum(axis=2)
        near = np.argsort(d, axis=1, kind="stable")[:, : self.k]
        return self.y[near].mean(axis=1)


class Logistic:
    """Logistic regression on standardised features, by Newton steps with a small ridge."""

    def __init__(self, ridge: float = 1e-3, steps: int = 50):
        self.ridge, self.steps = ridge, steps

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), (x - self.mean) / self.scale])

    def fit(self, x: np.ndarray, y: np.ndarray, rng) -> Logistic:
        self.mean, std = x.mean(axis=0), x.std(axis=0)
        self.scale = np.where(std > 0, std, 1.0)
        z = self._scaled(x)
        # more columns than rows: solve in the row space, the ridge solution lies there
        self.basis = np.linalg.qr(z.T)[0] if z.shape[1] > z.shape[0] else np.eye(z.shape[1])
        u = z @ self.basis
        w = np.zeros(u.shape[1])
        for _ in range(self.steps):
            p = 1.0 / (1.0 + np.exp(-np.clip(u @ w, -30, 30)))
            step = np.linalg.solve((u * (p * (1 - p))[:, None]).T @ u + self.ridge * np.eye(len(w)), u.T @ (p - y) + self.ridge * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.w = w
        return self

    def member(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self._scaled(x) @ self.basis @ self.w, -30, 30)))


class Forest:
    """Random forest: bootstrap samples, Gini splits, ``floor(sqrt(d))`` features per node, leaves down to one row."""

    def __init__(self, trees: int = TREES):
        self.trees = trees

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> Forest:
        self.roots = []
        for _ in range(self.trees):
            on = rng.integers(0, len(x), len(x))
            self.roots.append(self._grow(x[on], y[on], rng))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, rng):
        mean = float(y.mean())
        if mean in (0.0, 1.0):
            return mean
        d = x.shape[1]
        best = None
        for j in rng.permutation(d):
            if best is not None and best[3] >= int(np.sqrt(d)):
                break
            order = np.argsort(x[:, j], kind="stable")
            v, t = x[order, j], y[order]
            cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
            tried = 1 if best is None else best[3] + 1
            if not len(cuts):
                continue
            ones = np.cumsum(t)[cuts - 1]
            n = len(t)
            pl, pr = ones / cuts, (t.sum() - ones) / (n - cuts)
            gini = (cuts * pl * (1 - pl) + (n - cuts) * pr * (1 - pr)) / n
            i = int(np.argmin(gini))
            if best is None or gini[i] < best[0]:
                best = (gini[i], j, (v[cuts[i]] + v[cuts[i] - 1]) / 2, tried)
            else:
                best = (*best[:3], tried)
        if best is None:
            return mean
        left = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[left], y[left], rng), self._grow(x[~left], y[~left], rng)

    def member(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for root in self.roots:
            for i, row in enumerate(x):
                node = root
                while isinstance(node, tuple):
                    node = node[2] if row[node[0]] <= node[1] else node[3]
                out[i] += node
        return out / len(self.roots)


CLASSIFIERS = {"KNN": Knn, "LR": Logistic, "RF": Forest}


def predict_jobs(vectors: DataFrame, by: Sequence[str], kind: str = "RF", seed: int = 0, keep: Sequence[str] = ("sample_id",)) -> DataFrame:
    """``(by, keep, predicted, confidence, p_member)`` of every test vector of every job.

    ``vectors`` has ``by``, ``keep``, ``phase`` (``train`` or ``test``), ``label`` (1: target in) and ``features``.
    A job's vectors must have one length; a job without either phase is an error. Confidence belongs to the
    predicted label.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*by, *keep).schema.fields) + ", predicted int, confidence double, p_member double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        train, test = pdf[pdf["phase"] == "train"].sort_values(list(keep)), pdf[pdf["phase"] == "test"].sort_values(list(keep))
        if not len(train) or not len(test):
            raise ValueError("a job needs training and test vectors")
        if len({len(v) for v in pdf["features"]}) > 1:
            raise ValueError("feature vectors of different lengths")
        rng = np.random.default_rng(seed)
        model = CLASSIFIERS[kind]().fit(np.stack(train["features"]).astype(float), train["label"].to_numpy(float), rng)
        p = model.member(np.stack(test["features"]).astype(float))
        out = test[[*by, *keep]].copy()
        out["predicted"] = (p > 0.5).astype(np.int32)
        out["confidence"] = np.maximum(p, 1 - p)
        out["p_member"] = p
        return out

    return vectors.groupBy(*by).applyInPandas(run, schema)


# --- cluster-wide models ---------------------------------------------------------------------------


def spark_forest(features: int, label: str = "label", seed: int = 0):
    """A Spark ML random forest with the attack's settings; its depth is bounded by 30."""
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(labelCol=label, numTrees=TREES, impurity="gini", minInstancesPerNode=1, maxDepth=30, featureSubsetStrategy=str(max(1, int(np.sqrt(features)))), subsamplingRate=1.0, seed=seed)


def spark_logistic(label: str = "label"):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(labelCol=label)


def utility_accuracy(df: DataFrame, features: Sequence[str], target: str, folds: int = 3, seed: int = 0, key: str | None = None) -> DataFrame:
    """One row ``(target, accuracy)``: k-fold accuracy of a logistic regression that predicts ``target`` from one-hot ``features``; -1 without features.

    Folds are dealt by a hash of ``key`` (or of the row), so they repeat.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    spark = df.sparkSession
    if not features or not target:
        return spark.createDataFrame([(target, -1.0)], "target string, accuracy double")
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*features, target)], *([F.col(key).alias("__k")] if key else []))
    fold = F.pmod(F.xxhash64(F.lit(seed), *(["__k"] if key else [*features, target])), F.lit(folds))
    prepared = Pipeline(stages=[
        StringIndexer(inputCols=[*features, target], outputCols=[*[f"{c}__i" for c in features], "label"], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"{c}__i" for c in features], outputCols=[f"{c}__v" for c in features]),
        VectorAssembler(inputCols=[f"{c}__v" for c in features], outputCol="features"),
    ])
    ready = prepared.fit(text).transform(text).select("features", "label", fold.alias("fold")).persist()
    judge = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    scores = []
    for f in range(folds):
        train, test = ready.where(F.col("fold") != f), ready.where(F.col("fold") == f)
        if train.isEmpty() or test.isEmpty():
            continue
        scores.append(judge.evaluate(spark_logistic().fit(train).transform(test)))
    ready.unpersist()
    return spark.createDataFrame([(target, float(np.mean(scores)) if scores else -1.0)], "target string, accuracy double")


def utility_accuracy_of_samples(df: DataFrame, by: Sequence[str], features: Sequence[str], target: str, folds: int = 3, seed: int = 0) -> DataFrame:
    """``(by, accuracy)`` of many samples: k-fold accuracy of one-against-rest logistic regressions on one-hot ``features``, one sample per grouped task.

    A sample of fewer rows than folds, or with one target value only, scores the share of its most frequent value.
    """
    text = df.select(*by, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in dict.fromkeys([*features, target])])
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in text.select(*by).schema.fields) + "accuracy double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*features, target], kind="stable")
        y = pdf[target].to_numpy()
        found = sorted(set(y))
        if len(y) < folds or len(found) == 1:
            right = np.mean(y == pdf[target].mode().iloc[0])
        else:
            x = pd.get_dummies(pdf[list(features)]).to_numpy(float)
            fold = np.random.default_rng(seed).permutation(len(y)) % folds
            guess = np.empty(len(y), object)
            for f in range(folds):
                on, off = fold != f, fold == f
                p = np.stack([Logistic().fit(x[on], (y[on] == v).astype(float), None).member(x[off]) for v in found])
                guess[off] = np.array(found, object)[p.argmax(axis=0)]
            right = np.mean(guess == y)
        return pd.DataFrame({b: [pdf[b].iloc[0]] for b in by} | {"accuracy": [float(right)]})

    return text.groupBy(*by).applyInPandas(run, schema)
