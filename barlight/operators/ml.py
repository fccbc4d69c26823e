"""Training sets, fits and metrics of regime classifiers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numeric columns that are no features.
NOT_FEATURES = ("ticker", "day", "ts", "open", "high", "low", "close", "volume", "regime", "regime_prev", "changed", "split", "weight", "slope_n")


def training_set(features: DataFrame, labels: DataFrame, day=None, min_rows: int = 300) -> DataFrame:
    """Features with regime, up to the day, of tickers with enough labelled rows."""
    out = features.join(labels.select("ticker", "day", "regime"), ["ticker", "day"]).where(F.col("regime").isNotNull())
    if day is not None:
        out = out.where(F.col("day") <= day)
    return out.withColumn("_n", F.count("*").over(Window.partitionBy("ticker"))).where(F.col("_n") >= min_rows).drop("_n")


def feature_columns(df: DataFrame, drop_empty: bool = False) -> list[str]:
    """Numeric columns that are features; drop_empty leaves out those without a finite value (one aggregate row)."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in NOT_FEATURES]
    if not drop_empty or not names:
        return names
    finite = lambda c: F.count(F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")), 1)).alias(c)
    counts = df.agg(*[finite(c) for c in names]).first()
    return [c for c in names if counts[c]]


def time_split(df: DataFrame, holdout: float = 0.2) -> DataFrame:
    """split: the last max(1, round(share of rows)) days of each ticker are the holdout."""
    w = Window.partitionBy("ticker").orderBy(F.desc("day"))
    n = F.greatest(F.lit(1), F.round(F.count("*").over(Window.partitionBy("ticker")) * holdout).cast("int"))
    return df.withColumn("split", F.when(F.row_number().over(w) <= n, "holdout").otherwise("train"))


def split_ranges(df: DataFrame) -> DataFrame:
    return df.groupBy("ticker", "split").agg(F.min("day").alias("start_day"), F.max("day").alias("end_day"), F.count("*").alias("rows"))


def class_weights(train: DataFrame) -> DataFrame:
    """train with weight: rows / (classes * rows of the class), by ticker."""
    own = train.groupBy("ticker", "regime").agg(F.count("*").alias("_c"))
    every = own.groupBy("ticker").agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    return train.join(own, ["ticker", "regime"]).join(every, "ticker").withColumn("weight", F.col("_n") / (F.col("_k") * F.col("_c"))).drop("_c", "_n", "_k")


def fit_regime(train: DataFrame, columns: Sequence[str], weighted: bool = False, c: float = 1.0, max_iter: int = 800) -> PipelineModel:
    """Median imputation, scaling and multinomial logistic regression with penalty 1 / (c * rows)."""
    filled = [f"{x}_filled" for x in columns]
    index = StringIndexer(inputCol="regime", outputCol="label", stringOrderType="alphabetAsc").fit(train)
    stages = [Imputer(inputCols=list(columns), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw"),
              StandardScaler(inputCol="raw", outputCol="features", withMean=True), index,
              LogisticRegression(family="multinomial", regParam=1.0 / (c * max(train.count(), 1)), maxIter=max_iter, standardization=False, **({"weightCol": "weight"} if weighted else {})),
              IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)]
    return Pipeline(stages=stages).fit(train)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def multinomial(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, max_iter: int = 100) -> np.ndarray:
    """Coefficients (classes by features and intercept) of least weighted mean log loss plus penalty / 2 * |w|^2, by
    Newton's steps, halved while they don't help; the intercepts bear no penalty and sum to 0."""
    n, k = len(x), int(y.max()) + 1
    design, share = np.column_stack([x, np.ones(n)]), weight / weight.sum()
    d, hot = design.shape[1], np.eye(k)[y]
    ridge = np.full(d, penalty)
    ridge[-1] = 0.0
    beta = np.zeros((k, d))
    loss = lambda b: -(share * np.log(np.maximum((softmax(design @ b.T) * hot).sum(axis=1), 1e-300))).sum() + 0.5 * (ridge * b * b).sum()
    now = loss(beta)
    for _ in range(max_iter):
        p = softmax(design @ beta.T)
        slope = (share[:, None] * (p - hot)).T @ design + ridge * beta
        curve = np.zeros((k, d, k, d))
        for i in range(k):
            for j in range(k):
                curve[i, :, j] = (design * (share * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ design
            curve[i, :, i] += np.diag(ridge)
        step = np.linalg.lstsq(curve.reshape(k * d, k * d), slope.ravel(), rcond=1e-12)[0].reshape(k, d)
        size = 1.0
        while (new := loss(beta - size * step)) > now and size > 1e-6:
            size /= 2
        if now - new < 1e-13:
            break
        beta, now = beta - size * step, new
    beta[:, -1] -= beta[:, -1].mean()
    return beta


MODEL = "ticker string, classes array<string>, medians array<double>, means array<double>, scales array<double>, coefficients array<array<double>>, rows long, error string"


def fit_all(train: DataFrame, columns: Sequence[str], min_train: int = 50, weighted: bool = False, c: float = 1.0, max_iter: int = 100) -> DataFrame:
    """A row for each ticker: its model (medians that fill gaps, means and scales, coefficients with the intercept last),
    or why it has none. One job fits all; a task holds the daily rows of a ticker, and one failure stops no other."""
    names = list(columns)

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out = dict.fromkeys(("classes", "medians", "means", "scales", "coefficients", "error"))
        try:
            if len(f) < min_train:
                raise ValueError(f"{len(f)} training rows of {min_train}")
            x = f[names].to_numpy(np.float64)
            x[~np.isfinite(x)] = np.nan
            known = (~np.isnan(x)).any(axis=0)
            medians = np.where(known, np.nanmedian(np.where(known, x, 0.0), axis=0), 0.0)
            x = np.where(np.isnan(x), medians, x)
            means, spread = x.mean(axis=0), x.std(axis=0, ddof=1)
            scales = np.divide(1.0, spread, out=np.zeros(len(spread)), where=spread > 0)
            classes, y = np.unique(f.regime.to_numpy(str), return_inverse=True)
            own = np.bincount(y)
            weight = len(y) / (len(classes) * own[y]) if weighted else np.ones(len(y))
            beta = multinomial((x - means) * scales, y, weight, 1.0 / (c * len(y)), max_iter)
            out |= {"classes": classes.tolist(), "medians": medians, "means": means, "scales": scales, "coefficients": beta.tolist()}
        except Exception as e:  # noqa: BLE001
            out["error"] = f"{type(e).__name__}: {e}"
        return pd.DataFrame([{"ticker": key[0], **out, "rows": len(f)}])[[x.split()[0] for x in MODEL.split(", ")]]

    return train.select("ticker", "regime", *names).groupBy("ticker").applyInPandas(run, MODEL)


def predict_all(models: DataFrame, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """ticker, day, regime, prediction of the rows whose ticker has a model: the class of the highest score."""
    own = models.where("error IS NULL").select("ticker", "classes", "medians", "means", "scales", "coefficients")
    both = rows.select("ticker", "day", "regime", F.array(*[F.col(c).cast("double") for c in columns]).alias("x")).join(own, "ticker")
    finite = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))
    filled = F.transform("x", lambda v, i: (F.when(finite(v), v).otherwise(F.get("medians", i)) - F.get("means", i)) * F.get("scales", i))
    both = both.withColumn("z", F.concat(filled, F.array(F.lit(1.0))))
    score = F.transform("coefficients", lambda w: F.aggregate(F.zip_with(w, F.col("z"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    both = both.withColumn("score", score)
    return both.select("ticker", "day", "regime", F.element_at("classes", F.array_position("score", F.array_max("score")).cast("int")).alias("prediction"))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).select("ticker", "day", "regime", F.col("predicted").alias("prediction"))


def metrics(predictions: DataFrame) -> DataFrame:
    """accuracy and balanced_accuracy (mean recall of the classes in the truth) by ticker."""
    hit = F.when(F.col("regime") == F.col("prediction"), 1.0).otherwise(0.0)
    by_class = predictions.groupBy("ticker", "regime").agg(F.avg(hit).alias("recall"), F.sum(hit).alias("hits"), F.count("*").alias("n"))
    return by_class.groupBy("ticker").agg((F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.sum("n").alias("rows"))


def confusion(predictions: DataFrame) -> DataFrame:
    """Counts of every pair of labels of a ticker, zeros kept; labels are those in truth or prediction, a handful."""
    labels = predictions.select("ticker", F.col("regime").alias("l")).union(predictions.select("ticker", "prediction")).distinct()
    pairs = labels.withColumnRenamed("l", "regime").join(labels.withColumnRenamed("l", "prediction"), "ticker")
    counts = predictions.groupBy("ticker", "regime", "prediction").agg(F.count("*").alias("n"))
    return pairs.join(counts, ["ticker", "regime", "prediction"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_report(predictions: DataFrame) -> DataFrame:
    """precision, recall, f1 (0 on no rows) and support by class, then their macro and weighted means."""
    table = confusion(predictions)
    hits = table.where("regime = prediction").select("ticker", F.col("regime").alias("label"), F.col("n").alias("tp"))
    true = table.groupBy("ticker", F.col("regime").alias("label")).agg(F.sum("n").alias("support"))
    said = table.groupBy("ticker", F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    rows = hits.join(true, ["ticker", "label"]).join(said, ["ticker", "label"]).select("ticker", "label", part("tp", "predicted").alias("precision"), part("tp", "support").alias("recall"), "support")
    p, r = F.col("precision"), F.col("recall")
    rows = rows.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
    names = ("precision", "recall", "f1")
    macro = rows.groupBy("ticker").agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = rows.groupBy("ticker").agg(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names], F.sum("support").alias("support"))
    return rows.select("ticker", "label", *names, "support").unionByName(macro).unionByName(weighted)


def register_model(registry: DataFrame | None, row: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry with a row added, and its newest version of each model."""
    every = row if registry is None else registry.unionByName(row)
    w = Window.partitionBy("model").orderBy(F.desc("asof_day"), F.desc("version"))
    return every, every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
