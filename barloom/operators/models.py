"""MLlib models over feature panels: folds, calibration, importance, attributions."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import daily_rank_ic
from .labels import assign_folds
from .ordered import Cut
from .shared import by_rows, written


def _prepared(columns: list[str]) -> list:
    """Missing values by their median, then one vector."""
    filled = [f"_f{i}" for i in range(len(columns))]
    return [Imputer(inputCols=columns, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_x")]


def _columns_of(n: int) -> list[str]:
    return ["_x", *[f"_f{i}" for i in range(n)]]


class Models(NamedTuple):
    """A fitted return model and a fitted class model over the same columns, with their versions."""

    regression: PipelineModel
    classes: PipelineModel
    columns: list[str]
    regression_version: str = "1"
    classes_version: str = "1"


def _narrow(rows: DataFrame, columns: list[str], *more: str) -> DataFrame:
    return rows.select(*dict.fromkeys([*columns, *more]))


def fit(train: DataFrame, columns: list[str], y: str, label: str, *, seed: int = 7, version: str = "1", cut: Cut = written) -> Models:
    """A boosted regression of ``y`` and a forest for the classes ``label`` (0, 1, ..).

    Trees read their rows many times: ``cut`` writes the columns they learn from
    and reads them back.  A table without rows, and a feature without a single
    value, can't be learned from: an error that says so.
    """
    train = cut(_narrow(train, columns, y, label))
    seen = train.agg(F.count("*"), *[F.count(F.when(~F.isnan(c), F.col(c))) for c in columns]).first()
    if not seen[0]:
        raise ValueError("the training table has no rows")
    if not all(seen[1:]):
        raise ValueError(f"no value at all in the training table: {', '.join(c for c, n in zip(columns, seen[1:], strict=True) if not n)}")
    filled = Pipeline(stages=_prepared(columns)).fit(train)
    ready = filled.transform(train)
    boosted = GBTRegressor(featuresCol="_x", labelCol=y, predictionCol="predicted_return", maxIter=5, maxDepth=3, seed=seed).fit(ready)
    forest = RandomForestClassifier(featuresCol="_x", labelCol=label, predictionCol="_class", probabilityCol="_p", rawPredictionCol="_raw", numTrees=8, maxDepth=4, seed=seed)
    return Models(PipelineModel([*filled.stages, boosted]), PipelineModel([*filled.stages, forest.fit(ready)]), list(columns), version, version)


def score(rows: DataFrame, models: Models) -> DataFrame:
    """``rows`` with predicted return, most probable class, its neighbours at the ends, and the models' versions.

    ``predicted_class`` is the first of the most probable classes, ``top_p`` the
    last class's probability, ``bot_p`` the first one's, ``probabilities`` all of
    them.  Missing features are filled as the models learned; columns that the
    rows have not count as missing.
    """
    have, n = set(rows.columns), len(models.columns)
    out = rows.withColumns({c: F.lit(None).cast("double") for c in models.columns if c not in have})
    out = models.classes.transform(models.regression.transform(out).drop(*_columns_of(n)))
    p = vector_to_array("_p")
    out = out.withColumns(
        {
            "probabilities": p, "predicted_class": (F.array_position(p, F.array_max(p)) - 1).cast("int"), "top_p": F.element_at(p, -1), "bot_p": F.element_at(p, 1),
            "regression_version": F.lit(models.regression_version), "classes_version": F.lit(models.classes_version),
        }
    )
    return out.drop("_class", "_p", "_raw", *_columns_of(n), *[c for c in models.columns if c not in have])


def fit_predict_folds(rows: DataFrame, columns: list[str], y: str, label: str, *, folds: list | None = None, seed: int = 7, cut: Cut = written) -> DataFrame:
    """Predictions of each fold by models of the other folds: a return, and a class with its probabilities.

    Rows without a fold are in all trainings and get no prediction.  ``folds``
    lists the values of ``fold``, all of them by default; each trains once, so
    they should be few.  ``cut`` writes the rows once for all of them.
    """
    rows = cut(rows)
    folds = folds if folds is not None else sorted(r.fold for r in rows.filter("fold is not null").select("fold").distinct().collect())
    parts = []
    for k in folds:
        models = fit(rows.filter(~F.col("fold").eqNullSafe(F.lit(k))), columns, y, label, seed=seed, cut=lambda x: x)
        parts.append(score(rows.filter(F.col("fold") == k), models).drop("regression_version", "classes_version"))
    return reduce(DataFrame.unionByName, parts)


def revalidate(rows: DataFrame, models: Models, folds: DataFrame, y: str, label: str, *, cut: Cut = written) -> DataFrame:
    """(fold, mean_rank_ic, accuracy, n_rows) of frozen models on the validation part of purged folds, without training again.

    Rows without a return or class are left out of its figure; a fold without any rows is missing.
    Rows are scored once: ``cut`` writes what both figures read.
    """
    val = score(assign_folds(rows, folds).filter("part = 'val'"), models)
    val = cut(val.select(*dict.fromkeys(["fold", "bar_date", "predicted_return", "predicted_class", y, label])))
    ranks = val.filter(F.col(y).isNotNull()).withColumn("_day", F.struct("fold", "bar_date"))
    days = daily_rank_ic(ranks, "predicted_return", y, date="_day").groupBy("_day.fold").agg(F.avg("rank_ic").alias("mean_rank_ic"))
    hits = val.groupBy("fold").agg(F.avg((F.col("predicted_class") == F.col(label)).cast("double")).alias("accuracy"), F.count("*").alias("n_rows"))
    return hits.join(days, "fold", "left").select("fold", "mean_rank_ic", "accuracy", "n_rows")


def calibrate(rows: DataFrame, probs: str, label: str, n: int, *, cut: Cut = written) -> DataFrame:
    """``rows`` with ``calibrated``: isotonic regression per class, clipped, rows normalised (a zero sum stays zero).

    Rows with one probability of a class count as one with their weight, which
    is what the regression makes of them anyway; ``cut`` writes the rows, and
    those of all classes, once.
    """
    rows = out = cut(rows)
    each = rows.select(F.col(label).alias("_l"), F.posexplode(F.slice(probs, 1, n)).alias("_k", "_p"))
    each = cut(each.groupBy("_k", "_p").agg(F.avg((F.col("_l") == F.col("_k")).cast("double")).alias("_y"), F.count("_l").cast("double").alias("_w")).filter("_w > 0"))
    for k in range(n):
        model = IsotonicRegression(featuresCol="_p", labelCol="_y", weightCol="_w", predictionCol=f"_c{k}").fit(each.filter(F.col("_k") == k))
        out = model.transform(out.withColumn("_p", F.element_at(probs, k + 1))).drop("_p")
    clipped = [F.least(F.greatest(F.col(f"_c{k}"), F.lit(0.0)), F.lit(1.0)) for k in range(n)]
    total = reduce(lambda a, b: a + b, clipped)
    return out.withColumn("calibrated", F.array(*[c / F.when(total > 0, total).otherwise(1.0) for c in clipped])).drop(*[f"_c{k}" for k in range(n)])


def feature_importance(rows: DataFrame, columns: list[str], y: str, *, cut: Cut = written) -> DataFrame:
    """(feature, importance) of a boosted model, largest first; ``cut`` writes the columns it learns from, which trees read many times, in tasks of about as many rows however many there are."""
    rows = by_rows(cut(_narrow(rows, columns, y)))
    model = Pipeline(stages=[*_prepared(columns), GBTRegressor(featuresCol="_x", labelCol=y, maxIter=5, maxDepth=3, seed=7)]).fit(rows)
    gains = model.stages[-1].featureImportances.toArray().tolist()
    return rows.sparkSession.createDataFrame(list(zip(columns, gains, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def top_k_attribution(rows: DataFrame, keys: list[str], columns: list[str], y: str, k: int = 3, *, cut: Cut = written) -> DataFrame:
    """Per row the k largest contributions of a linear model, with sign and rank; ``cut`` writes the rows, which are read once to fill, to fit and to explain."""
    rows = cut(_narrow(rows, [*keys, *columns], y))
    model = Pipeline(stages=[*_prepared(columns), LinearRegression(featuresCol="_x", labelCol=y)]).fit(rows)
    weights = model.stages[-1].coefficients.toArray().tolist()
    x = [F.col(f"_f{i}") for i in range(len(columns))]
    items = F.array(*[F.struct(F.abs(x[i] * w).alias("size"), F.lit(c).alias("feature"), (x[i] * w).alias("contribution")) for i, (c, w) in enumerate(zip(columns, weights, strict=True))])
    best = F.slice(F.sort_array(items, asc=False), 1, k)
    out = model.transform(rows).select(*keys, F.posexplode(best).alias("rank", "x"))
    return out.select(*keys, (F.col("rank") + 1).alias("rank"), "x.feature", "x.contribution", F.when(F.col("x.contribution") >= 0, "+").otherwise("-").alias("sign"))


