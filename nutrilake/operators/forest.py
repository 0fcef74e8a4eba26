"""Grade classifier by information gain (M1-M4, A12): random forest fit, prediction
with confidence, importances and split statistics per level.

Labels are indexed and medians filled in by MLlib; the trees are those of
``gainforest``, which stay a table: the driver holds only the splits above its groups."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StringIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nutrilake.operators import gainforest
from nutrilake.session import materialize

SEED = 1678807467440 % (2 ** 31)


@dataclass
class ForestModel:
    """Label index and medians, and the forest over the filled features and the missing indicators."""

    stages: PipelineModel
    forest: gainforest.Forest

    @property
    def labels(self) -> list[str]:
        return self.stages.stages[0].labels

    def save(self, path: str) -> None:
        self.stages.write().save(f"{path}/stages")
        self.forest.save(f"{path}/forest")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ForestModel:
        return ForestModel(PipelineModel.load(f"{path}/stages"), gainforest.Forest.load(spark, f"{path}/forest"))


def model_features(features: Sequence[str], filled: str = "") -> list[str]:
    return [f"{c}{filled}" for c in features] + [f"{c}__missing" for c in features]


def add_missing_flags(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select("*", *[F.col(c).isNull().cast("double").alias(f"{c}__missing") for c in features])


def fit_forest(train: DataFrame, features: Sequence[str], label: str, num_trees: int = 100, max_depth: int = 30,
               seed: int = SEED, local_rows: int = gainforest.LOCAL_ROWS) -> ForestModel:
    """M1: label index -> median imputation + missing indicators -> forest
    (entropy gain, sqrt(p) features per node, bootstrap of the full
    size, leaves pruned). No gain ratio and no learned missing direction here; the
    indicators let trees split on missingness instead. Rows that are the same
    to the trees are one row with the bag of all of its copies."""
    data = materialize(add_missing_flags(train.where(F.col(label).isNotNull()), features))
    stages = Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep"),
        Imputer(inputCols=list(features), outputCols=[f"{c}__imp" for c in features], strategy="median"),
    ]).fit(data)
    filled, names = stages.transform(data), model_features(features, "__imp")
    forest = gainforest.Forest(names, stages.stages[0].labels, gainforest.cuts_of(filled, names), num_trees, seed, 0, None, [{} for _ in range(num_trees)])
    rows = filled.select(forest.bins().alias("bins"), F.col("_label").cast("int").alias("label")).groupBy("bins", "label").agg(F.count(F.lit(1)).alias("copies"))
    rows = materialize(rows.select(F.xxhash64("bins", "label").alias("h"), "bins", "label", "copies"))
    forest.rows = rows.count()
    return ForestModel(stages, gainforest.grown(forest, rows, math.ceil(math.sqrt(len(names))), local_rows, by_ratio=False, depth=max_depth, prune=True))


def predict(model: ForestModel, df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """M2: ``Prediction (label)`` and ``Prediction (label) (Confidence)``
    (the largest class probability: the mean of the leaves' shares)."""
    asked = model.stages.transform(add_missing_flags(df, features)).withColumn("_bins", model.forest.bins())
    asked = materialize(asked.select(*df.columns, "_bins"))
    votes = gainforest.told(model.forest, asked.select(F.xxhash64("_bins").alias("h"), F.col("_bins").alias("bins")), "all", soft=True)
    # Spark may take rows that derive from a small file for small and gather them on the driver: no broadcast.
    out = asked.hint("merge").join(votes, F.col("_bins") == F.col("bins")).withColumn("_prob", F.transform("votes", lambda v: v / F.lit(float(model.forest.trees))))
    conf = F.array_max("_prob")
    name = F.element_at(F.array(*map(F.lit, model.labels)), F.array_position("_prob", conf).cast("int"))
    return out.select(*df.columns, name.alias("prediction"), conf.alias("confidence"),
                      *[F.get("_prob", F.lit(i)).alias(f"p_{lab}") for i, lab in enumerate(model.labels)])


def split_statistics(model: ForestModel, features: Sequence[str], levels: int = 3) -> DataFrame:
    """Number of splits per attribute at tree levels 0..levels-1, read
    from the trees."""
    name_of = F.element_at(F.array(*map(F.lit, model_features(features))), F.col("feature") + 1)
    splits = gainforest.splits_by_level(model.forest, levels).groupBy(name_of.alias("attribute")).pivot("level", list(range(levels))) \
        .agg(F.sum("splits")).na.fill(0)
    return splits.select("attribute", *[F.col(str(i)).alias(f"splits_level_{i}") for i in range(levels)])


def feature_importances(spark: SparkSession, model: ForestModel, features: Sequence[str]) -> DataFrame:
    """M4: (attribute, importance), summing to 1; one row per model feature. The gains
    of each tree's splits, weighed by their rows, count in shares of the tree's sum."""
    names = model_features(features)
    total = [0.0] * len(names)
    for gain in gainforest.gains(model.forest):
        for i, v in enumerate(gain / (gain.sum() or 1.0)):
            total[i] += float(v)
    whole = sum(total) or 1.0
    return spark.createDataFrame([(n, v / whole) for n, v in zip(names, total, strict=True)], "attribute string, importance double")
