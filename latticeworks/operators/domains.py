"""How far apart two domains are: a classifier that is to tell them apart, and which features it does so by.

For each pair of domains the rows are dealt into folds by hash, a fold's side in proportion. A pipeline (medians for what
is missing, boosted trees) is fitted on the other folds and scores the fold. A feature's importance is the AUC that is
lost when its values are shuffled among the fold's rows: the shuffled copies are stacked and scored by the fitted model
as they are, and AUCs come from counts of equal scores, so that no task orders a fold.

Pairs are few and named by the caller, and each is a fit of its own; the number of rows is free. A shuffle gives the row
of each rank by id the value of the row of that rank by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeworks.operators.metrics import roc_auc
from latticeworks.operators.ranks import running_sums
from latticeworks.sources.scratch import written


def model_of(train: DataFrame, features: Sequence[str], trees: int, depth: int) -> PipelineModel:
    filled = [f"_f{i}" for i in range(len(features))]
    stages = [Imputer(inputCols=list(features), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_v"), GBTClassifier(featuresCol="_v", labelCol="_side", maxIter=trees, maxDepth=depth, seed=0)]
    return Pipeline(stages=stages).fit(train)


def stacked(rows: DataFrame, features: Sequence[str], repeats: int) -> DataFrame:
    """(pair, fold, _side, feature, repeat, features...): each row as it is (feature null) and once for each feature and repeat with the value of another row of its fold."""
    values = F.array(*features)
    placed = running_sums(rows.select("pair", "fold", "id", "_side", values.alias("f")), "id", {"rank": F.lit(1)}, ["pair", "fold"], ["_side"])
    drawn = rows.select("pair", "fold", "id", values.alias("g"), F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    drawn = running_sums(drawn.withColumn("draw", F.xxhash64("id", "g", "repeat")), "draw", {"rank": F.lit(1)}, ["pair", "fold", "repeat"], ["id"])
    met = placed.join(drawn.select("pair", "fold", "rank", "repeat", "g"), ["pair", "fold", "rank"])
    each = met.withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
    changed = F.transform("f", lambda x, i: F.when(i == F.col("feature"), F.get("g", F.col("feature"))).otherwise(x))
    whole = placed.select("pair", "fold", "_side", F.lit(None).cast("int").alias("feature"), F.lit(0).alias("repeat"), "f")
    return each.select("pair", "fold", "_side", "feature", "repeat", changed.alias("f")).unionByName(whole)


def scored(df: DataFrame, features: Sequence[str], folds: int = 3, repeats: int = 5, least: int = 100, trees: int = 20, depth: int = 3) -> DataFrame:
    """(pair, fold, feature, repeat, _side, score) of df (pair, id, side, features...): all stacked rows of the pairs with ``least`` rows on either side."""
    numbers = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in features]
    fold = F.pmod(F.xxhash64("pair", "id", F.lit("fold")), F.lit(folds)).cast("int")
    rows = written(df.where("pair is not null and side is not null").select("pair", "id", F.col("side").cast("double").alias("_side"), fold.alias("fold"), *numbers), "domain-rows")
    enough = rows.groupBy("pair").agg(F.sum("_side").alias("n1"), F.count(F.lit(1)).alias("n")).where((F.col("n1") >= least) & (F.col("n") - F.col("n1") >= least))
    pairs = sorted(r["pair"] for r in enough.collect())  # the pairs that the caller named
    copies = written(stacked(rows.join(F.broadcast(enough.select("pair")), "pair"), features, repeats), "domain-copies")
    out = None
    for pair in pairs:
        for k in range(folds):
            own = F.col("pair") == F.lit(pair)
            model = model_of(rows.where(own & (F.col("fold") != k)), features, trees, depth)
            part = copies.where(own & (F.col("fold") == k)).select("pair", "fold", "feature", "repeat", "_side", *(F.get("f", F.lit(i)).alias(f) for i, f in enumerate(features)))
            one = model.transform(part).select("pair", "fold", "feature", "repeat", "_side", vector_to_array("probability")[1].alias("score"))
            out = one if out is None else out.unionByName(one)
    if out is None:
        out = copies.select("pair", "fold", "feature", "repeat", "_side", F.lit(0.0).alias("score")).where("false")
    return written(out, "domain-scores")


def importances(scores: DataFrame, features: Sequence[str]) -> DataFrame:
    """(pair, auc, feature, loss, n1, n0): the mean AUC over folds, and for each feature the mean AUC lost over folds and repeats."""
    auc = roc_auc(scores, "score", F.col("_side") == 1, "pair", "fold", "feature", "repeat")
    whole = auc.where("feature is null").select("pair", "fold", F.col("auc").alias("whole"), "n1", "n0")
    sums = whole.groupBy("pair").agg(F.avg("whole").alias("auc"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    lost = auc.where("feature is not null").join(whole.select("pair", "fold", "whole"), ["pair", "fold"]).groupBy("pair", "feature").agg(F.avg(F.col("whole") - F.col("auc")).alias("loss"))
    names = F.array(*(F.lit(f) for f in features))
    return lost.join(sums, "pair").select("pair", "auc", F.get(names, F.col("feature")).alias("feature"), "loss", "n1", "n0")


def report(df: DataFrame, features: Sequence[str], top: int = 5, **settings: int) -> DataFrame:
    """A row a pair: AUC of the classifier, rows on either side, the features it leans on most, and how to read the AUC."""
    found = importances(scored(df, features, **settings), features)
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("loss")).alias("l"), "feature"))), 1, top)
    one = found.groupBy("pair", "auc", "n1", "n0").agg(F.array_join(F.transform(best, lambda x: x["feature"]), "; ").alias("top_features"))
    verdict = F.when(F.col("auc") < 0.65, "close").when(F.col("auc") <= 0.8, "moderate gap").otherwise("wide gap")
    return one.withColumn("verdict", verdict)
