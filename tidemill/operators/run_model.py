"""Models over run metrics: features, weak labels, scaling, classifier, evaluation."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions import constants as k
from tidemill.functions.exprs import dbl, dow, rnd, safe_divide
from tidemill.functions.ordered import exact_sample
from tidemill.functions.series import value_ranks
from tidemill.operators.anomalies import classify_error
from tidemill.session import cut_lineage

DETECTOR_FEATURES = ["records_loaded", "records_failed", "records_ingested", "duration_seconds",
                     "hour_of_day", "day_of_week", "success_flag", "fail_rate"]
CLASSIFIER_FEATURES = ["records_loaded", "records_failed", "duration_seconds", "hour_of_day", "day_of_week",
                       "source_code", "success_flag"]
SOURCE_CODES = ["csv", "postgresql", "rest_api", "google_sheets"]
#: Rows of one task that grows trees, at most and (with free cores) at least; MLlib holds about 1 KB of each, its draws for 200 trees.
TASK_ROWS, LEAST_ROWS = 100_000, 20_000


def _number(c: str) -> Column:
    return dbl(F.coalesce(F.col(c), F.lit(0)))


def _hour(at: str) -> Column:
    """Hour of day; unknown and midnight both count as 9."""
    hour = F.hour(at)
    return dbl(F.when(hour.isNull() | (hour == 0), 9).otherwise(hour))


def detector_features(runs: DataFrame) -> DataFrame:
    loaded, failed = F.col("records_loaded"), F.col("records_failed")
    return runs.select(
        "run_no", "pipeline_name", "status", "error_message",
        _number("records_loaded").alias("records_loaded"), _number("records_failed").alias("records_failed"),
        _number("records_ingested").alias("records_ingested"), _number("duration_seconds").alias("duration_seconds"),
        _hour("started_at").alias("hour_of_day"), dbl(F.coalesce(dow(F.col("started_at")), F.lit(0))).alias("day_of_week"),
        F.when(F.col("status") == "success", 1.0).otherwise(0.0).alias("success_flag"),
        F.when(loaded > 0, dbl(F.coalesce(failed, F.lit(0))) / dbl(loaded)).otherwise(0.0).alias("fail_rate"),
    )


def training_set(runs: DataFrame) -> DataFrame:
    """Classifier features with weak labels from status, duration and failed records."""
    loaded = F.coalesce("records_loaded", "records_ingested", F.lit(0))
    measures = {"loaded": loaded, "duration": F.col("duration_seconds"), "failed": F.coalesce("records_failed", F.lit(0))}
    label = F.when(F.col("status").isNull() | (F.col("status") != "failed"), k.NO_FAILURE)
    for name, measure, comparison, bound in k.WEAK_LABELS:
        label = label.when(measures[measure] < bound if comparison == "<" else measures[measure] > bound, name)
    label = label.otherwise(k.OTHER_FAILURE)
    code = F.when(F.lit(False), 0)
    for i, name in enumerate(SOURCE_CODES):
        code = code.when(F.col("source_type") == name, i)
    return runs.select(
        "run_no", dbl(loaded).alias("records_loaded"), _number("records_failed").alias("records_failed"),
        dbl(F.coalesce("duration_seconds", F.lit(k.DEFAULT_TRAINING_SECONDS))).alias("duration_seconds"), dbl(F.hour("started_at")).alias("hour_of_day"),
        dbl(dow(F.col("started_at"))).alias("day_of_week"), dbl(code.otherwise(0)).alias("source_code"),
        F.when(F.col("status") == "success", 1.0).otherwise(0.0).alias("success_flag"), label.alias("label"))


def scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns minus their mean over their population deviation; constant columns become 0."""
    stats = df.agg(*[a for c in columns for a in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    # One aggregate row.
    joined = df.crossJoin(F.broadcast(stats))
    scaled = {c: F.when(F.col(f"_s_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in columns}
    return joined.withColumns(scaled).select(*df.columns)


def balance(train: DataFrame) -> DataFrame:
    """All anomalies and an equal number of normal rows, chosen by content hash.

    The set is written first: counting, choosing and fitting read it many times.
    """
    train = cut_lineage(train, "labelled")
    anomalies = train.filter(F.col("label") != "NORMAL")
    return anomalies.unionByName(exact_sample(train.filter(F.col("label") == "NORMAL"), anomalies.count()))


def split(train: DataFrame, key: str = "run_no", share: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of label and key, so each label is split in the same proportion."""
    digest = F.md5(F.concat_ws("|", "label", F.col(key).cast("string")))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 10_000
    cut = int(share * 10_000)
    return train.filter(bucket < cut), train.filter(bucket >= cut)


def dealt(train: DataFrame, rows: int, most: int = TASK_ROWS, least: int = LEAST_ROWS) -> DataFrame:
    """``train`` of ``rows`` rows in tasks of about ``most``, or fewer (down to ``least``) where cores are free.

    Shuffles and scans pack narrow rows by their bytes, but the forest holds each much wider. Rows are dealt by position, so copies
    spread too, and sorted within tasks, so a fit can be repeated.
    """
    cores = train.sparkSession.sparkContext.defaultParallelism
    tasks = max(math.ceil(rows / most), min(cores, math.ceil(rows / least)))
    return train.repartition(tasks).sortWithinPartitions(*train.columns)


def weigh(train: DataFrame) -> DataFrame:
    """``train`` with ``weight``, which makes all classes equally heavy. More than ``LEAST_ROWS`` rows are written once and dealt out."""
    rows = train.count()
    large = rows > LEAST_ROWS
    if large:
        train = cut_lineage(train, "train")
    sizes = train.groupBy("label").agg(F.count("*").alias("_n"))
    total = train.agg(F.count("*")).scalar()
    kinds = sizes.agg(F.count("*")).scalar()
    # One row per class of a fixed vocabulary; a shuffle by label would gather a whole class in one task.
    weights = sizes.withColumn("weight", dbl(total) / (F.col("_n") * kinds)).drop("_n")
    return dealt(train.join(F.broadcast(weights), "label"), rows) if large else train.join(weights, "label")


def fit_classifier(train: DataFrame, trees: int = 200, depth: int = 10, seed: int = 42) -> PipelineModel:
    """Random forest with balanced class weights and at least two rows per leaf."""
    weighted = weigh(train)
    indexer = StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep").fit(weighted)
    return Pipeline(stages=[
        indexer,
        VectorAssembler(inputCols=CLASSIFIER_FEATURES, outputCol="features"),
        RandomForestClassifier(labelCol="label_index", featuresCol="features", weightCol="weight", numTrees=trees,
                               maxDepth=depth, minInstancesPerNode=2, seed=seed),
        IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels),
    ]).fit(weighted)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predicted type and its probability."""
    out = model.transform(df)
    return out.withColumn("confidence", F.array_max(vector_to_array("probability"))).drop(
        "features", "rawPrediction", "probability", "prediction", "label_index")


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def class_scores(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts."""
    cells = confusion(predictions)
    rows = cells.select(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).alias("claimed"),
                        F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    cols = cells.select(F.col("predicted").alias("class"), F.lit(0).alias("support"), F.col("n").alias("claimed"), F.lit(0).alias("hit"))
    sums = rows.unionByName(cols).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "claimed", "hit")])
    p, r = F.coalesce(safe_divide(F.col("hit"), F.col("claimed")), F.lit(0.0)), F.coalesce(safe_divide(F.col("hit"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(2 * F.col("p") * F.col("r") / F.nullif(F.col("p") + F.col("r"), F.lit(0.0)), F.lit(0.0))
    return sums.withColumns({"p": p, "r": r}).withColumn("f", f1).select(
        "class", "support", rnd(F.col("p"), 4).alias("precision"), rnd(F.col("r"), 4).alias("recall"), rnd(F.col("f"), 4).alias("f1"))


def overall_scores(predictions: DataFrame) -> DataFrame:
    """Accuracy and support-weighted F1."""
    per_class = class_scores(predictions)
    weighted = per_class.agg(safe_divide(F.sum(F.col("f1").cast("decimal(18,4)") * F.col("support")), F.sum("support"))).scalar()
    hits = confusion(predictions).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    return hits.select(F.col("n"), rnd(safe_divide(F.col("hit"), F.col("n")), 4).alias("accuracy"), rnd(weighted, 4).alias("weighted_f1"))


def binary_scores(scored: DataFrame, truth: str, flag: str) -> DataFrame:
    """Precision, recall and F1 of a boolean flag."""
    t, f = F.col(truth), F.col(flag)
    c = scored.agg(F.count_if(t & f).alias("tp"), F.count_if(~t & f).alias("fp"), F.count_if(t & ~f).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        rnd(safe_divide(tp, tp + fp), 4).alias("precision"), rnd(safe_divide(tp, tp + fn), 4).alias("recall"),
        rnd(safe_divide(2 * tp, 2 * tp + fp + fn), 4).alias("f1"))


def roc_auc(scored: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve by rank sum with mid-ranks; a higher score means positive."""
    cells = scored.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(truth)).alias("pos"))
    joined = cells.join(value_ranks(scored.select(F.col(score).alias("s")), "s", "r"), "s")
    total = scored.agg(F.count(score)).scalar()
    # Descending minimum rank r with n ties -> ascending mid-rank.
    mid = total - F.col("r") + 1 - (F.col("n") - 1) / 2.0
    sums = joined.agg(F.sum((mid * F.col("pos")).cast("decimal(38,1)")).alias("w"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    u = dbl(F.col("w")) - dbl(F.col("p")) * (dbl(F.col("p")) + 1) / 2.0
    return sums.select(rnd(u / F.nullif(dbl(F.col("p")) * dbl(F.col("q")), F.lit(0.0)), 4).alias("roc_auc"))


def anomaly_type(error_message: Column, predicted: Column) -> Column:
    """Type of an outlier: its error text first, then the classifier; NORMAL or nothing gives ML_ANOMALY."""
    by_text = F.when(F.length(error_message) > 0, classify_error(error_message))
    return F.coalesce(by_text, F.nullif(predicted, F.lit("NORMAL")), F.lit("ML_ANOMALY"))


def latest_only(scored: DataFrame) -> DataFrame:
    """The newest scored run per flow."""
    w = W.partitionBy("pipeline_name").orderBy(F.desc("run_no"))
    return scored.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
