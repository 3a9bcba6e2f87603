"""Supervised ranking of process reports: features, labels, split, forest, metrics."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators.ransomware import KEY

# The feature vector, in order
FEATURES = ("risk_score", "max_burst_unique_files_in_window", "total_unique_files_touched", "unique_files_in_long_window", "directory_spread", "num_suspicious_extensions", "num_outbound_external_connections", "abnormal_location", "elevated_integrity", "num_risk_factors", "lifetime_seconds")


def features(report: DataFrame) -> DataFrame:
    """FEATURES of each report row."""
    none = F.array()
    return report.select(
        *KEY,
        "risk_score",
        F.col("max_burst").alias("max_burst_unique_files_in_window"),
        F.col("unique_files").alias("total_unique_files_touched"),
        F.col("long_files").alias("unique_files_in_long_window"),
        "directory_spread",
        F.size(F.coalesce("suspicious_extensions", none)).alias("num_suspicious_extensions"),
        F.coalesce("n_outbound", F.lit(0)).alias("num_outbound_external_connections"),
        F.col("abnormal_location").cast("int").alias("abnormal_location"),
        F.col("elevated_integrity").cast("int").alias("elevated_integrity"),
        F.size("risk_factors").alias("num_risk_factors"),
        ((F.col("last_us") - F.col("first_us")) / 1e6).alias("lifetime_seconds"),
    )


def label_join(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with a label; the last of several labels (by seq) wins, unlabelled rows go."""
    last = labels.groupBy(*KEY).agg(F.max_by("label", "seq").alias("label"))
    return rows.join(last, list(KEY))


def split(rows: DataFrame, share: float = 0.7, seed: int = 42) -> DataFrame:
    """`train` marks a stratified share, by hash order within each label.

    Rows are ranked within (label, head of the hash); the counts of these give each one's first rank.
    """
    place = F.sha2(F.concat_ws("|", *KEY, F.lit(str(seed))), 256)
    placed = rows.withColumn("__place", place).withColumn("__head", F.substring("__place", 1, 3))
    counts = placed.groupBy("label", "__head").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("label").orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)
    first, total = F.coalesce(F.sum("__n").over(before), F.lit(0)), F.sum("__n").over(Window.partitionBy("label"))
    counts = counts.select("label", "__head", first.alias("__first"), total.alias("__total"))
    rank = F.row_number().over(Window.partitionBy("label", "__head").orderBy("__place", *KEY))
    ranked = placed.withColumn("__rank", rank).join(counts, ["label", "__head"])
    return ranked.select(*rows.columns, (F.col("__first") + F.col("__rank") <= F.ceil(F.lit(share) * F.col("__total"))).alias("train"))


def _vector(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows)


def train(rows: DataFrame, trees: int = 200, seed: int = 42) -> RandomForestClassificationModel:
    """Random forest with balanced class weights n / (2 * n_class)."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = F.lit(1.0)
    for label, n in counts.items():
        weight = F.when(F.col("label") == label, F.lit(sum(counts.values()) / (2.0 * n))).otherwise(weight)
    data = _vector(rows.withColumn("weight", weight).withColumn("label", F.col("label").cast("double")))
    return RandomForestClassifier(numTrees=trees, seed=seed, featuresCol="vector", labelCol="label", weightCol="weight").fit(data)


def importances(model: RandomForestClassificationModel) -> DataFrame:
    from pyspark.sql import SparkSession

    values = [float(v) for v in model.featureImportances.toArray()]
    return SparkSession.getActiveSession().createDataFrame(list(zip(FEATURES, values, strict=True)), "feature string, importance double")


def evaluate(rows: DataFrame) -> DataFrame:
    """(label, support, precision, recall) from label and prediction; 0 where undefined."""
    counts = rows.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    each = counts.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("of"), "*")
    hit, said, true = ((F.col("label") == F.col("of")) & (F.col("prediction") == F.col("of")), F.col("prediction") == F.col("of"), F.col("label") == F.col("of"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = each.groupBy(F.col("of").alias("label")).agg(total(hit).alias("tp"), total(said).alias("pp"), total(true).alias("support"))
    share = lambda d: F.when(F.col(d) > 0, F.round(F.col("tp") / F.col(d), 6)).otherwise(0.0)
    return out.select("label", "support", share("pp").alias("precision"), share("support").alias("recall"))


def rank(model: RandomForestClassificationModel, rows: DataFrame, top: int | None = None) -> DataFrame:
    """All rows by probability, or the first `top`, with label at 0.5 and rank.

    Rows are numbered within buckets of probability; the buckets' counts give each one's first rank.
    """
    scored = model.transform(_vector(rows)).withColumn("probability", vector_to_array("probability")[1])
    scored = scored.withColumn("__bucket", F.floor(F.col("probability") * 4096))
    before = Window.orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    counts = scored.groupBy("__bucket").agg(F.count("*").alias("__n"))
    counts = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(F.desc("probability"), *KEY))
    out = scored.withColumn("rank", place).join(F.broadcast(counts), "__bucket").withColumn("rank", (F.col("__first") + F.col("rank")).cast("int"))
    out = out.withColumn("predicted", F.col("probability") >= 0.5).select(*scored.drop("__bucket").columns, "predicted", "rank")
    return out if top is None else out.filter(F.col("rank") <= top)
