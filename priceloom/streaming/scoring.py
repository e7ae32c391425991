"""Scoring requests in batch and as a stream, with a drift warning on every row."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from priceloom.functions.scalars import clamp_percent, formula_price, implied_discount, not_discounted
from priceloom.operators.drift import check_drift
from priceloom.operators.training import score
from priceloom.schema import DISCOUNT_FEATURES, INPUT_BOUNDS
from priceloom.sources.models import load_published
from priceloom.sources.stats import add_batch, merged_stats


def within_bounds(requests: DataFrame, task: str = "discount") -> DataFrame:
    """Requests whose inputs all lie in the accepted ranges."""
    for column, (low, high) in INPUT_BOUNDS[task].items():
        requests = requests.where(F.col(column).between(low, high))
    return requests


def scored_with_drift(requests: DataFrame, model: PipelineModel, stats: DataFrame | None = None,
                      features: list[str] | None = None) -> DataFrame:
    """Prediction with 2 decimals, drift flag, z-scores and an echo of the inputs.

    Without statistics the flag is false and the map empty. The plan has no shuffle: the
    statistics are one broadcast row. It serves batch and streaming tables alike.
    """
    features = features or DISCOUNT_FEATURES
    keep = [c for c in requests.columns if c not in features]
    scored = score(model, requests)
    if stats is None:
        no_map = F.create_map().cast("map<string,double>")
        scored = scored.withColumns({"drift_detected": F.lit(False), "z_scores": no_map})
    else:
        scored = check_drift(scored, stats, features)
    return scored.select(
        *keep,
        F.round("prediction", 2).alias("predicted_discount_percentage"),
        F.col("drift_detected").alias("drift_warning"),
        F.col("z_scores").alias("drift_details"),
        F.struct(*features).alias("inputs"),
    )


def discount_answers(requests: DataFrame, model: PipelineModel, stats: DataFrame) -> DataFrame:
    """Requests with the clamped prediction, the discount that the prices imply, their difference and the drift flag."""
    scored = check_drift(score(model, requests), stats, DISCOUNT_FEATURES)
    answered = scored.withColumns({
        "predicted": clamp_percent(F.col("prediction")),
        "implied": implied_discount(F.col("actual_price"), F.col("discounted_price")),
    })
    return answered.withColumn("difference", F.col("predicted") - F.col("implied")).drop("prediction", "z_scores")


def price_answers(requests: DataFrame, model: PipelineModel) -> DataFrame:
    """Requests with the predicted price, the formula price, their difference, and a mark on prices not below the list."""
    answered = score(model, requests).withColumnRenamed("prediction", "predicted").withColumn(
        "formula", formula_price(F.col("actual_price"), F.col("discount_percentage")))
    return answered.withColumns({
        "difference": F.col("predicted") - F.col("formula"),
        "above_list": not_discounted(F.col("actual_price"), F.col("predicted")),
    })


def read_requests(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet",
                  files_per_trigger: int = 1000) -> DataFrame:
    """An unbounded table of requests: new files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def score_stream(requests: DataFrame, model: PipelineModel, stats: DataFrame | None, out: str,
                 checkpoint: str | None = None, features: list[str] | None = None,
                 available_now: bool = False) -> StreamingQuery:
    """Append scored requests to a Parquet folder, each exactly once.

    Stateless: there is no watermark and no state to lose. Model and statistics are those of the
    start of the query.
    """
    checkpoint = checkpoint or out.rstrip("/") + "/_checkpoint"
    scored = scored_with_drift(requests, model, stats, features)
    writer = scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(out)


def _started(writer, available_now: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stats_stream(rows: DataFrame, features: list[str], path: str, checkpoint: str,
                 available_now: bool = False) -> StreamingQuery:
    """Keep the state of ``merged_stats`` up to date; a batch that runs again replaces its own part."""
    def add(batch: DataFrame, number: int) -> None:
        add_batch(batch, features, path, number)

    return _started(rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint), available_now)


def score_published(requests: DataFrame, models: str, name: str, stats: str, out: str, checkpoint: str | None = None,
                    features: list[str] | None = None, available_now: bool = False) -> StreamingQuery:
    """Score each batch with the model and the merged statistics that are current when it begins.

    Rows carry ``model_version``. Each batch has a folder of its own, which a batch that runs again replaces
    (with what is current then), so no row is written twice.
    """
    def answer(batch: DataFrame, number: int) -> None:
        model, version = load_published(batch.sparkSession, models, name)
        scored = scored_with_drift(batch, model, merged_stats(batch.sparkSession, stats), features)
        scored.withColumn("model_version", F.lit(version)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    checkpoint = checkpoint or out.rstrip("/") + "/_checkpoint"
    return _started(requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint), available_now)
