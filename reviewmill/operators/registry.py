"""Model runs and the champion among them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from reviewmill.operators.model import LinearModel, load_model
from reviewmill.schema import MODEL_RUNS, ReviewDataError, require_columns

MODEL_NAME = "sentiment_linear_svm"


def champion_history(runs: DataFrame, min_f1: float | None = None, always: bool = False) -> DataFrame:
    """What each run did to the champion of its model name.

    promoted: it became champion; rejected: below the gate with no champion yet; kept: the
    champion stayed. A later run must be strictly better, so the champion's score is the
    running maximum over gated runs (or the latest gated run when always promoting).
    """
    require_columns(runs, "model_name", "run_id", "seq", "test_f1")
    earlier = Window.partitionBy("model_name").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("model_name").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    gated = F.lit(True) if min_f1 is None else F.col("test_f1") >= min_f1
    rival = F.when(gated, F.col("test_f1"))
    best = F.last(rival, ignorenulls=True).over(earlier) if always else F.max(rival).over(earlier)
    out = runs.withColumn("champion_f1", best)
    wins = gated & (F.col("champion_f1").isNull() | F.lit(always) | (F.col("test_f1") > F.col("champion_f1")))
    outcome = (
        F.when(wins, "promoted").when(F.col("champion_f1").isNull(), "rejected").otherwise("kept")
    )
    out = out.withColumn("outcome", outcome)
    promoted = F.col("outcome") == "promoted"
    out = out.withColumn("version", F.when(promoted, F.count_if(promoted).over(so_far).cast("int")))
    last = F.max(F.when(promoted, F.col("seq"))).over(Window.partitionBy("model_name"))
    return out.withColumn("is_champion", promoted & (F.col("seq") == last))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MODEL_RUNS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MODEL_RUNS)


def register_run(
    spark: SparkSession, runs_path: str, run: dict, min_f1: float | None = None, always: bool = False
) -> tuple[Row, bool]:
    """Append one run and return (champion run, whether it changed).

    A first run below the gate is an error and leaves no champion behind.
    """
    seen = read_runs(spark, runs_path).filter(F.col("model_name") == run["model_name"])
    seq = (seen.agg(F.max("seq")).first()[0] or 0) + 1
    row = spark.createDataFrame([{**run, "seq": seq}], MODEL_RUNS)
    row.coalesce(1).write.mode("append").parquet(runs_path)
    history = champion_history(read_runs(spark, runs_path), min_f1, always).filter(
        F.col("model_name") == run["model_name"]
    )
    outcome = history.filter(F.col("seq") == seq).first()["outcome"]
    if outcome == "rejected":
        raise ReviewDataError("the first model is below the quality gate and there is no champion")
    return history.filter("is_champion").first(), outcome == "promoted"


def resolve_champion(
    spark: SparkSession, runs_path: str, model_name: str = MODEL_NAME, min_f1: float | None = None, always: bool = False
) -> LinearModel:
    """Load the champion's model, which holds its own vocabulary."""
    history = champion_history(read_runs(spark, runs_path), min_f1, always)
    champion = history.filter((F.col("model_name") == model_name) & F.col("is_champion")).first()
    if champion is None:
        raise ReviewDataError(f"no champion for {model_name!r}")
    if not champion["model_path"]:
        raise ReviewDataError(f"run {champion['run_id']} has no stored model")
    return load_model(spark, champion["model_path"])
