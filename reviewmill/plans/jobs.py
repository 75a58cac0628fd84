"""End-to-end jobs: load the lake, train and promote a model, analyse apps."""

from __future__ import annotations

import os
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.operators.features import hashed_vectors
from reviewmill.operators.fetch import checked_strategy, dedup_reviews, fetch, latest_slice, seeded_sample
from reviewmill.operators.lake import LoadSummary, append_to_lake
from reviewmill.operators.metrics import classification_report, weighted_metrics
from reviewmill.operators.model import LinearModel, SvmParams, label_with, score_reviews, train_svm
from reviewmill.operators.registry import MODEL_NAME, register_run
from reviewmill.operators.report import analysis_result, complete, insight_prompt
from reviewmill.operators.split import with_split
from reviewmill.operators.summary import sentiment_percentages, top_reviews, top_reviews_nested, topic_summary
from reviewmill.operators.topics import cluster_topics
from reviewmill.operators.transform import transform_reviews
from reviewmill.session import cut_lineage, keep

ALL_REVIEWS, SAMPLED = "every_review", "random_sample"
MEASURES = ["accuracy", "precision", "recall", "f1"]


def load_job(df: DataFrame, lake_path: str, source: str, batch_id: str | None = None) -> LoadSummary:
    """Clean a batch of reviews and append it to the lake."""
    if df.isEmpty():
        return LoadSummary(None, 0, 0)
    return append_to_lake(transform_reviews(df), lake_path, source, batch_id, has_text=True)


def picked_reviews(raw: DataFrame, strategy: str, sample: int | None, counts: dict[str, int] | None) -> tuple[DataFrame, str]:
    """The reviews that a job works on, and what was done to get them.

    Without `counts` (newest_count, relevant_count) every review is taken, each id once, and the
    strategy is only checked; a `sample` per app is drawn after that.
    """
    checked_strategy(strategy)
    if counts is not None:
        return fetch(raw, strategy, sample=sample, **counts), strategy
    every = dedup_reviews(raw, [F.desc("row_id")])
    return (every, ALL_REVIEWS) if sample is None else (seeded_sample(every, sample, 42), SAMPLED)


def scrape_load_job(
    raw: DataFrame, strategy: str, scorer, lake_path: str, source: str, sample: int | None = None, counts: dict[str, int] | None = None
) -> LoadSummary:
    """Take reviews from a landed dump, label them with the user's classifier, clean and append; all of them unless the caller names limits."""
    picked, _ = picked_reviews(raw, strategy, sample, counts)
    if picked.isEmpty():
        return LoadSummary(None, 0, 0)
    return load_job(label_with(picked, scorer), lake_path, source)


@dataclass(frozen=True)
class TrainResult:
    run_id: str
    champion_run: str
    champion_updated: bool
    metrics: dict[str, float]
    model: LinearModel


def evaluate(scored: DataFrame) -> dict[str, float]:
    """The eight train and test measures of rows with label, prediction and split."""
    rows = weighted_metrics(scored, by=["split"]).collect()  # two rows
    return {f"{r['split']}_{m}": float(r[m]) for r in rows for m in MEASURES}


def train_job(
    lake: DataFrame,
    model_dir: str,
    params: SvmParams = SvmParams(),
    sample_size: int = 35000,
    min_f1: float | None = None,
    always: bool = False,
) -> TrainResult:
    """Train on the newest lake rows, measure, store model and run, promote if better."""
    spark = lake.sparkSession
    rows = latest_slice(lake, sample_size).withColumnRenamed("id", "row_id")
    split = keep(with_split(rows))
    model = train_svm(split.filter("split = 'train'"), params=params)
    predicted = score_reviews(split, model, decode=False).withColumnRenamed("label", "prediction")
    scored = keep(predicted.join(split.select("row_id", "label"), "row_id"))
    metrics = evaluate(scored)
    report = classification_report(scored.filter("split = 'test'")).toPandas()  # one row per class
    scored.unpersist()
    split.unpersist()
    run_id = uuid.uuid4().hex
    path = os.path.join(model_dir, "models", run_id)
    model.save(path)
    run = {
        "model_name": MODEL_NAME,
        "run_id": run_id,
        "test_f1": metrics["test_f1"],
        "params": {k: str(v) for k, v in asdict(params).items()},
        "metrics": metrics,
        "report": report.to_string(index=False),
        "model_path": path,
    }
    champion, updated = register_run(spark, os.path.join(model_dir, "runs"), run, min_f1, always)
    return TrainResult(run_id, champion["run_id"], updated, metrics, model)


def analyze(
    raw: DataFrame,
    model: LinearModel,
    strategy: str = "new_reviews",
    apps: DataFrame | None = None,
    encode=hashed_vectors,
    complete_with=None,
    sample: int | None = None,
    counts: dict[str, int] | None = None,
    **topics,
) -> DataFrame:
    """Fetch, score, summarise, cluster and report: one record per app.

    All rows are analysed unless the caller names a strategy's `counts` (newest_count,
    relevant_count) or a `sample` per app; a sample without counts is drawn from all rows. The
    scored rows are written once, because the count and four summaries read them. scraping_method
    says what was done. Without `complete_with` there is no insight, and the record's is empty.
    """
    picked, method = picked_reviews(raw, strategy, sample, counts)
    scored = cut_lineage(score_reviews(picked, model))
    percentages = sentiment_percentages(scored)
    top = cut_lineage(top_reviews(scored))
    summary = cut_lineage(topic_summary(cluster_topics(scored, encode=encode, **topics)))
    insights = complete(insight_prompt(top, summary, scored), complete_with) if complete_with else None
    return analysis_result(
        apps if apps is not None else raw, scored, percentages, top_reviews_nested(top, scored), summary, insights, method
    )
