"""Per-app result records and the text handed to a language model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.functions.text import one_line
from reviewmill.schema import SUMMARY_CLASSES, TOPIC_CLASSES, UNKNOWN_LABEL, require_columns

NO_REVIEWS = "No reviews available."

PROMPT = """Write a short briefing for the product team of one app, based on its user reviews.
Look for what lies behind the topics and the reviews; do not list them again. Skip topics that make no sense.
Use these headings: Summary, Strengths, Problems, Trends, Next steps.

Topics by sentiment (JSON):
{topics}

Most supported positive reviews:
{positive}

Most supported neutral reviews:
{neutral}

Most supported negative reviews:
{negative}
"""


def _blocks(top: DataFrame, apps: DataFrame) -> DataFrame:
    """(app_id, one column per class): the class's lines, or NO_REVIEWS."""
    require_columns(top, "app_id", "sentiment", "rank", "content", "thumbsUpCount")
    text = one_line(F.col("content"))
    line = F.concat(F.lit("- ("), F.coalesce("thumbsUpCount", F.lit(0)).cast("string"), F.lit(" upvotes) "), text)
    entry = F.struct("rank", line.alias("line"))
    # top-n rows only: one pass, a list for each class
    listed = top.filter(text != "").groupBy("app_id").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("sentiment") == c, entry))).alias(c) for c in SUMMARY_CLASSES]
    )
    joined = lambda c: F.array_join(F.transform(c, lambda r: r["line"]), "\n")
    return apps.select("app_id").distinct().join(listed, "app_id", "left").select(
        "app_id", *[F.when(F.size(c) > 0, joined(c)).otherwise(NO_REVIEWS).alias(c) for c in SUMMARY_CLASSES]
    )


def review_block(top: DataFrame, apps: DataFrame) -> DataFrame:
    """(app_id, sentiment, block): one '- (N upvotes) text' line per top review, in rank order."""
    entries = F.array(*[F.struct(F.lit(c).alias("sentiment"), F.col(c).alias("block")) for c in SUMMARY_CLASSES])
    return _blocks(top, apps).select("app_id", F.inline(entries))


def topic_map(summary: DataFrame, apps: DataFrame) -> DataFrame:
    """(app_id, topic_summary): each of the three classes to its ranked list of topics, which may be empty."""
    entry = F.struct("rank", "topic", "count", "percentage")
    listed = summary.groupBy("app_id").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("sentiment") == c, entry))).alias(c) for c in TOPIC_CLASSES]
    )
    plain = lambda t: F.struct(t["topic"].alias("topic"), t["count"].alias("count"), t["percentage"].alias("percentage"))
    none = F.array().cast("array<struct<topic:string,count:bigint,percentage:double>>")
    pairs = [x for c in TOPIC_CLASSES for x in (F.lit(c), F.coalesce(F.transform(c, plain), none))]
    return apps.select("app_id").distinct().join(listed, "app_id", "left").select("app_id", F.create_map(*pairs).alias("topic_summary"))


def insight_prompt(top: DataFrame, topics: DataFrame, apps: DataFrame) -> DataFrame:
    """(app_id, prompt): the filled-in template of every app of `apps`."""
    joined = _blocks(top, apps).join(topic_map(topics, apps), "app_id").withColumn("topics", F.to_json("topic_summary"))
    # the template is cut at its slots, so review text can hold braces or percent signs
    pieces, rest = [], PROMPT
    for slot in ["topics", *SUMMARY_CLASSES]:
        head, rest = rest.split("{" + slot + "}")
        pieces += [F.lit(head), F.col(slot)]
    return joined.select("app_id", F.concat(*pieces, F.lit(rest)).alias("prompt"))


def complete(prompts: DataFrame, model: Callable[[], Callable[[str], str]]) -> DataFrame:
    """Adds `insight` by a user-supplied completion function, loaded once per task; only the prompt goes to Python."""

    @F.pandas_udf(T.StringType())
    def ask_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = model()
        for texts in batches:
            yield pd.Series([ask(p) for p in texts], dtype=object)

    return prompts.withColumn("insight", ask_all("prompt"))


def analysis_result(
    apps: DataFrame,
    reviews: DataFrame,
    percentages: DataFrame,
    top_nested: DataFrame,
    topics: DataFrame,
    insights: DataFrame | None,
    method: str,
) -> DataFrame:
    """One record per app of `apps`; an app without reviews gets a zero record."""
    counts = reviews.groupBy("app_id").agg(F.count(F.lit(1)).alias("review_count"))
    named = percentages.groupBy("app_id", F.coalesce("sentiment", F.lit(UNKNOWN_LABEL)).alias("k")).agg(F.sum("pct").alias("v"))
    entries = F.sort_array(F.collect_list(F.struct("k", "v")))  # one entry per class
    shares = named.groupBy("app_id").agg(F.map_from_entries(entries).alias("sentiment_percentages"))
    out = (
        apps.select("app_id")
        .distinct()
        .join(counts, "app_id", "left")
        .join(shares, "app_id", "left")
        .join(top_nested.select("app_id", "top_reviews"), "app_id", "left")
        .join(topic_map(topics, reviews), "app_id", "left")
    )
    if insights is not None:
        out = out.join(insights.select("app_id", "insight"), "app_id", "left")
    else:
        out = out.withColumn("insight", F.lit(None).cast("string"))
    return out.select(
        "app_id",
        F.lit(method).alias("scraping_method"),
        F.coalesce("review_count", F.lit(0)).alias("review_count"),
        F.coalesce("sentiment_percentages", F.create_map().cast("map<string,double>")).alias("sentiment_percentages"),
        *[F.coalesce(c, F.create_map().cast(out.schema[c].dataType)).alias(c) for c in ["top_reviews", "topic_summary"]],
        F.coalesce("insight", F.lit("")).alias("llm_insight"),
        F.current_timestamp().alias("insight_generated_at"),
    )
