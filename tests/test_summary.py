import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from reviewmill.operators import fetch, report, summary, topics
from reviewmill.operators.freshness import fresh_results
from reviewmill.operators.ranking import top_k
from reviewmill.schema import MissingColumnError, ReviewDataError

FELT = "app_id string, row_id long, sentiment string, content string, thumbsUpCount int"


def felt(spark, rows):
    return spark.createDataFrame([("a", i, *r) for i, r in enumerate(rows)], FELT)


def test_percentages_keep_null_and_round_half_even(spark):
    df = felt(spark, [("positive", "x", 1)] * 2 + [(None, "y", 1)] + [("negative", "z", 1)])
    got = {r["sentiment"]: r["pct"] for r in summary.sentiment_percentages(df).collect()}
    assert got == {"positive": 50.0, None: 25.0, "negative": 25.0}
    df = felt(spark, [("positive", "x", 1)] + [("negative", "z", 1)] * 799)
    assert {r["sentiment"]: r["pct"] for r in summary.sentiment_percentages(df).collect()}["positive"] == 0.12
    assert summary.sentiment_percentages(df.limit(0)).count() == 0
    with pytest.raises(MissingColumnError):
        summary.sentiment_percentages(df.drop("sentiment"))


def test_top_reviews(spark):
    df = felt(spark, [("positive", f"p{i}", v) for i, v in enumerate([3, 9, None, 9, 1, 4, 9])] + [("other", "o", 99)])
    got = [(r["rank"], r["content"]) for r in summary.top_reviews(df).orderBy("rank").collect()]
    assert got == [(1, "p1"), (2, "p3"), (3, "p6"), (4, "p5"), (5, "p0")]
    nested = summary.top_reviews_nested(summary.top_reviews(df), df).first()["top_reviews"]
    assert sorted(nested) == ["negative", "neutral", "positive"] and nested["negative"] == [] and len(nested["positive"]) == 5


@pytest.mark.parametrize("k", [3, 1500])
def test_top_k_on_a_hot_group(spark, k):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), "id")
    got = {(r["g"], r["id"], r["rank"]) for r in top_k(df, ["g"], [F.desc("id")], k, "id").collect()}
    want = set()
    rows = sorted(((("hot" if i % 3 == 0 else f"g{i % 5}"), i) for i in range(4000)), key=lambda x: (x[0], -x[1]))
    for g, part in itertools.groupby(rows, key=lambda x: x[0]):
        want |= {(g, i, at) for at, (_, i) in enumerate(list(part)[:k], 1)}
    assert got == want


def raw(spark, n=60):
    rows = [("a" if i % 3 else "b", f"r{i // 2}", f"t{i}", i % 5 + 1, (i * 7) % 13, i) for i in range(n)]
    return spark.createDataFrame(rows, "app_id string, reviewId string, content string, score int, thumbsUpCount int, row_id long")


def test_fetch(spark):
    df = raw(spark)
    got = fetch.fetch(df, "new_reviews", newest_count=4, sample=100).collect()
    by_app = {}
    for r in df.collect():
        by_app.setdefault(r["app_id"], []).append(r["row_id"])
    for app, ids in by_app.items():
        newest = sorted(ids, reverse=True)[:4]
        kept, seen = [], set()
        for i in newest:
            if i // 2 not in seen:
                seen.add(i // 2)
                kept.append(i)
        assert sorted(r["row_id"] for r in got if r["app_id"] == app) == sorted(kept)
    both = fetch.fetch(df, "all_reviews", newest_count=4, relevant_count=4, sample=3)
    assert all(r["count"] == 3 for r in both.groupBy("app_id").count().collect())
    again = fetch.fetch(df.repartition(7), "all_reviews", newest_count=4, relevant_count=4, sample=3)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, again.collect()))
    with pytest.raises(ReviewDataError):
        fetch.fetch(df, "everything")


def test_sampled_apps(spark):
    apps = fetch.sample_apps(raw(spark), 1).collect()
    assert len(apps) == 1
    got = fetch.fetch_sampled_apps(raw(spark), 1)
    assert {(r["app_id"], r["strategy"]) for r in got.collect()} == {(apps[0]["app_id"], apps[0]["strategy"])}


def test_cap(spark):
    df = felt(spark, [("positive", "p", 1)] * 50 + [("negative", "n", 1)] * 5 + [("odd", "o", 1)] * 20 + [(None, "x", 1)] * 3)
    got = {r["sentiment"]: r["count"] for r in fetch.cap_per_sentiment(df, 10).groupBy("sentiment").count().collect()}
    assert got == {"positive": 10, "negative": 5, "odd": 20, None: 3}
    assert fetch.cap_per_sentiment(df, None).count() == fetch.cap_per_sentiment(df, 0).count() == 78


def test_topics_counts(spark):
    rows = [("positive", 0, "x")] * 4 + [("positive", 1, "x")] * 1 + [("positive", 2, "b")] * 5 + [("positive", -1, "Uncategorized")] * 6
    rows += [("positive", 3, "c")] * 2 + [("positive", 4, "d")] * 2
    df = spark.createDataFrame([("a", i, s, c, t) for i, (s, c, t) in enumerate(rows)], "app_id string, row_id long, sentiment string, cluster int, topic string")
    got = [(r["topic"], r["count"], r["percentage"]) for r in summary.topic_summary(df).orderBy("rank").collect()]
    assert got == [("b", 5, 25.0), ("x", 5, 25.0), ("c", 2, 10.0)]
    kept = {r["cluster"]: r["count"] for r in summary.keep_top_clusters(df).groupBy("cluster").count().collect()}
    assert kept == {2: 5, 0: 4, 3: 2, -1: 9}
    stats = summary.cluster_stats(df).first()
    assert (stats["n_rows"], stats["n_clusters"], stats["n_noise"], stats["noise_pct"]) == (20, 5, 6, 30.0)
    long = summary.topic_summary(df.withColumn("topic", F.repeat("topic", F.lit(50))))
    assert {len(r["label"]) for r in summary.report_topics(long).collect()} == {46}


def test_keyphrases(spark):
    df = felt(spark, [("positive", "battery life is great battery life", 1), ("positive", "the battery charging is slow", 2)]).withColumn("cluster", F.lit(0).cast("long"))
    noise = felt(spark, [("positive", "noise words", 1)]).withColumn("cluster", F.lit(-1).cast("long")).withColumn("row_id", F.lit(99).cast("long"))
    rows = df.unionByName(noise)
    texts = topics.cluster_text(rows)
    assert [r["cluster_text"] for r in topics.cluster_text(rows, chars=7).collect()] == ["battery"]
    assert [r["cluster_text"] for r in texts.collect()] == ["battery life is great battery life the battery charging is slow"]
    names = {r["cluster"]: r["topic"] for r in topics.topic_names(rows, topics.pick_keyphrases(topics.keyphrase_scores(rows))).collect()}
    assert names[-1] == "Uncategorized" and len(names[0].split(" | ")) == 3
    empty = felt(spark, [("positive", "of the", 1)]).withColumn("cluster", F.lit(4).cast("long"))
    none = topics.pick_keyphrases(topics.keyphrase_scores(empty))
    assert topics.topic_names(empty, none).first()["topic"] == "N/A"


@pytest.mark.parametrize("diversity", [0.0, 0.5, 0.9])
def test_mmr_matches_brute_force(spark, diversity):
    rng = random.Random(5)
    words = ["red", "blue", "green", "fast", "slow", "app"]
    terms = words + [f"{a} {b}" for a in words for b in words if a != b]
    scores = {t: round(rng.random(), 9) for t in terms}
    df = spark.createDataFrame([("a", "positive", 1, t, s) for t, s in scores.items()], "app_id string, sentiment string, cluster long, term string, score double")

    def overlap(x, y):
        x, y = set(x.split()), set(y.split())
        return len(x & y) / len(x | y)

    picked = [min(terms, key=lambda t: (-scores[t], t))]
    while len(picked) < 4:
        rest = [t for t in terms if t not in picked]
        picked.append(min(rest, key=lambda t: (round(diversity * max(overlap(t, p) for p in picked) - (1 - diversity) * scores[t], 9), t)))
    assert topics.pick_keyphrases(df, 4, diversity).first()["keywords"] == picked


def test_review_block_and_prompt(spark):
    df = felt(spark, [("positive", " line\none ", 7), ("positive", "  ", 9), ("negative", "bad {topics} 100%", 2)])
    top = summary.top_reviews(df)
    blocks = {r["sentiment"]: r["block"] for r in report.review_block(top, df).collect()}
    assert blocks == {"positive": "- (7 upvotes) line one", "neutral": "No reviews available.", "negative": "- (2 upvotes) bad {topics} 100%"}
    no_topics = spark.createDataFrame([], "app_id string, sentiment string, rank int, topic string, count long, percentage double")
    prompt = report.insight_prompt(top, no_topics, df).first()["prompt"]
    assert "bad {topics} 100%" in prompt and "{positive}" not in prompt
    silent = df.withColumn("app_id", F.lit("b"))  # an app without a review of a known class
    said = {r["app_id"]: r["prompt"] for r in report.insight_prompt(top, no_topics, df.unionByName(silent)).collect()}
    assert said["a"] == prompt and said["b"].count("No reviews available.") == 3 and '"neutral":[]' in said["b"]
    answered = report.complete(report.insight_prompt(top, no_topics, df), lambda: (lambda p: f"seen {len(p)}"))
    assert answered.first()["insight"] == f"seen {len(prompt)}"


def test_freshness_edges(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    results = spark.createDataFrame([("k", at(0)), ("k", at(5000)), ("z", at(10))], "key string, created_at timestamp")
    asks = [(1, "k", 0, False), (2, "k", 1799, False), (3, "k", 1800, False), (4, "k", 100, True), (5, "k", 5001, False), (6, "q", 5, False), (7, "k", 4999, False), (8, "k", 6799, False), (9, "z", 1000, False)]
    requests = spark.createDataFrame([(i, k, at(s), f) for i, k, s, f in asks], "request_id long, key string, ts timestamp, force_refresh boolean")
    got = {r["request_id"]: r["hit"] for r in fresh_results(requests, results).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False, 8: True, 9: True}
    removals = spark.createDataFrame([(20, "k", at(50)), (21, "k", at(60)), (22, "z", at(5))], "request_id long, key string, ts timestamp")
    got = {r["request_id"]: r["hit"] for r in fresh_results(requests, results, removals).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False, 7: False, 8: True, 9: True, 20: True, 21: False, 22: False}


def test_freshness_matches_brute_force(spark):
    rng, ttl = random.Random(3), 1800
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    make = lambda n, ids: [(i, rng.choice("aaab"), rng.randrange(20000)) for i in ids[:n]]
    asks, stored, gone = make(300, range(300)), make(40, range(1000, 1040)), make(40, range(2000, 2040))
    frame = lambda rows: spark.createDataFrame([(i, k, at(s)) for i, k, s in rows], "request_id long, key string, ts timestamp")
    out = fresh_results(frame(asks), frame(stored).select("key", F.col("ts").alias("created_at")), frame(gone), ttl)
    got = {r["request_id"]: r["hit"] for r in out.collect()}
    events = [(s, 0, i, k) for i, k, s in stored] + [(s, 1, i, k) for i, k, s in gone] + [(s, 2, i, k) for i, k, s in asks]
    live = {}
    for s, kind, i, k in sorted(events):
        hit = k in live and s < live[k] + ttl
        if kind == 0:
            live[k] = s
        elif kind == 1:
            assert got[i] == hit
            live.pop(k, None)
        else:
            assert got[i] == hit


def test_cluster_text_and_samples_take_all_rows_by_default(spark, monkeypatch):
    from reviewmill.plans import jobs

    rows = felt(spark, [("positive", f"w{i}", 1) for i in range(150)]).withColumn("cluster", F.lit(0).cast("long"))
    assert [len(r["cluster_text"].split()) for r in topics.cluster_text(rows).collect()] == [150]
    assert [len(r["cluster_text"].split()) for r in topics.cluster_text(rows, reviews=100).collect()] == [100]
    raw = spark.range(6000).select(
        F.lit("app").alias("app_id"), F.concat(F.lit("r"), "id").alias("reviewId"), F.lit("x").alias("content"),
        F.lit(3).alias("score"), F.lit(0).alias("thumbsUpCount"), F.col("id").alias("row_id"),
    )

    class Picked(Exception):
        pass

    def stop(picked, model):
        raise Picked(picked.count())

    monkeypatch.setattr(jobs, "score_reviews", stop)
    for sample, n in ((5500, 5500), (None, 6000)):
        try:
            jobs.analyze(raw, None, sample=sample)
        except Picked as seen:
            assert seen.args[0] == n


def test_seeded_sample(spark):
    from reviewmill.operators.ranking import seeded_order, seeded_sample

    df = spark.range(20_000).withColumn("x", F.lit(1)).repartition(6)
    in_order = [r.id for r in df.orderBy(seeded_order(42, "id")).select("id").collect()]
    for n in (0, 1, 7, 5000, 19_999, 20_000, 50_000):
        got = seeded_sample(df, ["id"], n)
        assert sorted(r.id for r in got.collect()) == sorted(in_order[:n])
    plan = seeded_sample(df, ["id"], 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Sort" not in plan


def test_picks_from_a_shortlist_are_those_from_all_terms(spark, monkeypatch):
    import numpy as np

    from reviewmill.operators import topics

    rng = np.random.default_rng(9)
    rows = []
    for c in range(6):
        names = {" ".join(rng.choice(list("abcdef") if c % 2 else [f"w{i}" for i in range(60)], 2)) for _ in range(50)}
        rows += [("a", "positive", c, t, float(round(1 - 0.003 * i if c % 2 else rng.random(), 9))) for i, t in enumerate(sorted(names))]
    rows += [("a", "negative", 0, "one", 1.0), ("a", None, 0, "none", 1.0)]
    scores = spark.createDataFrame(rows, "app_id string, sentiment string, cluster long, term string, score double")
    want = {}
    for key in {r[:3] for r in rows}:
        left, got = {r[3]: r[4] for r in rows if r[:3] == key}, []
        overlap = lambda x, y: len({*x.split()} & {*y.split()}) / len({*x.split()} | {*y.split()})
        while left and len(got) < (1 if None in key else 3):
            cost = lambda t: (round(0.5 * max(overlap(t, g) for g in got) - 0.5 * left[t], 9) if got else -left[t], t)
            got.append(min(left, key=cost))
            left.pop(got[-1])
        want[key] = got
    whole = []
    picks = topics._picks
    monkeypatch.setattr(topics, "_picks", lambda *a: whole.append(1) or picks(*a))
    found = lambda df: {(r.app_id, r.sentiment, r.cluster): r.keywords for r in topics.pick_keyphrases(df).collect()}
    assert found(scores) == want
    monkeypatch.setattr(topics, "SHORTLIST", 4)
    whole.clear()
    assert found(scores) == want and len(whole) == 2  # equal words everywhere: a term beyond the shortlist is needed
    whole.clear()
    far = scores.filter("cluster = 0")
    assert found(far) == {k: v for k, v in want.items() if k[2] == 0} and len(whole) <= 2
    monkeypatch.setattr(topics, "SHORTLIST", 30)
    whole.clear()
    assert found(far) == {k: v for k, v in want.items() if k[2] == 0} and len(whole) == 1  # all terms are read once
