import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewmill.operators import density, features, metrics, model, registry, split, topics
from reviewmill.operators.components import connected_components
from reviewmill.operators.lake import read_lake
from reviewmill.plans.jobs import analyze, picked_reviews, scrape_load_job, train_job
from reviewmill.plans.queries import QUERIES
from reviewmill.schema import ReviewDataError
from reviewmill.sources import tables

GOOD = ["great app love it", "love this great app", "works great love", "great love app works"]
BAD = ["terrible app hate it", "hate this terrible app", "terrible crash hate", "hate crash app terrible"]
SOSO = ["okay app average", "average okay nothing special", "okay average app special", "nothing special okay average"]


def labelled(spark, copies=3):
    texts = [(t, c) for _ in range(copies) for c, group in enumerate([BAD, SOSO, GOOD]) for t in group]
    return spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(texts)], "row_id long, content string, label int")


def counts(df):
    return {(r["label"], r["split"]): r["count"] for r in df.groupBy("label", "split").count().collect()}


def test_stratified_split(spark):
    df = spark.createDataFrame([(i, f"t{i}", 0 if i < 51 else 1 if i < 100 else 2) for i in range(399)], "row_id long, content string, label int")
    out = split.with_split(df)
    assert counts(out) == {(0, "test"): 10, (0, "train"): 41, (1, "test"): 10, (1, "train"): 39, (2, "test"): 60, (2, "train"): 239}
    pick = lambda d: sorted(r["row_id"] for r in d.filter("split = 'test'").collect())
    assert pick(out) == pick(split.with_split(df.repartition(5)))


def test_counted_terms(spark):
    lists = [[], ["a"], ["b", "a", "b"], ["x"] * 5, list("hello world")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "i int, terms array<string>")
    for r in df.select("i", features.counted_terms(F.col("terms")).alias("c")).collect():
        assert {e["term"]: e["tf"] for e in r["c"] or []} == Counter(lists[r["i"]])


def test_split_falls_back_on_rare_class(spark):
    df = spark.createDataFrame([(i, f"t{i}", "x" if i else "rare") for i in range(10)] + [(98, None, "x"), (99, "t", None)], "row_id long, content string, label string")
    out = split.with_split(df)
    assert out.count() == 10 and out.filter("split = 'test'").count() == 2
    test = {r["row_id"] for r in out.filter("split = 'test'").collect()}
    plain = {r["row_id"] for r in split.plain_split(df.filter("row_id < 90")).filter("split = 'test'").collect()}
    assert test == plain
    assert split.with_split(df.limit(0)).count() == 0


def test_tfidf_matches_brute_force(spark):
    docs = GOOD + BAD + ["x", "great"]
    df = spark.createDataFrame(list(enumerate(docs)), "row_id long, content string")
    terms = []
    for d in docs:
        w = re.findall(r"\b\w\w+\b", d.lower())
        terms.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    seen = Counter(t for c in terms for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in seen.items() if 2 <= n <= 0.95 * len(docs)}
    want = {}
    for i, c in enumerate(terms):
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        size = math.sqrt(sum(v * v for v in raw.values()))
        want |= {(i, t): v / size for t, v in raw.items()}
    got = {(r["row_id"], r["term"]): r["weight"] for r in features.tfidf(df, features.vocabulary(df)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_known_occurrences_slice_by_slice(monkeypatch):
    monkeypatch.setattr(features, "SLICE_CHARS", 20)
    texts = ["aa bb aa", "bb", "cc cc cc cc", "aa bb aa bb aa bb aa bb aa bb", "zz", "bb cc"]
    terms = ["bb", "aa bb", "cc", "cc cc"]
    got = {(int(r), terms[a]): int(n) for part in features.known_occurrences(pa.array(texts), pa.array(terms)) for r, a, n in zip(*part)}
    want = {}
    for i, text in enumerate(texts):
        w = text.split()
        want |= {(i, t): n for t, n in Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]).items() if t in terms}
    assert got == want and len(list(features.slices(pa.array(texts)))) > 1


def shuffled_terms(df):
    """Shuffled rows of a query whose tables hold `term`, next to all of its windows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning\((term|row_id)#", line) or " Window " in line]


def test_terms_of_rows_are_not_shuffled(spark):
    rows = [(1, "aa bb aa"), (1, "bb cc"), (None, "aa aa"), (None, "bb"), (2, "zz"), (3, None), (4, "aa bb cc")]
    df = spark.createDataFrame(rows, "row_id long, content string")
    idf, coef = {"aa": 1.5, "bb": 2.0, "aa bb": 3.0}, {"aa": [1.0, 0.0], "bb": [-1.0, 0.5], "aa bb": [0.25, 2.0]}
    table = spark.createDataFrame([(t, idf[t], coef[t]) for t in idf], "term string, idf double, coef array<double>").checkpoint()
    found = [(k, t, (1 + math.log(n)) * idf[t]) for k, text in rows for w in [(text or "").split()] for t, n in Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]).items() if t in idf]
    length = {k: math.sqrt(sum(w * w for j, _, w in found if j == k)) for k, _, _ in found}
    out = features.tfidf(df, table.select("term", "idf"))
    rounded = lambda rows: Counter((k, t, round(w, 9)) for k, t, w in rows)
    assert rounded(out.collect()) == rounded((k, t, w / length[k]) for k, t, w in found)
    scored = model.class_scores(df, model.LinearModel(table, [0, 1], [0.5, 0.0], 10**9))
    want = {k: [sum(w * coef[t][i] for j, t, w in found if j == k) / length[k] + b for i, b in enumerate([0.5, 0.0])] for k in length}
    got = {r["row_id"]: r["scores"] for r in scored.collect()}
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-12 for k in got for x, y in zip(got[k], want[k]))
    assert not shuffled_terms(out) and not shuffled_terms(scored)


def test_vocabulary_travels_packed(spark):
    rows = [(1, "aa bb aa", "x"), (1, "bb cc", "y"), (2, "aa aa", None), (3, None, "x"), (4, "", "y"), (5, "dd " * 9, "y"), (6, "aa bb", "x")]
    df = spark.createDataFrame(rows, "row_id long, content string, label string")
    out = features.vocabulary(df, kind="label", kinds=["x", "y"])
    seen, own = Counter(), Counter()
    for _, text, label in rows:
        w = (text or "").split()
        terms = {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}
        seen.update(terms)
        own.update((t, label) for t in terms)
    want = {(t, n, 7, own[t, "x"], own[t, "y"]) for t, n in seen.items() if n >= 2}
    assert {(r["term"], r["df"], r["n_docs"], r["x"], r["y"]) for r in out.collect()} == want and ("bb", 3, 7, 2, 1) in want
    assert not shuffled_terms(out) and "hashpartitioning(_part" in out._jdf.queryExecution().executedPlan().toString()


def test_hashes_of_terms():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeé漢"), rng.integers(1, 90))) for _ in range(3000)] + [""]
    terms = pa.array(words)
    hashes = features.term_hashes(terms)
    assert len(set(hashes.tolist())) > 0.99 * len(set(words)) and hashes.max() < 1 << features.HASH_BITS
    assert (features.term_hashes(terms[100:200]) == hashes[100:200]).all() and len(features.term_hashes(terms[:0])) == 0
    some = np.unique(hashes)
    assert (features.unpacked_hashes(pa.scalar(features.packed_hashes(some))) == some).all()
    for n in (1, 7, 1000):
        bounds = features.part_bounds(some, n)
        assert bounds[0] == 0 and bounds[-1] == len(some) and len(bounds) == n + 1
        parts = [(int(b["_part"][0].as_py()), t) for b in features.in_parts(pa.table({"term": terms}), n) for t in features.unpacked(b["_rows"][0])["term"].to_pylist()]
        assert sorted(t for _, t in parts) == sorted(words)
        assert all(bounds[p] <= np.searchsorted(some, hashes[words.index(t)]) < bounds[p + 1] for p, t in parts)


def test_metrics(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (2, 2), (1, 3)]
    df = spark.createDataFrame(pairs, "label int, prediction int")
    out = metrics.weighted_metrics(df).first()
    want = {"accuracy": 0, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    for c in {0, 1, 2}:
        tp = sum(a == b == c for a, b in pairs)
        support, predicted = sum(a == c for a, _ in pairs), sum(b == c for _, b in pairs)
        p, r = tp / predicted, tp / support
        f = 2 * p * r / (p + r) if p + r else 0
        want["accuracy"] += tp / len(pairs)
        want = {**want, "precision": want["precision"] + p * support / 7, "recall": want["recall"] + r * support / 7, "f1": want["f1"] + f * support / 7}
    assert all(abs(out[k] - v) < 1e-12 for k, v in want.items())
    report = {r["name"]: r for r in metrics.classification_report(df).collect()}
    assert set(report) == {"0", "1", "2", "3", "accuracy", "macro avg", "weighted avg"}
    assert report["3"]["recall"] == 0.0 and report["accuracy"]["support"] == 7


@pytest.fixture(scope="module")
def trained(spark):
    return model.train_svm(labelled(spark))


def test_training_and_scoring(spark, trained, tmp_path):
    rows = [(0, "I LOVE this great app 😍"), (1, "hate, terrible crash"), (2, "okay average"), (3, "😍🎉"), (4, None), (5, "zzz unseen")]
    df = spark.createDataFrame(rows, "row_id long, content string").withColumn("extra", F.col("row_id") * 2)
    got = {r["row_id"]: r for r in model.score_reviews(df, trained).collect()}
    assert set(got) == {0, 1, 2, 3, 5}
    assert [got[i]["label"] for i in (0, 1, 2, 3)] == [2, 0, 1, None]
    assert got[3]["sentiment"] == "unknown" and got[1]["sentiment"] == "negative" and got[5]["label"] is not None
    assert got[2]["extra"] == 4
    trained.save(str(tmp_path / "m"))
    again = {r["row_id"]: r["label"] for r in model.score_reviews(df, model.load_model(spark, str(tmp_path / "m"))).collect()}
    assert again == {i: r["label"] for i, r in got.items()}
    assert model.score_reviews(df.limit(0), trained).count() == 0
    assert trained.converged == [True, True, True] == model.load_model(spark, str(tmp_path / "m")).converged
    big = model.LinearModel(trained.weights, trained.classes, trained.intercepts, 10**9)  # too large to broadcast
    assert {r["row_id"]: r["label"] for r in model.score_reviews(df, big).collect()} == again
    with pytest.raises(ReviewDataError):
        model.train_svm(labelled(spark), params=model.SvmParams(loss="squared_hinge"))


def run(name, f1):
    return {"model_name": "m", "run_id": name, "test_f1": f1, "params": {}, "metrics": {}, "report": "", "model_path": ""}


def test_promotion(spark, tmp_path):
    path = str(tmp_path / "runs")
    steps = [(0.6, True), (0.5, False), (0.6, False), (0.7, True)]
    for i, (f1, updated) in enumerate(steps):
        champion, changed = registry.register_run(spark, path, run(f"r{i}", f1))
        assert changed == updated
    assert (champion["run_id"], champion["version"]) == ("r3", 2)
    _, changed = registry.register_run(spark, path, run("r4", 0.1), always=True)
    assert changed
    with pytest.raises(ReviewDataError):
        registry.register_run(spark, str(tmp_path / "gated"), run("low", 0.2), min_f1=0.5)
    with pytest.raises(ReviewDataError):
        registry.resolve_champion(spark, path, "m")  # the run has no stored model
    gated = spark.createDataFrame([("m", f"r{i}", i, f) for i, f in enumerate([0.4, 0.6, 0.3, 0.9, 0.7])], "model_name string, run_id string, seq long, test_f1 double")
    out = [r["outcome"] for r in registry.champion_history(gated, 0.5).orderBy("seq").collect()]
    assert out == ["rejected", "promoted", "kept", "promoted", "kept"]
    out = [r["outcome"] for r in registry.champion_history(gated, 0.5, always=True).orderBy("seq").collect()]
    assert out == ["rejected", "promoted", "kept", "promoted", "promoted"]


def planted(seed=1, size=60, noise=40, dims=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(3, dims))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    near = np.concatenate([c + 0.03 * rng.normal(size=(size, dims)) for c in centers])
    far = rng.normal(size=(noise, dims))
    all_ = np.concatenate([near, far])
    return all_ / np.linalg.norm(all_, axis=1, keepdims=True)


def vectors(spark, x, group="g", start=0):
    return spark.createDataFrame([(group, start + i, v.tolist()) for i, v in enumerate(x)], "grp string, row_id long, vector array<double>")


def test_density_finds_planted_groups(spark):
    df = vectors(spark, planted(size=80, noise=80, dims=64))
    out = {r["row_id"]: r["cluster"] for r in density.density_clusters(df, ["grp"]).collect()}
    groups = [Counter(out[i] for i in range(a, a + 80)).most_common(1)[0] for a in (0, 80, 160)]
    assert len({g for g, _ in groups}) == 3 and all(n >= 40 and g >= 0 for g, n in groups)
    assert all(out[i] == -1 for i in range(240, 320))


@pytest.mark.parametrize("args", [dict(eps=0.3), dict(), dict(min_similarity=0.9, min_samples=3, min_cluster_size=4)])
def test_blocked_density_equals_local(spark, args):
    x = planted(seed=2)
    x = np.concatenate([x, x[:5], np.repeat(x[:1], 70, axis=0)])  # copies, one of them hot
    df = vectors(spark, x).unionByName(vectors(spark, planted(3, size=20, noise=10), "h", start=1000))
    whole = {tuple(r) for r in density.density_clusters(df, ["grp"], block_rows=5000, **args).collect()}
    blocked = {tuple(r) for r in density.density_clusters(df, ["grp"], block_rows=40, **args).collect()}
    assert whole == blocked and len({c for _, _, c in whole}) > 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 200)] + [(300, 300)]
    out = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(out[i] == 1 for i in list(range(1, 41)) + [200])
    assert {out[100], out[101], out[102]} == {100} and out[300] == 300


def test_group_floor_and_reduction(spark):
    df = spark.createDataFrame([("a", s, i) for s, n in [("positive", 29), ("negative", 30), ("odd", 50)] for i in range(n)], "app_id string, sentiment string, row_id long")
    assert [(r["sentiment"], r["n"]) for r in topics.eligible_groups(df).collect()] == [("negative", 30)]
    x = planted(size=50, noise=50)
    wide = vectors(spark, x).select(F.lit("a").alias("app_id"), F.lit("positive").alias("sentiment"), "row_id", "vector")
    reduced = {r["row_id"]: r["vector"] for r in topics.reduce_vectors(wide).collect()}
    assert all(len(v) == 10 for v in reduced.values())
    c = np.cov(x.T, bias=True)
    basis = np.linalg.eigh(c)[1][:, ::-1][:, :10]
    got, want = np.array([reduced[i] for i in range(len(x))]), x @ basis
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    assert {len(r["vector"]) for r in topics.reduce_vectors(wide, dims=None).collect()} == {16}
    # another app, small or large, changes nothing
    other = wide.withColumns({"app_id": F.lit("b"), "row_id": F.col("row_id") + 1000, "vector": F.transform("vector", lambda v: v * v)})
    both = {r["row_id"]: r["vector"] for r in topics.reduce_vectors(wide.unionByName(other)).filter("app_id = 'a'").collect()}
    assert all(np.allclose(both[i], reduced[i]) for i in range(len(x)))


def test_embedding_reuse(spark):
    df = spark.createDataFrame([(0, "a b c1"), (1, "Aa bb"), (2, "aa bb"), (3, "aa bb")], "row_id long, content string")
    known = spark.createDataFrame([("none", [1.0])], "text_hash string, vector array<double>")
    rows, fresh = features.embed_with_reuse(df, known, lambda d: features.hashed_vectors(d, dims=8))
    assert rows.count() == 4 and fresh.count() == 3
    _, none = features.embed_with_reuse(df, fresh, lambda d: features.hashed_vectors(d, dims=8))
    assert none.count() == 0
    coded = features.encode_with(df, lambda: (lambda texts: [[3.0, 4.0 * (t == "aa bb")] for t in texts]), batch=3).orderBy("row_id").collect()
    assert coded[0]["vector"] == [1.0, 0.0] and np.allclose(coded[2]["vector"], [0.6, 0.8])


def test_bulk_labels(spark):
    df = spark.createDataFrame([(0, "good"), (1, None), (2, "bad")], "row_id long, content string")
    names = {"good": "LABEL_Positive", "bad": "NEGATIVE", "": "Neutral?"}
    out = model.label_with(df, lambda: (lambda texts: [names[t] for t in texts]), batch=2)
    assert {r["row_id"]: r["label"] for r in out.collect()} == {0: "positive", 1: "neutral", 2: "negative"}


def test_jobs_end_to_end(spark, tmp_path):
    lake_path, models = str(tmp_path / "lake"), str(tmp_path / "models")
    texts = [f"{t} {w}" for w in ["alpha", "beta", "gamma", "delta", "omega"] for t in GOOD + BAD + SOSO]
    raw = spark.createDataFrame(
        [("app1" if i % 2 else "app2", f"r{i}", t, 3, i, i) for i, t in enumerate(texts)],
        "app_id string, reviewId string, content string, score int, thumbsUpCount int, row_id long",
    )

    def scorer():
        return lambda batch: ["positive" if "love" in t else "negative" if "hate" in t else "neutral" for t in batch]

    loaded = scrape_load_job(raw, "all_reviews", scorer, lake_path, "scrape")
    assert loaded.inserted == 60
    result = train_job(read_lake(spark, lake_path), models, model.SvmParams(max_iter=30))
    assert result.champion_updated and len(result.metrics) == 8 and result.metrics["test_f1"] > 0.5
    champion = registry.resolve_champion(spark, f"{models}/runs")
    apps = raw.select("app_id").union(spark.createDataFrame([("empty",)], "app_id string"))
    out = {r["app_id"]: r for r in analyze(raw, champion, "all_reviews", apps=apps, min_rows=5, min_samples=2, min_cluster_size=2).collect()}
    assert out["app1"]["review_count"] == out["app2"]["review_count"] == 30
    assert abs(sum(out["app1"]["sentiment_percentages"].values()) - 100) < 0.1
    assert len(out["app1"]["top_reviews"]["positive"]) == 5
    assert sorted(out["app1"]["topic_summary"]) == sorted(out["app1"]["top_reviews"]) == ["negative", "neutral", "positive"]
    assert out["empty"]["review_count"] == 0 and out["empty"]["sentiment_percentages"] == {} and out["empty"]["llm_insight"] == ""
    assert out["empty"]["top_reviews"] == {} and out["empty"]["topic_summary"] == {}
    assert {r["scraping_method"] for r in out.values()} == {"every_review"} and out["app1"]["llm_insight"] == ""


def test_strategy_and_counts_of_jobs(spark, tmp_path):
    raw = spark.createDataFrame(
        [(i, "a", f"r{i}", f"text number {i} here", 1 + i % 5, i) for i in range(40)], "row_id long, app_id string, reviewId string, content string, score int, thumbsUpCount int"
    )
    with pytest.raises(ReviewDataError):
        picked_reviews(raw, "best_reviews", None, None)
    count = lambda **kw: (lambda p: (p[0].count(), p[1]))(picked_reviews(raw, "new_reviews", kw.get("sample"), kw.get("counts")))
    assert count() == (40, "every_review") and count(sample=7) == (7, "random_sample")
    assert count(counts={"newest_count": 9}) == (9, "new_reviews") and count(counts={"newest_count": 0}) == (0, "new_reviews")
    scorer = lambda: lambda texts: ["positive"] * len(texts)
    assert scrape_load_job(raw, "new_reviews", scorer, str(tmp_path / "lake"), "s").inserted == 40
    assert scrape_load_job(raw, "new_reviews", scorer, str(tmp_path / "few"), "s", counts={"newest_count": 5}).inserted == 5


def test_far_cells_do_not_meet(spark):
    """Tight, distant groups: most block pairs are ruled out, for a fixed reach and for the default one."""
    rng = np.random.default_rng(4)
    x = np.concatenate([c + 0.01 * rng.normal(size=(60, 8)) for c in 10 * rng.normal(size=(10, 8))])
    points = vectors(spark, x).select("grp", F.col("row_id").alias("_id"), F.col("vector").alias("_vec")).withColumns(
        {"_w": F.lit(1).cast("long"), "_ms": F.lit(3), "_mcs": F.lit(5)}
    )
    celled, pivots = density._cells(points, ["grp"], 40)
    blocks = density._blocks(celled, ["grp"])
    pairs = lambda reach: density._block_pairs(blocks.withColumn("_reach", F.lit(reach)), pivots, ["grp"]).count()
    every, near = pairs(float("inf")), pairs(0.2)
    n = blocks.count()
    assert every == n * (n + 1) / 2 and near < every / 3
    assert density._median_reach(celled, blocks, pivots, ["grp"]).count() == 1
    whole = {tuple(r) for r in density.density_clusters(vectors(spark, x), ["grp"], block_rows=5000).collect()}
    assert whole == {tuple(r) for r in density.density_clusters(vectors(spark, x), ["grp"], block_rows=40).collect()}


def test_points_travel_once_per_strip(spark):
    """However many blocks a group has, each of its points meets a bounded number of tasks."""
    x = np.random.default_rng(6).normal(size=(600, 8))
    points = vectors(spark, x).select("grp", F.col("row_id").alias("_id"), F.col("vector").alias("_vec"))
    celled, pivots = density._cells(points, ["grp"], 10)
    blocks = density._blocks(celled, ["grp"]).withColumn("_reach", F.lit(float("inf")))
    pairs = density._strip_pairs(celled, density._cell_pairs(blocks, pivots, ["grp"]), ["grp"])

    def sizes(a, b, cells):
        return pd.DataFrame([{"n": len(a) if a is b else len(a) + len(b), "met": sum(len(i) * len(j) if i is not j else len(i) * (len(i) - 1) // 2 for i, j in density._tiles(a, b, cells))}])

    got = density._meet(celled, pairs, ["grp"], sizes, "n long, met long").agg(F.sum("n"), F.sum("met")).first()
    assert got[0] == 600 * density.STRIPS and got[1] == 600 * 599 // 2
    assert blocks.count() > 5 * density.STRIPS


def test_size_estimates_do_not_grow_with_rounds(spark, capsys):
    chain = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    roots = connected_components(chain)
    roots.explain(mode="cost")
    assert "E+" not in capsys.readouterr().out.split("Physical Plan")[0]
    assert roots.filter("root = 0").count() == 201


def test_cluster_text_query_takes_every_review(spark):
    rows = tables.clustered(spark, "/root/testdata/sf0.001").filter("cluster <> -1")
    cut = QUERIES["cluster_text"](spark, "/root/testdata/sf0.001").agg(F.sum(F.length("cluster_text")), F.count(F.lit(1))).first()
    want = rows.agg(F.sum(F.length("content")), F.count("content")).first()
    assert cut[0] == want[0] + want[1] - cut[1]


def test_terms_of_one_group_are_counted_in_many_tasks(spark, monkeypatch):
    texts = ["battery drains fast", "login screen keeps loading"]
    rows = spark.createDataFrame([("a", "negative", i, texts[i % 2]) for i in range(80)], "app_id string, sentiment string, row_id long, content string")
    points = spark.createDataFrame([(i, [float(i % 2), 1.0 - i % 2]) for i in range(80)], "row_id long, vector array<double>")
    shares, scores = [], topics.keyphrase_scores

    def seen(df, *args):
        shares.extend(r["count"] for r in df.groupBy(F.spark_partition_id().alias("at")).count().collect())
        return scores(df, *args)

    monkeypatch.setattr(topics, "keyphrase_scores", seen)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        named = topics.cluster_topics(rows, points, reduce_dims=None, max_clusters=2, min_similarity=0.3, min_samples=2, min_cluster_size=5)
        assert named.count() == 80 and sum(shares) == 80 and max(shares) < 80
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
