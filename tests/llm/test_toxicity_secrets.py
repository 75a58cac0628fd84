"""Toxicity chain and secret scan: held-out accuracy and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.llm import secrets, toxicity
from reviewmill.llm.queries import QUERIES, read

LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def chain_and_held_out(spark):
    docs, labels = read(spark, LARGER, "documents"), read(spark, LARGER, "labels")
    held = F.pmod(F.xxhash64(F.lit(99), "doc_id"), F.lit(3)) == 0
    return toxicity.train_chain(docs, labels.filter(~held)), docs.join(labels.filter(held).select("doc_id", F.col("toxic").alias("truth")), "doc_id")


def test_held_out_toxicity(chain_and_held_out):
    chain, held = chain_and_held_out
    scored = toxicity.score_toxicity(held, chain).join(held.select("doc_id", "truth"), "doc_id").toPandas()
    hit = (scored.toxic & (scored.truth == 1)).sum()
    print(chain.categories, chain.threshold, "precision", hit / scored.toxic.sum(), "recall", hit / (scored.truth == 1).sum())
    assert hit / scored.toxic.sum() > 0.95 and hit / (scored.truth == 1).sum() > 0.8
    wide = held.withColumn("toxic", F.lit("x")).withColumn("_scores", F.lit(1))
    kept = toxicity.drop_toxic(wide, chain)
    assert kept.columns == wide.columns and kept.count() == (~scored.toxic).sum()


def test_later_models_use_earlier_categories(chain_and_held_out):
    chain, _ = chain_and_held_out
    assert chain.categories[-1] == "toxic" and len(chain.categories) > 2
    for i, w in enumerate(chain.weights):
        assert len(w) == len(chain.features) + i + 1
    assert np.abs(chain.weights[-1][len(chain.features) : -1]).max() > 0.01


def test_linear_fit_reaches_the_optimum():
    rng = np.random.default_rng(0)
    n, width = 300, 12
    x = rng.random((n, width)) < 0.3
    dense = rng.standard_normal((n, 2))
    y = (rng.random(n) < toxicity.logistic(x @ rng.standard_normal(width) + dense @ [1.0, -2.0])).astype(float)
    row, col = np.nonzero(x)
    inputs = toxicity.Inputs(n, width, row, col, np.ones(len(row)), dense)
    w = toxicity.fit_linear(inputs, y, toxicity.Training(steps=3000, tolerance=1e-6, penalty=1.0))
    full = np.column_stack([x, dense, np.ones(n)])
    slope = full.T @ (toxicity.logistic(full @ w) - y)
    slope[:-1] += w[:-1]
    assert np.abs(slope).max() < 0.05


def test_toxicity_edges(spark):
    schema = "doc_id long, text string, lang string, _scores int"
    rows = [(1, None, None, 1), (2, "", "en", 1), (3, "word " * 50_000, "en", 1), (3, "x", "en", 1), (None, "y", "en", 1)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, None), (2, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    chain = toxicity.train_chain(docs, labels)
    assert not any(r.toxic for r in toxicity.score_toxicity(docs, chain).collect())
    assert toxicity.drop_toxic(docs, chain).count() == len(rows)
    assert toxicity.score_toxicity(docs.limit(0), toxicity.train_chain(docs.limit(0), labels.limit(0))).count() == 0
    many = [(i, ("vile brute " if i % 4 == 0 else "kind friend ") * 3 + str(i), "en", 1) for i in range(80)]
    docs = spark.createDataFrame([*many, (500, None, "en", 1)], schema)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)] + [(0, 1)], "doc_id long, toxic int")
    scored = {r.doc_id: r.toxic for r in toxicity.score_toxicity(docs, toxicity.train_chain(docs, labels)).collect()}
    assert scored == {i: i % 4 == 0 for i in range(80)} | {500: False}


def test_repeated_documents_keep_the_sample_bounded(spark):
    words = lambda i: ("vile brute " if i % 4 == 0 else "kind friend ") * 3 + str(i)
    rows = [(i, words(i), "en") for i in range(80)] + [(4, words(4), "en")] * 300 + [(8, "some other text", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(4, 1)] * 5, "doc_id long, toxic int")
    for most in (50, 500):
        sample = toxicity.labelled_sample(docs, labels, toxicity.Training(max_rows=most)).collect()
        assert len(sample) == len({r.doc_id for r in sample}) == min(most, 80)
    scored = toxicity.score_toxicity(docs, toxicity.train_chain(docs, labels)).collect()
    assert all(r.toxic == (r.doc_id % 4 == 0) for r in scored if r.doc_id != 8)


def test_threshold_keeps_the_recall_floor():
    y = np.array([1, 1, 0, 1, 0, 0, 1, 0, 0, 0], dtype=float)
    score = np.linspace(0.9, 0.1, 10)
    for floor in (0.0, 0.5, 0.75, 1.0):
        at = toxicity.best_threshold(score, y, floor, 0.0)
        assert y[score >= at].sum() >= floor * y.sum()
    assert toxicity.best_threshold(score, y, 0.0, 0.0) > toxicity.best_threshold(score, y, 1.0, 0.0)
    # a recall that costs clean rows is given up, and scores that tell nothing reject nothing
    assert y[score >= toxicity.best_threshold(score, y, 1.0, 0.9)].tolist() == [1, 1]
    assert toxicity.best_threshold(np.full(10, 0.4), y, 0.85, 0.9) > 1


def test_secrets_in_the_corpus(spark):
    found = QUERIES["op10_secret_scan"](spark, LARGER).join(read(spark, LARGER, "documents").select("doc_id", "text"), "doc_id")
    truth = F.expr("candidate rlike '^[0-9a-fA-F]{40}$' AND lower(text) rlike concat('token\\\\W+', lower(candidate))")
    table = found.groupBy(truth.alias("truth"), "is_secret").count().collect()
    n = {(r.truth, r.is_secret): r["count"] for r in table}
    print(n)
    assert n.get((True, True), 0) > 100 and n.get((True, False), 0) <= 0.02 * n[True, True]
    assert n.get((False, True), 0) <= 0.05 * n[True, True]
    planted = F.size(F.regexp_extract_all("text", F.lit(r'(?i)token\W+[0-9a-f]{40}'), F.lit(0)))
    assert n[True, True] + n.get((True, False), 0) == read(spark, LARGER, "documents").select(F.sum(planted)).first()[0]


def test_held_out_findings(spark):
    docs = read(spark, LARGER, "documents")
    words = secrets.corpus_dictionary(docs)
    labelled = secrets.with_features(secrets.with_dictionary(secrets.labelled_findings(docs, 1500), words)).cache()
    held = F.pmod(F.xxhash64("candidate"), F.lit(3)) == 0
    model = secrets.train_forest(labelled.filter(~held))
    rows = model.transform(secrets.VectorAssembler(inputCols=secrets.FEATURES, outputCol="features").transform(labelled.filter(held)))
    right, total = rows.agg(F.count_if(F.col("prediction") == F.col("label")), F.count(F.lit(1))).first()
    assert total > 200 and right / total > 0.97


def test_secret_edges(spark):
    key = "0f3a" * 10
    rows = [
        (1, None, "a"), (2, "", "a"), (3, f'token = "{key}"', "a"), (3, f'token = "{key}"', "a"), (None, f"password: {key}", "a"),
        (4, "plain words only", "a"), (5, "x" * 200_000 + "1", "a"), (6, f"{key}", "a"), (7, f'a="{key}";b="{key[::-1]}"', "a"),
    ] + [(100 + i, f"some plain words number {i} in a line", "a") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, candidate string")
    got = secrets.scan_secrets(docs).collect()
    assert sorted((r.doc_id or 0, r.word_at) for r in got) == [(0, 1), (3, 2), (3, 2), (5, 0), (6, 0), (7, 0), (7, 0)]
    assert all(r.is_secret for r in got if r.doc_id in (3, None)) and all(0 <= r.score <= 1 for r in got)
    assert secrets.scan_secrets(docs.limit(0)).count() == 0
    one_kind = secrets.find_candidates(docs.filter("doc_id = 3")).withColumn("label", F.lit(1.0)).drop("doc_id")
    assert all(r.score == 1 for r in secrets.scan_secrets(docs, one_kind).collect())


def test_copies_do_not_make_a_secret_known(spark):
    secret = "kqXvTz7LpwZrWmnbYsd9QhJgfRtc"
    rows = [(i, f"some plain words in line {'abcdefghij'[i % 10] * 4} number {i}") for i in range(200)]
    once, often = [(1000, f"key material {secret} here")], [(1000 + i, f"key material {secret} here") for i in range(1000)]
    got = []
    for more in (once, often):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string")
        words = secrets.corpus_dictionary(docs)
        found = secrets.with_dictionary(secrets.find_candidates(docs), words).filter(F.col("candidate") == secret)
        scored = secrets.scan_secrets(docs, secrets.labelled_findings(spark.createDataFrame(rows, "doc_id long, text string"))).filter(F.col("candidate") == secret)
        got.append(({r.entry for r in words.collect()}, {r.known_share for r in found.collect()}, {(r.score, r.is_secret) for r in scored.collect()}))
    assert got[0] == got[1] and got[0][1] == {0.0} and "plain" in got[0][0]


def test_values_after_key_words_are_candidates(spark):
    rows = [(i, f"some plain words in line {'abcdefghij'[i % 10] * 4} number {i}") for i in range(600)]
    values = {
        1000: ('secret = "{}"', "kXvTqLpZrWmNbYsD"), 1001: ("api_key={}", "84629173058264"), 1002: ("password: {}", "hT7!qZ2$xR9~kW4"),
        1003: ("passwd={}", "q7Rx.Lm2"), 1004: ('{{"token":"{}","user":"bob"}}', "xK9,mQ2;vB"), 1005: ("password : {}.", "zQ8@wN3%tY"),
    }
    made = [(i, f"plain words {form.format(v)} plain words") for i, (form, v) in values.items()]
    odd = [(2000, "password: plainwords"), (2001, "token " * 20_000), (2002, "token" * 20_000), (2003, "password:" + "." * 100_000), (2004, "password: abc")]
    docs = spark.createDataFrame(rows + made + odd, "doc_id long, text string")
    got = secrets.scan_secrets(docs).filter("doc_id >= 1000").collect()
    by_id = {(r.doc_id, r.candidate): r for r in got}
    print([(r.doc_id, r.candidate[:40], r.score) for r in got])
    assert all((i, v) in by_id for i, (_, v) in values.items())
    assert all(by_id[i, v].is_secret for i, (_, v) in values.items())
    assert (2004, "abc") not in by_id and not any(r.is_secret for r in got if r.doc_id == 2000)
