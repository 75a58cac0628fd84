"""N-gram join, vector join, license scans and mixing against plain versions."""

import random

import brute
import numpy as np
import pytest

from reviewmill.llm import licenses, mixing, ngrams, projections
from reviewmill.llm.queries import QUERIES, read

SMALL = "/root/testdata/sf0.001"


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at : at + rng.choice([0, 1])] = [f"e{rng.randrange(10**6)}"] * rng.choice([0, 1])
    return words


def made_texts(seed):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "one", "One two", "one two", "ONE TWO THREE", "one\x0btwo\x0cthree", "é É", "a\xa0b c d"]
    for size in (4, 8, 11, 12, 15, 19, 20, 21, 22, 25, 30, 60, 150, 400):
        for _ in range(3):
            base = [f"w{rng.randrange(3000)}" for _ in range(size)]
            texts += [" ".join(edited(rng, base, rng.randint(0, 3))) for _ in range(8)]
    passage = [f"p{i}" for i in range(40)]
    texts += [" ".join(passage + [f"x{i}_{j}" for j in range(rng.randint(0, 30))]) for i in range(60)]
    base = [f"c{i}" for i in range(150)]
    texts += [" ".join(edited(rng, base, rng.randint(0, 5))) for _ in range(120)]
    texts += ["same again text"] * 30 + ["z " * 50_000]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (3, 95, 3), (1, 60, 4)])
def test_jaccard_groups(spark, k, percent, seed):
    rows = list(enumerate(made_texts(seed), start=1))
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, node string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.jaccard_groups(docs, ngrams.Join(k, percent)).collect()}
    assert got == brute.jaccard_groups(rows, k, percent)


def test_jaccard_edges(spark):
    schema = "doc_id long, text string, size int"
    rows = [(7, "a b c d", 1), (7, "a b c d", 1), (None, "a b c d", 1), (3, None, 1), (4, None, 1), (None, "q r s t", 1), (None, None, 1)]
    docs = spark.createDataFrame(rows, schema)
    join = ngrams.Join(3, 90)
    got = sorted(map(repr, (tuple(r) for r in ngrams.jaccard_groups(docs, join).collect())))
    assert got == sorted(map(repr, [(7, 2, 7), (7, 2, 7), (None, 2, 7), (3, 0, 3), (4, 0, 4), (None, 2, None), (None, 0, None)]))
    kept = ngrams.one_of_each(docs, join)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [3, 4, 7, 7]
    assert ngrams.jaccard_groups(docs.limit(0), join).count() == 0


def test_prefix_and_subsets_are_complete():
    for percent in (60, 80, 90, 95):
        join = ngrams.Join(3, percent)
        for a in range(1, 60):
            for b in range(join.smallest(a), a + 1):
                t = join.overlap(a, b)
                linked = lambda shared: 100 * shared >= percent * (a + b - shared)
                assert linked(t) and not linked(t - 1)
                if t <= b:
                    assert join.prefix(a) >= a - t + 1 and join.prefix(b) >= b - t + 1
                    assert t in join.subset_sizes(a, 100) and t in join.subset_sizes(b, 100)


def test_names_that_collide_are_made_anew(spark, monkeypatch):
    rows = [(1, "a b c d"), (2, "e f g h"), (3, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    true, calls = ngrams.profiled, []

    def colliding(docs, join):
        calls.append(join.seed)
        out = true(docs, join)
        return out.withColumn("node", (out["node"] * 0).cast("long")) if join.seed == 0 else out

    monkeypatch.setattr(ngrams, "profiled", colliding)
    got = {r.doc_id: r.component_id for r in ngrams.jaccard_groups(docs, ngrams.Join(3, 90)).collect()}
    assert got == {1: 1, 2: 2, 3: 1} and calls == [0, 1]


def test_join_query(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, SMALL, "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op6_ngram_jaccard_join"](spark, SMALL).collect()}
    assert got == brute.jaccard_groups(rows, 3, 90)


def vectors(seed, dims=16):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, 2):
        for _ in range(25):
            centre = rng.standard_normal(dims)
            for _ in range(rng.integers(1, 8)):
                rows.append(((centre + rng.standard_normal(dims) * rng.choice([0, 0.05, 0.2, 0.3])).astype("float32") * rng.choice([1.0, 9.0]), label))
        rows += [(rows[-1][0], label)] * 15
    rows += [(rows[0][0], 2), (rows[0][0], None)]
    out = [(i, [float(x) for x in v], label) for i, (v, label) in enumerate(rows)]
    out += [(9000, None, 1), (9001, [0.0] * dims, 1), (9002, [0.0] * dims, 1), (9003, [float("nan")] * dims, 1), (9004, [1.0, None], 1),
            (9005, [1.0, float("inf")], 1), (9006, [], 1), (9007, [1.0, 0.0], 1), (9008, [2.0, 0.0], 1), (9009, [1e30, 1e30], 1), (9010, [1e-30, 1e-30], 1)]
    return [(i * 7 % 10007, v, label) for i, v, label in out]


@pytest.mark.parametrize("block", [512, 5])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(projections, "BLOCK_ROWS", block)
    rows = vectors(3)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in projections.near_vectors(df).collect()}
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]
    assert got == brute.near_vectors(as_float, 0.98)
    assert projections.near_vectors(df.limit(0)).count() == 0


def test_vector_query(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in read(spark, SMALL, "embeddings").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op5_embedding_near_dedup"](spark, SMALL).collect()}
    want = brute.near_vectors(rows, 0.98)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_recall_of_the_window_count():
    rng, w = np.random.default_rng(0), projections.Windows()
    u = projections.unit_rows(rng.standard_normal(64 * 4000), 64)
    noise = rng.standard_normal(u.shape)
    noise -= (noise * u).sum(1, keepdims=True) * u
    v = 0.98 * u + np.sqrt(1 - 0.98**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    hits = (np.abs((u - v) @ w.matrix(64)) <= w.window).sum(1)
    assert (hits >= w.need).all()
    assert (np.abs(np.floor(u @ w.matrix(64) / w.cell) - np.floor(v @ w.matrix(64) / w.cell))[:, : w.grid] <= 1).all()


def test_licenses(spark):
    base = licenses.BASE_PHRASES
    texts = [
        None, "", "Under the MIT License.", "UNDER THE MIT-LICENSE under the mit license", "under the the mit license", "cc by nc cc by nc by nc",
        "cc by nc", "cc by", "Licensed under the Apache License, Version 2.0.", "x " * 30_000 + "cc-by-nc", "ünder the mit license under thé mit license",
        "This work is licensed under the GNU General Public License, version 3.", "licensed under the gnu very general public license version 3",
        "general public words without a notice", "under the mit license" * 3, "İ under the mit license",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2])]
    docs = spark.createDataFrame([(*r, "q", 1.5) for r in rows], "doc_id long, text string, label string, score double")
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        n, places = brute.license_places(texts[r.doc_id], base)
        assert (r.n_words, r.n_base) == (n, len(places)), texts[r.doc_id]
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        labels = sorted({label for _, label in places})
        assert r.base_labels == ",".join(labels) and set(labels) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    found = {r.doc_id: r.labels for r in got}
    assert found[11] == found[12] == "gpl-3" and found[13] == ""
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


LICENSED = [
    ("Licensed under the GNU Lesser General Public License version 2.1", "lgpl"),
    ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lgpl"),
    ("Licensed under the GNU General Public License version 2", "gpl-2"),
    ("GNU General Public License v3.0", "gpl-3"),
    ("licensed under the GNU Affero General Public License", "agpl"),
    ("Licensed under a Creative Commons Attribution 3.0 Unported License", "cc-by"),
    ("licensed under CC BY-SA 3.0", "cc-by-sa"),
    ("licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 licence", "cc-by-sa"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2"),
    ("Mozilla Public License 2.0", "mpl-2"),
    ("BSD 3-Clause License", "bsd"),
    ("the general public has a license to read this", ""),
    ("she was licensed under the new law", ""),
    ("the software is provided as is, without warranty of any kind, either express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement", "mit"),
    ("SPDX-License-Identifier: MIT " + "then other words " * 9 + "Mozilla Public License, version 2.0", "mit,mpl-2"),
]


def plain_license_labels(text):
    """The method's labels by looking at every window of words: templates compared place by place."""
    words = licenses_words(text)
    spans = []
    for label, notice in [*licenses.BASE_PHRASES, *licenses.NOTICES]:
        w = notice.split()
        grams = [tuple(w[i : i + licenses.K]) for i in range(len(w) - licenses.K + 1)]
        hits = sorted((p - a, a) for a, g in enumerate(grams) for p in range(len(words)) if tuple(words[p : p + licenses.K]) == g)
        runs = []
        for d, a in hits:
            if runs and d - runs[-1][-1][0] <= licenses.NEIGHBOURS:
                runs[-1].append((d, a))
            else:
                runs.append([(d, a)])
        for run in runs:
            found, first, last = {a for _, a in run}, run[0][0], run[-1][0]
            covered = {a + j for a in found for j in range(licenses.K)}
            numbers = {a for a, g in enumerate(grams) if any(c.isdigit() for x in g for c in x)}
            score = len(covered) / (len(w) + last - first)
            if score >= licenses.COVERAGE and (not numbers or numbers & found):
                spans.append((label, (len(found), score), max(first, 0) + min(found), last + max(found) + licenses.K))
    return {a for a, n, b, e in spans if not any(x != a and m > n and s < e and t > b for x, m, s, t in spans)}


def licenses_words(text):
    return __import__("re").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", __import__("re").sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_license_labels(spark):
    rng = random.Random(4)
    rows = [(i, t) for i, (t, _) in enumerate(LICENSED)]
    for i in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(licenses.NOTICES)[1].split()
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1])] = rng.choice([[], ["lesser"], ["filler", "2"]])
            parts += [*words, *["between"] * rng.randint(0, 5)]
        rows.append((100 + i, " ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, t in rows:
        base = {label for _, label in brute.license_places(t, licenses.BASE_PHRASES)[1]}
        assert got[i].labels == ",".join(sorted(base | plain_license_labels(t))), t
    assert [got[i].labels for i in range(len(LICENSED))] == [label for _, label in LICENSED]


def test_vectors_with_null_and_repeated_ids(spark):
    v, far = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, v, 1), (None, v, 1), (7, [0.999, 0.01, 0.0], 1), (5, far, 2), (8, far, 2), (9, far, 1), (9, v, 1), (None, [0.0, 0.0, 1.0], 3), (None, [0.0, 0.001, 1.0], 3), (1, None, 3)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int, least int").repartition(3)
    got = sorted(map(repr, (tuple(r) for r in projections.near_vectors(df).collect())))
    want = [(5, 3, 5, True), (None, 3, 5, False), (7, 3, 5, False), (5, 1, 5, True), (8, 1, 5, False), (9, 0, 9, True), (9, 3, 5, False), (None, 1, None, True), (None, 1, None, True), (1, 0, 1, True)]
    assert got == sorted(map(repr, want))


def test_license_query(spark):
    texts = {r.doc_id: r.text for r in read(spark, SMALL, "documents").collect()}
    for r in QUERIES["op8_license_scans"](spark, SMALL).collect():
        n, places = brute.license_places(texts[r.doc_id], licenses.BASE_PHRASES)
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(sorted({label for _, label in places})))


def check_mix(rows, texts):
    sizes, of = {}, {}
    for (i, source, text) in texts:
        n = len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")])
        sizes[source] = sizes.get(source, 0) + n
        of.setdefault(i, []).append((source, n))
    want = brute.targets(sizes)
    taken = {}
    for r in rows:
        source, n = of[r.doc_id][0]
        assert (r.size, r.source_size) == (n, sizes[source]) and abs(r.target - want[source]) < 1e-6 * max(1, want[source])
        assert r.taken in {n * c for c in (0, 1, 2)}
        taken[source] = taken.get(source, 0) + r.taken
    assert len(rows) == len(texts)
    for source in sizes:
        largest = max(n for (s, n) in (x[0] for x in of.values()) if s == source)
        assert abs(taken[source] - want[source]) <= 3 * largest, (source, taken[source], want[source])


def test_mixing(spark):
    rng = random.Random(2)
    sources = [None, "", "a", "b", "Z", "é", "🎉", "￿", "one", "empty"]
    texts = [(i, s := rng.choice(sources[:-1]), " ".join(["w"] * rng.choice([1, 5, 20, 60, 300]))) for i in range(900)]
    texts += [(2000, "one", "only words here"), (2001, "empty", None), (2002, "empty", ""), (2003, "a", None)] + [(3000 + i, "hot", "same text again") for i in range(800)]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, source string, text string, size int")
    first = mixing.mix_report(docs).collect()
    check_mix(first, texts)
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert sorted(first) == sorted(again)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    seen = {}
    for r in mixed.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert all(seen.get(r.doc_id, 0) * r.size == r.taken for r in first)
    assert mixing.mix_report(docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, "a", None), (None, None, "")], "doc_id long, source string, text string")
    assert sorted(r.taken for r in mixing.mix_report(nothing).collect()) == [0, 0]
    twice = spark.createDataFrame([(1, "a", "x y"), (1, "a", "x y"), (2, "a", "z")], "doc_id long, source string, text string")
    assert mixing.mix_report(twice).count() == 3


def test_mix_query(spark):
    texts = [(r.doc_id, r.source, r.text) for r in read(spark, SMALL, "documents").collect()]
    check_mix(QUERIES["op9_source_mixing"](spark, SMALL).collect(), texts)


def test_parity_bits_never_rule_out_a_link():
    rng, join = np.random.default_rng(1), ngrams.Join(3, 90)
    for size in (1, 5, 40, 300, 2000, 20_000):
        for share in (0.0, 0.02, 0.05, 0.5):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            fresh = rng.integers(0, 1 << 63, int(size * share), dtype=np.uint64)
            b = np.unique(np.concatenate([a[len(fresh) :], fresh]))
            apart = len(np.setxor1d(a, b))
            bits = sum(int(x).bit_count() for x in (ngrams.parity_of(a) ^ ngrams.parity_of(b)).view(np.uint64))
            assert bits <= apart
            if len(np.intersect1d(a, b)) * (100 + join.percent) >= (len(a) + len(b)) * join.percent:
                assert bits * (100 + join.percent) <= (len(a) + len(b)) * (100 - join.percent)


def test_near_copies_go_by_id_and_text(spark):
    rows = [(7, "a b c d", 1), (None, "a b c d", 2), (None, "q r s t", 3), (None, None, 4), (None, "", 5), (9, "a b c d", 6), (9, "u v w x", 7), (9, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int")
    kept = ngrams.one_of_each(docs, ngrams.Join(3, 90))
    assert kept.columns == docs.columns and sorted(r.at for r in kept.collect()) == [1, 3, 4, 5, 7, 8]


def test_repeated_rows_are_taken_near_the_target(spark):
    rows = [(1, "a", "x y z w", 0)] * 100 + [(None, "a", "p q r s", 0)] * 31 + [(i, "a", "w w w w", 0) for i in range(2, 160)]
    rows += [(500, "b", "m n", i) for i in range(90)] + [(i, "b", "m n", 0) for i in range(501, 600)] + [(i, "c", "k", 0) for i in range(700, 760)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, at int").repartition(5)
    report = mixing.mix_report(docs).collect()
    assert len(report) == len(rows)
    mixed = mixing.mix_documents(docs).collect()
    for source, longest in (("a", 4), ("b", 2), ("c", 1)):
        n = sum(r[1] == source for r in rows) * longest
        target = {r.target for r in report if r.source_size == n}.pop()
        assert 0.1 < target / n <= 2
        assert abs(sum(r.taken for r in report if r.source_size == n) - target) <= 3 * longest
        assert sum(longest for r in mixed if r.source == source) == sum(r.taken for r in report if r.source_size == n)
    for i, many in ((1, 100), (None, 31), (500, 90)):
        reported = [r.taken // r.size for r in report if r.doc_id == i]
        assert len(reported) == many and max(reported) - min(reported) <= 1
        assert sum(reported) == sum(r.doc_id == i for r in mixed)
    times = [sum(r.doc_id == 500 and r["at"] == i for r in mixed) for i in range(90)]
    assert max(times) - min(times) <= 1
