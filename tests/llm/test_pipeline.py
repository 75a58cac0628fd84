"""The pipeline's stages against plain versions of their operators, and the rest without this package."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import brute
import pytest

import corpus_pipeline
from reviewmill.llm.queries import QUERIES, read

REPO, SMALL = Path(__file__).resolve().parents[2], "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents before and after each stage."""
    docs, out = read(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage"))
        stage(spark, docs, SMALL).write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages(steps):
    import re

    columns = steps[0][1].columns
    for name, before, after in steps:
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns, name
    rows = {name: (before.collect(), after.collect()) for name, before, after in steps}
    ids = lambda part: sorted(r.doc_id for r in part)

    before, after = rows["exact dedup"]
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert ids(after) == sorted(first.values())

    before, after = rows["ngram jaccard join"]
    groups = brute.jaccard_groups([(r.doc_id, r.text) for r in before], 5, 80)
    assert ids(after) == sorted(i for i, (_, root) in groups.items() if i == root)

    before, after = rows["source mixing"]
    taken = Counter(r.doc_id for r in after)
    assert set(taken) <= set(ids(before)) and max(taken.values()) <= 2

    before, after = rows["bpe encoding"]
    assert ids(after) == ids(before)


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SMALL).count() == steps[-1][2].count()


def test_toxic_documents_go(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    _, stage = corpus_pipeline.STAGES[0]
    kept = stage(spark, docs, sf_dir).select("doc_id").join(labels, "doc_id")
    left, clean = kept.filter("toxic = 1").count(), kept.filter("toxic = 0").count()
    assert left <= 0.3 * labels.filter("toxic = 1").count() and clean >= 0.98 * labels.filter("toxic = 0").count()


def test_every_operator_has_a_query():
    assert sorted({int(name[2:].split("_")[0]) for name in QUERIES}) == list(range(1, 14))


def test_the_rest_needs_neither():
    code = (
        "import sys\n"
        "sys.modules['reviewmill.llm'] = None\n"
        "import __spark_entry__ as e\n"
        "assert not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries()), 'left'\n"
        "assert len(e.queries()) > 60 and len(e.oracle_sql()) > 60\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_queries_equal_sql(spark):
    from oracle import differences, duck

    from reviewmill.llm.queries import ORACLES

    con = duck(SMALL)
    for name, sql in ORACLES.items():
        assert differences(QUERIES[name](spark, SMALL), sql, con) is None, name
