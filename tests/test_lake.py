import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from reviewmill.operators import lake
from reviewmill.plans.jobs import load_job
from reviewmill.schema import RAW_REVIEWS
from reviewmill.sources.reviews import read_review_dump, read_reviews_csv, stream_review_dump
from reviewmill.streaming.ingest import ingest_stream


def batch(spark, texts, start=0):
    rows = [("a", str(start + i), t, 5, i, start + i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, RAW_REVIEWS)


def test_append_skips_conflicts(spark, tmp_path):
    path = str(tmp_path / "lake")
    one = lake.append_to_lake(batch(spark, ["Good", " good ", "bad", "", None]), path, "csv", "b1")
    assert (one.attempted, one.inserted, one.skipped) == (3, 2, 1)
    again = lake.append_to_lake(batch(spark, ["Good", "bad"]), path, "csv", "b2")
    assert (again.attempted, again.inserted) == (2, 0)
    other = lake.append_to_lake(batch(spark, ["GOOD", "new"]), path, "other", "b3")
    assert other.inserted == 2
    rows = lake.read_lake(spark, path).orderBy("id").collect()
    assert [(r["id"], r["content"], r["source"]) for r in rows] == [
        (1, "Good", "csv"), (2, "bad", "csv"), (3, "GOOD", "other"), (4, "new", "other"),
    ]
    assert {r["ingestion_batch_id"]: r["n_rows"] for r in lake.batch_audit(lake.read_lake(spark, path)).collect()} == {"b1": 2, "b3": 2}


def test_empty_load(spark, tmp_path):
    got = load_job(batch(spark, []), str(tmp_path / "lake"), "csv")
    assert (got.batch_id, got.attempted, got.inserted) == (None, 0, 0)
    assert lake.read_lake(spark, str(tmp_path / "none")).count() == 0


def test_large_batch_takes_the_shuffled_anti_join(spark, monkeypatch):
    prepared = lake.prepare_rows(batch(spark, ["a", "b", "c"]), "s", "b")
    known = lake.prepare_rows(batch(spark, ["b"]), "s", "b").select(*lake.KEY)
    small = lake.append_plan(prepared, known, 3)
    large = lake.append_plan(prepared, known, 10**9)
    for plan in (small, large, lake.append_plan(prepared, known)):
        assert sorted(r["content"] for r in plan.collect()) == ["a", "c"]


@pytest.mark.parametrize("parts", [1, 7])
def test_ids_follow_row_order(spark, parts):
    df = spark.range(1000).select((F.lit(5000) - F.col("id")).alias("row_id")).repartition(parts)
    rows = lake.number_rows(df, 11).orderBy("row_id").collect()
    assert [r["id"] for r in rows] == list(range(11, 1011))


def test_stream_equals_batch(spark, tmp_path):
    landing, files = tmp_path / "landing", [["One", "two"], ["TWO", "three 😍"], ["four", "one"]]
    for i, texts in enumerate(files):
        batch(spark, texts, start=10 * i).coalesce(1).write.mode("append").parquet(str(landing))
    streamed, batched = str(tmp_path / "s"), str(tmp_path / "b")
    for _ in range(2):  # the second run finds nothing new
        ingest_stream(
            stream_review_dump(spark, str(landing), files_per_batch=1), streamed, "dump", str(tmp_path / "cp")
        ).awaitTermination()
    # replay from the start: nothing is inserted twice
    ingest_stream(stream_review_dump(spark, str(landing)), streamed, "dump", str(tmp_path / "cp2")).awaitTermination()
    load_job(read_review_dump(spark, str(landing)), batched, "dump")
    a, b = (sorted(r["content_hash"] for r in lake.read_lake(spark, p).collect()) for p in (streamed, batched))
    assert a == b and len(a) == 4


def test_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('content,score,thumbsUpCount,label\n"two\nlines, ""quoted""",5,3,positive\nN/A,,7.0,NA\nplain,x,1,neutral\n')
    rows = read_reviews_csv(spark, str(path), multi_line=True).orderBy("row_id").collect()
    assert [tuple(r)[:4] for r in rows] == [
        ('two\nlines, "quoted"', 5, 3, "positive"), (None, None, 7, None), ("plain", None, 1, "neutral"),
    ]
    with pytest.raises(AnalysisException):
        read_reviews_csv(spark, str(tmp_path / "missing.csv"))
