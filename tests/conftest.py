import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from reviewmill.session import build_session

    session = build_session(
        "local[4]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def reviews(spark):
    rows = [
        ("Great! 😍🎉🚀 <b>visit</b> https://x.y/z?a=1 now", 5, 10, "positive"),
        ("😍🎉", 3, 1, "neutral"),
        ("SHOUTING Text", 1, 2, "negative"),
        ("", 2, 0, "neutral"),
        (None, 2, 0, "neutral"),
        ("plain words", 4, 7, "invalid"),
    ]
    cols = ["content", "score", "thumbsUpCount", "label"]
    data = [(i, "app", f"r{i}", *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(
        data, "row_id long, app_id string, reviewId string, content string, score int, thumbsUpCount int, label string"
    ).select("app_id", "reviewId", "row_id", *cols)
