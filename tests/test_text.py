import re

import pytest
from pyspark.sql import functions as F

from reviewmill.functions import labels, links, text
from reviewmill.operators.transform import drop_any_null, drop_blank, null_profile, transform_reviews
from reviewmill.schema import EmptyInputError, MissingColumnError


def python_clean(value: str) -> str:
    """The rules in Python, for comparison."""
    value = re.sub(r"<.*?>", " ", value.lower())
    value = re.sub(r"http\S+|www\S+", " ", value)
    spans = [(0x1F300, 0x1F5FF), (0x1F600, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F700, 0x1FAFF), (0x2702, 0x27B0), (0x24C2, 0x1F251)]
    inside = "".join(f"{chr(a)}-{chr(b)}" for a, b in spans)
    return re.sub(r"\s+", " ", re.sub(f"[{inside}]+", " ", value)).strip()


HARD = [
    "Great! 😍🎉🚀", "a b c", "tag <b\rold> end", "tag <b\nold> end", "漢字 and かな", "x\x1cy", "İstanbul ΣΑΣ",
    "　ideographic　", "zero​width", "em—dash", "var️", "☕ coffee", "seehttp://a.b c", "WWW.A.B c",
    "<a><b>", "1 < 2 > 0", "  lots   of\t space ", "<only>", "www.only", "😍", "half <open", "Ⓐ", "h", "w w", "🎉h",
    "http", "<p>http://x</p>😍", " ",
]


def test_clean_text_matches_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "i int, t string")
    out = df.select("i", text.clean_text(F.col("t")).alias("c"), text.survives_cleaning(F.col("t")).alias("s")).collect()
    for r in out:
        assert r["c"] == python_clean(HARD[r["i"]]), HARD[r["i"]]
        assert r["s"] == (r["c"] != ""), HARD[r["i"]]


def test_hash_ignores_case_and_outer_space(spark):
    df = spark.createDataFrame([(" Good App ",), ("good app",), ("bad",)], "t string")
    hashes = [r[0] for r in df.select(text.content_hash(F.col("t"))).collect()]
    assert hashes[0] == hashes[1] != hashes[2]


def test_tokens_and_pairs(spark):
    df = spark.createDataFrame([("I am a Big_fan of C3PO!",), ("x",), ("",), ("one",)], "t string")
    words = text.tokens(F.col("t"))
    rows = df.select(text.words_and_pairs(words).alias("w")).collect()
    assert rows[0][0] == ["am", "big_fan", "of", "c3po", "am big_fan", "big_fan of", "of c3po"]
    assert [r[0] for r in rows[1:]] == [[], [], ["one"]]


def test_casts(spark):
    df = spark.createDataFrame([("7",), (None,), ("abc",), (" 7 ",), ("7.0",), (" 7",), ("-3",)], "v string")
    assert [r[0] for r in df.select(labels.safe_int(F.col("v"))).collect()] == [7, None, None, 7, None, 7, -3]
    nums = spark.createDataFrame([(3.9,), (float("nan"),), (-3.9,), (1e20,)], "v double")
    assert [r[0] for r in nums.select(labels.safe_int(F.col("v"))).collect()] == [3, None, -3, None]
    df = spark.createDataFrame([(" Negative ",), ("NEUTRAL",), ("2",), ("invalid",), (None,)], "v string")
    assert [r[0] for r in df.select(labels.safe_label(F.col("v"))).collect()] == [0, 1, 2, None, None]


def test_normalize_and_decode(spark):
    df = spark.createDataFrame([("LABEL Positive",), ("not negative, neutral",), ("Neutral!",), ("Other",)], "v string")
    assert [r[0] for r in df.select(labels.normalize_label(F.col("v"))).collect()] == ["Positive", "Negative", "Neutral", "other"]
    df = spark.createDataFrame([(0,), (1,), (2,), (7,), (None,)], "v int")
    assert [r[0] for r in df.select(labels.decode_label(F.col("v"))).collect()] == [
        "negative", "neutral", "positive", "unknown", "unknown",
    ]


def test_app_id(spark):
    cases = {
        "https://play.google.com/store/apps/details?id=com.a.b&hl=en": "com.a.b",
        " https://market.android.com/store/apps/details?hl=en&id=c.d ": "c.d",
        "https://PLAY.google.com/store/apps/details?id=e.f": "e.f",
        "https://evil.com/store/apps/details?id=com.a.b": "",
        "https://play.google.com/store/apps/details?id=": "",
        "com.plain.id": "com.plain.id", "no dots": "", "": "", "has space.com x": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r["u"]: r["a"] for r in df.select("u", links.extract_app_id(F.col("u")).alias("a")).collect()} == cases


def test_transform(spark, reviews):
    out = transform_reviews(reviews).orderBy("row_id").collect()
    assert [(r["row_id"], r["content"], r["label"], r["label_raw"]) for r in out] == [
        (0, "great! visit now", 2, None), (2, "shouting text", 0, None), (5, "plain words", None, "invalid"),
    ]
    assert [r["row_id"] for r in drop_blank(reviews).orderBy("row_id").collect()] == [0, 1, 2, 5]
    assert drop_any_null(reviews, ("score",)).count() == 5
    assert {r["column_name"]: r["nulls"] for r in null_profile(reviews).collect()}["content"] == 1


def test_guards(spark, reviews):
    with pytest.raises(MissingColumnError):
        transform_reviews(reviews.drop("content"))
    with pytest.raises(EmptyInputError):
        transform_reviews(reviews.limit(0), check_rows=True)
    with pytest.raises(EmptyInputError):
        transform_reviews(None)
