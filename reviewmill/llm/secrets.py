"""Secret scans: candidates by shape or by the key word before them, false positives removed by a random forest.

Candidates, features, dictionary, training and scoring are DataFrame functions and Spark ML; no
Python runs on the executors. The forest learns from labelled findings; where none are given,
`labelled_findings` derives some by setting known values into the corpus's own words.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.operators.ranking import seeded_sample
from reviewmill.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
CANDIDATE = r"[A-Za-z0-9_+/=-]{12,}"
KEY_WORD = r"(?i)(token|secret|passw|api[_-]?key|credential|private|bearer|auth|access[_-]?key)"
# what a word assigns to a key word in it, and the end of the words before an assigned word
ASSIGNS = KEY_WORD + r"[^\s=:]{0,40}[=:]+>?(([\"'`]).*?\3|.+)"
ASSIGNED = KEY_WORD + r"[^\s=:]{0,40}\s?[=:]+>?[\"'`]?$"
HAS_ASSIGNED = KEY_WORD + r"[^\s=:]{0,40}\s*[=:]"
MARKS = r"\"'`,;.)\]}>"
VALUE_CHARS = 6
OTHER_WORD = r"(?i)(commit|md5|sha\d*|checksum|version|build|uuid|id|hash|file|url|page|mail|phone|order|sku|isbn)\W*$"
DICTIONARY_TEXTS, DICTIONARY_SHARE = 5, 1 / 20_000
LETTERS = r"\p{L}{3,}"
FEATURES = [
    "n_chars", "changes", "digits", "uppers", "symbols", "distinct_chars", "hex", "known_share",
    "is_path", "is_address", "quoted", "assigned", "key_near", "other_near", "after_word",
]


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def assigned_values(word: Column, before: Column, before_2: Column) -> Column:
    """The values that `word` holds for a key word and = or : in it or before it, without quotes and marks around them.

    Printable characters of any kind; where no quotes say how far a value goes, it ends with the
    word, or at the first & , or ; of it, and both stand.
    """
    prior = F.concat_ws(" ", F.coalesce(before_2, F.lit("")), F.coalesce(before, F.lit("")))
    inside = F.when(word.rlike("[=:]"), F.regexp_extract_all(word, F.lit(ASSIGNS), F.lit(2)))
    next_to = F.when(F.coalesce(before, F.lit("")).rlike("[=:]>?[\"'`]?$") & prior.rlike(ASSIGNED), F.array(word))
    raw = F.concat(F.coalesce(inside, F.array().cast("array<string>")), F.coalesce(next_to, F.array().cast("array<string>")))
    bare = lambda v: F.regexp_replace(v, rf"^[\"'`]+|(?<![{MARKS}])[{MARKS}]+$", "")
    quoted = lambda v: F.regexp_extract(v, "^([\"'`])(.+?)\\1", 2)
    each = F.flatten(F.transform(raw, lambda v: F.when(quoted(v) != "", F.array(quoted(v))).otherwise(F.array(bare(v), bare(F.regexp_extract(v, "^[^&,;]+", 0))))))
    return F.array_distinct(F.filter(each, lambda v: F.length(v) >= VALUE_CHARS))


def find_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, word_at, candidate, word, before, before_2, after): runs of 12 or more key characters with
    a letter and a digit among them, and values assigned to a key word, of VALUE_CHARS or more characters of
    any kind; with the words around."""
    words = docs.select("doc_id", F.coalesce(F.col("text").rlike(HAS_ASSIGNED), F.lit(False)).alias("some"), split_words(F.col("text")).alias("words"))
    values = lambda i: assigned_values(F.get("words", i), F.get("words", i - 1), F.get("words", i - 2))
    places = F.sequence(F.lit(0), F.size("words") - 1)
    at = F.when(F.col("some"), F.filter(places, lambda i: shaped(F.get("words", i)) | (F.size(values(i)) > 0))).otherwise(
        F.filter(places, lambda i: shaped(F.get("words", i)))
    )
    near = lambda i: F.struct(
        i.alias("word_at"), F.get("words", i).alias("word"), F.get("words", i - 1).alias("before"),
        F.get("words", i - 2).alias("before_2"), F.get("words", i + 1).alias("after"),
    )
    found = words.filter(F.size("words") > 0).select("doc_id", F.explode(F.transform(at, near)).alias("f")).select("doc_id", "f.*")
    runs = F.filter(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0)), lambda c: c.rlike("[0-9]") & c.rlike("[A-Za-z]"))
    more = F.array_except(assigned_values(F.col("word"), F.col("before"), F.col("before_2")), runs)
    return found.withColumn("candidate", F.explode(F.concat(runs, more)))


def shaped(word: Column) -> Column:
    return (F.length(word) >= 12) & word.rlike(r"[0-9]") & word.rlike(CANDIDATE)


def corpus_dictionary(docs: DataFrame) -> DataFrame:
    """(entry): runs of three or more letters that stand in DICTIONARY_SHARE of the distinct texts, and in DICTIONARY_TEXTS at least.

    Words that hold candidates do not count, nor do copies of a text.
    """
    texts = docs.select("text").filter(F.length("text") > 0).distinct()
    plain = texts.select(F.filter(split_words(F.col("text")), lambda w: ~shaped(w)).alias("words"))
    runs = F.array_distinct(F.split(F.lower(F.array_join("words", " ")), r"[^\p{L}]+"))
    # an empty entry of every text counts the texts
    each = plain.select(F.explode(F.array_union(F.array(F.lit("")), F.filter(runs, lambda r: F.length(r) >= 3))).alias("entry"))
    counted = cut_lineage(each.groupBy("entry").agg(F.count(F.lit(1)).alias("n")))
    total = counted.filter("entry = ''").select("n").first()
    least = max(DICTIONARY_TEXTS, (total.n if total else 0) * DICTIONARY_SHARE)
    return counted.filter((F.col("n") >= least) & (F.col("entry") != "")).select("entry")


def with_dictionary(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """`found` with known_share: the share of a candidate's characters that lie in dictionary words."""
    runs = F.array_distinct(F.regexp_extract_all(F.lower("candidate"), F.lit(LETTERS), F.lit(0)))
    each = found.select("candidate").distinct().withColumn("entry", F.explode(runs))
    # written, so that the join deals out both sides itself and can split a value that stands everywhere
    known = cut_lineage(each.join(dictionary, "entry").groupBy("candidate").agg(F.collect_set("entry").alias("_known")))
    joined = found.join(known, "candidate", "left")
    covered = F.aggregate(
        F.filter(F.regexp_extract_all(F.lower("candidate"), F.lit(LETTERS), F.lit(0)), lambda r: F.array_contains("_known", r)),
        F.lit(0), lambda total, r: total + F.length(r),
    )
    return joined.withColumn("known_share", F.coalesce(covered / F.length("candidate"), F.lit(0.0))).drop("_known")


def with_features(found: DataFrame) -> DataFrame:
    """`found` (with known_share) and the other FEATURES as doubles."""
    c, n = F.col("candidate"), F.length("candidate")
    count = lambda pattern: F.regexp_count(c, F.lit(pattern))
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    head = F.expr("substring_index(word, candidate, 1)")
    around = F.concat_ws(" ", text("before_2"), text("before"), head)
    made = {
        "n_chars": n,
        "changes": count("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]") / n,
        "digits": count("[0-9]") / n,
        "uppers": count("[A-Z]") / n,
        "symbols": count("[^A-Za-z0-9]") / n,
        "distinct_chars": F.size(F.array_distinct(F.split(c, ""))) / n,
        "hex": c.rlike("^([0-9a-f]+|[0-9A-F]+)$"),
        "is_path": F.col("word").rlike(r"://|^/|/.*/|\.\w{2,4}$"),
        "is_address": F.col("word").rlike(r"@|\bwww\."),
        "quoted": head.rlike("[\"'`]$"),
        "assigned": around.rlike(r"[=:]\s*[\"'`]?$"),
        "key_near": around.rlike(KEY_WORD),
        "other_near": F.regexp_replace(around, r"[=:\s\"'`]+$", "").rlike(OTHER_WORD),
        "after_word": text("after").rlike(r"^\p{L}"),
    }
    return found.withColumns({name: value.cast("double") for name, value in made.items()})


def labelled_findings(docs: DataFrame, max_rows: int = 3_000) -> DataFrame:
    """Findings with a label, derived from at most `max_rows` documents, the same in every run.

    Each document lends two of its words; a value drawn from a hash of its id is set between
    them, once as a secret (hex, base64 and prefixed keys after a key word) and once as what is
    often taken for one: checksums, identifiers, addresses, paths, numbered and compound words.
    """
    usable = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    # a filter, so that no text but the sample's moves; of a repeated id one text counts
    few = seeded_sample(usable, ["doc_id"], max_rows).groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    words = F.filter(split_words(F.col("text")), lambda w: w.rlike(r"^\p{L}+$"))
    base = few.select(
        "doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("s"), F.pmod(F.xxhash64("doc_id"), F.lit(12)).cast("int").alias("kind"),
        F.coalesce(F.get(words, F.lit(0)), F.lit("the")).alias("w0"), F.coalesce(F.get(words, F.lit(1)), F.lit("of")).alias("w1"),
        F.coalesce(F.get(F.filter(words, lambda w: F.length(w) >= VALUE_CHARS), F.lit(0)), F.lit("required")).alias("w2"),
    )
    base = base.repartition(1).sortWithinPartitions("doc_id")  # max_rows short rows, in one order, so that the forest is the same in every run
    s, w0, w1, w2 = F.col("s"), F.col("w0"), F.col("w1"), F.col("w2")
    b64 = F.regexp_replace(F.base64(F.unhex(s)), "=", "")
    letters, digits = F.regexp_replace(b64, "[^A-Za-z]", ""), F.translate(s, "abcdef", "273941")
    part = lambda n: F.substring(b64, 5 * n + 1, 4)
    long_word = F.regexp_replace(F.concat(w0, F.lit("ing"), w1, F.lit("ation"), F.lit("station")), r"[^A-Za-z]", "a")
    secret = [
        ('token = "', F.substring(s, 1, 40), '"'), ("api_key=", F.substring(b64, 1, 32), ""), ("password: '", F.substring(b64, 3, 16), "'"),
        ("aws_secret_access_key = ", F.substring(b64, 1, 40), ""), ("Authorization: Bearer ", b64, ""), ('secret: "', F.substring(s, 3, 32), '"'),
        ("access-key ", F.concat(F.lit("AK"), F.upper(F.substring(s, 5, 18))), ""), ('"auth_token": "', F.concat(F.lit("sk_"), F.substring(b64, 1, 24)), '",'),
        ('secret = "', F.substring(letters, 1, 16), '"'), ("auth_token: ", F.substring(digits, 1, 14), ""),
        ("password: ", F.concat(part(0), F.lit("!"), part(1), F.lit("$"), part(2)), ""), ("passwd=", F.concat(part(0), F.lit("."), part(1)), ""),
    ]
    other = [
        ("md5 ", F.substring(s, 1, 32), ""), ("commit ", F.substring(s, 1, 40), ""), ("", F.concat(long_word, F.lit("2024")), "@mail.example.com"),
        ("/usr/share/", F.concat(long_word, F.lit("/v2/"), F.substring(s, 1, 6)), ".txt"), ("https://example.com/", F.concat(F.lit("page-"), long_word, F.lit("-7")), ""),
        ("order id ", F.concat(F.lit("ORDER-"), F.conv(F.substring(s, 1, 8), 16, 10)), ""), ("", F.concat(long_word, F.lit("1984")), ","),
        ("version ", F.concat(F.lit("release-2024-"), F.substring(s, 1, 3)), ""),
        ("password: ", w2, ""), ("author: ", F.initcap(w2), ","), ("token = ", F.concat(F.lower(w2), F.lit("_"), F.lower(w1)), ";"),
        ("api_key=", F.concat(F.lit("<your-"), w2, F.lit(">")), ""),
    ]

    def made(options, label):
        pick = lambda part: F.element_at(F.array(*[part(o) for o in options]), F.col("kind") + 1)
        lit = lambda k: lambda o: F.lit(o[k])
        line = F.concat(w0, F.lit(" "), w1, F.lit(" "), pick(lit(0)), pick(lambda o: o[1]), pick(lit(2)), F.lit(" "), w0)
        return base.select(F.struct("doc_id", F.lit(label).alias("label"), pick(lambda o: o[1]).alias("value")).alias("doc_id"), line.alias("text"))

    lines = made(secret, 1.0).unionByName(made(other, 0.0))
    # a secret's line may hold more: "Bearer" is the value of Authorization
    label = F.when(F.contains(F.col("candidate"), F.col("doc_id.value")), F.col("doc_id.label")).otherwise(0.0)
    found = find_candidates(lines)
    return found.filter((F.col("doc_id.label") == 0) | F.contains(F.col("candidate"), F.col("doc_id.value")) | ~F.contains(F.col("doc_id.value"), F.col("candidate"))).select(label.alias("label"), "word_at", "candidate", "word", "before", "before_2", "after")


def train_forest(labelled: DataFrame, trees: int = 20, depth: int = 6, seed: int = 0) -> RandomForestClassificationModel:
    """A forest over FEATURES of labelled findings (features and label)."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=False).fit(rows)


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, word_at, candidate, n_chars, score, is_secret): one row per candidate of every whole text.

    `labelled` holds findings as of `find_candidates` with a label (1 secret, 0 not); by default they
    are derived. Null and empty texts hold no candidate; rows that repeat give repeated findings; a
    null doc_id is an id; without labels of both kinds nothing can be learnt and every candidate
    keeps the score 1. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    dictionary = cut_lineage(corpus_dictionary(rows))
    # written: its words are read for the dictionary's shares and again for the result
    found = with_features(with_dictionary(cut_lineage(find_candidates(rows)), dictionary))
    train = cut_lineage(with_features(with_dictionary(labelled_findings(rows) if labelled is None else labelled, dictionary)))
    out = ["doc_id", F.col("word_at").cast("long").alias("word_at"), "candidate", F.col("n_chars").cast("long").alias("n_chars")]
    if train.select("label").distinct().count() < 2:
        return found.select(*out, F.lit(1.0).alias("score"), F.lit(True).alias("is_secret"))
    model = train_forest(train)
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    score = F.get(vector_to_array("probability"), F.lit(1))
    return scored.select(*out, score.alias("score"), (score >= threshold).alias("is_secret"))
