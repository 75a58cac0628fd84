"""License scans by diagonal voting.

Every 3-word gram of a text is joined by hash with the positions of that gram in the license
templates. A true notice puts many hits on one diagonal (text position less template position);
neighbouring diagonals are merged, since a word added or left out shifts the rest, and a span
counts when enough of its template's words are covered by grams compared as text; a word put in
costs as much as one left out. Where spans of several licenses overlap, the one with most grams
wins, so "gnu lesser general public" is not "gnu general public" with a word too many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewmill.session import cut_lineage

K = 3
NEIGHBOURS = 2
COVERAGE = 0.8

# Fixed values: (label, phrase). Each consecutive occurrence counts.
BASE_PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# (label, notice): found when COVERAGE of the words stand in about this order. Of any length;
# where a notice holds a number, one of the grams with the number must be among them.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "licensed under the mit license"),
    ("mit", "released under the mit license"),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("apache-2", "licensed under the apache 2 0 license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "gnu general public license v3 0"),
    ("gpl-3", "spdx license identifier gpl 3 0"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-2", "gnu general public license v2 0"),
    ("gpl-2", "spdx license identifier gpl 2 0"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("lgpl", "spdx license identifier lgpl"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "bsd 3 clause license"),
    ("bsd", "bsd 2 clause license"),
    ("bsd", "spdx license identifier bsd"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "mozilla public license 2 0"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("mpl-2", "spdx license identifier mpl 2 0"),
    ("cc-by", "creative commons attribution license"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("cc-by", "licensed under cc by"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial"),
    ("cc-by-nc", "licensed under a creative commons attribution non commercial"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike"),
    ("cc-by-sa", "licensed under a creative commons attribution share alike"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def template_grams(spark: SparkSession, base: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """(template, label, base, n_grams, versions, at, gram, h): one row per gram of each template.

    `versions` lists the grams that hold a number: a span must show one of them, since licenses
    of two versions differ in little else.
    """
    rows = []
    for number, (label, text, is_base) in enumerate([(*t, True) for t in base] + [(*t, False) for t in notices]):
        words = text.split()
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {text}")
        grams = [words[at : at + K] for at in range(len(words) - K + 1)]
        versions = [at for at, gram in enumerate(grams) if any(c.isdigit() for w in gram for c in w)]
        rows += [(number, label, is_base, len(grams), versions, at, " ".join(gram)) for at, gram in enumerate(grams)]
    table = spark.createDataFrame(rows, "template int, label string, base boolean, n_grams int, versions array<int>, at int, gram string")
    return table.withColumn("h", F.xxhash64("gram"))


def license_votes(docs: DataFrame, base: list[tuple[str, str]] = BASE_PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """(doc_id, key, template, label, base, n_grams, versions, diagonal, found): the template grams found on a diagonal."""
    words = docs.select("doc_id", F.xxhash64("text").alias("key"), words_of(F.col("text")).alias("words"))
    gram = lambda i: F.concat_ws(" ", *[F.get("words", i + j) for j in range(K)])
    grams = F.transform(F.sequence(F.lit(0), F.size("words") - K), gram)
    rows = words.filter(F.size("words") >= K).select("doc_id", "key", F.posexplode(grams).alias("pos", "found"))
    rows = rows.withColumn("h", F.xxhash64("found"))
    templates = F.broadcast(template_grams(docs.sparkSession, base, notices))  # one row per word of the stated templates
    hits = rows.join(templates, "h").filter(F.col("found") == F.col("gram"))
    by = ["doc_id", "key", "template", "label", "base", "n_grams", "versions", (F.col("pos") - F.col("at")).alias("diagonal")]
    return hits.groupBy(*by).agg(F.collect_set("at").alias("found"))


def license_spans(votes: DataFrame) -> DataFrame:
    """(doc_id, key, label, start, score): spans of merged diagonals that cover enough of their template.

    Of overlapping spans of different labels those with most grams stay, of equally many those that
    cover more of their template. A span stands from its first gram found to its last; the frame of
    the comparison is as wide as the longest template.
    """
    w = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(w) <= NEIGHBOURS
    merged = (
        votes.withColumn("_new", F.when(apart, 0).otherwise(1))
        .withColumn("_span", F.sum("_new").over(w))
        .groupBy("doc_id", "key", "template", "label", "n_grams", "versions", "_span")
        .agg(F.min("diagonal").alias("diagonal"), F.max("diagonal").alias("_last"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    )
    versioned = (F.size("versions") == 0) | F.arrays_overlap("versions", "found")
    covered = F.size(F.array_distinct(F.flatten(F.transform("found", lambda a: F.sequence(a, a + K - 1)))))
    score = covered / (F.col("n_grams") + K - 1 + F.col("_last") - F.col("diagonal"))
    spans = merged.filter(versioned & (score >= COVERAGE)).select(
        "doc_id", "key", "label", score.alias("score"), F.size("found").alias("_n"),
        F.greatest("diagonal", F.lit(0)).cast("long").alias("start"),
        (F.col("_last") + F.array_max("found") + K).cast("long").alias("_end"),
        (F.greatest("diagonal", F.lit(0)) + F.array_min("found")).cast("long").alias("_begin"),
    )
    longest = max(len(text.split()) for _, text in [*BASE_PHRASES, *NOTICES]) + NEIGHBOURS * K
    around = Window.partitionBy("doc_id", "key").orderBy("_begin").rangeBetween(-longest, longest)
    others = F.collect_list(F.struct("label", F.struct("_n", "score").alias("rank"), "_begin", "_end")).over(around)
    beaten = F.exists(
        "_others",
        lambda o: (o["label"] != F.col("label")) & (o["rank"] > F.struct("_n", "score")) & (o["_begin"] < F.col("_end")) & (o["_end"] > F.col("_begin")),
    )
    return spans.withColumn("_others", others).filter(~beaten).select("doc_id", "key", "label", "start", "score")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of `docs`.

    Base phrases count where all their grams lie on one diagonal, that is where their words stand
    consecutively. `labels` adds the notices found; `score` is the largest share of a template
    found, 0 without any. Null and empty texts have no words; rows that repeat an id and text give
    repeated results, an empty table none; a null doc_id is an id. Other columns are ignored.
    """
    votes = cut_lineage(license_votes(docs))  # few rows; two branches read them, and no gram is made twice
    places = votes.filter(F.col("base") & (F.size("found") == F.col("n_grams")))
    nothing = F.lit(None).cast("long")
    found = places.select("doc_id", "key", F.col("diagonal").cast("long").alias("place"), F.col("label").alias("base_label"), "label", F.lit(1.0).alias("score")).unionByName(
        license_spans(votes).select("doc_id", "key", nothing.alias("place"), F.lit(None).cast("string").alias("base_label"), "label", "score")
    )
    per = found.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(
        F.count("place").alias("n_base"),
        F.min("place").alias("first_word"),
        F.max("place").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set("base_label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return rows.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
