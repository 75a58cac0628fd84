"""Toxicity by a chain of linear classifiers.

Categories come in a fixed order. The model of each sees the words of a text and the scores of
all earlier categories; in training those are out-of-fold predictions, so a later model learns
from scores like those it will meet. Training works on a bounded sample of labelled rows, its
folds side by side as Spark tasks; scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import logging
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.llm.bpe import whole_text_batches
from reviewmill.operators.ranking import seeded_sample
from reviewmill.session import cut_lineage

log = logging.getLogger(__name__)

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
KNOWN_WORDS = 200_000
NOTHING = 1.1  # a cut-off above all scores


@dataclass(frozen=True)
class Training:
    """`max_rows` bounds the labelled sample, `features` the inputs chosen for each category.

    A feature is chosen only if its likelihood ratio (in nats) is at least `least_gain`. A fit
    ends when no weight moves by `tolerance` any more, or after `steps`. The cut-off has the best
    F0.5 out of fold among those with at least `precision`, and with `recall` where it can be had.
    """

    max_rows: int = 20_000
    features: int = 400
    least_docs: int = 3
    least_gain: float = 8.0
    folds: int = 3
    penalty: float = 0.1
    steps: int = 1_000
    tolerance: float = 1e-4
    recall: float = 0.85
    precision: float = 0.9
    seed: int = 0


@dataclass
class ToxicityChain:
    """Weights of the chain: per category one number per feature, per earlier category, and a bias."""

    categories: list[str]
    features: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float = 0.5

    @property
    def index(self) -> dict[int, int]:
        return {int(h): i for i, h in enumerate(self.features)}


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings, which carry a stem through its endings."""
    keys = [f"w:{word}"] + [f"p:{word[:n]}" for n in PREFIXES if len(word) > n]
    return [xxhash.xxh32_intdigest(k) for k in keys]


def text_features(text: str | None) -> dict[int, int]:
    """How often each feature stands in a whole text."""
    counts: dict[int, int] = {}
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for h in word_features(word):
            counts[h] = counts.get(h, 0) + n
    return counts


def strength(n: np.ndarray) -> np.ndarray:
    """What a feature's count puts into the models: 1 for once, 2 for three times, 3 for seven."""
    return np.log2(1 + np.asarray(n, dtype=float))


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def chain_input(score: np.ndarray) -> np.ndarray:
    """An earlier category's score as the later models see it."""
    return np.log(np.clip(score, 1e-4, 1 - 1e-4) / (1 - np.clip(score, 1e-4, 1 - 1e-4))) / 4


@dataclass
class Inputs:
    """Rows of a design: sparse values (row, col, value) under `width` columns, and dense ones."""

    n: int
    width: int
    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    dense: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, cols: np.ndarray, values: np.ndarray, width: int, dense: np.ndarray) -> Inputs:
        """`sizes` tells how many of the columns and values belong to each row."""
        return cls(len(sizes), width, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), cols, values, dense)

    def margin(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[: self.width][self.col] * self.value, self.n) + self.dense @ w[self.width : -1] + w[-1]

    def back(self, error: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.col, error[self.row] * self.value, self.width), self.dense.T @ error, [error.sum()]])

    def curvature(self, used: np.ndarray) -> np.ndarray:
        """For each weight an upper bound of the loss's curvature along it over the rows used, with all others moving."""
        reach = (np.bincount(self.row, self.value, self.n) + np.abs(self.dense).sum(1) + 1) * used
        return np.concatenate([np.bincount(self.col, self.value * reach[self.row], self.width), np.abs(self.dense).T @ reach, [reach.sum()]]) / 4


def fit_linear(x: Inputs, y: np.ndarray, plan: Training, used: np.ndarray | None = None) -> np.ndarray:
    """Penalised logistic weights by accelerated gradient steps: sparse part, dense part, bias.

    Only rows `used` count. The momentum starts anew whenever it leads uphill.
    """
    used = np.ones(x.n) if used is None else used.astype(float)
    rate = 1 / (x.curvature(used) + plan.penalty)
    w = momentum = np.zeros(x.width + x.dense.shape[1] + 1)
    since = 0
    for _ in range(plan.steps):
        slope = x.back((logistic(x.margin(momentum)) - y) * used)
        slope[:-1] += plan.penalty * momentum[:-1]
        new = momentum - rate * slope
        since = 0 if slope @ (new - w) > 0 else since + 1
        momentum, w = new + since / (since + 3) * (new - w), new
        if np.abs(rate * slope).max() < plan.tolerance:
            break
    return w


def best_threshold(score: np.ndarray, y: np.ndarray, recall: float, precision: float) -> float:
    """The score from which calling a row toxic gives the best F0.5, midway to the next lower score.

    F0.5 counts precision double, for clean documents should stay. Only cut-offs of at least
    `precision` count, and among them those that find a share of `recall` where there are any;
    without any cut-off nothing is to be rejected.
    """
    order = np.argsort(-score, kind="stable")
    hits, called = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    f = 1.25 * hits / (called + 0.25 * y.sum())
    last = np.r_[score[order][1:] < score[order][:-1], True]
    sure = last & (hits >= precision * called)
    if not sure.any():
        log.warning("no cut-off tells toxic from clean labelled rows well enough: the chain rejects nothing")
        return NOTHING
    found = sure & (hits >= recall * y.sum())
    at = int(np.argmax(np.where(found if found.any() else sure, f, -1)))
    low = score[order][at + 1] if at + 1 < len(y) else 0.0
    return float((score[order][at] + low) / 2)


def labelled_sample(docs: DataFrame, labels: DataFrame, plan: Training) -> DataFrame:
    """(doc_id, text, lang, toxic) of at most `max_rows` labelled documents, the same ones in every run.

    Ids are drawn first and broadcast (max_rows of them). A doc_id that repeats counts once, with
    the one of its texts whose hash is smallest, cut down inside the map tasks.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    ids = cut_lineage(seeded_sample(known, ["doc_id"], plan.max_rows, plan.seed).withColumnRenamed("doc_id", "_id"))
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    one = rows.groupBy("doc_id", "toxic").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("_one"))
    return one.select("doc_id", "_one.text", "_one.lang", "toxic")


def chosen_features(rows: DataFrame, categories: list[str], plan: Training) -> np.ndarray:
    """The features that tell a category's rows best from the rest, by likelihood ratio, for each."""
    of = lambda c: F.array_contains("positive", c)
    counts = cut_lineage(
        rows.select(F.explode("features").alias("h"), *[of(c).alias(f"_{i}") for i, c in enumerate(categories)])
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"_{i}")).alias(f"_{i}") for i in range(len(categories))])
        .filter(F.col("n") >= plan.least_docs)
    )
    total = rows.agg(F.count(F.lit(1)), *[F.count_if(of(c)) for c in categories]).first()
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    chosen: set[int] = set()
    for i in range(len(categories)):
        if not 0 < total[i + 1] < total[0]:
            continue
        share = total[i + 1] / total[0]
        inside, n = F.col(f"_{i}"), F.col("n")
        gain = part(inside, n * share) + part(n - inside, n * (1 - share))
        chosen |= {r.h for r in counts.filter(gain >= plan.least_gain).orderBy(gain.desc(), "h").limit(plan.features).select("h").collect()}  # bounded
    return np.array(sorted(chosen), dtype=np.int64)


def chain_categories(sample: DataFrame, most: int = 8, least: int = 5) -> list[tuple[str, str | None]]:
    """(category, language): abuse in each language with enough toxic rows, then toxic overall."""
    langs = (
        sample.filter("toxic AND lang IS NOT NULL").groupBy("lang").count().filter(F.col("count") >= least)
        .orderBy(F.desc("count"), "lang").limit(most).collect()
    )
    return [(f"toxic_{r.lang}", r.lang) for r in langs] + [("toxic", None)]


def train_chain(docs: DataFrame, labels: DataFrame, plan: Training = Training()) -> ToxicityChain:
    """A chain fitted on labelled documents: docs (doc_id, text, lang), labels (doc_id, toxic).

    Rows whose label or id is null are left out, repeated labels count once as toxic if one of
    them is, repeated documents once. Without toxic or without clean rows nothing can be learnt: the chain then has no
    features and rejects nothing.
    """
    whole_text_batches(docs)
    sample = labelled_sample(docs, labels, plan)

    @F.pandas_udf("features array<long>, counts array<int>")
    def features(texts: pd.Series) -> pd.DataFrame:
        found = [text_features(t) for t in texts]
        return pd.DataFrame({"features": [list(f) for f in found], "counts": [list(f.values()) for f in found]})

    rows = cut_lineage(sample.select("doc_id", "lang", "toxic", features("text").alias("_f")).select("doc_id", "lang", "toxic", "_f.*"))
    pairs = chain_categories(rows)
    names = [name for name, _ in pairs]
    positive = F.array_compact(
        F.array(*[F.when(F.col("toxic") & (F.lit(True) if lang is None else F.col("lang") == lang), F.lit(name)) for name, lang in pairs])
    )
    rows = rows.select("doc_id", "features", "counts", positive.alias("positive"))
    vocabulary = chosen_features(rows, names, plan)
    chain = ToxicityChain(names, vocabulary, threshold=NOTHING)
    if not len(vocabulary):
        log.warning("no word tells toxic from clean labelled rows: the chain rejects nothing")
        return chain
    index = rows.sparkSession.sparkContext.broadcast(chain.index)  # at most features x categories

    @F.pandas_udf("cols binary, n binary")
    def columns(features: pd.Series, counts: pd.Series) -> pd.DataFrame:
        known = index.value
        kept = [[(known[h], n) for h, n in zip(hs, ns) if h in known] for hs, ns in zip(features, counts)]
        packed = lambda at: [np.array([k[at] for k in row], dtype=np.int32).tobytes() for row in kept]
        return pd.DataFrame({"cols": packed(0), "n": packed(1)})

    # the bounded sample, packed; every model's task reads all of it
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(plan.folds)).alias("fold")
    small = cut_lineage(rows.select("doc_id", columns("features", "counts").alias("_c"), "positive", fold).select("doc_id", "_c.*", "positive", "fold"))
    frame = small
    for i, name in enumerate(names):
        last = i + 1 == len(names)
        own = F.array_contains("positive", name).alias("y")
        models = frame.select("doc_id", "cols", "n", own, "fold", *names[:i], F.explode(F.sequence(F.lit(0), F.lit(plan.folds))).alias("model"))
        fit = fit_task(names[:i], len(vocabulary), plan)
        fitted = cut_lineage(models.groupBy("model").applyInPandas(fit, "doc_id long, score double, y boolean, w array<double>"))
        chain.weights.append(np.array(fitted.filter("w IS NOT NULL").first().w))
        scored = fitted.filter("w IS NULL").select("doc_id", "y", F.col("score").alias(name))
        if not last:
            frame = cut_lineage(frame.join(scored.drop("y"), "doc_id"))
    final = scored.select(names[-1], "y").toPandas()  # two numbers for each of max_rows at most
    if final["y"].any():
        chain.threshold = best_threshold(final[names[-1]].to_numpy(), final["y"].to_numpy().astype(float), plan.recall, plan.precision)
    return chain


def fit_task(earlier: list[str], width: int, plan: Training):
    """Fit one category on all rows but one fold and predict that fold; the last model uses all rows.

    The folds share one design: rows held out have no weight in the fit.
    """

    def fit(data: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values("doc_id")
        sizes = (data["cols"].map(len) // 4).to_numpy()
        unpacked = lambda c: np.frombuffer(b"".join(data[c]), dtype=np.int32)
        dense = np.column_stack([chain_input(data[e].to_numpy()) for e in earlier]) if earlier else np.zeros((len(data), 0))
        x = Inputs.of(sizes, unpacked("cols"), strength(unpacked("n")).astype(np.float32), width, dense)
        data = data[["doc_id", "y", "fold", "model"]]
        held, y = (data["fold"] == data["model"]).to_numpy(), data["y"].to_numpy().astype(float)
        w = fit_linear(x, y, plan, ~held)
        if not (data["model"] < plan.folds).all():
            return pd.DataFrame({"doc_id": [None], "score": [0.0], "y": [None], "w": [w]})
        return pd.DataFrame({"doc_id": data["doc_id"].to_numpy()[held], "score": logistic(x.margin(w))[held], "y": y[held] > 0, "w": None})

    return fit


def category_scores(text: Column, chain: ToxicityChain) -> Column:
    """array<double>: a score for each category, in the chain's order."""
    index, weights = chain.index, chain.weights

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[int]] = {}

        def columns(text: str | None) -> tuple[list[int], np.ndarray]:
            counts: dict[int, int] = {}
            for w, n in Counter(WORD.findall((text or "").lower())).items():
                cols = known.get(w)
                if cols is None:
                    cols = known[w] = [index[h] for h in word_features(w) if h in index]
                for c in cols:
                    counts[c] = counts.get(c, 0) + n
            if len(known) > KNOWN_WORDS:
                known.clear()
            return list(counts), strength(list(counts.values()))

        for texts in batches:
            rows = [columns(t) for t in texts]
            sizes = np.array([len(c) for c, _ in rows], dtype=int)
            cols = np.concatenate([np.zeros(0, dtype=np.int32), *[np.array(c, dtype=np.int32) for c, _ in rows]])
            values = np.concatenate([np.zeros(0), *[v for _, v in rows]])
            out = np.zeros((len(rows), len(chain.categories)))
            for i, w in enumerate(weights):
                x = Inputs.of(sizes, cols, values, len(index), chain_input(out[:, :i]))
                out[:, i] = logistic(x.margin(w))
            yield pd.Series(list(out), dtype=object)

    return run(text)


def score_toxicity(docs: DataFrame, chain: ToxicityChain) -> DataFrame:
    """(doc_id, toxicity, worst_category, toxic) per row of `docs`.

    toxicity is the last category's score; worst_category the earlier one with the highest score.
    Null and empty texts have no words and are never toxic; repeated rows give repeated results,
    an empty table none; other columns are ignored.
    """
    whole_text_batches(docs)
    rows = docs.select("doc_id", F.col("text"), category_scores(F.col("text"), chain).alias("_scores"))
    toxicity = F.element_at("_scores", -1)
    named = F.array(*[F.lit(c) for c in chain.categories])
    parts = F.slice("_scores", 1, max(len(chain.categories) - 1, 1))
    worst = F.element_at(named, F.array_position(parts, F.array_max(parts)).cast("int"))
    seen = F.coalesce(F.col("text"), F.lit("")) != ""
    return rows.select("doc_id", toxicity.alias("toxicity"), worst.alias("worst_category"), (seen & (toxicity >= chain.threshold)).alias("toxic"))


def drop_toxic(docs: DataFrame, chain: ToxicityChain) -> DataFrame:
    """The rows of `docs`, with all their columns, that the chain does not call toxic."""
    whole_text_batches(docs)
    toxicity = F.element_at(category_scores(docs["text"], chain), -1)
    return docs.filter((F.coalesce(docs["text"], F.lit("")) == "") | (toxicity < chain.threshold))
