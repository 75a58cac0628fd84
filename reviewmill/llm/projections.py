"""Near-duplicate vectors by collision counting on one-dimensional projections.

Vectors are projected on many random directions. Two vectors within the threshold lie close on
every direction, so they fall into each other's window on nearly all of them; pairs with enough
such collisions are verified by cosine. The first directions also cut the vectors into cells,
and only neighbouring cells meet, as blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.operators.components import connected_components
from reviewmill.session import cut_lineage

BLOCK_ROWS = 512


@dataclass(frozen=True)
class Windows:
    """The settings that a threshold and a wished recall lead to.

    On a Gaussian direction the difference of two unit vectors at cosine t is normal with
    deviation sqrt(2 - 2t). A window of 2.5 deviations is met with p = 0.988; `need` is the
    largest count that a pair at the threshold reaches with the wished recall. Cells are 4.5
    deviations wide, so a pair in cells that do not touch has a chance under 1e-5 a direction.
    """

    threshold: float = 0.98
    directions: int = 24
    grid: int = 2
    recall: float = 1 - 1e-6
    seed: int = 7

    @property
    def spread(self) -> float:
        return math.sqrt(max(2 - 2 * self.threshold, 1e-12))

    @property
    def window(self) -> float:
        return 2.5 * self.spread

    @property
    def cell(self) -> float:
        return 4.5 * self.spread

    @property
    def need(self) -> int:
        p, m = math.erf(2.5 / math.sqrt(2)), self.directions
        tail, k = 0.0, m
        while k > 0:
            tail += math.comb(m, k) * p**k * (1 - p) ** (m - k)
            if tail >= self.recall:
                return k
            k -= 1
        return 0

    def matrix(self, dims: int) -> np.ndarray:
        return np.random.default_rng([self.seed, dims]).standard_normal((dims, self.directions))


def unit_rows(flat: np.ndarray, dims: int) -> np.ndarray:
    rows = np.asarray(flat, dtype=np.float64).reshape(-1, dims)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def window_collisions(left: np.ndarray, right: np.ndarray, window: float) -> np.ndarray:
    """How many directions put each right vector into the window centred on each left vector."""
    hits = np.zeros((len(left), len(right)), dtype=np.int16)
    for j in range(left.shape[1]):
        order = np.argsort(right[:, j], kind="stable")
        line = right[order, j]
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order))
        low = np.searchsorted(line, left[:, j] - window, "left")
        high = np.searchsorted(line, left[:, j] + window, "right")
        hits += (place >= low[:, None]) & (place < high[:, None])
    return hits


def smallest_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position in the component of each of n positions, under links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def block_links(left: tuple, right: tuple, same: bool, dims: int, windows: Windows) -> pd.DataFrame:
    """(rep, n, root) of the vectors of two blocks that link: copies linked, and a shared smallest id."""
    ids_l, weight_l, flat_l = left
    ids_r, weight_r, flat_r = right
    u, v, directions = unit_rows(flat_l, dims), unit_rows(flat_r, dims), windows.matrix(dims)
    hits = window_collisions(u @ directions, v @ directions, windows.window)
    i, k = np.nonzero(hits >= windows.need)
    if same:
        i, k = i[i < k], k[i < k]
    near = np.einsum("ij,ij->i", u[i], v[k]) >= windows.threshold
    i, k = i[near], k[near]
    ids = ids_l if same else np.concatenate([ids_l, ids_r])
    weights = weight_l if same else np.concatenate([weight_l, weight_r])
    k = k if same else k + len(ids_l)
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    root = ids[order][smallest_roots(len(ids), place[i], place[k])][place]
    n = np.bincount(i, weights[k], len(ids)) + np.bincount(k, weights[i], len(ids))
    linked = n > 0
    return pd.DataFrame({"rep": ids[linked], "n": n[linked].astype("int64"), "root": root[linked]})


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(label, vector, rep, least, weight): comparable vectors, copies merged before they move.

    `rep` names a vector of a label; it is a number of its own, since vec_ids may be null or
    stand for several vectors. `least` is the smallest vec_id of the copies.
    """
    v = F.col("vector")
    top = F.array_max(F.transform(v, F.abs))
    usable = F.col("label").isNotNull() & ~F.exists(v, lambda x: x.isNull()) & (top > 0) & (top < float("inf"))
    merged = vectors.filter(usable).groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    return cut_lineage(merged.withColumn("rep", F.monotonically_increasing_id()))


def cells_of(distinct: DataFrame, windows: Windows) -> DataFrame:
    """`distinct` with dims and its cell on the first directions."""

    @F.pandas_udf("array<long>")
    def cell(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: np.floor(unit_rows(x, len(x))[0] @ windows.matrix(len(x))[:, : windows.grid] / windows.cell).astype("int64"))

    return distinct.select("label", F.size("vector").alias("dims"), "vector", "rep", "weight", cell("vector").alias("cell"))


def vector_links(distinct: DataFrame, windows: Windows) -> DataFrame:
    """(rep, n, root) per vector and pair of blocks; never pairs of vectors."""
    place = ["label", "dims", "cell"]
    celled = cut_lineage(cells_of(distinct, windows))
    counts = cut_lineage(celled.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("parts")))
    item = F.struct("rep", "weight", "vector")
    blocks = cut_lineage(
        celled.join(counts, place)
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
        .repartition(*place, "part")  # else the join's partitioning would leave a whole cell to one task
        .groupBy(*place, "part")
        .agg(F.collect_list(item).alias("rows"))
        .select(
            *place, F.struct(*place, "part").alias("block"), F.transform("rows", lambda r: r.rep).alias("reps"),
            F.transform("rows", lambda r: r.weight).alias("weights"), F.flatten(F.transform("rows", lambda r: r.vector)).alias("flat"),
        )
    )
    names = blocks.select(*place, "block")
    around = names.withColumn("cell", F.explode(neighbours(windows.grid)))
    pairs = around.withColumnRenamed("block", "left").join(names.withColumnRenamed("block", "right"), place).filter("left <= right")
    side = lambda name: blocks.select(F.col("block").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("reps", "weights", "flat")])
    ready = (
        pairs.select("left", "right", "dims")
        .join(side("left"), "left")
        .join(side("right"), "right")
        .select("dims", (F.col("left") == F.col("right")).alias("same"), *[f"{s}_{c}" for s in ("left", "right") for c in ("reps", "weights", "flat")])
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                left, right = (r.left_reps, r.left_weights, r.left_flat), (r.right_reps, r.right_weights, r.right_flat)
                yield block_links(left, right, r.same, r.dims, windows)

    return ready.mapInPandas(solve, "rep long, n long, root long")


def neighbours(grid: int) -> Column:
    """All cells that differ from `cell` by at most one step in each direction."""
    steps = [[]]
    for _ in range(grid):
        steps = [[*done, step] for done in steps for step in (-1, 0, 1)]
    return F.array(*[F.array(*[F.get("cell", F.lit(i)) + step for i, step in enumerate(moves)]) for moves in steps])


def near_vectors(vectors: DataFrame, windows: Windows = Windows()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of `vectors` (vec_id, embedding, label).

    Vectors link when label and number of components agree and their cosine reaches the
    threshold; n_links counts the other rows linked directly, copies included. Vectors or labels
    that are null, and vectors that are empty, zero or hold null or non-finite components link
    with nothing and stay. Rows with a null vec_id take part and have a null component only if
    all of its vec_ids are null; rows that share a vec_id are vectors of their own. Equal
    vectors are compared once. An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("vector"))
    distinct = distinct_vectors(rows)
    links = cut_lineage(vector_links(distinct.select("label", "vector", "rep", "weight"), windows))
    counted = links.groupBy("rep").agg(F.sum("n").alias("n"))
    joined = connected_components(links.filter("rep <> root").select(F.col("rep").alias("src"), F.col("root").alias("dst")).distinct())
    placed = distinct.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = placed.groupBy("root").agg(F.min("least").alias("component"))
    per = (
        placed.join(named, "root")
        .join(counted, "rep", "left")
        .select(
            F.col("label").alias("_label"), F.col("vector").alias("_vector"), "component",
            (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"),
        )
    )
    matched = rows.join(per, (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")), "left")
    component = F.coalesce("component", "vec_id")
    return matched.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
