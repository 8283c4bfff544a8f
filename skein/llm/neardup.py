"""Embedding near-duplicates by collision-counting projections.

Vectors of length 1 are projected on many random directions and laid in order on
each. Two vectors collide on a projection if their values differ by at most a
window's half width, so the window is centred on the query, not on a fixed grid.
For a pair at the threshold the difference is normal with a known spread, so the
number of collisions is binomial; the count a pair must reach is the largest
whose recall at the threshold is still as wanted. Pairs that reach it are
verified in double precision.

Windows on single projections hold a constant share of all pairs: at a cosine of
0.95 each pair of unrelated vectors collides about once for every four collisions
of a near copy, at any width. So who is counted against whom is decided first, by
orders that cut at the middle of one projection after the other: a vector's cell
is the side it has on each of them. The number of cuts follows the number of
vectors, so a cell holds about CELL_ROWS whatever the table; near copies fall
apart now and then, and as many such orders are taken as the wanted recall needs,
measured on pairs planted at the threshold around a bounded sample. Rows are sent
once for each order, and work grows as n times a small power of n.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common, vectors

PROJECTIONS = 24
#: Half width in spreads of a pair at the threshold.
WINDOW = 2.0
#: Vectors of a cell, about.
CELL_ROWS = 2048
#: Vectors that the cuts and the number of orders are fitted on at most, and orders at most.
FIT_ROWS = 20_000
MAX_ORDERS = 400


def threshold_count(m: int, window: float, recall: float) -> int:
    """The largest count that a pair at the threshold reaches with this probability."""
    p = math.erf(window / math.sqrt(2))
    tail, at = 0.0, m
    while at > 0:
        tail += math.comb(m, at) * p**at * (1 - p) ** (m - at)
        if tail >= recall:
            return at
        at -= 1
    return 0


def directions(dim: int, m: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


def _steps(p: np.ndarray, half: float, steps: int = 24) -> np.ndarray:
    """Projections on a ring of 256 steps; `steps` of them make a half width. Two
    values that collide are at most steps + 1 apart; the ring can only add collisions."""
    return np.floor(p * (steps / half)).astype(np.int64).astype(np.uint8)


def _pairs(a: np.ndarray, b: np.ndarray, least: int, steps: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose rows (projections x vectors, in steps) collide at least `least` times."""
    count = np.zeros((a.shape[1], b.shape[1]), np.uint8)
    diff = np.empty_like(count)
    hit = np.empty(count.shape, bool)
    for x, y in zip(a, b):
        np.subtract(x[:, None] + np.uint8(steps + 1), y[None, :], out=diff)
        np.less_equal(diff, 2 * (steps + 1), out=hit)
        np.add(count, hit.view(np.uint8), out=count)
    return np.nonzero(count >= least)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


class Orders:
    """Orders of cuts: a vector's cell in each is the sides it has on the order's projections."""

    def __init__(self, sample: np.ndarray, cuts: int, threshold: float, recall: float, seed: int = 13) -> None:
        """sample: unit vectors. Takes as many orders as find a pair at the threshold with this recall."""
        self.cuts, self.at, self.middle = cuts, np.empty((sample.shape[1], 0)), np.empty(0)
        if not cuts:
            self.n = 1  # one cell, which holds all
            return
        rng = np.random.default_rng(seed)
        side = rng.standard_normal(sample.shape)
        side -= np.einsum("ij,ij->i", side, sample)[:, None] * sample
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
        other = threshold * sample + math.sqrt(max(0.0, 1 - threshold * threshold)) * side
        met, self.n = np.zeros(len(sample), bool), 0
        while met.mean() < recall:
            if self.n == MAX_ORDERS:
                raise ValueError(f"{MAX_ORDERS} orders don't reach a recall of {recall}")
            a = rng.standard_normal((sample.shape[1], cuts))
            p, q = sample @ a, other @ a
            m = np.median(p, axis=0)
            met |= ((p > m) == (q > m)).all(axis=1)
            self.at, self.middle, self.n = np.c_[self.at, a], np.r_[self.middle, m], self.n + 1

    def cells(self, x: np.ndarray) -> np.ndarray:
        """(rows, orders): the cell of each vector."""
        if not self.cuts:
            return np.zeros((len(x), 1), np.int32)
        sides = (x @ self.at > self.middle).reshape(len(x), self.n, self.cuts)
        return (sides @ (1 << np.arange(self.cuts))).astype(np.int32)


def near_duplicates(vecs: DataFrame, threshold: float = 0.95, recall: float = 0.999, id_col: str = "vec_id",
                    vec_col: str = "embedding", cell_rows: int = CELL_ROWS, block_rows: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per id.

    Links are pairs with cosine >= threshold, in double precision, found with the
    given recall at the threshold (more above it). Null, zero and non-finite
    vectors link with nothing; ids that repeat are one vector (the least of
    theirs); null ids are left out; vectors of different lengths never meet; an
    empty table gives an empty result; other columns are not read, whatever their
    names. Equal vectors are one with a number of copies, so copies cost no
    pairs; links of different vectors are counted in blocks, of which a row per
    vector leaves.
    """
    spark = vecs.sparkSession
    common.tune(spark)
    rows = common.materialize(vectors.valid_vectors(vecs, id_col, vec_col).withColumn("h", F.xxhash64("vec")), "vectors")
    classes = rows.groupBy("dim", "h", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    classes = common.materialize(classes, "classes")
    found, used = spark.createDataFrame([], "rep long, n long, root long"), [classes]
    for dim, n in sorted(map(tuple, classes.groupBy("dim").count().collect())):  # the kinds of embedding, not the rows
        part, tables = _links(classes.filter(F.col("dim") == dim), dim, n, threshold, recall, cell_rows, block_rows)
        found, used = found.unionByName(part), used + tables
    found = common.materialize(found, "links")
    comp = common.connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    degree = found.groupBy("rep").agg(F.sum("n").alias("n"))
    each = classes.select("rep", "size", "h", "vec").join(degree, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    each = common.materialize(each.select("rep", "size", "h", "vec", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"),
                                          F.coalesce("component", "rep").alias("component_id")), "classes")
    common.discard(*used, found)
    cols = ["vec_id", "n_links", "component_id"]
    single = each.filter("size = 1").withColumnRenamed("rep", "vec_id").select(cols)
    # both sides are written, so that adaptive execution splits the partition of a vector with many copies
    copies = rows.select("vec_id", "h", "vec").join(each.filter("size > 1").select("h", "vec", *cols[1:]), ["h", "vec"]).select(cols)
    ids = vecs.select(F.col(id_col).cast("long").alias("vec_id")).filter("vec_id is not null").distinct()
    out = ids.join(single.unionByName(copies), "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"),
                      (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"))


def fit_orders(classes: DataFrame, n: int, threshold: float, recall: float, cell_rows: int) -> Orders:
    """Orders for n vectors, fitted on at most FIT_ROWS of them (those with the least hash)."""
    sample = classes.orderBy(F.xxhash64("rep"), "rep").select("vec").limit(FIT_ROWS).toArrow().column(0).combine_chunks()
    cuts = max(0, math.ceil(math.log2(max(1, n / cell_rows))))
    return Orders(vectors.unit(vectors.matrix(sample)), cuts, threshold, recall)


def _links(classes: DataFrame, dim: int, n: int, threshold: float, recall: float, cell_rows: int, block_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rep, n, root) and the tables it reads: for each block of a cell the copies a vector links with and the smallest id that links reach there."""
    spark = classes.sparkSession
    a = directions(dim, PROJECTIONS)
    # nine tenths of the losses are the cells', a tenth the counts'
    half, least = WINDOW * math.sqrt(2 - 2 * threshold), threshold_count(PROJECTIONS, WINDOW, 1 - (1 - recall) / 10)
    shared = spark.sparkContext.broadcast(fit_orders(classes, n, threshold, 1 - (1 - recall) * 0.9, cell_rows))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                cells = shared.value.cells(vectors.unit(vectors.matrix(batch.column(2))))
                ends = np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(cells.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["rep", "size", "vec", "cells"])

    kind = dict(classes.dtypes)["vec"]
    placed = classes.select("rep", "size", "vec").mapInArrow(place, f"rep long, size long, vec {kind}, cells array<int>")
    placed = common.materialize(placed, "cells")
    where = F.posexplode("cells").alias("order", "cell")
    # a cell that is too large is dealt out to parts, each of which meets each other one
    large = placed.select(where).groupBy("order", "cell").agg(F.count("*").alias("c")).filter(F.col("c") > 2 * block_rows)
    large = common.materialize(large.select("order", "cell", F.ceil(F.col("c") / block_rows).cast("int").alias("parts")), "large")
    rows = placed.select("rep", "size", "vec", "cells", where).join(large, ["order", "cell"], "left")
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("order", "cell", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), (F.col("part") > F.col("o")).alias("right"),
                       "rep", "size", "vec", F.slice("cells", F.lit(1), F.col("order")).alias("earlier"))

    def count(key, t):
        import pyarrow as pa

        schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])
        if t.num_rows < 2:
            return schema.empty_table()
        order = np.argsort(t.column("rep").to_numpy())  # the smallest index is the smallest id
        t = t.combine_chunks().take(pa.array(order))
        x, ids, size = vectors.matrix(t.column("vec").combine_chunks()), t.column("rep").to_numpy(), t.column("size").to_numpy()
        earlier = t.column("earlier").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        side = t.column("right").to_numpy()
        q = _steps((vectors.unit(x) @ a).T, half)
        own = key[2].as_py() == key[3].as_py()
        l = np.nonzero(~side)[0]
        r = l if own else np.nonzero(side)[0]
        n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for s in range(0, len(l), 1024):
            for e in range(s if own else 0, len(r), 1024):
                i, j = _pairs(q[:, l[s : s + 1024]], q[:, r[e : e + 1024]], least)
                if own and s == e:
                    i, j = i[i < j], j[i < j]
                links = []
                for c in range(0, len(i), 65536):
                    p, o = l[s + i[c : c + 65536]], r[e + j[c : c + 65536]]
                    ok = vectors.cosine(x[p], x[o]) >= threshold
                    ok[ok] = ~(earlier[p[ok]] == earlier[o[ok]]).any(axis=1)  # an earlier order's cell has counted these
                    links.append((p[ok], o[ok]))
                if sum(len(p) for p, _ in links):
                    p, o = (np.concatenate(v) for v in zip(*links))
                    n += np.bincount(p, weights=size[o], minlength=len(n)).astype(np.int64) + np.bincount(o, weights=size[p], minlength=len(n)).astype(np.int64)
                    root = _roots(len(ids), np.r_[p, np.arange(len(ids))], np.r_[o, root])
        at = np.nonzero(n)[0]
        return pa.Table.from_arrays([pa.array(ids[at]), pa.array(n[at]), pa.array(ids[root[at]])], schema=schema)

    return rows.groupBy("order", "cell", "i", "j").applyInArrow(count, "rep long, n long, root long"), [placed, large]
