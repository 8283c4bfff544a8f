"""Approximate nearest neighbours by balanced posting lists.

A bounded sample is cut by median splits along its main directions until the
cells are small, one for every LIST_ROWS vectors of the table up to what the
sample can tell apart. Rounds of moving each centroid to its cell's mean follow;
a cell that grew is split, one that shrank goes, so the lists stay balanced.
Every vector joins the list of its nearest centroid and, near a boundary, the
lists of other centroids within a distance ratio. Queries search the centroids
by a best-first walk over an in-memory neighbour graph; the walk ends, and lists
are pruned, at a ratio to the distance of the eighth nearest (the nearest alone
says little: it is near by chance), the least ratio that reaches the wanted
recall within the sample (the whole table's neighbours are nearer still). Near lists travel together: a vector or a query goes once to each
group of lists that it needs, and meets there what shares a list with it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common, vectors

#: The index is fitted on at most this many rows, and on fewer where vectors are long. Every row is indexed.
FIT_ROWS = 131_072
FIT_VALUES = 1 << 23
#: Rows of the table for each list, and sample rows that a list needs at least; so there are FIT_ROWS / FIT_LIST lists at most.
LIST_ROWS = 16
FIT_LIST = 8
#: Lists of a group, and queries that a task looks up.
GROUP = 64
QUERIES = 256


class CentroidGraph:
    """Centroids on the unit sphere, each with links to its nearest others."""

    def __init__(self, centroids: np.ndarray, degree: int = 16) -> None:
        self.centroids = centroids
        self.links = []
        for a in range(0, len(centroids), 512):
            near = centroids[a : a + 512] @ centroids.T  # doubles or floats, as the centroids are
            near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
            k = min(degree, len(centroids) - 1)
            self.links.append(np.argpartition(-near, k - 1, axis=1)[:, :k] if k else np.empty((len(near), 0), int))
        self.links = np.concatenate(self.links)
        back: list[set[int]] = [set(map(int, row)) for row in self.links]
        for i, row in enumerate(self.links):
            for j in row:
                back[int(j)].add(i)
        self.links = [np.array(sorted(x), dtype=int) for x in back]
        # entry points spread over the sphere; each part of the graph holds one
        self.entries = self._entries()

    def _entries(self) -> np.ndarray:
        seen, out = set(), []
        for i in range(len(self.centroids)):
            if i not in seen:
                out.append(i)
                todo = [i]
                seen.add(i)
                while todo:
                    for j in self.links[todo.pop()]:
                        if int(j) not in seen:
                            seen.add(int(j))
                            todo.append(int(j))
        n = len(self.centroids)
        return np.unique([*out, *range(0, n, max(1, int(n**0.5)))])

    def search(self, q: np.ndarray, ratio: float, least: int, slack: int = 32) -> list[int]:
        """The `least` nearest lists and those whose centroid is within ratio x the last of these' distance."""
        dist = lambda ids: np.sqrt(np.maximum(0, 2 - 2 * (self.centroids[ids] @ q)))
        heap = [(float(d), int(i)) for d, i in zip(dist(self.entries), self.entries)]
        heapq.heapify(heap)
        known = {i for _, i in heap}
        found: list[tuple[float, int]] = []
        late = 0
        while heap:
            d, i = heapq.heappop(heap)
            found.append((d, i))
            if len(found) < 64 + least:  # the nearest are met early on the walk
                base = sorted(found)[least - 1][0] if len(found) >= least else np.inf
            late = late + 1 if d > ratio * base else 0
            if late > slack:
                break
            new = [int(j) for j in self.links[i] if int(j) not in known]
            if new:
                known.update(new)
                for e, j in zip(dist(np.array(new)), new):
                    heapq.heappush(heap, (float(e), j))
        found.sort()
        base = found[min(least, len(found)) - 1][0]
        return [i for k, (d, i) in enumerate(found) if k < least or d <= ratio * base]


def split_cells(x: np.ndarray, rows: int) -> list[np.ndarray]:
    """Cells of at most `rows` row numbers, by median splits along the direction of largest spread."""
    cells, done = [np.arange(len(x))], []
    rng = np.random.default_rng(7)
    while cells:
        c = cells.pop()
        if len(c) <= rows:
            done.append(c)
            continue
        y = x[c] - x[c].mean(axis=0)
        v = rng.standard_normal(x.shape[1]).astype(x.dtype)
        for _ in range(4):
            v = y.T @ (y @ v)
            v /= max(np.linalg.norm(v), 1e-30)
        order = np.argsort(y @ v, kind="stable")
        cells += [c[order[: len(c) // 2]], c[order[len(c) // 2 :]]]
    return done


def _means(x: np.ndarray, cells: list[np.ndarray]) -> np.ndarray:
    cent = np.array([x[c].mean(axis=0) for c in cells])
    return cent / np.maximum(np.linalg.norm(cent, axis=1, keepdims=True), 1e-30)


def fit_centroids(sample: np.ndarray, n_lists: int, refine: int = 2) -> np.ndarray:
    """About n_lists centroids whose cells hold from a quarter of their share of the sample to twice of it."""
    share = max(1.0, len(sample) / n_lists)
    cells = split_cells(sample, max(1, int(share)))
    for _ in range(refine):
        cent = _means(sample, cells)
        home = np.concatenate([np.argmax(sample[a : a + 2048] @ cent.T, axis=1) for a in range(0, len(sample), 2048)])
        order = np.argsort(home, kind="stable")
        each = np.split(order, np.cumsum(np.bincount(home, minlength=len(cent)))[:-1])
        cells = [c[p] for c in each if len(c) > share / 4 for p in split_cells(sample[c], max(1, int(2 * share)))]
    return _means(sample, cells)


class Index:
    """Centroids with their graph, the group of each list, and the ratio that selects lists."""

    def __init__(self, sample: np.ndarray, n_lists: int, k: int, recall: float, copies: int, closure: float, least: int) -> None:
        self.graph = CentroidGraph(fit_centroids(sample, n_lists))
        self.copies, self.closure, self.least = copies, closure, least
        cent = self.graph.centroids
        self.groups = np.empty(len(cent), np.int32)
        for g, c in enumerate(split_cells(cent, GROUP)):
            self.groups[c] = g
        self.ratio = self._ratio(sample, k, recall)

    def post(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that vectors join."""
        d = x @ self.graph.centroids.T
        m = min(self.copies, d.shape[1])
        near = np.argpartition(-d, m - 1, axis=1)[:, :m]
        dist = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(d, near, axis=1)))
        i, j = np.nonzero(dist <= self.closure * dist.min(axis=1, keepdims=True))
        return i, near[i, j]

    def probe(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that queries search."""
        lists = [self.graph.search(q, self.ratio, self.least) for q in x]
        return np.repeat(np.arange(len(x)), [len(r) for r in lists]), np.concatenate([np.array(r, dtype=np.int64) for r in lists])

    def _ratio(self, sample: np.ndarray, k: int, recall: float, queries: int = 512) -> float:
        """The least ratio at which this share of the sample's own k nearest lie in a selected list."""
        if len(sample) < 2:
            return 1.0
        at = np.arange(0, len(sample), max(1, len(sample) // queries))[:queries]
        near = sample[at] @ sample.T
        near[np.arange(len(at)), at] = -2
        m = min(k, len(sample) - 1)
        best = np.argpartition(-near, m - 1, axis=1)[:, :m]
        del near
        dist = np.sqrt(np.maximum(0, 2 - 2 * (sample[at] @ self.graph.centroids.T)))
        i, lists = self.post(sample[best.reshape(-1)])
        to = np.full(best.size, np.inf)
        np.minimum.at(to, i, dist[i // m, lists])
        base = np.partition(dist, min(self.least, dist.shape[1]) - 1, axis=1)[:, min(self.least, dist.shape[1]) - 1]
        return max(1.0, float(np.quantile(to.reshape(-1, m) / np.maximum(base[:, None], 1e-9), recall))) + 1e-6


def search(vecs: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", query_every: int = 50,
           recall: float = 0.95, fit_rows: int = FIT_ROWS, list_rows: int = LIST_ROWS, closure: float = 1.5, copies: int = 4,
           least: int = 8, block: int = 65_536, query_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: for every id that query_every divides, the k
    nearest others found, by cosine; ties go to the smaller id.

    Fitted on at most fit_rows rows (those with the least hash of the id); every
    row is indexed. Null, zero and non-finite vectors and null ids take no part;
    ids that repeat are one vector, the least of theirs; vectors of different
    lengths only meet their own kind; with fewer than k candidates all found are
    returned; an empty table gives an empty result; other columns are not read,
    whatever their names. Of equal vectors the k + 1 smallest ids alone can be
    among the nearest, so only these are listed, and equal queries are asked once.
    """
    spark = vecs.sparkSession
    common.tune(spark)
    rows = common.materialize(vectors.valid_vectors(vecs, id_col, vec_col).withColumn("h", F.xxhash64("vec")), "vectors")
    # the limit of a row number is applied before the shuffle too, so a vector's copies never meet in one task
    listed = rows.selectExpr("*", "row_number() over (partition by h, vec order by vec_id) as _n").filter(F.col("_n") <= k + 1).drop("_n")
    listed = common.materialize(listed, "listed")
    asked = rows.filter(F.col("vec_id") % query_every == 0)
    first = common.materialize(asked.groupBy("dim", "h", "vec").agg(F.min("vec_id").alias("first")), "queries")
    found, used = spark.createDataFrame([], "first long, vec_id long, score double"), [listed]
    for dim, n in sorted(map(tuple, listed.groupBy("dim").count().collect())):  # the kinds of embedding, not the rows
        same = F.col("dim") == dim
        fit = min(fit_rows, max(1024, FIT_VALUES // max(dim, 1)))
        sample = listed.filter(same).orderBy(F.xxhash64("vec_id"), "vec_id").select("vec").limit(fit).toArrow().column(0).combine_chunks()
        sample = vectors.unit(vectors.matrix(sample)).astype(np.float32)
        lists = max(1, min(-(-n // list_rows), len(sample) // FIT_LIST))
        index = spark.sparkContext.broadcast(Index(sample, lists, k, recall, copies, closure, least))  # at most 4 * FIT_VALUES / FIT_LIST bytes and links
        queries = first.filter(same)
        queries = queries.repartition(max(1, -(-queries.count() // QUERIES)))  # a walk costs far more than its row's bytes tell
        part, tables = _search(listed.filter(same), queries, index, k + 1, block, query_block)
        found, used = found.unionByName(part), used + tables
    # copies of boundary vectors meet a query more than once
    found = common.materialize(found.groupBy("first", "vec_id").agg(F.max("score").alias("score")), "found")
    common.discard(*used)
    top = found.selectExpr("*", "row_number() over (partition by first order by score desc, vec_id) as _n").filter(F.col("_n") <= k + 1).drop("_n")
    mine = asked.select(F.col("vec_id").alias("query_id"), "h", "vec").join(first.select("h", "vec", "first"), ["h", "vec"]).select("query_id", "first")
    out = mine.join(common.materialize(top, "top"), "first").filter("query_id <> vec_id")
    rank = "row_number() over (partition by query_id order by score desc, vec_id)"
    return out.selectExpr("query_id", f"cast({rank} as int) as rank", "vec_id", "score").filter(F.col("rank") <= k)


def _by_group(batch, ids: int, vec: int, row: np.ndarray, lists: np.ndarray, groups: np.ndarray, name: str):
    """A record batch with a row for each row and group: (grp, id, vec, lists)."""
    import pyarrow as pa

    g = groups[lists]
    order = np.lexsort((lists, g, row))
    row, g, lists = row[order], g[order], lists[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (g[1:] != g[:-1])])
    at = pa.array(row[new])
    ends = pa.array(np.r_[new, len(row)].astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(g[new]), batch.column(ids).take(at), batch.column(vec).take(at), pa.ListArray.from_arrays(ends, pa.array(lists.astype(np.int32)))],
                                      names=["grp", name, "vec", "lists"])


def _search(rows: DataFrame, queries: DataFrame, index, k: int, block: int, query_block: int) -> tuple[DataFrame, list[DataFrame]]:
    """(first, vec_id, score) and the tables it reads: for each query of (first, vec) the k best of each group of lists."""

    def post(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                x = vectors.unit(vectors.matrix(batch.column(1))).astype(np.float32)
                yield _by_group(batch, 0, 1, *index.value.post(x), index.value.groups, "vec_id")

    def probe(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                x = vectors.unit(vectors.matrix(batch.column(1))).astype(np.float32)
                yield _by_group(batch, 0, 1, *index.value.probe(x), index.value.groups, "first")

    kind = dict(rows.dtypes)["vec"]
    posted = rows.select("vec_id", "vec").mapInArrow(post, f"grp int, vec_id long, vec {kind}, lists array<int>")
    probes = queries.select("first", "vec").mapInArrow(probe, f"grp int, first long, vec {kind}, lists array<int>")
    posted, probes = common.materialize(posted, "lists"), common.materialize(probes, "probes")
    # groups with many vectors or queries are split, so that no task holds more than a block of each
    parts = lambda df, rows_: df.groupBy("grp").agg(F.ceil(F.count("*") / rows_).cast("int").alias("n"))
    n_vec = parts(posted, block).withColumnRenamed("n", "nv")
    n_query = parts(probes, query_block).withColumnRenamed("n", "nq")
    size = F.broadcast(n_vec.join(n_query, "grp"))  # a row for each group, so at most FIT_ROWS / FIT_LIST rows
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    p = posted.join(size, "grp").withColumn("v", F.pmod(F.xxhash64("vec_id"), "nv").cast("int")).withColumn("q", every("nq"))
    s = probes.join(size, "grp").withColumn("q", F.pmod(F.xxhash64("first"), "nq").cast("int")).withColumn("v", every("nv"))

    def by_list(column) -> dict[int, np.ndarray]:
        """The rows of each list."""
        row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())
        lists = column.flatten().to_numpy()
        order = np.argsort(lists, kind="stable")
        names, at = np.unique(lists[order], return_index=True)
        return dict(zip(names.tolist(), np.split(row[order], at[1:])))

    def score(key, left, right):
        import pyarrow as pa

        schema = pa.schema([("first", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left, right = left.combine_chunks(), right.combine_chunks()
        qx, vx = vectors.matrix(left.column("vec").combine_chunks()), vectors.matrix(right.column("vec").combine_chunks())
        qi, vi = left.column("first").to_numpy(), right.column("vec_id").to_numpy()
        near, at = vectors.unit(qx), vectors.unit(vx)
        theirs, pairs = by_list(right.column("lists").combine_chunks()), [np.empty(0, np.int64)]
        for name, mine in by_list(left.column("lists").combine_chunks()).items():
            b = theirs.get(name)
            if b is None:
                continue
            step = max(1, (1 << 22) // len(b))
            for a in range(0, len(mine), step):
                c = near[mine[a : a + step]] @ at[b].T
                m = min(k, c.shape[1])
                bound = np.partition(c, c.shape[1] - m, axis=1)[:, c.shape[1] - m]
                i, j = np.nonzero(c >= bound[:, None] - 1e-12)
                pairs.append(mine[a + i] * len(vi) + b[j])
        i, j = np.divmod(np.unique(np.concatenate(pairs)), len(vi))
        exact = vectors.cosine(qx[i], vx[j])
        order = np.lexsort((vi[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, np.int64)
        keep = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)])) < k
        return pa.Table.from_arrays([pa.array(qi[i[keep]]), pa.array(vi[j[keep]]), pa.array(exact[keep])], schema=schema)

    found = s.select("grp", "v", "q", "first", "vec", "lists").groupBy("grp", "v", "q").cogroup(
        p.select("grp", "v", "q", "vec_id", "vec", "lists").groupBy("grp", "v", "q")).applyInArrow(score, "first long, vec_id long, score double")
    return found, [posted, probes]
