"""N-gram Jaccard join with adaptive multi-match prefixes.

All documents' shingles are put in one global order, rare ones first. Two sets
that reach the threshold share at least l of the first (n - needed overlap + l)
shingles of each, for any l. A longer prefix costs more postings and demands more
matches, so fewer candidates are verified; each document picks its own l by the
candidate cost estimated from the shingles' corpus counts, and a pair needs the
smaller l of its two. Candidates are verified on the whole sets.

The corpus counts that order the shingles come from a sketch of fixed size over
all documents: any order gives right results, the counts only make it a good one.

Groups of copies. Every posting list first links its members to its smallest
member only, which is linear. Verified links make components, and only lists with
members of several components go on: a pair inside one component would change
nothing. What is left of a large group of near copies consists of documents far
from its pivot. Each is kept as what it lacks of the pivot and what it adds, which
gives the exact overlap of any two; they are compared in blocks, and a block
returns stars, not pairs. Pairs without a common pivot are joined on their prefixes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common
from skein.llm.shingles import shingle_set

#: The sketch: counters in all, and in a row of its table.
SKETCH = 1 << 21
CHUNK = 1 << 14
#: Choices of the number of matches.
MATCHES = (1, 2, 4, 8, 16)
#: Members from which a list gives its documents a pivot.
LONG_LIST = 32
#: Cost of verifying a candidate, in postings, for each shingle of the document.
VERIFY_COST = 0.05


def _needed(n, percent: int):
    """Least overlap of a set of n with any set that reaches the threshold."""
    return -(-percent * n // 100)


def _sketch(docs: DataFrame, size: int) -> np.ndarray:
    """Counts of hashed shingles over all documents; equal sets met in one task count once."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        total, seen = np.zeros(SKETCH, np.uint32), set()
        for batch in batches:
            places, held = [], 0
            for text in batch.column(0):
                s = shingle_set(text.as_py(), size)
                key = len(s), hash(s.tobytes())
                if len(s) and key not in seen:
                    seen.add(key)
                    places.append((s & np.uint64(SKETCH - 1)).astype(np.int64))
                    held += len(s)
                if held >= 4 * SKETCH:
                    total += np.bincount(np.concatenate(places), minlength=SKETCH).astype(np.uint32)
                    places, held = [], 0
            if held:
                total += np.bincount(np.concatenate(places), minlength=SKETCH).astype(np.uint32)
        rows = [(k, zlib.compress(c.tobytes(), 1)) for k, c in enumerate(total.reshape(-1, CHUNK)) if c.any()]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["chunk", "part", "counts"])

    def add(key, t):
        import pyarrow as pa

        total = np.zeros(CHUNK, np.uint64)
        for b in t.column("counts"):
            total += np.frombuffer(zlib.decompress(b.as_py()), np.uint32)
        packed = zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "counts": pa.array([packed], pa.binary())})

    schema = "chunk int, part int, counts binary"
    each = docs.select("text").mapInArrow(count, schema)
    # two levels, so that no group holds a table of every task
    some = each.withColumn("g", F.pmod("part", F.lit(64))).groupBy("chunk", "g").applyInArrow(add, schema)
    out = np.zeros(SKETCH, np.uint32).reshape(-1, CHUNK)
    for r in some.groupBy("chunk").applyInArrow(add, schema).collect():  # SKETCH counters, whatever the input
        out[r.chunk] = np.frombuffer(zlib.decompress(r.counts), np.uint32)
    return out.reshape(-1)


def choose_matches(counts: np.ndarray, n: int, percent: int, noise: float) -> int:
    """The l with the least estimated cost: postings of the prefix, and candidates
    (what its shingles' counts exceed noise by, shared out over l) to verify."""
    base = n - _needed(n, percent)
    extra = np.maximum(0.0, counts[: base + MATCHES[-1]] - 1.0 - noise)
    if not extra.any():
        return 1
    total = np.cumsum(extra)
    best, cost = 1, None
    for l in MATCHES:
        if l > _needed(n, percent):
            break
        sum_ = total[min(base + l, len(total)) - 1]
        c = base + l + sum_ + VERIFY_COST * n * sum_ / l
        if cost is None or c < cost:
            best, cost = l, c
    return best


def _prefixes(docs: DataFrame, sketch: np.ndarray, percent: int, size: int) -> DataFrame:
    """A row per document: set size, the first document of this task with the same set, l and prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    mean = float(sketch.mean())
    noise = mean + 3 * mean**0.5 if mean >= 0.5 else 0.0

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts, seen = shared.value, {}
        for batch in batches:
            n, first, ls, prefixes = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle_set(text.as_py(), size)
                n.append(len(s))
                copy = None
                if len(s) and doc is not None:
                    key = len(s), zlib.crc32(s.tobytes()), hash(s.tobytes())
                    copy = seen.setdefault(key, doc)
                    copy = None if copy == doc else copy
                first.append(copy)
                if not len(s) or doc is None or copy is not None:
                    ls.append(0)
                    prefixes.append([])
                    continue
                c = counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                order = np.lexsort((s, c))
                l = choose_matches(c[order].astype(float), len(s), percent, noise)
                ls.append(l)
                prefixes.append(s[order[: len(s) - _needed(len(s), percent) + l]].view(np.int64))
            flat = np.concatenate([np.asarray(p, np.int64) for p in prefixes]) if prefixes else np.empty(0, np.int64)
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(ls, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "n", "first", "l", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, first long, l int, prefix array<long>")


def _with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(x, y, tx, ty): the pairs with both texts. The last join is on x, and a merge
    join, so that rows of one x stand next to each other and its set is made once."""
    texts = docs.select("doc_id", "text")
    with_y = pairs.select("x", "y").join(texts.select(F.col("doc_id").alias("y"), F.col("text").alias("ty")), "y")
    with_x = with_y.join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("tx")).hint("merge"), "x")
    return with_x.select("x", "y", "tx", "ty")


class _Kept:
    """The shingles of the last left text; rows that repeat an id can have other texts."""

    def __init__(self, size: int) -> None:
        self.size, self.text, self.shingles, self.hash = size, None, None, 0

    def of(self, text: str | None) -> np.ndarray:
        if self.shingles is None or text != self.text:
            self.text, self.shingles = text, shingle_set(text, self.size)
            self.hash = xxhash.xxh3_64_intdigest(self.shingles.tobytes()) >> 1
        return self.shingles


def _verify(pairs: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (x, y) whose whole sets reach the threshold."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        left = _Kept(size)
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3)):
                kept, t = left.of(a.as_py()), shingle_set(b.as_py(), size)
                both = len(np.intersect1d(kept, t, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(kept) + len(t) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    out = common.materialize(_with_texts(pairs, docs).mapInArrow(run, "x long, y long").distinct(), "verified")
    common.release(docs.sparkSession)
    return out


def _attach(pairs: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """For pairs (pivot x, document y) that share half of each set: whether they
    link, a hash of the pivot's set, the sizes, which of its shingles y lacks, and which it adds."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("pivot", pa.int64()), ("set", pa.int64()), ("doc_id", pa.int64()), ("linked", pa.bool_()), ("h", pa.int64()), ("n", pa.int64()),
                            ("lacked", pa.list_(pa.int64())), ("added", pa.list_(pa.int64()))])
        left = _Kept(size)
        for batch in batches:
            rows = []
            for x, y, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                kept, t = left.of(a.as_py()), shingle_set(b.as_py(), size)
                added = np.setdiff1d(t, kept, assume_unique=True)
                both = len(t) - len(added)
                if 2 * both >= max(len(t), len(kept), 1):
                    lacked = np.setdiff1d(kept, t, assume_unique=True).view(np.int64)
                    rows.append({"pivot": x, "set": left.hash, "doc_id": y, "linked": 100 * both >= percent * (len(kept) + len(added)), "h": len(kept), "n": len(t),
                                 "lacked": lacked, "added": added.view(np.int64)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    out = _with_texts(pairs, docs).mapInArrow(run, "pivot long, set long, doc_id long, linked boolean, h long, n long, lacked array<long>, added array<long>")
    # rows that repeat an id can have other texts, on either side
    out = out.withColumn("s", F.xxhash64("lacked", "added")).dropDuplicates(["pivot", "set", "doc_id", "s"]).drop("s")
    out = common.materialize(out, "attached")
    common.release(docs.sparkSession)
    return out


def join(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id; one row per input row.

    Documents link when 100 * intersection >= percent * union of their distinct
    shingles of `size` words; component_id is the smallest doc_id that links
    reach. Texts without words (null, empty, blank) have no shingle and link with
    nothing. Rows that repeat an id are one document for linking (their sets'
    links are joined); a null id gives a row without a component. An empty table
    gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    common.tune(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = common.materialize(_prefixes(docs, _sketch(docs, size), percent, size), "prefixes")

    postings = rows.filter("l > 0").select(F.explode("prefix").alias("token"), "doc_id")
    lists = postings.groupBy("token").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).filter("hub < last")
    posted = common.materialize(postings.join(lists.select("token", "hub"), "token"), "postings")
    common.release(spark)

    # Whichever prefix ends first in the order, what it leaves out lies in its rest, and all else the two
    # share is in both prefixes. So an overlap is at most the matches and the longer rest, and the
    # matches are at most the prefix shingles of either that any other prefix has.
    own = posted.groupBy("doc_id").agg(F.count("*").alias("c"))
    own = rows.filter("l > 0").select("doc_id", "n", "l", F.size("prefix").alias("p")).join(own, "doc_id")
    own = common.materialize(own.selectExpr("doc_id", "n", "l", "c", "n - p as rest"), "bounds")
    both = 100 + percent
    reach = f"{both} * ({{c}} + greatest(a.rest, b.rest)) >= {percent} * (a.n + b.n)"
    fits = f"{reach.format(c='least(a.c, b.c)')} and least(a.c, b.c) >= least(a.l, b.l) and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)"
    enough = f"c >= least(a.l, b.l) and {reach.format(c='c')}"

    # lists' smallest members
    stars = posted.filter("doc_id <> hub").groupBy(F.col("hub").alias("x"), F.col("doc_id").alias("y")).agg(F.count("*").alias("m"))
    stars = stars.join(own.alias("a"), F.col("x") == F.col("a.doc_id")).join(own.alias("b"), F.col("y") == F.col("b.doc_id"))
    stars = stars.filter(F.expr(fits) & F.expr("m >= least(a.l, b.l)")).select("x", "y")
    links = rows.filter("first is not null").select(F.col("first").alias("src"), F.col("doc_id").alias("dst"))
    links = links.unionByName(_verify(stars, docs, percent, size).select(F.col("x").alias("src"), F.col("y").alias("dst")))

    def mixed(posted: DataFrame, comp: DataFrame, name: str) -> DataFrame:
        """The postings of lists with several components."""
        placed = posted.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("k", F.coalesce("component", "doc_id")).drop("component")
        several = placed.groupBy("token").agg(F.min("k").alias("k0"), F.max("k").alias("k1")).filter("k0 < k1").select("token")
        return common.materialize(placed.join(several, "token"), name)

    comp = common.materialize(common.connected_components(links), "components")
    first = placed = mixed(posted.select("token", "doc_id").join(own.select("doc_id"), "doc_id"), comp, "mixed")

    # A pivot for each document in long lists: the smallest member that as many of its lists
    # share as it needs matches, twice over. Documents that share half with their pivot are known
    # by what they lack and add, see _same_pivot. Short lists are cheap pair by pair.
    lows = placed.groupBy("token").agg(F.min("doc_id").alias("low"), F.count("*").alias("c")).filter(F.col("c") >= LONG_LIST).select("token", "low")
    up = placed.join(lows, "token").groupBy("doc_id", "low").agg(F.count("*").alias("c")).join(own.select("doc_id", "l"), "doc_id")
    up = common.materialize(up.filter("c >= l").groupBy("doc_id").agg(F.min("low").alias("up")), "pivots")
    pivots = up.alias("a").join(up.alias("b"), F.expr("a.up = b.doc_id"), "left").select(F.coalesce("b.up", "a.up").alias("x"), F.col("a.doc_id").alias("y")).filter("x <> y")
    attached = _attach(pivots, docs, percent, size)
    links = links.unionByName(attached.filter("linked").select(F.col("pivot").alias("src"), F.col("doc_id").alias("dst")))
    comp = common.materialize(common.connected_components(links), "components")

    second = placed = mixed(placed.select("token", "doc_id"), comp, "mixed")
    common.discard(posted, first, up)
    placed = placed.join(attached.select("doc_id", "pivot").distinct(), "doc_id", "left").withColumn("g", F.coalesce("pivot", "doc_id")).drop("pivot")
    several = placed.groupBy("token").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).filter("g0 < g1").select("token")
    placed = common.materialize(placed.join(several, "token").join(own, "doc_id"), "mixed")
    common.discard(second)
    a, b = placed.alias("a"), placed.alias("b")
    across = a.join(b, F.expr(f"a.token = b.token and a.doc_id < b.doc_id and a.k <> b.k and a.g <> b.g and {fits}"))
    across = across.groupBy(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y")).agg(
        F.count("*").alias("c"), *[F.first(f"{t}.{v}").alias(f"{t}_{v}") for t in "ab" for v in ("n", "l", "rest")])
    across = across.filter(enough.replace("a.", "a_").replace("b.", "b_")).select("x", "y")
    rest = _verify(across, docs, percent, size).select(F.col("x").alias("src"), F.col("y").alias("dst"))
    links = links.unionByName(rest).unionByName(_same_pivot(attached, comp, percent))

    comp = common.connected_components(links)
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of a shares with each set of b."""
    out = np.zeros((len(a), len(b)), np.float32)
    va, vb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(va, vb)
    ia, ib = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    ka, kb = np.searchsorted(both, va), np.searchsorted(both, vb)
    oka, okb = np.isin(va, both), np.isin(vb, both)
    for c in range(0, len(both), 4096):
        m = oka & (ka >= c) & (ka < c + 4096), okb & (kb >= c) & (kb < c + 4096)
        x, y = np.zeros((len(a), min(4096, len(both) - c)), np.float32), np.zeros((len(b), min(4096, len(both) - c)), np.float32)
        x[ia[m[0]], ka[m[0]] - c] = 1
        y[ib[m[1]], kb[m[1]] - c] = 1
        out += x @ y.T
    return out


def _same_pivot(attached: DataFrame, comp: DataFrame, percent: int, block: int = 1024) -> DataFrame:
    """Links (src, dst) between documents of one pivot, at least enough of them to
    join their components.

    With h the pivot's size, two documents share exactly h - |both lack lists joined|
    + |both added lists met| shingles, so their lists decide and no text is read
    again. Documents of the pivot's own component are not compared with each
    other; the others are compared with all of the pivot's in blocks, and a block
    returns a link or none for each document, never its pairs.
    """
    spark = attached.sparkSession
    own = comp.select(F.col("node").alias("pivot"), F.col("component").alias("pk"))
    at = attached.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(own, "pivot", "left")
    k = F.coalesce("component", "doc_id")
    at = at.select("pivot", "set", "doc_id", "h", "n", "lacked", "added", k.alias("k"), (k != F.coalesce("pk", "pivot")).alias("apart"))
    at = common.materialize(at, "group")
    sizes = at.groupBy("pivot", "set").agg(F.count("*").alias("g"), F.count_if("apart").alias("u")).filter("u > 0 and g > 1")
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # small groups share a task's call; large ones are dealt to blocks of their own
    small = F.col("g") <= block // 4
    sizes = sizes.select("pivot", "set", F.when(small, F.pmod(F.xxhash64("pivot"), F.lit(parts))).otherwise(-1).cast("int").alias("call"),
                         F.ceil(F.col("u") / block).cast("int").alias("nu"), F.ceil(F.col("g") / block).cast("int").alias("ng"))
    at = at.join(sizes, ["pivot", "set"])
    mine = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["call", "pivot", "set", "doc_id", "h", "n", "lacked", "added", "k"]
    left = at.filter("apart").select(*cols, mine("nu").alias("bu"), every("ng").alias("bg"), F.lit(0).alias("side"))
    right = at.select(*cols, every("nu").alias("bu"), mine("ng").alias("bg"), F.lit(1).alias("side"))
    both = left.unionByName(right).withColumn("at", F.when(F.col("call") < 0, F.col("pivot")))

    def compare(key, t):
        import pyarrow as pa

        src, dst = [], []
        t = t.combine_chunks()
        pivots, sets, side, ids, k = (t.column(c).to_numpy() for c in ("pivot", "set", "side", "doc_id", "k"))
        h, n = t.column("h").to_numpy(), t.column("n").to_numpy()
        lacked, added = t.column("lacked"), t.column("added")
        order = np.lexsort((sets, pivots))
        p, q = pivots[order], sets[order]
        starts = np.nonzero(np.r_[True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])])[0]
        for s, e in zip(starts, [*starts[1:], len(order)]):
            rows = order[s:e]
            a, b = rows[side[rows] == 0], rows[side[rows] == 1]
            if not len(a) or not len(b):
                continue
            get = lambda c, at: [np.asarray(c[int(i)].values.to_numpy(), np.int64) for i in at]
            la, lb = get(lacked, a), get(lacked, b)
            lack = np.array([len(x) for x in la])[:, None] + np.array([len(x) for x in lb])[None, :] - _overlaps(la, lb)
            inter = h[a][:, None] - lack + _overlaps(get(added, a), get(added, b))
            total = n[a][:, None] + n[b][None, :]
            met = ((100 + percent) * inter >= percent * total) & (k[a][:, None] != k[b][None, :])
            i, j = np.nonzero(met)
            r = _forest(ids[a], ids[b], i, j)
            src.append(r[0])
            dst.append(r[1])
        flat = lambda v: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64())
        return pa.table({"src": flat(src), "dst": flat(dst)})

    return common.materialize(both.groupBy("call", "at", "bu", "bg").applyInArrow(compare, "src long, dst long").distinct(), "verified")


def _forest(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links a[i] - b[j]: every node and its component's least."""
    nodes, at = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
    x, y, root = at[: len(i)], at[len(i) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def keep_one(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """The rows of docs, all columns, without those whose group has a document of
    smaller id; rows with a null id stay."""
    drop = join(docs, percent, size).filter("doc_id <> component_id").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(drop, docs["doc_id"] == F.col("_dropped"), "left_anti")
