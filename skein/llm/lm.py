"""Stupid-backoff scores of documents, computed relationally.

A document's bigrams are scored with the counts of all other documents:
    S(w | v) = c(v w) / c(v) where c(v w) > 0, else 0.4 * c(w) / N,
each count less the document's own occurrences. Words that no other document has
count as seen once. A document's score is the sum of ln S over its words.

Exploded bigrams (document, v, w) are partitioned by the hash of v, so a
partition holds the whole count table of its contexts; joining it with its own
rows needs no further shuffle. What has to back off goes on to the partition of
w's hash, where the unigram table waits. Partitions are as many as the words need.
Contexts with a thousandth of all words, or a tenth of a partition's share, are
spread by the bigram's hash, their counts known to every task: a thousand or ten
for each partition at most. Rows travel as compressed columns of a few thousand
documents; each partition returns a sum per document, and these are summed.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common
from skein.llm.shingles import mix, word_hashes

BACKOFF = 0.4
#: Words of a partition, about: their number follows the input, whatever the session's setting.
PART_WORDS = 2_000_000
#: A word with this share of all words, or a tenth of a partition's, is spread over all partitions; the
#: least share bounds what every task is told of hot words (1 / LEAST_SHARE of them at most).
HOT_SHARE = 0.001
LEAST_SHARE = 2e-6
#: Words that a task holds before it hands on a block.
BLOCK_WORDS = 1_200_000
#: Rows of a partition that are scored at once.
STEP_ROWS = 600_000

_M = np.uint64(0x9E3779B97F4A7C15)


def _small(a: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest unsigned type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _dictionary(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A column by its distinct values: the least, the steps to the next ones byte by
    byte (the high bytes are alike), codes, and a place of each value."""
    values, at, codes = np.unique(v.view(np.uint64), return_index=True, return_inverse=True)
    steps = np.diff(values).view(np.uint8).reshape(-1, 8).T.copy()
    if (codes[1:] >= codes[:-1]).all():  # a sorted column needs its runs' lengths only
        return values[:1], steps, (_small(np.bincount(codes)),), at
    return values[:1], steps, _small(codes), at


def pack(**columns: np.ndarray) -> bytes:
    """Columns as one compressed block of plain arrays; hashes and ids (names in capitals)
    by dictionary, n_doc (which DOC determines) once for each value of DOC."""
    import zstandard

    out, n_doc = {}, columns.pop("n_doc", None)
    for k, v in columns.items():
        if k.isupper():
            out[f"{k}.first"], out[f"{k}.steps"], codes, at = _dictionary(v)
            out[f"{k}.runs" if isinstance(codes, tuple) else f"{k}.codes"] = codes[0] if isinstance(codes, tuple) else codes
            if k == "DOC" and n_doc is not None:
                out["n_doc"] = _small(n_doc[at])
        else:
            out[k] = _small(v) if v.dtype.kind in "ui" else v
    file = io.BytesIO()
    np.savez(file, **out)
    return zstandard.ZstdCompressor(level=3).compress(file.getbuffer())


def unpack(block: bytes) -> dict[str, np.ndarray]:
    import zstandard

    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(block)), allow_pickle=False) as file:
        got = {k: file[k] for k in file.files}
    out = {}
    for k, v in got.items():
        name, _, part = k.partition(".")
        if not part and name != "n_doc":
            out[k] = v
        elif part in ("codes", "runs"):
            codes = np.repeat(np.arange(len(v)), v) if part == "runs" else v
            steps = np.ascontiguousarray(got[f"{name}.steps"].T).view(np.uint64).reshape(-1)
            values = np.cumsum(np.r_[got[f"{name}.first"], steps], dtype=np.uint64)
            out[name] = values[codes].view(np.int64) if name == "DOC" else values[codes]
            if name == "DOC" and "n_doc" in got:
                out["n_doc"] = got["n_doc"][codes]
    return out


def _table(blocks) -> dict[str, np.ndarray]:
    """The rows of several blocks."""
    parts = [unpack(b.as_py()) for b in blocks]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def _split(part: np.ndarray, **columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A block for each partition that has rows."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    starts = np.nonzero(np.r_[True, part[1:] != part[:-1]])[0] if len(part) else []
    for a, b in zip(starts, [*starts[1:], len(part)]):
        yield int(part[a]), pack(**{k: v[order[a:b]] for k, v in columns.items()})


def _batches(batches: Iterator, texts: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, word hashes) of documents, about BLOCK_WORDS words at a time."""
    ids, words, n = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(texts)):
            w = word_hashes(text.as_py())
            ids.append(doc)
            words.append(w)
            n += len(w)
            if n >= BLOCK_WORDS:
                yield ids, words
                ids, words, n = [], [], 0
    if ids:
        yield ids, words


def _counts(docs: DataFrame) -> DataFrame:
    """(w, c, x): occurrences of each word, and those with a word after it."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, words in _batches(batches, 1):
            w, at = np.unique(np.concatenate(words), return_inverse=True)
            c = np.bincount(at, minlength=len(w))
            ends = np.cumsum([len(x) for x in words if len(x)]) - 1
            x = c - np.bincount(at[ends], minlength=len(w)) if len(ends) else c
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.astype("i8")), pa.array(x.astype("i8"))], names=["w", "c", "x"])

    return docs.mapInArrow(run, "w long, c long, x long").groupBy("w").agg(F.sum("c").alias("c"), F.sum("x").alias("x"))


class _Hot:
    """Counts of the hot words, by sorted hash."""

    def __init__(self, rows: list, total: int) -> None:
        rows = sorted((np.uint64(r.w & (1 << 64) - 1), r.c, r.x) for r in rows)
        self.w = np.array([r[0] for r in rows], np.uint64)
        self.c = np.array([r[1] for r in rows], np.int64)
        self.x = np.array([r[2] for r in rows], np.int64)
        self.total = total

    def find(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is hot, place) of each."""
        if not len(self.w):
            return np.zeros(len(w), bool), np.zeros(len(w), np.int64)
        at = np.minimum(np.searchsorted(self.w, w), len(self.w) - 1)
        return self.w[at] == w, at


def _part(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h) % np.uint64(n)).astype(np.int64)


def exploded(ids: list, words: list[np.ndarray], hot: _Hot, parts: int) -> Iterator[tuple[int, bytes]]:
    """Blocks of distinct (document, context, word) with counts; a document's first word has no context."""
    ids, words = zip(*[(i, w) for i, w in zip(ids, words) if i is not None and len(w)] or [((), ())])
    if not ids or isinstance(ids[0], tuple):
        return
    n = np.array([len(w) for w in words])
    vocab, code = np.unique(np.concatenate(words), return_inverse=True)
    code = code.astype(np.int32)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), n)
    first = np.zeros(len(code), bool)
    first[np.cumsum(n) - n] = True
    size = np.int64(len(vocab))
    _, at, per = np.unique(doc * size + code, return_inverse=True, return_counts=True)
    in_doc = per.astype(np.int32)[at]  # the word's occurrences in its document
    del at, per
    before = np.r_[np.int32(0), code[:-1]]
    # the occurrences of a context are the word's, less the one that ends the document
    last = code[np.cumsum(n) - 1]
    as_context = np.r_[np.int32(0), in_doc[:-1]] - (before == last[doc])
    key = (doc * size + before) * size + code
    key[first] = -1 - doc[first]
    _, one, count = np.unique(key, return_index=True, return_counts=True)
    del key
    v, w, d, first = vocab[before[one]], vocab[code[one]], doc[one], first[one]
    spread = first | hot.find(v)[0]
    part = _part(np.where(spread, v * _M + w, v), parts)
    # by context, so that its codes pack to almost nothing
    order = np.argsort(v, kind="stable")
    cols = {"DOC": np.array(ids, np.int64)[d], "V": v, "W": w, "n": count, "first": first.astype(np.uint8), "v_doc": as_context[one] * ~first, "w_doc": in_doc[one], "n_doc": n[d]}
    for k in cols:
        cols[k] = cols[k][order]
    yield from _split(part[order], **cols)


def _sums(doc: np.ndarray, score: np.ndarray, parts: int, kind: int) -> Iterator[tuple[int, int, bytes]]:
    ids, at = np.unique(doc, return_inverse=True)
    total = np.bincount(at, weights=score, minlength=len(ids))
    for p, b in _split(_part(ids.view(np.uint64), parts), DOC=ids, s=total):
        yield kind, p, b


BLOCKS = "kind int, p int, block binary"


def _blocks(rows) -> object:
    import pyarrow as pa

    rows = list(rows)
    return pa.table({"kind": pa.array([r[0] for r in rows], pa.int32()), "p": pa.array([r[1] for r in rows], pa.int32()), "block": pa.array([r[2] for r in rows], pa.binary())})


def _unigram(c: np.ndarray, t: dict, hot: _Hot) -> np.ndarray:
    return t["n"] * (np.log(np.maximum(c - t["w_doc"].astype(np.int64), 1)) - np.log(np.maximum(hot.total - t["n_doc"].astype(np.int64), 1)))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score; one row per id.

    Words are those of shingles.word_hashes. Null, empty and blank texts have no
    word: scores 0 and null. Rows that repeat an id are scored each on its own and
    summed; rows with a null id count in the tables and are not scored. An empty
    table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    common.tune(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    unigrams = common.materialize(_counts(docs), "unigrams")
    common.release(spark)
    total = unigrams.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_WORDS))
    share = min(HOT_SHARE, max(0.1 / parts, LEAST_SHARE))
    hot = _Hot(unigrams.filter(F.col("c") >= max(1, math.ceil(total * share))).collect(), total)  # 1 / share rows at most

    def explode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, words in _batches(batches, 1):
            rows = list(exploded(ids, words, hot, parts))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["p", "block"])

    def bigrams(key, t):
        parts_in = [unpack(b.as_py()) for b in t.column("block")]
        del t
        # some contexts at a time, so that a task's memory stays near that of its rows
        n = max(1, -(-sum(len(p["n"]) for p in parts_in) // STEP_ROWS))
        groups = [(mix(p["V"] ^ _M) % np.uint64(n)).astype(np.uint16) for p in parts_in]
        out, ids, sums = [], [], []
        for k in range(n):
            at = [np.nonzero(x == k)[0] for x in groups]
            doc, score, rest = score_contexts({c: np.concatenate([p[c][i] for p, i in zip(parts_in, at)]) for c in parts_in[0]})
            doc, at = np.unique(doc, return_inverse=True)
            ids.append(doc)
            sums.append(np.bincount(at, weights=score, minlength=len(doc)))
            out += rest
        return _blocks([*out, *_sums(np.concatenate(ids), np.concatenate(sums), parts, 0)])

    def score_contexts(t):
        first = t["first"].astype(bool)
        n = t["n"].astype(np.int64)
        _, at = np.unique(mix(t["V"] * _M + t["W"]), return_inverse=True)
        pair = np.bincount(at, weights=n * ~first)[at].astype(np.int64) - n
        _, at = np.unique(t["V"], return_inverse=True)
        context = np.bincount(at, weights=n * ~first)[at].astype(np.int64)
        if len(hot.w):
            is_hot, place = hot.find(t["V"])
            context = np.where(is_hot, hot.x[place], context)
        context = context - t["v_doc"].astype(np.int64)
        met = ~first & (pair > 0)
        score = np.where(met, n * (np.log(np.maximum(pair, 1)) - np.log(np.maximum(context, 1))), np.where(first, 0.0, n * math.log(BACKOFF)))
        w_hot, place = hot.find(t["W"])
        if len(hot.w):
            score = score + np.where(~met & w_hot, _unigram(hot.c[place], t, hot), 0.0)
        out = []
        rest = ~met & ~w_hot
        if rest.any():
            r = {k: t[k][rest] for k in ("DOC", "W", "n", "w_doc", "n_doc")}
            order = np.argsort(r["W"], kind="stable")
            out += [(1, p, b) for p, b in _split(_part(r["W"][order], parts), **{k: v[order] for k, v in r.items()})]
        return t["DOC"], score, out

    def unigram(key, table, t):
        if not t.num_rows:
            return _blocks([])
        w = table.column("w").to_numpy().view(np.uint64)
        order = np.argsort(w)
        w, c = w[order], table.column("c").to_numpy()[order]
        t = _table(t.column("block"))
        return _blocks(_sums(t["DOC"], _unigram(c[np.searchsorted(w, t["W"])], t, hot), parts, 0))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_part(b.column(0).to_numpy().view(np.uint64), parts).astype("i4")), b.column(0), b.column(1)], names=["p", "w", "c"])

    def add(key, t):
        import pyarrow as pa

        t = _table(t.column("block"))
        ids, at = np.unique(t["DOC"], return_inverse=True)
        return pa.table({"doc_id": pa.array(ids.astype("i8")), "s": pa.array(np.bincount(at, weights=t["s"]))})

    def dealt(df: DataFrame):
        return df.repartition(parts, "p").groupBy("p")  # as many tasks as partitions of words

    blocks = dealt(docs.mapInArrow(explode, "p int, block binary")).applyInArrow(bigrams, BLOCKS)
    blocks = common.materialize(blocks, "bigrams")
    common.release(spark)
    table = unigrams.select("w", "c").mapInArrow(place, "p int, w long, c long")
    rest = dealt(table).cogroup(dealt(blocks.filter("kind = 1").select("p", "block"))).applyInArrow(unigram, BLOCKS)
    sums = dealt(blocks.filter("kind = 0").unionByName(rest)).applyInArrow(add, "doc_id long, s double")

    def lengths(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            n = [len((x.as_py() or "").encode().split()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n"])

    n_words = docs.filter("doc_id is not null").mapInArrow(lengths, "doc_id long, n long").groupBy("doc_id").agg(F.sum("n").alias("n_words"))
    out = n_words.join(sums, "doc_id", "left").select("doc_id", "n_words", F.coalesce("s", F.lit(0.0)).alias("log_score"))
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


#: The same scores in SQL, rounded as the query rounds them.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT doc_id, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM d)),
b AS (SELECT doc_id, v, w, count(*) AS n FROM t WHERE v IS NOT NULL GROUP BY ALL),
bt AS (SELECT v, w, sum(n) AS c FROM b GROUP BY ALL),
vd AS (SELECT doc_id, v, sum(n) AS n FROM b GROUP BY ALL),
vt AS (SELECT v, sum(n) AS c FROM vd GROUP BY ALL),
u AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY ALL),
ut AS (SELECT w, sum(n) AS c FROM u GROUP BY ALL),
nd AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL),
nt AS (SELECT sum(n) AS c FROM nd),
s AS (
  SELECT b.doc_id, b.n * CASE WHEN bt.c - b.n > 0 THEN ln(bt.c - b.n) - ln(vt.c - vd.n)
    ELSE ln(0.4) + ln(greatest(ut.c - u.n, 1)) - ln(greatest(nt.c - nd.n, 1)) END AS s
  FROM b JOIN bt USING (v, w) JOIN vd USING (doc_id, v) JOIN vt USING (v) JOIN u USING (doc_id, w) JOIN ut USING (w) JOIN nd USING (doc_id) CROSS JOIN nt
  UNION ALL
  SELECT t.doc_id, ln(greatest(ut.c - u.n, 1)) - ln(greatest(nt.c - nd.n, 1))
  FROM t JOIN u USING (doc_id, w) JOIN ut USING (w) JOIN nd USING (doc_id) CROSS JOIN nt WHERE t.i = 1)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, round(coalesce(x.s, 0), 6) AS log_score,
  CASE WHEN len(d.ws) > 0 THEN round(coalesce(x.s, 0) / len(d.ws), 6) END AS mean_log_score
FROM d LEFT JOIN (SELECT doc_id, sum(s) AS s FROM s GROUP BY doc_id) x USING (doc_id)
"""
