"""Line dedup by content-defined line chunks.

A chunk is the fewest lines from a line on, or up to a line, that have min_words
words: its ends follow from its content alone, so a passage is cut alike wherever
it stands and whatever precedes it. Every line of a passage of min_words words or
more lies in a chunk inside the passage: the one that ends at the line if enough
words of the passage precede it, else the one that starts with the passage. So a
line goes exactly if one of its chunks also stands in a document of smaller id,
and any such document will do: each chunk is long enough by itself, the first
holder of its hash stands for all others. Chunks next to each other, aligned with
the same holder, are joined, compared byte by byte with it and removed. The
smallest document that holds a passage keeps it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm import common
from skein.llm.shingles import mix

_M = 0x9E3779B97F4A7C15
_INVERSE = pow(_M, -1, 1 << 64)


def lines_of(text: str | None) -> list[str]:
    """Lines with a word in them; blank lines neither count nor break a passage."""
    return [x for x in text.split("\n") if x.strip()] if text else []


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _cut(lines: list[str], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (int64), first line and number of lines of every chunk, each place once."""
    n = len(lines)
    upto = np.zeros(n + 1, np.int64)  # every line has a word, so this rises
    np.cumsum([len(x.split()) for x in lines], out=upto[1:])
    at = np.arange(n + 1)
    ends = np.searchsorted(upto, upto + max(min_words, 1))
    starts = np.searchsorted(upto, upto - max(min_words, 1), "right") - 1
    ahead, back = ends <= n, starts >= 0
    place = np.unique(np.concatenate([at[ahead] * (n + 1) + ends[ahead], starts[back] * (n + 1) + at[back]]))
    i, j = place // (n + 1), place % (n + 1)
    h = np.fromiter((xxhash.xxh3_64_intdigest(x.encode()) for x in lines), np.uint64, n)
    # a rolling hash: the sum of the lines' hashes times the powers of a factor, shifted to the chunk's start
    roll = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _powers(_M, n), dtype=np.uint64, out=roll[1:])
    return mix((roll[j] - roll[i]) * _powers(_INVERSE, n + 1)[i]).view(np.int64), i, j - i


def line_chunks(lines: list[str], min_words: int = 50) -> list[tuple[int, int, int]]:
    """(hash, first line, lines) of every chunk."""
    return list(zip(*(x.tolist() for x in _cut(lines, min_words))))


def _chunks(docs: DataFrame, min_words: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "key", "hash", "line", "n"]
        for batch in batches:
            parts = [[np.zeros(0, np.int64)] * 5]
            for d, k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                lines = lines_of(text.as_py())
                if d is None or not lines:
                    continue
                h, i, n = _cut(lines, min_words)
                parts.append([np.full(len(h), d, np.int64), np.full(len(h), k, np.int64), h, i, n])
            cols = [np.concatenate(x) for x in zip(*parts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if x < 3 else pa.int32()) for x, c in enumerate(cols)], names=names)

    return docs.mapInArrow(run, "doc_id long, key long, hash long, line int, n int")


def _spans_text(base: DataFrame, wanted: DataFrame, at: int) -> DataFrame:
    """The text of the wanted spans (doc_id, key, line, n), once each.

    base: documents with _ld_doc and _ld_key. All its columns go through the join,
    so that the exchange is the one that dedup_lines joins the cuts to: the texts
    are shuffled once.
    """
    each = wanted.groupBy(F.col("doc_id").alias("_ld_d"), F.col("key").alias("_ld_k")).agg(F.collect_set(F.struct("line", "n")).alias("_ld_spans"))  # at most a document's lines
    n_cols = len(base.columns)
    d, k = base.columns.index("_ld_doc"), base.columns.index("_ld_key")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc, key, text, spans in zip(batch.column(d).to_pylist(), batch.column(k).to_pylist(), batch.column(at), batch.column(n_cols)):
                if not spans.is_valid:
                    continue
                lines = lines_of(text.as_py())
                for s in spans.as_py():
                    found = "\n".join(lines[s["line"] : s["line"] + s["n"]])
                    rows.append((doc, key, s["line"], s["n"], found, len(found.split())))
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64()))], names=["doc_id", "key", "line", "n", "bytes", "words"])

    found = base.join(each.hint("merge"), (F.col("_ld_doc") == F.col("_ld_d")) & (F.col("_ld_key") == F.col("_ld_k")), "left").select(*base.columns, "_ld_spans")
    return found.mapInArrow(run, "doc_id long, key long, line int, n int, bytes string, words long").dropDuplicates(["doc_id", "key", "line", "n"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with its id as a long and a hash of its text, by which rows are found again."""
    return docs.select("*", F.col(id_col).cast("long").alias("_ld_doc"), F.xxhash64(F.col(text_col).cast("string")).alias("_ld_key"))


def repeated_spans(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, line, n, words, kept_in, kept_line: runs of n lines, of min_words
    words at least, that equal the lines from kept_line in the earlier document
    kept_in. key: xxhash64 of the text; lines are counted without blank ones."""
    common.tune(docs.sparkSession)
    base = _keyed(docs, id_col, text_col)
    rows = base.select(F.col("_ld_doc").alias("doc_id"), F.col("_ld_key").alias("key"), F.col(text_col).cast("string").alias("text"))
    chunks = common.materialize(_chunks(rows, min_words), "chunks")
    first = chunks.groupBy("hash").agg(F.min(F.struct("doc_id", "key", "line")).alias("k"), F.max("doc_id").alias("last"))
    first = first.filter("k.doc_id < last").select("hash", F.col("k.doc_id").alias("k_doc"), F.col("k.key").alias("k_key"), F.col("k.line").alias("k_line"))
    # written, so that the join reads two plain exchanges and splits the partition of a hot chunk
    again = chunks.join(common.materialize(first, "repeated").hint("merge"), "hash").filter("doc_id > k_doc")
    again = again.selectExpr("doc_id", "key", "line", "line + n as end", "k_doc", "k_key", "line - k_line as shift")
    # chunks that touch, aligned with the same earlier document, are one run
    by = "partition by doc_id, key, k_doc, k_key, shift order by line, end"
    runs = again.selectExpr("*", f"max(end) over ({by} rows between unbounded preceding and 1 preceding) as before")
    runs = runs.selectExpr("*", f"count_if(before is null or line > before) over ({by} rows unbounded preceding) as run")
    runs = runs.groupBy("doc_id", "key", "k_doc", "k_key", "shift", "run").agg(F.min("line").alias("line"), F.max("end").alias("end"))
    runs = runs.selectExpr("doc_id", "key", "line", "end - line as n", "k_doc", "k_key", "line - shift as k_line")
    runs = common.materialize(runs, "runs")
    common.release(docs.sparkSession)
    own = runs.select("doc_id", "key", "line", "n")
    kept = runs.select(F.col("k_doc").alias("doc_id"), F.col("k_key").alias("key"), F.col("k_line").alias("line"), "n")
    text = _spans_text(base, own.unionByName(kept), docs.columns.index(text_col))
    there = text.select(F.col("doc_id").alias("k_doc"), F.col("key").alias("k_key"), F.col("line").alias("k_line"), "n", F.col("bytes").alias("kept"))
    same = runs.join(text.hint("merge"), ["doc_id", "key", "line", "n"]).join(there.hint("merge"), ["k_doc", "k_key", "k_line", "n"]).filter("bytes = kept")
    return same.select("doc_id", "key", "line", "n", "words", F.col("k_doc").alias("kept_in"), F.col("k_line").alias("kept_line"))


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated passages cut from the text, and removed_lines (long).

    All columns stay; one of the name removed_lines is replaced. A document whose
    lines are all repeated ends with an empty text. Null, empty and blank texts
    are untouched, and so are rows with a null id. Rows that repeat an id count as
    one document: a passage that only they hold stays in all of them. An empty
    table gives an empty one. A row's text is otherwise kept byte for byte.
    """
    common.tune(docs.sparkSession)
    docs = docs.drop("removed_lines")
    spans = repeated_spans(docs, min_words, id_col, text_col)
    cut = spans.groupBy(F.col("doc_id").alias("_ld_d"), F.col("key").alias("_ld_k")).agg(F.collect_set(F.struct("line", "n")).alias("_ld_cut"))
    schema = T.StructType([*docs.schema.fields, T.StructField("removed_lines", T.LongType())])
    at, n_cols = docs.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, removed = [], []
            for text, spans in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                text, spans = text.as_py(), spans.as_py()
                gone: set[int] = set()
                for s in spans or ():
                    gone.update(range(s["line"], s["line"] + s["n"]))
                texts.append(_without(text, gone) if gone else text)
                removed.append(len(gone))
            cols = list(batch.columns[:n_cols])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(removed, pa.int64())], names=[*batch.schema.names[:n_cols], "removed_lines"])

    base = _keyed(docs, id_col, text_col)
    joined = base.join(cut.hint("merge"), (F.col("_ld_doc") == F.col("_ld_d")) & (F.col("_ld_key") == F.col("_ld_k")), "left")
    return joined.select(*base.columns, "_ld_cut").mapInArrow(run, schema)


def _without(text: str, gone: set[int]) -> str:
    """The text without the numbered lines and the blank lines before them."""
    out, i, blanks = [], 0, []
    for x in text.split("\n"):
        if not x.strip():
            blanks.append(x)
            continue
        if i not in gone:
            out += [*blanks, x]
        blanks = []
        i += 1
    return "\n".join([*out, *blanks] if out else [])
