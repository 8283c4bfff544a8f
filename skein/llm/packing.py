"""Harmonic packing of token sequences.

Every document is cut into pieces whose lengths are reciprocals of the capacity:
whole bins first, then the longest capacity // k (k up to 32) that still fits,
and a tail shorter than capacity // 32. A piece's length is its class; a bin of a class takes
capacity // length pieces, a fixed number, so a worker can fill its bins by
counting alone and never looks at other classes. What is left in the last,
unfilled bin of each class is less than one bin for each of at most
capacity // 32 + 32 classes, whatever the input; those pieces are packed together
once, longest first.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common

RECIPROCALS = 32

PIECES = "part long, idx long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def piece_lengths(n: int, capacity: int, reciprocals: int = RECIPROCALS) -> list[int]:
    """Lengths that n tokens are cut into, longest first."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    for k in range(2, reciprocals + 1):
        size = capacity // k
        while size and rest >= size:
            out.append(size)
            rest -= size
    return out + [rest] * bool(rest)


_TOKENIZERS: dict[str, object] = {}


def added_tokens(ranks_path: str) -> dict[str, int]:
    """The tokens that the vocabulary's JSON form, beside the ranks, matches in a text before the merges."""
    path = os.path.splitext(ranks_path)[0] + ".json"
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    odd = [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if odd:
        raise ValueError(f"added tokens that take more than their own text: {odd}")
    return {t["content"]: t["id"] for t in added}


def _tokenizer(ranks_path: str, pattern: str):
    """The rank form of the vocabulary with the JSON form's added tokens; both forms give the same ids."""
    import tiktoken

    from skein.llm.bpe import load_ranks

    key = f"{ranks_path}\0{pattern}"
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens=added_tokens(ranks_path))
    return _TOKENIZERS[key]


def cut_documents(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 2048, end_id: int = 1,
                  id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece, numbered in its class within its task (part, idx)."""
    common.tune(docs.sparkSession)
    schema = PIECES + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode = _tokenizer(ranks_path, pattern).encode
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or "", allowed_special="all"), end_id], dtype="<u4")
                at = 0
                for n in piece_lengths(len(ids), capacity):
                    packed = ids[at : at + n].tobytes()
                    k = seen.get(n, 0)
                    seen[n] = k + 1
                    rows.append((part, k, doc, at, n, zlib.crc32(packed), len(ids), *([packed] if with_ids else [])))
                    at += n
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if x == "ids" else pa.int64()) for c, x in zip(cols, names)], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def fill_rest(pieces: list[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for (length, key) pieces: longest first, each into the fullest bin it fits."""
    room: dict[int, list[int]] = {}
    sizes: list[int] = []  # heap of the rooms that have bins
    out, used = [(0, 0)] * len(pieces), 0
    for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], pieces[i][1])):
        n = pieces[i][0]
        fits = [r for r in sizes if r >= n and room.get(r)]
        if fits:
            r = min(fits)
            b = room[r].pop()
        else:
            r, b = capacity, used
            used += 1
        out[i] = b, capacity - r
        left = r - n
        if left:
            room.setdefault(left, []).append(b)
            if left not in sizes:
                heapq.heappush(sizes, left)
        sizes = [x for x in sizes if room.get(x)]
    return out


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 2048, end_id: int = 1,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids), one row per piece.

    Null texts are empty: a document of end_id alone. Repeated rows and null ids
    are documents like others; an empty table gives an empty one; other columns
    are not read. An added token's text in a document is that token, as in the
    vocabulary's JSON form. Sequences hold at most `capacity` tokens and are gapless.

    The pieces are written once to the shared folder; their numbers depend on
    files from then on, not on the order in which tasks happen to run again.
    """
    spark = docs.sparkSession
    pieces = common.materialize(cut_documents(docs, ranks_path, pattern, capacity, end_id, id_col, text_col, with_ids), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # a row for each task and class; the window's rows are as many as tasks
    starts = counts.selectExpr("part", "length", "sum(n) over (partition by length order by part rows between unbounded preceding and current row) - n as before")
    # a row for each class: at most capacity // RECIPROCALS + RECIPROCALS
    totals = sorted(counts.groupBy("length").agg(F.sum("n").alias("n")).collect(), reverse=True)
    base, classes = 0, []
    for length, n in totals:
        per = capacity // length
        classes.append((length, per, base, n // per * per))
        base += n // per
    table = spark.createDataFrame(classes, "length long, per long, base long, filled long")
    numbered = pieces.join(starts, ["part", "length"]).join(F.broadcast(table), "length").withColumn("g", F.col("before") + F.col("idx"))
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    full = numbered.filter("g < filled").select(
        *keep, F.expr("base + g div per").alias("sequence_id"), F.expr("(g % per) * length").alias("offset"))

    # under one bin of each class is left: at most capacity * (capacity // RECIPROCALS + RECIPROCALS) tokens in all
    rest = numbered.filter("g >= filled")
    plan = rest.select("length", "g").collect()
    placed = fill_rest([(r.length, r.g) for r in plan], capacity)
    where = spark.createDataFrame([(r.length, r.g, base + b, o) for r, (b, o) in zip(plan, placed)],
                                  "length long, g long, sequence_id long, offset long")
    last = rest.join(F.broadcast(where), ["length", "g"]).select(*keep, "sequence_id", "offset")
    return full.unionByName(last)
