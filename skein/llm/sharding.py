"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard levels. At each level every child draws
-ln(u)/weight, u a hash of (child, row key) in (0, 1), and the least draw wins:
the weighted form of highest-random-weight hashing. A child's draws depend on
its own name and weight only, so raising a weight moves rows to that child
alone, and what happens below one child never touches the rows of another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A leaf has a shard; any other node has children. Weight: share of rows among siblings."""

    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int | None = None


def topology(n_shards: int, base: int = 16, racks: int = 2, per_rack: int = 4) -> Node:
    """The tree for shards 0 to n_shards - 1.

    The first `base` shards fill regions of `racks` x `per_rack` equal shards.
    Every later shard joins as a region of its own with one rack, so that adding
    one moves rows into that shard only.
    """
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    groups: list[list[int]] = [list(range(i, min(i + racks * per_rack, base, n_shards))) for i in range(0, min(base, n_shards), racks * per_rack)]
    groups += [[s] for s in range(base, n_shards)]
    regions = []
    for r, shards in enumerate(groups):
        rows = [shards[i : i + per_rack] for i in range(0, len(shards), per_rack)]
        regions.append(Node(f"region{r}", float(len(shards)), tuple(
            Node(f"region{r}/rack{k}", float(len(row)), tuple(Node(f"shard{s}", 1.0, shard=s) for s in row)) for k, row in enumerate(rows))))
    return Node("root", float(n_shards), tuple(regions))


def _draw(node: Node, key: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(node.name), key), 12).cast("double") + 0.5) / float(2**52)
    return -F.log(u) / node.weight


def shard_of(key: Column, tree: Node) -> Column:
    """The shard that `key` (any type; null is a key like others) descends to; one native expression."""
    if not tree.children:
        return F.lit(tree.shard).cast("int")
    if len(tree.children) == 1:
        return shard_of(key, tree.children[0])
    if any(c.weight <= 0 for c in tree.children):
        raise ValueError("weights must be positive")
    least = F.array_min(F.array(*[F.struct(_draw(c, key).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(tree.children)]))["i"]
    if all(not c.children for c in tree.children):
        return F.array(*[F.lit(c.shard).cast("int") for c in tree.children])[least]
    out = None
    for i, c in enumerate(tree.children):
        below = shard_of(key, c)
        out = F.when(least == i, below) if out is None else out.when(least == i, below)
    return out


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                    tree: Node | None = None, grown: Node | None = None, slot_buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per input row.

    The law is `key`: the row's key and the tree decide, nothing else. Null texts
    count as empty (size 1, crc 0); a null key is a key like others; repeated rows
    share a shard and get slots of their own; an empty table gives an empty one.
    Other columns of docs are not read, whatever their names.

    Slots run from 0 in each shard. Rows are numbered within (shard, bucket of a
    content hash) and the bucket's offset is added, so no shard meets in one task.
    """
    tree = tree or topology(n_shards)
    grown = grown or topology(n_shards + 1)
    spark = docs.sparkSession
    buckets = slot_buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col("doc_id")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = rows.select("*", shard_of(key, tree).alias("shard"), shard_of(key, grown).alias("grown_shard"),
                       F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int").alias("_b"))
    counts = rows.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    # one row per shard and bucket: bounded by the two parameters
    offsets = counts.selectExpr("shard", "_b", "coalesce(sum(_n) over (partition by shard order by _b rows between unbounded preceding and 1 preceding), 0) as _o")
    ranked = rows.selectExpr("*", "row_number() over (partition by shard, _b order by doc_id, text_crc32, size) - 1 as _r")
    return ranked.join(F.broadcast(offsets), ["shard", "_b"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_o") + F.col("_r")).cast("long").alias("slot"), "grown_shard")
