"""Shards of near equal bytes, as leaves of a k-d tree over documents' metadata.

Dimensions are the id, the text's size (logarithm), the source and the language (their crc32). A node that holds several
shards is split along its widest dimension, at the weighted quantile that gives each side the bytes of its shards: the
median, or a third where three shards are split in one and two. Ties along a dimension are ordered by the texts' crc32, then
by the id's.

Equal texts lie in one shard: they form a group, and its documents all take the metadata of the one with the smallest id. Only
a group of more than GROUP of a shard's bytes is split, document by document by their own metadata, for shards of near equal
bytes come first and a group may hold a third of all.

Quantiles are distributed: each pass adds up bytes in at most 8192 bins of each node, what the bin with the quantile really
spans becomes the next pass's range, and passes end when that bin is a small part of a shard or a single key. The driver holds
the tree alone, fewer nodes than twice the shards; every document's shard follows from its keys.

Defined cases: a null text has no bytes and crc32 0; null ids, sources and languages come first along their dimension, and an
absent column is no dimension. A null text equals an empty one. Rows that agree in everything stay together. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.storage import joined, stored

SHARDS, OVERHEAD = 24, 8
SCALE_BITS, TIE_BITS, BIN_BITS = 30, 32, 13
#: A quantile is good enough when its bin holds at most this part of a shard.
PART = 0.0005
#: A group of equal texts stays together up to this part of a shard's bytes.
GROUP = 0.03
SLOT_GROUPS = 256


@dataclass
class Node:
    """A box that holds `shards` shards from `first` on; once split, rows with key <= bound go to `left`."""

    first: int
    shards: int
    key: str = ""
    bound: int = 0
    left: Node | None = None
    right: Node | None = None


def _number(node: Node) -> Column:
    """The number of the leaf (by its first shard) in which a row lies."""
    if node.left is None or node.right is None:
        return F.lit(node.first)
    return F.when(F.col(node.key) <= F.lit(node.bound), _number(node.left)).otherwise(_number(node.right))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.left is None or node.right is None else _leaves(node.left) + _leaves(node.right)


def keyed(docs: DataFrame, id_col: str, text_col: str, more: tuple[str, ...], shards: int) -> tuple[DataFrame, list[str]]:
    """id, size, crc and a key for each dimension: its scaled value, then the tie order, in one long."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = lambda c: F.crc32(F.col(c).cast("string").cast("binary")).cast("double")
    dims = {"d_id": F.col(id_col).cast("double"), "d_size": F.log2(F.octet_length(text) + F.lit(2.0))} | {f"d_{c}": named(c) for c in more if c in docs.columns}
    plain = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("hash"), *(v.alias(k) for k, v in dims.items()))
    plain = stored(plain)
    same = ["crc", "hash", "size"]
    groups = stored(plain.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("id", *dims)).alias("first")))
    sums = groups.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("size")).alias("bytes")).first()
    together = F.col("n") * F.col("size") <= GROUP * (sums["bytes"] or 0) / shards
    plain = joined(plain, groups, same, "n", sums["rows"] or 0)
    plain = stored(plain.select("id", "size", "crc", *(F.when(together, F.col(f"first.{c}")).otherwise(F.col(c)).alias(n) for c, n in [("id", "lead"), *((k, k) for k in dims)])))
    ranges = plain.agg(*(f(k).alias(f"{f.__name__}_{k}") for k in dims for f in (F.min, F.max))).first()
    tie = F.shiftleft(F.shiftright("crc", 16), 16) + F.shiftright(F.crc32(F.coalesce(F.col("lead").cast("string"), F.lit("")).cast("binary")), 16)
    keys = []
    for k in dims:
        low, high = ranges[f"min_{k}"], ranges[f"max_{k}"]
        scaled = F.lit(0) if low is None or high <= low else F.coalesce((F.col(k) - low) / (high - low) * ((1 << SCALE_BITS) - 2) + 1, F.lit(0.0))
        keys.append(F.shiftleft(scaled.cast("long"), TIE_BITS).bitwiseOR(tie).alias(k))
    return stored(plain.select("id", "size", "crc", *keys)), list(dims)


def _widest(rows: DataFrame, root: Node, dims: list[str], nodes: list[Node]) -> dict[int, tuple[str, int, int, int]]:
    """By node: its widest key, the key's range, and the node's bytes."""
    found = rows.withColumn("node", _number(root)).where(F.col("node").isin([n.first for n in nodes])).groupBy("node")
    out = {}
    for r in found.agg(F.sum("size").alias("size"), *(f(k).alias(f"{f.__name__}_{k}") for k in dims for f in (F.min, F.max))).collect():
        key = max(dims, key=lambda k: r[f"max_{k}"] - r[f"min_{k}"])
        out[r["node"]] = (key, r[f"min_{key}"], r[f"max_{key}"], r["size"])
    return out


def grow(rows: DataFrame, dims: list[str], shards: int) -> Node:
    """The tree whose leaves are single shards."""
    root = Node(0, shards)
    while nodes := [n for n in _leaves(root) if n.shards > 1]:
        wide = _widest(rows, root, dims, nodes)
        open_: dict[int, tuple[int, int, float]] = {}
        for n in nodes:
            if n.first in wide:
                n.key, low, high, size = wide[n.first]
                open_[n.first] = (low, high, size * (n.shards // 2) / n.shards)
            else:
                n.key = dims[0]
        by_first = {n.first: n for n in nodes}
        while open_:
            number = _number(root)
            base, shift, key = F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("long")
            for first, (low, high, _) in open_.items():
                is_it = F.col("node") == first
                own = F.col(by_first[first].key)
                inside = is_it & (own >= F.lit(low)) & (own <= F.lit(high))
                key = F.when(inside, own).otherwise(key)
                base, shift = F.when(is_it, F.lit(low)).otherwise(base), F.when(is_it, F.lit(max(0, (high - low).bit_length() - BIN_BITS))).otherwise(shift)
            at = rows.withColumn("node", number).withColumns({"key": key, "base": base, "shift": shift}).where("key is not null")
            bins: dict[int, list[tuple[int, int, int]]] = {}
            summed = at.groupBy("node", F.expr("shiftright(key - base, shift)").alias("bin")).agg(F.min("key").alias("start"), F.max("key").alias("end"), F.sum("size").alias("size")).toArrow()
            for node, *of in zip(*(summed.column(c).to_pylist() for c in ("node", "start", "end", "size")), strict=True):
                bins.setdefault(node, []).append(tuple(of))
            for first, (_, _, goal) in list(open_.items()):
                share = wide[first][3] / by_first[first].shards
                for start, end, size in sorted(bins.get(first, [])):
                    if goal > size:
                        goal -= size
                        by_first[first].bound = end
                        continue
                    if start < end and size > PART * share:
                        open_[first] = (start, end, goal)
                    else:
                        by_first[first].bound = end if 2 * goal >= size else start - 1
                        del open_[first]
                    break
                else:
                    del open_[first]
        for n in nodes:
            n.left, n.right = Node(n.first, n.shards // 2), Node(n.first + n.shards // 2, n.shards - n.shards // 2)
    return root


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ("source", "lang"), shards: int = SHARDS) -> DataFrame:
    """id, size, text_crc32, shard, slot (gapless from 0 in each shard) for each row of docs."""
    rows, dims = keyed(docs, id_col, text_col, more, shards)
    placed = rows.withColumn("shard", _number(grow(rows, dims, shards))).select("id", "size", "crc", "shard")
    placed = stored(placed.withColumn("part", F.pmod(F.xxhash64("id", "crc"), F.lit(SLOT_GROUPS))))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("of_shard"), F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # shards * SLOT_GROUPS rows at most
    slotted = placed.join(F.broadcast(starts), (F.col("shard") == F.col("of_shard")) & (F.col("part") == F.col("of_part")))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "crc", "size")) - 1
    return slotted.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + place).cast("long").alias("slot"))
