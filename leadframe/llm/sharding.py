"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws -ln(u)/weight, u a hash of the row's id and the
child's path, and the smallest draw wins, so a child takes its weight's share of the rows. A child's draw changes only with
its own weight: when weights change, rows move only into or out of the subtrees whose weights changed. A shard added later
opens a region of its own, hence it takes rows and no other shard gains any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, stored, with_slots

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def tree_of(shards: int, racks_per_region: int = 2, shards_per_rack: int = 4, base: int = 16) -> Tree:
    """The first `base` shards fill regions rack by rack; each later one is a region of its own."""
    tree: Tree = {}
    for s in range(min(shards, base)):
        rack, region = s // shards_per_rack, s // (shards_per_rack * racks_per_region)
        tree.setdefault(f"g{region}", {}).setdefault(f"r{rack}", {})[s] = 1.0
    for s in range(base, shards):
        tree[f"g+{s}"] = {f"r+{s}": {s: 1.0}}
    return tree


def _pick(key: Column, children: dict[str, float]) -> Column:
    """The winning child's name: of positive weights, the smallest -ln(u)/weight."""
    def draw(name: str, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.ln(u) / F.lit(weight)).alias("d"), F.lit(name).alias("c"))

    draws = [draw(name, w) for name, w in sorted(children.items()) if w > 0]
    return (draws[0] if len(draws) == 1 else F.least(*draws))["c"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard number of each row."""
    weight = lambda x: x if isinstance(x, float) else sum(weight(y) for y in x.values())
    picked = _pick(key, {g: weight(racks) for g, racks in tree.items()})
    by_region = None
    for g, racks in tree.items():
        rack = _pick(key, {f"{g}/{r}": weight(s) for r, s in racks.items()})
        by_rack = None
        for r, shards in racks.items():
            shard = _pick(key, {f"{g}/{r}/{s}": w for s, w in shards.items()})
            value = F.substring_index(shard, "/", -1).cast("int")
            by_rack = (F.when if by_rack is None else by_rack.when)(rack == f"{g}/{r}", value)
        by_region = (F.when if by_region is None else by_region.when)(picked == g, by_rack)
    return by_region


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: id and shard count decide alone, so repeated rows share a shard; a null id counts as the text 'null'.
    size is the text's UTF-8 bytes (null: none) plus 1, text_crc32 the unsigned CRC-32 of those bytes. Slots number a
    shard's rows in hash order, gapless from 0, ties in any order. An empty table gives an empty result.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    data = F.encode("text", "UTF-8")
    rows = documents(docs).select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, tree_of(shards)).alias("shard"),
        shard_of(key, tree_of(shards + 1)).alias("grown_shard"),
    )
    return with_slots(stored(rows, "shards"), ["shard"], ["doc_id", "size", "text_crc32"], "slot")
