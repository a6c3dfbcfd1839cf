"""Exact n-gram Jaccard join by prefix trees.

1. Every document's set of k-word shingles becomes 58-bit hashes. Hashes travel packed, a block for each chunk of documents
   and hash range, each hash once for a chunk; the range's task counts how many documents have each hash and answers with
   those that two or more have. So a shingle of very many documents makes one entry for each chunk of up to 1000 of them.
2. A set in the global order (rarest first, then by hash) that reaches similarity t with any other must share one of its
   first n - ceil(t n) + 1 shingles. Where the shingles that no other document has fill this prefix, the document has no
   partner. The rest are linked, loosely, to the smallest document of each prefix shingle; any true link lies within a
   component of this loose graph.
3. Within a component the ordered sets form a prefix tree. A probe walks it once, shares the overlap of common beginnings,
   and leaves a subtree when what remains of either set cannot reach the overlap needed.
Components too large for a task are first compared with a few pivots; members outside the largest cluster found are then
compared with all documents that share a prefix shingle with them, in blocks of bounded size. No cap drops a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, HashCache, documents, joined, mix64, small_parts, stored, swept, tidied, trim, with_rows, without_rows
from .graph import components

BITS = 58
#: Text bytes whose shingle hashes one counting task holds.
RANGE_BYTES = 12_000_000
#: A block of the join holds so many shingles and documents at most; larger loose components are split.
BLOCK_ITEMS, BLOCK_DOCS = 2_000_000, 1500
PIVOTS = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> list[int]:
    return [xxhash.xxh64_intdigest(w) for w in words]


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of a text with word hashes h, ascending; fewer words than `size` make one, none makes none."""
    n = len(h)
    if not n:
        return h
    width = min(n, size)
    acc = mix64(h[: n - width + 1] + np.uint64(width))
    for j in range(1, width):
        acc = mix64(acc * _ODD + h[j : n - width + 1 + j])
    return np.unique(acc >> np.uint64(64 - BITS))


def _packed(low: np.ndarray, width: int) -> bytes:
    return low.astype("<u8").view("u1").reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(data) // width, 8), "u1")
    wide[:, :width] = np.frombuffer(data, "u1").reshape(-1, width)
    return wide.view("<u8").ravel()


def _owners(doc: np.ndarray, docs: int) -> bytes:
    """Ascending document numbers of a chunk: one by one, or as counts of each document, whichever is shorter."""
    if 2 * len(doc) < 4 * docs:
        return b"e" + doc.astype("<u2").tobytes()
    return b"c" + np.bincount(doc, minlength=docs).astype("<u4").tobytes()


def _owned(data: bytes) -> np.ndarray:
    if data[:1] == b"e":
        return np.frombuffer(data, "<u2", offset=1).astype("i8")
    counts = np.frombuffer(data, "<u4", offset=1)
    return np.repeat(np.arange(len(counts)), counts)


def shingler(size: int) -> Callable[[], Callable[[list[str]], list[np.ndarray]]]:
    """Makes, in a worker, what turns texts into their sets of shingles."""
    def make() -> Callable[[list[str]], list[np.ndarray]]:
        cache = HashCache(word_hashes)
        return lambda texts: [shingles(v, size) for v in cache.values([t.encode().lower().split() for t in texts])]

    return make


def shared_items(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[np.ndarray]]], num: int, den: int) -> DataFrame:
    """doc_id, n_shingles (the set's size), items, same_a, same_b. items: those that other documents have too, in the global order; null where no other document can be similar.

    make gives what turns texts into sets of BITS-bit hashes, ascending. An item's upper bits hold the binary logarithm of its document count, the lower ones its hash. same_a and same_b, a digest of the
    items, are null where a document has a shingle of its own and so no equal.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    range_bits = max(0, int(np.ceil(np.log2(max(1, total / RANGE_BYTES)))))
    low_bits = BITS - range_bits  # a block's hashes agree in the other bits
    width = -(-low_bits // 8)
    low_mask, to_range = np.uint64((1 << low_bits) - 1), np.uint64(low_bits)
    ranges = 1 << range_bits

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sets_of, part = make(), TaskContext.get().partitionId()
        for at, batch in enumerate(small_parts(batches)):
            sets = sets_of(batch.column("text").to_pylist())
            sizes = np.array([len(s) for s in sets], "i4")
            flat = np.concatenate(sets) if sets else np.zeros(0, "u8")
            doc = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(flat, kind="stable")
            ends = np.flatnonzero(np.append(flat[order][1:] != flat[order][:-1], True)) if len(flat) else np.zeros(0, "i8")
            runs = np.diff(np.append(-1, ends))
            once = np.zeros(len(flat), bool)
            once[order[ends[runs == 1]]] = True
            many, times = flat[order[ends[runs > 1]]], runs[runs > 1]
            many_docs = doc[order[np.repeat(runs > 1, runs)]]
            flat, doc = flat[once], doc[once]
            where = (flat >> to_range).astype("i8") if range_bits else np.zeros(len(flat), "i8")
            order = np.argsort(where, kind="stable")
            flat, doc = flat[order] & low_mask, doc[order]
            bounds = np.searchsorted(where[order], np.arange(ranges + 1))
            starts = np.searchsorted(many, np.arange(ranges + 1, dtype="u8") << to_range) if range_bits else np.array([0, len(many)])
            chunk = (part << 32) + at
            rows = []
            for b in range(ranges):
                own, shared = slice(bounds[b], bounds[b + 1]), slice(starts[b], starts[b + 1])
                if bounds[b] < bounds[b + 1] or starts[b] < starts[b + 1]:
                    rows.append((b, _owners(doc[own], len(sets)), _packed(flat[own], width), _packed(many[shared] & low_mask, width), times[shared].astype("<u4").tobytes()))
            n = len(rows)
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([chunk % ranges] + [r[0] for r in rows], pa.int32()), "chunk": pa.array([chunk] * (n + 1), pa.int64()), "blocks": pa.array([n] * (n + 1), pa.int32()),
                "owners": pa.array([many_docs.astype("<u2").tobytes()] + [r[1] for r in rows], pa.binary()), "data": pa.array([None] + [r[2] for r in rows], pa.binary()),
                "many": pa.array([None] + [r[3] for r in rows], pa.binary()), "times": pa.array([times.astype("<u4").tobytes()] + [r[4] for r in rows], pa.binary()),
                "ids": pa.array([batch.column("doc_id").to_pylist()] + [None] * n, pa.list_(pa.int64())), "sizes": pa.array([sizes.tolist()] + [None] * n, pa.list_(pa.int32())),
            })

    def answer(table: pa.Table) -> pa.Table:
        trim()
        own = {c: table.column(c) for c in table.column_names}
        owners, times, many, data = (own[c].to_pylist() for c in ("owners", "times", "many", "data"))
        at = [i for i, x in enumerate(data) if x is not None]
        if at:
            bucket = np.uint64(own["bucket"][at[0]].as_py()) << np.uint64(low_bits)
            sizes = [len(data[i]) // width for i in at]
            flat, stop = np.empty(sum(sizes), "u8"), 0
            for i, n in zip(at, sizes, strict=True):  # unpacked once, in one array
                flat[stop : stop + n] = _unpacked(data[i], width)
                data[i], stop = None, stop + n
            order = np.argsort(flat)
            ranked = flat[order]
            ends = np.flatnonzero(np.append(ranked[1:] != ranked[:-1], True)) if len(ranked) else np.zeros(0, "i8")
            runs = np.diff(np.append(-1, ends)).astype("i4")
            found = np.empty(len(flat), "i4")
            found[order] = np.repeat(runs, runs)
            del order
            shared = [_unpacked(many[i], width) for i in at]
            keys, of = np.unique(np.concatenate(shared), return_inverse=True)
            sums = np.bincount(of, np.concatenate([np.frombuffer(times[i], "<u4") for i in at]), len(keys)).astype("i8")
            if len(keys):  # what some chunks have more than once
                place = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
                found += np.where(keys[place] == flat, sums[place], 0).astype("i4")
                sums += np.searchsorted(ranked, keys, "right") - np.searchsorted(ranked, keys, "left")
            del ranked

            def items(low: np.ndarray, count: np.ndarray) -> bytes:
                return ((np.frexp(count)[1].astype("u8") - np.uint64(1) << np.uint64(BITS)) | bucket | low).astype("<u8").tobytes()

            stop, first = 0, 0
            for i, n, low in zip(at, sizes, shared, strict=True):
                keep = found[stop : stop + n] > 1
                data[i], owners[i] = items(flat[stop : stop + n][keep], found[stop : stop + n][keep]), b"e" + _owned(owners[i])[keep].astype("<u2").tobytes()
                many[i], times[i] = items(low, sums[of[first : first + len(low)]]), None
                stop, first = stop + n, first + len(low)
        out = table
        for name, values in (("data", data), ("many", many), ("owners", owners), ("times", times)):
            out = out.set_column(out.schema.get_field_index(name), name, pa.array(values, pa.binary()))
        return out

    def gather(table: pa.Table) -> pa.Table:
        trim()
        rows = table.to_pylist()
        info = [r for r in rows if r["ids"] is not None]
        blocks = sorted((r for r in rows if r["ids"] is None), key=lambda r: r["bucket"])
        if len(info) != 1 or len(blocks) != info[0]["blocks"]:
            raise RuntimeError("a chunk's blocks are not all there")
        ids, sizes = info[0]["ids"], np.array(info[0]["sizes"], "i8")
        times = np.frombuffer(info[0]["times"], "<u4")
        many = np.frombuffer(b"".join(r["many"] for r in blocks), "<u8")  # ascending over all ranges, as the chunk has them
        items = np.concatenate([np.repeat(many, times)] + [np.frombuffer(r["data"], "<u8") for r in blocks])
        doc = np.concatenate([np.frombuffer(info[0]["owners"], "<u2").astype("i8")] + [_owned(r["owners"]) for r in blocks])
        order = np.lexsort((items, doc))
        items, shared = items[order].astype("i8"), np.bincount(doc, minlength=len(ids))
        ends = np.cumsum(shared)
        need = -(-sizes * num // den)
        alive = (sizes > 0) & (shared >= need) & np.array([i is not None for i in ids], bool)
        out = [items[e - s : e] if a else None for a, s, e in zip(alive, shared, ends, strict=True)]
        digest = [xxhash.xxh3_128_intdigest(x.tobytes()) if x is not None and len(x) == n else None for x, n in zip(out, sizes, strict=True)]
        halves = [pa.array([None if d is None else (d >> k & (1 << 64) - 1) - (1 << 63) for d in digest], pa.int64()) for k in (64, 0)]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_shingles": pa.array(sizes, pa.int64()), "items": pa.array(out, pa.list_(pa.int64())), "same_a": halves[0], "same_b": halves[1]})

    wire = "bucket int, chunk long, blocks int, owners binary, data binary, many binary, times binary, ids array<long>, sizes array<int>"
    sent = docs.select("doc_id", "text").mapInArrow(tidied(send), wire)
    return sent.groupBy("bucket").applyInArrow(answer, wire).groupBy("chunk").applyInArrow(gather, "doc_id long, n_shingles long, items array<long>, same_a long, same_b long")


class PrefixTree:
    """Ordered sets, told apart where they branch. sets: ascending arrays, all different; sizes: of the whole sets, unshared shingles included."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, num: int, den: int):
        self.num, self.den, self.sizes = num, den, sizes
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
        self.leaf = [sets[i] for i in order]
        self.of, n = order, len(order)
        common = [0] * (n + 1)
        for i in range(1, n):
            a, b = self.leaf[i - 1], self.leaf[i]
            m = min(len(a), len(b))
            differs = np.flatnonzero(a[:m] != b[:m])
            common[i] = int(differs[0]) if len(differs) else m
        #: node: segment's start and end, a leaf that has it, children, leaf that ends here, least size and longest set below
        self.nodes: list[list] = []
        todo = [(0, n, 0, -1)] if n else []
        while todo:
            l, r, start, parent = todo.pop()
            end = len(self.leaf[l]) if r - l == 1 else min(common[l + 1 : r])
            own = [order[i] for i in range(l, r)]
            node = [start, end, l, [], -1, int(sizes[own].min()), max(len(self.leaf[i]) for i in range(l, r))]
            me = len(self.nodes)
            self.nodes.append(node)
            if parent >= 0:
                self.nodes[parent][3].append(me)
            cuts = [l] + [i for i in range(l + 1, r) if common[i] == end] + [r]
            if len(self.leaf[l]) == end:  # sorts first among those that begin with it
                node[4] = order[l]
                cuts = cuts[1:]
            if r - l > 1 or node[4] < 0:
                todo += [(a, b, end, me) for a, b in zip(cuts, cuts[1:])]

        self.lists = [x.tolist() for x in self.leaf]
        #: of each node a set that stands for all below it, once all of those are connected
        self.stands = [n[4] if not n[3] else -1 for n in self.nodes]

    def refresh(self, find) -> None:
        """Notes which subtrees have become connected."""
        for at in range(len(self.nodes) - 1, -1, -1):  # children come after their parents
            if self.stands[at] < 0:
                children, leaf = self.nodes[at][3], self.nodes[at][4]
                below = [self.stands[c] for c in children] + ([leaf] if leaf >= 0 else [])
                if min(below) >= 0 and len({find(x) for x in below}) == 1:
                    self.stands[at] = below[0]

    def similar(self, a: np.ndarray, size: int, known=None) -> list[int]:
        """Which sets have num/den or more of the union with set a in common. known: tells which sets need no answer; a subtree of those is not entered."""
        out, num, both, length = [], self.num, self.num + self.den, len(a)
        place = {item: i for i, item in enumerate(a.tolist(), 1)}
        todo = [(0, 0, 0)] if self.nodes else []
        while todo:
            at, overlap, gone = todo.pop()
            if known is not None and self.stands[at] >= 0 and known(self.stands[at]):
                continue
            start, end, row, children, leaf, least, longest = self.nodes[at]
            need = -(-num * (size + least) // both)
            if overlap + min(length - gone, longest - start) < need:
                continue
            items = self.lists[row]
            for d in range(start, end):
                found = place.get(items[d])
                if found is not None:
                    overlap += 1
                    gone = found
                if overlap + min(length - gone, longest - d - 1) < need:
                    break
            else:
                if leaf >= 0 and overlap * both >= num * (size + int(self.sizes[leaf])):
                    out.append(leaf)
                todo += [(c, overlap, gone) for c in children]
        return out


def link_block(ids: list[int], sizes: list[int], items: list[np.ndarray], num: int, den: int) -> list[int]:
    """The smallest id that each document reaches within the block. Equal sets are one node; a probe stops once all are connected."""
    first: dict[tuple, int] = {}
    node = [first.setdefault((n, x.tobytes()) if n == len(x) else (i,), len(first)) for i, (n, x) in enumerate(zip(sizes, items, strict=True))]
    rep = {k: i for i, k in reversed(list(enumerate(node)))}
    root = list(range(len(first)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left = len(root)
    if left > 1:
        sets = [items[rep[k]] for k in range(left)]
        tree = PrefixTree(sets, np.array([sizes[rep[k]] for k in range(left)], "i8"), num, den)
        for k in range(len(sets)):
            if k % 32 == 0:
                tree.refresh(find)
            for other in tree.similar(sets[k], sizes[rep[k]], lambda x, k=k: find(x) == find(k)):
                if (a := find(k)) != (b := find(other)):
                    root[max(a, b)] = min(a, b)
                    left -= 1
            if left == 1:
                break
    least: dict[int, int] = {}
    for i, k in zip(ids, node, strict=True):
        least[find(k)] = min(least.get(find(k), i), i)
    return [least[find(k)] for k in node]


def _lists(table: pa.Table) -> tuple[list[int], list[int], list[np.ndarray]]:
    column = table.column("items").combine_chunks()
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return table.column("doc_id").to_pylist(), table.column("n_shingles").to_pylist(), [flat[a:b] for a, b in zip(ends, ends[1:])]


def _linked_within(members: DataFrame, num: int, den: int) -> DataFrame:
    """node, component: members are whole loose components, many to a bin."""
    def run(table: pa.Table) -> pa.Table:
        trim()
        ids, sizes, items = _lists(table)
        own: dict[int, list[int]] = {}
        for i, c in enumerate(table.column("loose").to_pylist()):
            own.setdefault(c, []).append(i)
        node, component = [], []
        for at in own.values():
            node += [ids[i] for i in at]
            component += link_block([ids[i] for i in at], [sizes[i] for i in at], [items[i] for i in at], num, den)
        return pa.table({"node": pa.array(node, pa.int64()), "component": pa.array(component, pa.int64())})

    return members.groupBy("bin").applyInArrow(run, "node long, component long")


def _linked_across(left: DataFrame, right: DataFrame, tasks: int, num: int, den: int) -> DataFrame:
    """u, v: of each block (equal `block`), every document that a link between left and right joins to a smaller one, and the smallest it reaches. A task has many blocks."""
    def link_blocks(a: tuple, b: tuple, root: dict[int, int]) -> None:
        def find(i: int) -> int:
            while root.setdefault(i, i) != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        def link(i: int, j: int) -> None:
            if (x := find(i)) != (y := find(j)):
                root[max(x, y)] = min(x, y)

        ids, sizes, items = a
        same: dict[tuple, list[int]] = {}
        for i, (n, x) in enumerate(zip(sizes, items, strict=True)):
            same.setdefault((n, x.tobytes()) if n == len(x) else (i,), []).append(i)
        groups = list(same.values())
        for g in groups:
            for i in g[1:]:
                link(ids[g[0]], ids[i])
        tree = PrefixTree([items[g[0]] for g in groups], np.array([sizes[g[0]] for g in groups], "i8"), num, den)
        for k, (doc, n, x) in enumerate(zip(*b, strict=True)):
            if k % 32 == 0:
                tree.refresh(lambda g: find(ids[groups[g][0]]))
            for g in tree.similar(x, n, lambda g, doc=doc: find(ids[groups[g][0]]) == find(doc)):
                link(doc, ids[groups[g][0]])
        for i in list(root):
            root[i] = find(i)

    def by_block(table: pa.Table) -> dict[int, tuple]:
        out: dict[int, tuple] = {}
        for block, *row in zip(table.column("block").to_pylist(), *_lists(table), strict=True):
            own = out.setdefault(block, ([], [], []))
            for column, x in zip(own, row, strict=True):
                column.append(x)
        return out

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        trim()
        u, v = [], []
        if a.num_rows and b.num_rows:
            others = by_block(b)
            for block, own in by_block(a).items():
                if block in others:
                    root: dict[int, int] = {}
                    link_blocks(own, others[block], root)
                    u += [i for i in root if root[i] != i]
                    v += [root[i] for i in root if root[i] != i]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    columns = ["block", "doc_id", "n_shingles", "items"]
    task = F.pmod(F.xxhash64("block"), F.lit(tasks)).alias("task")
    sides = [x.select([F.col(c).alias(c) for c in columns]).select(task, *columns).groupBy("task") for x in (left, right)]  # new names: both sides may stem from one table
    return sides[0].cogroup(sides[1]).applyInArrow(run, "u long, v long").distinct()


def _parts(docs: str, items: str):
    """In how many parts so many documents with so many items must go."""
    return F.greatest(F.ceil(F.col(docs) / BLOCK_DOCS), F.ceil(F.col(items) / BLOCK_ITEMS)).cast("int")


def _linked_large(members: DataFrame, first: DataFrame, num: int, den: int) -> DataFrame:
    """node, component of loose components that no task should hold.

    All members meet a few pivots, which finds large clusters. Whoever is not in its component's largest cluster then meets
    all members that share a prefix shingle with it; two documents of that cluster need no link between them.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.col("salts"))
    salted = members.withColumn("salts", _parts("docs", "items_in"))
    least = members.groupBy("loose").agg(*[F.min(F.struct(F.xxhash64(F.lit(k), "doc_id").alias("h"), "doc_id")).alias(f"p{k}") for k in range(PIVOTS)])
    chosen = least.select("loose", F.explode(F.array_distinct(F.array(*[F.col(f"p{k}.doc_id") for k in range(PIVOTS)]))).alias("doc_id"))
    pivots = salted.join(chosen, ["loose", "doc_id"]).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)))
    pivots = pivots.withColumn("block", F.xxhash64("loose", "s"))
    total = members.agg(F.sum(F.size("items"))).first()[0] or 0
    edges = stored(_linked_across(pivots, salted.withColumn("block", F.xxhash64("loose", part)), max(1, total * 4 // BLOCK_ITEMS), num, den), "large-edges")
    swept(members.sparkSession)
    found = components(edges)
    clustered = members.select("loose", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("loose", "doc_id", F.coalesce("component", "doc_id").alias("cluster"))
    clustered = stored(clustered, "clusters")
    largest = clustered.groupBy("loose", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy("loose").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("largest"))
    outside = clustered.join(largest, "loose").where("cluster <> largest").select("doc_id", F.lit(True).alias("outside"))
    seen = first.join(members.select("doc_id", F.size("items").alias("k")), "doc_id").join(outside, "doc_id", "left")
    seen = stored(seen.select("item", "doc_id", "k", F.coalesce("outside", F.lit(False)).alias("outside")), "large-first")
    few = F.when(F.col("outside"), F.col("k"))
    extent = seen.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("all_items"), F.count(few).alias("few"), F.sum(few).alias("few_items")).where("n > 1 AND few > 0")
    extent = stored(extent.select("item", "n", "all_items", "few_items", _parts("n", "all_items").alias("salts"), _parts("few", "few_items").alias("blocks")), "large-items")
    volume, rows = extent.agg(F.sum(F.expr("all_items * blocks + few_items * salts"))).first()[0] or 0, seen.count()
    sets = members.select("doc_id", "n_shingles", "items")
    key = F.xxhash64("item", "b", "s").alias("block")
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    met = joined(seen, extent, ["item"], rows)
    left = met.where("outside").select("doc_id", "item", own("blocks").alias("b"), every("salts").alias("s")).select("doc_id", key).join(sets, "doc_id")
    right = met.select("doc_id", "item", every("blocks").alias("b"), own("salts").alias("s")).select("doc_id", key).join(sets, "doc_id")
    return components(edges.union(stored(_linked_across(left, right, max(1, volume * 4 // BLOCK_ITEMS), num, den), "large-edges")))


def linked_sets(sets_of: Callable[[DataFrame], DataFrame], first: DataFrame, num: int, den: int) -> DataFrame:
    """doc_id, component (the smallest doc_id that links reach) of sets that have a partner at all, and perhaps of others.

    first: doc_id, item; linked sets share an item. sets_of: of a stored table of doc_ids, the sets to compare (doc_id,
    n_shingles, items, ascending in one order for all).
    """
    first = stored(first, "first")
    least = first.groupBy("item").agg(F.min("doc_id").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    loose = components(joined(first, least, ["item"], first.count()).select(F.col("doc_id").alias("u"), "v").distinct())
    loose = stored(loose.select(F.col("node").alias("doc_id"), F.col("component").alias("loose")).distinct(), "nodes")
    members = stored(sets_of(loose.select("doc_id")).select("doc_id", "n_shingles", "items").join(loose, "doc_id"), "members")
    extent = members.groupBy("loose").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("items")).alias("items_in"))
    extent = stored(extent, "extent")
    total = extent.agg(F.sum("items_in")).first()[0] or 0
    fits = (F.col("docs") <= BLOCK_DOCS) & (F.col("items_in") <= BLOCK_ITEMS)
    large = extent.where(~fits).limit(1).count()
    members = members.join(extent, "loose")
    bins = max(1, int(np.ceil(total / (BLOCK_ITEMS / 8))))
    linked = _linked_within(members.where(fits).withColumn("bin", F.pmod(F.xxhash64("loose"), F.lit(bins))), num, den)
    if large:
        linked = linked.union(_linked_large(members.where(~fits), first, num, den))
    return stored(linked.groupBy(F.col("node").alias("doc_id")).agg(F.min("component").alias("component")), "labels")


def similar(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[np.ndarray]]], num: int, den: int, by_length: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id: what similar_groups gives, of any sets.

    by_length: sets fall into partitions by size whose bounds grow by den/num, so a partner lies in a set's own partition or
    in one beside it; only those that share an item and a partition are compared.
    """
    sets = stored(shared_items(documents(docs), make, num, den), "sets")
    swept(docs.sparkSession)
    alive = sets.where("items IS NOT NULL")
    keys = ["n_shingles", "same_a", "same_b"]
    equal = alive.where("same_a IS NOT NULL").select("doc_id", *keys)
    reps = stored(equal.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "reps")
    copies = joined(equal, reps, keys, equal.count())
    copies = stored(copies.where("doc_id <> rep").select("doc_id", "rep"), "copies")  # of equal sets only the smallest doc_id is compared
    prefix = F.size("items") - F.ceil(F.col("n_shingles") * num / den) + 1
    first = alive.select("doc_id", "n_shingles", F.slice("items", F.lit(1), prefix.cast("int")).alias("items")).join(copies, "doc_id", "left_anti")
    if by_length:
        bounds, longest = [1], sets.agg(F.max("n_shingles")).first()[0] or 1
        while bounds[-1] <= longest:
            bounds.append(max(bounds[-1] + 1, bounds[-1] * den // num + 1))
        part = F.size(F.filter(F.array([F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col("n_shingles")))
        first = first.select("doc_id", F.explode(F.array(part, part + 1)).alias("part"), "items").select("doc_id", "part", F.explode("items").alias("s")).select("doc_id", F.xxhash64("part", "s").alias("item"))
    else:
        first = first.select("doc_id", F.explode("items").alias("item"))
    labels = linked_sets(lambda nodes: alive.join(nodes, "doc_id", "left_semi"), first, num, den)
    follow = copies.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component")).distinct()
    return sets.join(labels.union(follow), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def similar_groups(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, the smallest doc_id that links reach.

    Two documents link when the shingles they share are num/den or more of those of either. Null texts and texts without a
    word have no shingles and no links, texts with fewer than `size` words one shingle. Rows with a null doc_id are linked
    with nothing and have a null component; repeated rows of one doc_id are one node. An empty table gives an empty result.
    """
    return similar(docs, shingler(size), num, den)


def one_of_each(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row of each group of linked texts, with all its columns: that of the smallest doc_id (a null id comes last), then the first of repeated rows.

    Each row is a node of its own, so repeated rows of a doc_id and rows with a null doc_id are linked by their texts like any others.
    """
    keyed = with_rows(docs, "near-rows")
    groups = similar_groups(keyed.select(F.col(ROW).alias("doc_id"), "text"), size, num, den)
    groups = stored(groups.select(F.col("doc_id").alias(ROW), "component_id"), "near-groups")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW)
    best = groups.join(keyed.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min(order)[ROW].alias("best"))
    gone = stored(groups.join(best, "component_id").where(F.col(ROW) != F.col("best")).select(ROW), "near-gone")
    return without_rows(keyed, gone).select(*docs.columns)
