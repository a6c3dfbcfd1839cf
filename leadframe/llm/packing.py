"""Packing by cutting-stock column generation.

Documents are cut at the sequence length; what is left of each is a piece of 1 to 2048 tokens. Lengths are counted in classes
of `grain` tokens, so the driver sees one bounded histogram however many documents there are. A linear program over patterns
(multisets of classes that fit one sequence) covers the histogram with as few sequences as it can: the duals price the
classes, a knapsack dynamic program finds the best new pattern, until none helps. Pattern counts are rounded down and the
bounded remainder is packed first-fit. Pieces of a class are ranked in parallel and each rank looks up its pattern.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordCache, documents, small_parts, stored, tidied, with_slots

CAPACITY = 2048
GRAIN = 16
END_ID = 1

#: The split pattern of the tokenizer's file for text that is in lower case already: words of Latin-1 characters only, where every version of Unicode agrees.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\s0-9a-zªµºß-öø-ÿ²³¹¼½¾]+")
_LATIN = re.compile(r"[\x21-\x84\x86-\x9f\xa1-\xff]+")
_LATIN_TEXT = re.compile(r"[\t-\r\x20-\x84\x86-\x9f\xa1-\xff]*")


class WordBpe:
    """Ids of a tokenizer that drops white space: the matches of its split pattern are encoded apart, and equal ones once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: The library takes these strings out of a text before it splits the rest, so texts that have one are encoded whole.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(vocab.values()) + 1, "i8")
        for text, i in vocab.items():
            self.n_bytes[i] = len(text.removesuffix("</w>"))
        self.parts = WordCache(self._encode, most=200_000)

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Ids of each part as little-endian 32-bit numbers. Parts are encoded many at a time and told apart by byte counts; where those do not tally, one at a time."""
        out: list[bytes] = []
        groups = [parts[i : i + 256] for i in range(0, len(parts), 256)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            have = np.cumsum(self.n_bytes[ids])
            ends = np.cumsum([len(p) if p.isascii() else len(unicodedata.normalize("NFC", p).lower().encode()) for p in group])
            cuts = np.searchsorted(have, ends)
            if len(have) and have[-1] == ends[-1] and (have[cuts] == ends).all():
                data, at = ids.tobytes(), 0
                for to in ((cuts + 1) * 4).tolist():
                    out.append(data[at:to])
                    at = to
            else:
                out += [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
        return out

    @staticmethod
    def cut(text: str) -> list[str]:
        """The matches of the split pattern in lower case where the text is Latin-1, else words without white space."""
        if _LATIN_TEXT.fullmatch(text):
            return _PARTS.findall(text.lower())
        words = [w.decode() for w in text.encode().split()]
        return [p for w in words for p in (_PARTS.findall(w.lower()) if _LATIN.fullmatch(w) else [w])]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids as little-endian 32-bit numbers."""
        whole = {i for i, t in enumerate(texts) if any(x in t for x in self.special)}
        out = [b"".join(v) for v in self.parts.values([[] if i in whole else self.cut(t) for i, t in enumerate(texts)])]
        for i in whole:
            out[i] = np.asarray(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids and then end_id, cut at every capacity tokens.

    Null texts count as empty: end_id alone. Repeated rows are cut as often as they occur; other columns are not looked at.
    """
    path = path or default_path()
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in small_parts(batches):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), bpe.ids(batch.column("text").to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                rows += [(doc_id, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n) for at in range(0, n, capacity)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), columns, strict=True)})
        bpe.parts.shrink(60_000)

    return documents(docs).mapInArrow(tidied(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within capacity with the greatest value: an unbounded knapsack, one vector step for each capacity."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sizes_up, values_up = sizes[order], values[order]
    fits = np.searchsorted(sizes_up, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            v = best[c - sizes_up[:k]] + values_up[:k]
            if v[i := int(v.argmax())] > best[c]:
                best[c], took[c] = v[i], order[i]
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one in a row) and their fractional counts: the linear program's optimum, or its best point after `rounds` pivots, which covers the demand as well."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse, x = np.diag(1.0 / basis.diagonal()), demand / basis.diagonal()
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        value, pattern = price(np.maximum(duals, 0), sizes, capacity)
        if value <= 1 + 1e-9:
            break
        step = inverse @ pattern
        able = step > 1e-9
        if not able.any():
            break
        ratio = np.full(m, np.inf)
        ratio[able] = x[able] / step[able]
        out = int(ratio.argmin())
        x -= ratio[out] * step
        x[out] = ratio[out]
        np.maximum(x, 0, out=x)
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        basis[:, out] = pattern
    return basis.T, x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern: copies by class, repeats) that hold every piece of the histogram exactly. Classes and capacity are in grains."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram, reverse=True))
    left = np.array([histogram[s] for s in sizes], "i8")
    patterns, x = column_generation(sizes, left.astype(float), capacity)
    out = []
    for pattern, count in zip(patterns.astype("i8"), np.floor(x + 1e-7).astype("i8"), strict=True):
        used = pattern > 0
        repeats = int(min(count, (left[used] // pattern[used]).min())) if used.any() else 0
        if repeats > 0:
            left -= repeats * pattern
            out.append(({int(s): int(k) for s, k in zip(sizes[used], pattern[used], strict=True)}, repeats))
    bins: list[tuple[int, dict[int, int]]] = []  # what rounding leaves is less than one of each pattern
    for s, n in zip(sizes.tolist(), left.tolist(), strict=True):
        for i, (room, own) in enumerate(bins):
            if k := min(n, room // s):
                own[s] = k
                bins[i] = (room - k * s, own)
                n -= k
        while n:
            k = min(n, capacity // s)
            bins.append((capacity - k * s, {s: k}))
            n -= k
    return out + [(own, 1) for _, own in bins]


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts count as empty: one piece, the end id. Repeated rows are packed as often as they occur; a null doc_id is kept.
    An empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, path, capacity), "pieces")
    classed = cut.withColumn("cls", F.ceil(F.col("length") / grain))
    histogram = {r["cls"]: r["n"] for r in classed.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity / grain rows
    slots, base, taken = [], 0, dict.fromkeys(histogram, 0)
    for pattern, repeats in plan(histogram, capacity // grain):
        for cls, copies in pattern.items():
            slots.append((cls, taken[cls], taken[cls] + copies * repeats, copies, base))
            taken[cls] += copies * repeats
        base += repeats
    slot_table = spark.createDataFrame(slots, "cls long, low long, high long, copies long, base long")  # bounded by patterns times classes
    ranked = with_slots(classed, ["cls"], ["doc_id", "start", "ids_crc32"], "pack")
    placed = ranked.alias("r").join(F.broadcast(slot_table).alias("s"), (F.col("r.cls") == F.col("s.cls")) & (F.col("slot") >= F.col("low")) & (F.col("slot") < F.col("high")))
    placed = placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.floor((F.col("slot") - F.col("low")) / F.col("copies"))).cast("long").alias("sequence_id"), "slot")
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("slot")


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, tokens, padded length: sequences are padded to capacity unless they hold a power of two of tokens."""
    tokens = F.col("tokens")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens")).withColumn("padded", F.when(tokens.bitwiseAND(tokens - 1) == 0, tokens).otherwise(F.lit(capacity)))
