"""Document fingerprints by SpotSigs (Theobald et al., 2008).

A spot is a common word, the anchor, with the chain of content words that follow it. A document's spots are its signature
set; sets are compared by Jaccard, and two sets whose lengths differ too much for the likeness asked for are not compared.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashCache, documents, mix64, plain_words, small_parts, tidied
from .ngram_join import BITS as SET_BITS
from .ngram_join import similar

#: Common words of the corpus languages.
ANCHORS = frozenset(
    "the of and to a in is it that for was on are as with be by this at or an from you he she they his her not have had but which "
    "der die das und ist in von zu den mit auf für ein eine im dem nicht sich des als auch es an werden aus er hat dass sie nach "
    "le la les de des et en un une est que qui dans pour sur pas au du il elle par plus ne se ce avec sont aux "
    "el los las y es que en un una por con para no se del al lo como más su pero sus o este".split()
)
CHAIN = 2
#: Bits of a signature: six bytes, eight characters of a fingerprint.
BITS = 48
#: Bytes of a range of doc_id: the most that a table has of them, and the size that gives every core its work. Tasks stream their ranges.
RANGE_BYTES, LEAST_RANGE_BYTES = 256_000_000, 8_000_000


def word_values(words: list[str]) -> list[int]:
    """A hash of each word whose lowest bit says whether the word is an anchor."""
    return [xxhash.xxh64_intdigest(w) & ~1 | (w in ANCHORS) for w in words]


def spots(h: np.ndarray, chain: int = CHAIN) -> np.ndarray:
    """The distinct spots of a text with word values h, ascending. An anchor with fewer content words after it makes none."""
    is_anchor = (h & np.uint64(1)).astype(bool)
    content = np.flatnonzero(~is_anchor)
    anchors = np.flatnonzero(is_anchor)
    first = np.searchsorted(content, anchors)
    whole = first + chain <= len(content)
    anchors, first = anchors[whole], first[whole]
    acc = h[anchors]
    for j in range(chain):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[content[first + j]])
    return np.unique(acc >> np.uint64(64 - BITS))


def signature_sets(texts: list[str], cache: HashCache) -> list[np.ndarray]:
    """Of each text its spots; a text without any has one signature, its own hash, so equal texts always have equal sets."""
    cut = [plain_words(t) for t in texts]
    sets = [spots(v) for v in cache.values(cut)]
    return [s if len(s) else np.array([xxhash.xxh64_intdigest(t) >> 64 - BITS], "u8") for s, t in zip(sets, texts, strict=True)]


def fingerprint(signatures: np.ndarray) -> str:
    """The whole set, ascending, eight characters of base64 for each signature."""
    wide = signatures.astype(">u8").view("u1").reshape(-1, 8)
    return base64.b64encode(wide[:, 8 - BITS // 8 :].tobytes()).decode()


def signatures_of(text: str) -> np.ndarray:
    """The set that a fingerprint holds."""
    wide = np.zeros((len(text) // 8, 8), "u1")
    wide[:, 8 - BITS // 8 :] = np.frombuffer(base64.b64decode(text), "u1").reshape(-1, BITS // 8)
    return wide.view(">u8").ravel().astype("u8")


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two signature sets, 0 if it is under `least`. Lengths alone rule out most such pairs."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    value = both / (len(a) + len(b) - both)
    return value if value >= least else 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_signatures, signatures array<long>, fingerprint of each row of docs; null texts count as empty, equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache(word_values)
        for batch in small_parts(batches):
            sets = signature_sets(batch.column("text").to_pylist(), cache)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_signatures": pa.array([len(s) for s in sets], pa.int64()), "signatures": pa.array([s.astype("i8") for s in sets], pa.list_(pa.int64())), "fingerprint": pa.array([fingerprint(s) for s in sets], pa.string())})

    return documents(docs).mapInArrow(tidied(run), "doc_id long, n_signatures long, signatures array<long>, fingerprint string")


def alike(docs: DataFrame, num: int = 8, den: int = 10) -> DataFrame:
    """One row per row of docs: doc_id, n_signatures, class_id: the smallest doc_id reached by likenesses of num/den or more.

    Sets fall into partitions by length whose bounds grow by den/num, so a partner lies in a set's own partition or in one
    beside it. Of those, sets are compared, with lengths pruning what cannot reach the likeness, that share one of their
    first signatures in the global order, rarest first. Documents of one fingerprint are compared once. Null and empty texts
    are alike; rows with a null doc_id are compared with none and have a null class; repeated rows of one doc_id are one
    node; an empty table gives an empty result.
    """
    def make():
        cache = HashCache(word_values)
        return lambda texts: [s << np.uint64(SET_BITS - BITS) for s in signature_sets(texts, cache)]

    return similar(docs, make, num, den, by_length=True).select("doc_id", F.col("n_shingles").alias("n_signatures"), F.col("component_id").alias("class_id"))


def with_edits(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half (rounded down) of the code points replaced by the first as many, or all, of the next
    row in the order of doc_id (a null id first, repeated ids by a hash of their text); the first row follows the last. Null
    texts count as empty; a single row follows itself; an empty table gives an empty result; other columns are not looked at.
    near_edited and near_next are the Jaccard of the sets that the fingerprints hold.

    Rows are dealt into ranges of doc_id that begin at ids of the table, so the row that follows a range's last one is
    known beforehand and is sent to that range as well. Tasks stream their ranges in order, so a range, and the rows of one
    repeated id, may be of any size. Texts travel compressed.
    """
    rows = documents(docs)
    low = -(1 << 63)
    extent = rows.agg(F.sum(F.octet_length("text") + 64), F.min(F.coalesce("doc_id", F.lit(low)))).first()
    total, cores = extent[0] or 0, docs.sparkSession.sparkContext.defaultParallelism
    n = max(1, min(total // LEAST_RANGE_BYTES, 16 * cores), total // RANGE_BYTES)
    at = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(100_000, 4 * n))).first()[0] if n > 1 else []
    bounds = sorted(set(at or []) - {extent[1]})
    least = extent[1]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        starts, starting = np.array(bounds, "i8"), set(bounds)
        for batch in small_parts(batches):
            ids = batch.column("doc_id").to_pylist()
            keys = [low if i is None else i for i in ids]
            data = [press.compress(t.encode()) for t in batch.column("text").to_pylist()]
            where = np.searchsorted(starts, keys, "right").tolist()
            out = list(zip(where, [False] * len(keys), keys, ids, data, strict=True))
            out += [(w - 1, True, k, i, d) for w, k, i, d in zip(where, keys, ids, data, strict=True) if k in starting]
            out += [(len(bounds), True, k, i, d) for k, i, d in zip(keys, ids, data, strict=True) if k == least]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(("range", "ahead", "key", "doc_id", "data"), columns, kinds, strict=True)})

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, cache = zstandard.ZstdDecompressor(), HashCache(word_values)
        before = None  # the row that waits for the one after it: range, doc_id, text, signatures
        for batch in small_parts(batches, "data"):
            ranges, ahead, ids = (batch.column(c).to_pylist() for c in ("range", "ahead", "doc_id"))
            texts = [unpress.decompress(d).decode() for d in batch.column("data").to_pylist()]
            sets = signature_sets(texts, cache)
            pairs = []
            for r, over, i, text, own in zip(ranges, ahead, ids, texts, sets, strict=True):
                if before is not None and before[0] == r:
                    pairs.append((before[1], before[2], before[3], text, own))
                before = None if over else (r, i, text, own)
            edited = [text[: len(text) - len(text) // 2] + after[: len(text) // 2] for _, text, _, after, _ in pairs]
            changed = signature_sets(edited, cache)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([p[0] for p in pairs], pa.int64()), "n_chars": pa.array([len(p[1]) for p in pairs], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                "fingerprint": pa.array([fingerprint(p[2]) for p in pairs], pa.string()), "edited_fingerprint": pa.array([fingerprint(c) for c in changed], pa.string()),
                "near_edited": pa.array([likeness(p[2], c) for p, c in zip(pairs, changed, strict=True)], pa.float64()), "near_next": pa.array([likeness(p[2], p[4]) for p in pairs], pa.float64()),
            })

    sent = rows.mapInArrow(tidied(send), "range int, ahead boolean, key long, doc_id long, data binary")
    dealt = sent.repartition(max(12, len(bounds) + 1), "range").sortWithinPartitions("range", "ahead", "key", "data")
    return dealt.mapInArrow(tidied(receive), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
