"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file holds byte strings. The library's model works on characters, so every byte is mapped to a printable character,
and decoding reverses that table. A text is cut where a non-space character meets an ASCII space, which no match of the
split pattern can cross; equal pieces of an executor's batches are encoded once and kept in a bounded cache.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WordCache, documents, small_parts, tidied

#: Unicode white space outside ASCII: next to these a cut may lie within a match, so such texts are encoded in one piece.
_EXOTIC = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_SPACES = frozenset(" \t\n\v\f\r")
_PIECES = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    printable = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class ByteBpe:
    """Encodes as a rank-ordered byte-pair merge of each match of `pattern` by itself, without special tokens."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        chars = byte_characters()
        shown = {token: "".join(chars[b] for b in token) for token in ranks}
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for i in range(1, len(token)):
                if token[:i] in ranks and token[i:] in ranks:
                    merges.append((shown[token[:i]], shown[token[i:]]))
        model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, cache_capacity=0)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        back = {c: b for b, c in enumerate(chars)}
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for text, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes_of[i] = bytes(back[c] for c in text)
        self.n_bytes = np.array([len(x) for x in self.bytes_of])
        self.decimal = [str(i).encode() for i in range(len(self.bytes_of))]
        self.cache = WordCache(self._encode, most=300_000)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Of each piece its ids as little-endian 32-bit numbers.

        Pieces that start with a space and end without one stay apart in a longer text too, so they are encoded together
        and told apart by the number of bytes that their ids stand for.
        """
        out: dict[str, bytes] = {}
        joined = [p for p in pieces if p[0] in _SPACES and p[-1] not in _SPACES and not _EXOTIC.search(p)]
        groups = [joined[i : i + 256] for i in range(0, len(joined), 256)]
        rest = [[p] for p in set(pieces).difference(joined)]
        for group, e in zip(groups + rest, self.tokenizer.encode_batch_fast(["".join(g) for g in groups + rest], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            ends = np.cumsum([len(p.encode()) for p in group])
            cuts = (np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1) * 4
            data, at = ids.tobytes(), 0
            for p, to in zip(group, cuts.tolist(), strict=True):
                out[p] = data[at:to]
                at = to
        return [out[p] for p in pieces]

    def pieces(self, text: str) -> list[str]:
        return [text] if text and _EXOTIC.search(text) else _PIECES.findall(text)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(v), "<u4") for v in self.cache.values([self.pieces(t) for t in texts])]

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Of each id the first character it has a part of and the one after its last; parts of one character share it."""
        return [tuple(x) for x in self.tokenizer.encode(text, add_special_tokens=False).offsets]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids.tolist()])

    def decode_pieces(self, ids) -> list[str]:
        """Text of each id. A character split between ids comes with the last of them; bytes that are no UTF-8 become U+FFFD."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        ids = list(ids)
        return [decoder.decode(self.bytes_of[i], k == len(ids) - 1) for k, i in enumerate(ids)]


@lru_cache(maxsize=4)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One tokenizer for each worker process and file."""
    return ByteBpe(path, pattern)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, offsets: bool = True) -> DataFrame:
    """doc_id, ids array<int>, and with offsets starts and ends array<int>: the characters of the text that each id covers.

    Null texts count as empty and have no ids. Repeated rows give repeated rows; other columns are not looked at.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in small_parts(batches):
            texts = batch.column("text").to_pylist()
            columns = {"doc_id": batch.column("doc_id"), "ids": pa.array([x.astype("i4") for x in bpe.ids(texts)], pa.list_(pa.int32()))}
            if offsets:
                spans = [bpe.offsets(t) for t in texts]
                columns |= {n: pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int32())) for k, n in enumerate(("starts", "ends"))}
            yield pa.RecordBatch.from_pydict(columns)

    return documents(docs).mapInArrow(tidied(run), "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * offsets)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, data binary, text string of a table with doc_id and ids; null ids count as none, bytes that are no UTF-8 become U+FFFD."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            data = [bpe.decode_bytes(np.asarray(x or [], "i8")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "data": pa.array(data, pa.binary()), "text": [x.decode("utf-8", "replace") for x in data]})

    return encoded.select("doc_id", "ids").mapInArrow(tidied(run), "doc_id long, data binary, text string")


def round_trip_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the bytes the ids decode to.

    Null and empty texts have no ids and the digests of nothing; strings of special tokens are ordinary text. Repeated rows
    give repeated rows, a null doc_id is kept, an empty table gives an empty result; other columns are not looked at.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in small_parts(batches):
            rows = []
            for ids in bpe.ids(batch.column("text").to_pylist()):
                text = b",".join([bpe.decimal[i] for i in ids.tolist()])
                rows.append((len(ids), hashlib.sha256(text).hexdigest(), hashlib.sha256(bpe.decode_bytes(ids)).hexdigest()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array([r[0] for r in rows], pa.int64()), "ids_sha256": pa.array([r[1] for r in rows], pa.string()), "decoded_sha256": pa.array([r[2] for r in rows], pa.string())})

    return documents(docs).mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
