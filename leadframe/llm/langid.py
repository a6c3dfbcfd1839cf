"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is the sum, over all ways to
cut it into pieces, of the product of their probabilities, which a forward pass gives; expectation maximisation over word
counts fits the probabilities. Words are scored once for each executor's cache, many at a time; runs of letters of any length
are scored whole, by a forward pass that keeps as many positions as the longest piece has characters.

A language's fit also notes how likely its own documents are, letter by letter. A text that is less likely than nearly all of
those, in the best of the languages, is in none of them: its score, the posterior under equal priors, counts that as well.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_parts, stored, tidied

#: Runs of up to so many letters are scored many at a time; longer ones one at a time, whole. The fit counts these in parts of this length.
WORD_CHARS = 32
#: Letters of a long run whose pieces are looked up at once.
STRETCH = 1 << 14
#: The training sample holds about so many documents of each language, chosen by a hash of doc_id; all their words are fitted.
SAMPLE_DOCS = 600
FLOOR = 1e-7
#: A text is in none of the languages if its letters are, on the mean, so many times as unlikely as those of the lowest
#: hundredth of a language's documents, in distance from their mean, and at least NEAR under it.
FAR, NEAR = 3.0, 0.5

_LETTERS = regex.compile(r"\p{L}+")
_STEP, _SLOT = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def letter_words(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return _LETTERS.findall(text.lower())


class Pieces:
    """The vocabulary as a hash table of substrings; entry 0 stands for any single character without a piece."""

    BITS = 18  # some thirteen slots for a piece: a table that stays in a core's cache

    def __init__(self, pieces: list[str]):
        kept = sorted({p for p in pieces if p})
        self.size, self.longest = len(kept) + 1, max(map(len, kept), default=1)
        self.key, self.id, self.more = np.zeros(1 << self.BITS, "u8"), np.zeros(1 << self.BITS, "i4"), np.zeros(1 << self.BITS, bool)
        spill = {}
        for i, p in enumerate(kept, 1):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in p:
                    h = h * _STEP + np.uint64(ord(c) + 1)
                slot = int(self._slot(h))
            if self.id[slot]:
                spill[int(h)] = i
                self.more[slot] = True
            else:
                self.key[slot], self.id[slot] = h, i
        self.spill_keys = np.array(sorted(spill), "u8")
        self.spill_ids = np.array([spill[int(k)] for k in self.spill_keys], "i4")

    def _slot(self, h):
        return (h * _SLOT) >> np.uint64(64 - self.BITS)

    def lattice(self, words: list[str]) -> list[np.ndarray]:
        """For words of one length L: at k - 1 the ids [word, start] of the substrings of k characters, 0 where there is no piece."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype("u8") + np.uint64(1)
        out, h = [], np.zeros_like(chars)
        for k in range(1, min(self.longest, chars.shape[1]) + 1):
            h = h[:, : chars.shape[1] - k + 1] * _STEP + chars[:, k - 1 :]
            slot = self._slot(h)
            ids = np.where(self.key[slot] == h, self.id[slot], 0)
            if len(self.spill_keys) and (rest := np.flatnonzero(self.more[slot].ravel() & (ids.ravel() == 0))).size:
                asked = h.ravel()[rest]
                at = np.minimum(np.searchsorted(self.spill_keys, asked), len(self.spill_keys) - 1)
                ids.ravel()[rest] = np.where(self.spill_keys[at] == asked, self.spill_ids[at], 0)
            out.append(ids)
        return out


Cut = tuple[int, int, np.ndarray, np.ndarray]


def cuts(lattice: list[np.ndarray]) -> list[Cut]:
    """(start, end, words, pieces) of the pieces of two characters and more, which cover few of the substrings. Words are in order, each once."""
    out = []
    for k in range(2, len(lattice) + 1):
        ids = lattice[k - 1].T
        starts, rows = np.nonzero(ids)
        found, bounds = ids[starts, rows], np.searchsorted(starts, np.arange(ids.shape[0] + 1))
        out += [(start, start + k, rows[a:b], found[a:b]) for start, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]
    return out


def _by(cut: list[Cut], side: int, length: int) -> list[list[Cut]]:
    out: list[list[Cut]] = [[] for _ in range(length + 1)]
    for c in cut:
        out[c[side]].append(c)
    return out


def forward(lattice: list[np.ndarray], probs: np.ndarray, cut: list[Cut] | None = None) -> np.ndarray:
    """[position, word, language]: the summed probability of all segmentations of each prefix. probs[0] counts for single characters only."""
    n, length = lattice[0].shape
    alpha = np.zeros((length + 1, n, probs.shape[1]))
    alpha[0] = 1
    ends = _by(cuts(lattice) if cut is None else cut, 1, length)
    for i in range(1, length + 1):
        alpha[i] = alpha[i - 1] * probs[lattice[0][:, i - 1]]
        for start, _, rows, found in ends[i]:
            alpha[i, rows] += alpha[start, rows] * probs[found]
    return alpha


def long_score(pieces: Pieces, word: str, probs: np.ndarray) -> np.ndarray:
    """[language]: the log likelihood of one run of letters of any length. Each language's sums are rescaled as they shrink."""
    reach, longer = pieces.longest, probs.copy()
    longer[0] = 0
    alpha = np.zeros((reach, probs.shape[1]))  # of the last `reach` positions, the latest first
    alpha[0] = 1
    logs = np.zeros(probs.shape[1])
    for start in range(0, len(word), STRETCH):
        before = min(start, reach - 1)
        lattice = pieces.lattice([word[start - before : start + STRETCH]])
        for i in range(before + 1, before + 1 + len(word[start : start + STRETCH])):
            new = alpha[0] * probs[lattice[0][0, i - 1]]
            for k in range(2, min(i, len(lattice)) + 1):
                if at := lattice[k - 1][0, i - k]:
                    new = new + alpha[k - 1] * longer[at]
            alpha = np.concatenate([new[None], alpha[:-1]])
            if new.min() < 1e-100:
                logs += np.log(new)
                alpha = alpha / new
    return logs + np.log(alpha[0])


def by_length(words: list[str], most: int = 4096) -> Iterator[list[int]]:
    """Indices of words of one length each, in groups of bounded size."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        to, n = at, len(words[order[at]])
        while to < len(order) and to - at < most and len(words[order[to]]) == n:
            to += 1
        yield order[at:to]
        at = to


class Model:
    """Languages, vocabulary, probs [piece, language] and levels [language], the log likelihood of a letter under which a text is in no language known."""

    def __init__(self, languages: list[str], pieces: list[str], probs: np.ndarray | None = None):
        self.languages, self.names, self.pieces = languages, pieces, Pieces(pieces)
        self.probs = np.full((self.pieces.size, len(languages)), 1.0 / self.pieces.size) if probs is None else probs
        self.levels = np.full(len(languages), -np.inf)

    def fit(self, words: list[str], counts: np.ndarray, rounds: int = 4) -> Model:
        """Expectation maximisation. counts [word, language]."""
        groups = list(by_length(words))
        for _ in range(rounds):
            got = np.zeros_like(self.probs)
            for group in groups:
                lattice = self.pieces.lattice([words[i] for i in group])
                cut, length = cuts(lattice), lattice[0].shape[1]
                alpha, starts = forward(lattice, self.probs, cut), _by(cut, 0, length)
                beta = np.zeros_like(alpha)
                beta[length] = counts[group] / np.maximum(alpha[length], 1e-300)
                ids, flows = [], []
                for i in range(length - 1, -1, -1):
                    single = lattice[0][:, i]
                    flow = self.probs[single] * beta[i + 1]
                    beta[i] = flow
                    ids.append(single), flows.append(flow * alpha[i])
                    for _, end, rows, found in starts[i]:
                        flow = self.probs[found] * beta[end, rows]
                        beta[i, rows] += flow
                        ids.append(found), flows.append(flow * alpha[i, rows])
                at, flow = np.concatenate(ids), np.concatenate(flows)
                for lang in range(flow.shape[1]):
                    got[:, lang] += np.bincount(at, flow[:, lang], self.pieces.size)
            self.probs = (got + FLOOR * got.sum(0)) / ((got + FLOOR * got.sum(0)).sum(0))
        return self

    def word_scores(self, words: list[str]) -> np.ndarray:
        """[word, language]: log likelihoods."""
        out = np.zeros((len(words), len(self.languages)))
        for group in by_length(words):
            if len(words[group[0]]) > WORD_CHARS:
                for i in group:
                    out[i] = long_score(self.pieces, words[i], self.probs)
            else:
                lattice = self.pieces.lattice([words[i] for i in group])
                out[group] = np.log(forward(lattice, self.probs)[-1])
        return out


def vocabulary(path: str | None = None) -> list[str]:
    """The letter-only pieces of the public sentencepiece model, in lower case, without their word marks."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    names = (model.id_to_piece(i).replace("▁", "").lower() for i in range(model.get_piece_size()))
    return sorted({n for n in names if _LETTERS.fullmatch(n)})


def _fitted(seen: pa.Table, pieces: list[str]) -> Model:
    """A model from lang, word, n: how often each language has each word."""
    if not seen.num_rows:
        return Model([], pieces)
    languages, words = (pc.dictionary_encode(seen.column(c).combine_chunks()) for c in ("lang", "word"))
    names = [str(x) for x in languages.dictionary.to_pylist()]
    order = np.argsort(names)
    table = np.zeros((len(words.dictionary), len(names)), "f4")
    np.add.at(table, (words.indices.to_numpy(), np.argsort(order)[languages.indices.to_numpy()]), seen.column("n").to_numpy())
    return Model([names[i] for i in order], pieces).fit(words.dictionary.to_pylist(), table)


def train(labelled: DataFrame, path: str | None = None, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from doc_id, text and non-null lang of labelled. It reads a sample: about sample_docs documents of each language, whole texts.

    Documents without a letter teach nothing and are not drawn; a language that has no others is no language of the model.
    All words of the sample are fitted. Levels come from half of the sample under a model of the other half, so that they
    stand for texts that the model has not seen: FAR times the distance from the mean to the lowest hundredth, under the mean.
    A language with fewer than two documents in one of the halves has none.
    """
    spark, pieces = labelled.sparkSession, vocabulary(path)
    rows = documents(labelled.where("lang IS NOT NULL"), "lang").where(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], pieces)
    h = F.xxhash64(F.lit("langid"), "doc_id")
    draw = F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))
    share = spark.createDataFrame([(k, min(1.0, sample_docs / n)) for k, n in counts.items()], "lang string, share double")
    half = F.xxhash64(F.lit("half"), "doc_id", "text").bitwiseAND(F.lit(1)).cast("int")
    sample = stored(rows.join(F.broadcast(share), "lang").where(draw < F.col("share")).select("lang", "text", half.alias("half")), "langid-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches):
            own: Counter = Counter()
            for lang, text, h in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "half")), strict=True):
                for w in letter_words(text):
                    for at in range(0, len(w), WORD_CHARS):
                        own[lang, w[at : at + WORD_CHARS], h] += 1
            columns = list(zip(*own, strict=True)) if own else [()] * 3
            yield pa.RecordBatch.from_pydict({"lang": pa.array(columns[0], pa.string()), "word": pa.array(columns[1], pa.string()), "half": pa.array(columns[2], pa.int32()), "n": pa.array(list(own.values()), pa.int64())})

    words = sample.mapInArrow(tidied(run), "lang string, word string, half int, n long").groupBy("lang", "word", "half").agg(F.sum("n").alias("n"))
    seen = words.orderBy("word", "lang", "half").toArrow()  # the words of sample_docs documents of each language
    first, model = _fitted(seen.filter(pc.equal(seen.column("half"), 0)), pieces), _fitted(seen, pieces)
    del seen
    if not first.languages:
        return model
    shared = spark.sparkContext.broadcast((first.languages, first.names, first.probs, first.levels))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*shared.value)
        for batch in small_parts(batches):
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "letter": pa.array([best / max(1, n) for _, best, n, _ in judge.sums(batch.column("text").to_pylist())], pa.float64())})

    letters = sample.where("half = 1").select("lang", "text").mapInArrow(tidied(measure), "lang string, letter double").toPandas()
    for lang, own in letters[letters["lang"].isin(first.languages)].groupby("lang")["letter"]:
        if len(own) > 1:
            mean = own.mean()
            model.levels[model.languages.index(lang)] = mean - max(NEAR, FAR * (mean - np.quantile(own, 0.01)))
    return model


class Judge:
    """Languages of texts in a worker, with a cache of word likelihoods: a table, and each known word's row in it."""

    def __init__(self, languages: list[str], names: list[str], probs: np.ndarray, levels: np.ndarray, most: int = 120_000):
        self.languages, self.levels, self.model, self.most = languages, levels, Model(languages, names, probs.astype("f8")), most
        self._clear()

    def _clear(self) -> None:
        self.row_of, self.used = defaultdict(count().__next__), 0  # a word that is looked up for the first time takes the next row
        self.table, self.letters = np.zeros((1024, len(self.languages))), np.zeros(1024, "i8")

    def _learn(self) -> None:
        """Fills the rows that new words took."""
        if len(self.row_of) == self.used:
            return
        new, to = list(islice(self.row_of, self.used, None)), len(self.row_of)
        if to > len(self.table):
            more = max(to, 2 * len(self.table)) - len(self.table)
            self.table, self.letters = np.pad(self.table, ((0, more), (0, 0))), np.pad(self.letters, (0, more))
        self.table[self.used : to] = self.model.word_scores(new)
        self.letters[self.used : to] = [len(w) for w in new]
        self.used = to

    def sums(self, texts: list[str]) -> Iterator[tuple[np.ndarray, float, int, int]]:
        """Of each text the summed log likelihoods by language, the sum of each word's greatest, letters and words."""
        if self.used > self.most or self.letters[: self.used].sum() > 20 * self.most:
            self._clear()
        rows_of = [np.fromiter(map(self.row_of.__getitem__, own), "i8", len(own)) for own in (letter_words(t) if self.languages else [] for t in texts)]
        self._learn()
        for rows in rows_of:
            total, best = np.zeros(len(self.languages)), 0.0
            for at in range(0, len(rows), 1 << 16):  # of a very long text so many words at once
                got = self.table[rows[at : at + (1 << 16)]]
                total, best = total + got.sum(0), best + float(got.max(1).sum())
            yield total, best, int(self.letters[rows].sum()), len(rows)

    def languages_of(self, texts: list[str]) -> tuple[list[str], list[float], list[int]]:
        pred, score, letters = [], [], []
        for total, best, n, words in self.sums(texts):
            if not words:
                pred.append("und"), score.append(0.0), letters.append(0)
                continue
            top = int(total.argmax())
            others = np.exp((total - total[top]) / words**0.5).sum()
            none = np.exp(min(700.0, (self.levels[top] * n - best) / words**0.5))
            pred.append(self.languages[top]), score.append(float(1 / (others + none))), letters.append(n)
        return pred, score, letters


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, letters of each row of docs.

    lang_pred is the language with the greatest likelihood of all the text's words (ties: the first in name order), score its
    posterior under equal priors for the languages and for none of them, taken per square root of the word count so that long
    texts do not saturate it. For `none` stands the language's level, against each word in the language that suits it best:
    texts that mix known languages are not foreign. Null texts, texts without a letter, and models without a language give
    `und` and 0. Repeated rows give repeated rows, an empty table an empty result; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.names, model.probs, model.levels))  # vocabulary times languages: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*shared.value)
        for batch in small_parts(batches):
            pred, score, letters = judge.languages_of(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()), "letters": pa.array(letters, pa.int64())})

    return documents(docs).mapInArrow(tidied(run), "doc_id long, lang_pred string, score double, letters long")


def in_known_language(docs: DataFrame, model: Model, least: float, languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of docs whose language is one of `languages` (None: any of the model's, never `und`) with a score of `least` or more.

    All columns stay as they are, in one pass and without a shuffle. Null texts and texts without a letter go, each of
    repeated rows is judged alike, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.names, model.probs, model.levels))  # as in identify
    wanted = frozenset(model.languages if languages is None else languages) - {"und"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*shared.value)
        for batch in small_parts(batches):
            pred, score, _ = judge.languages_of([t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array([p in wanted and s >= least for p, s in zip(pred, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


def held_out(modulus: int, remainder: int):
    """Whether crc32 of doc_id's text leaves remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % modulus == remainder, F.lit(False))


def predict_held_out(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on the rows that are not held out, applied to all.

    Nulls, empty texts, ties, repeated rows and empty tables are as identify has them; a null doc_id is not held out, and all
    rows with one are drawn for training or none, as they share one hash.
    """
    model = train(docs.where(~held_out(3, 1)))
    return identify(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
