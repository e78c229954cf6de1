"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of one fixed public vocabulary. A word's likelihood is the sum, over all
ways to cut it into pieces, of the product of their probabilities (forward algorithm). Words are independent.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, memory_returned, remainder, small_batches, without

MARK = "▁"
#: Added to every piece's count; words whose scores or pieces one Python worker keeps, and characters of one that is kept.
SMOOTHING, KEPT, LONG = 0.5, 500_000, 100
#: Characters that are scored at a time, and positions after which a forward pass is scaled anew, so that no product underflows.
SPAN, SCALED = 400_000, 16
UNDETERMINED = "und"


def loaded(model_file: str):
    """The processor, piece -> row, and the table of pieces; the row after the last is for characters that no piece has."""

    def load():
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(processor.get_piece_size()) if not (processor.is_control(i) or processor.is_byte(i) or processor.is_unknown(i))]
        pieces = {processor.id_to_piece(i): row for row, i in enumerate(plain)}
        return processor, pieces, PieceTable(pieces)

    return held(("language", model_file), load)


def vocabulary(model_file: str):
    return loaded(model_file)[:2]


def piece_table(model_file: str) -> PieceTable:
    return loaded(model_file)[2]


def words_of(text: str) -> list[str]:
    return text.lower().split()


def has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


class PieceTable:
    """Rows of many pieces at once: polynomial hashes of code points, looked up in two open tables without collisions left."""

    BITS, BASE, SPREAD = 20, np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))

    def __init__(self, pieces: dict[str, int]):
        self.missing, self.longest = len(pieces) + 1, max(map(len, pieces), default=1)
        self.keys = np.zeros((2, 1 << self.BITS), np.uint64)
        self.rows = np.full((2, 1 << self.BITS), self.missing, np.int32)
        for piece, row in pieces.items():
            key = self.hashes(self.prefixes(np.array([[*map(ord, piece)]], np.uint64)), len(piece))[0, 0]
            for t in range(2):
                at = self.slot(key, t)
                if self.rows[t, at] == self.missing:
                    self.keys[t, at], self.rows[t, at] = key, row
                    break
            else:
                raise ValueError("both slots of a piece are taken")

    def slot(self, keys, t: int):
        with np.errstate(over="ignore"):
            return (keys * self.SPREAD[t]) >> np.uint64(64 - self.BITS)

    def prefixes(self, points: np.ndarray) -> np.ndarray:
        """Hash of each prefix of each row's code points."""
        out = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(points.shape[1]):
                out[:, i + 1] = out[:, i] * self.BASE + points[:, i]
        return out

    def hashes(self, prefixes: np.ndarray, size: int) -> np.ndarray:
        """Hash of each run of ``size`` code points in each row."""
        shift = np.uint64(pow(int(self.BASE), size, 1 << 64))
        with np.errstate(over="ignore"):
            return prefixes[:, size:] - prefixes[:, :-size] * shift + np.uint64(size) * shift

    def find(self, prefixes: np.ndarray, size: int) -> np.ndarray:
        keys = self.hashes(prefixes, size)
        out = np.full(keys.shape, self.missing, np.int32)
        for t in range(2):
            at = self.slot(keys, t)
            np.copyto(out, self.rows[t][at], where=self.keys[t][at] == keys)
        return out


#: Pieces of a character that no piece has, after the first.
CONTINUED = frozenset(f"<0x{b:02X}>" for b in range(0x80, 0xC0))


def _cut(word: str, pieces: dict[str, int], processor) -> list[int]:
    unknown = len(pieces)
    return [pieces.get(p, unknown) for p in processor.encode(word, out_type=str) if p not in CONTINUED]


def piece_counts(labelled: DataFrame, model_file: str, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, piece, n): how often each piece row occurs in all labelled texts, one row per task, language and piece."""
    small_batches(labelled.sparkSession)

    def run(batches):
        processor, pieces = vocabulary(model_file)
        words: dict[str, Counter] = {}

        def flush():
            for lang, counter in words.items():
                n = [0] * (len(pieces) + 1)
                for word, k in counter.items():
                    if has_letter(word):
                        for row in _cut(word, pieces, processor):
                            n[row] += k
                n = np.array(n, np.int64)
                rows = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(rows, pa.int64()), pa.array(n[rows])], names=["lang", "piece", "n"])
            words.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, words.values())) > KEPT:
                yield from flush()
        yield from flush()
        memory_returned()

    source = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), text_col)
    return source.mapInArrow(run, "lang string, piece long, n long")


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order and the probabilities of pieces: rows for pieces and one for unknown characters, columns by language."""

    langs: tuple[str, ...]
    probabilities: np.ndarray


def fit(labelled: DataFrame, model_file: str, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """Piece probabilities by language from the piece counts of all labelled rows.

    What reaches the driver has at most (vocabulary size) x (number of languages) rows, whatever the corpus.
    Null languages or texts teach nothing; without any labelled row there are no languages.
    """
    size = len(vocabulary(model_file)[1]) + 1
    counted = piece_counts(labelled, model_file, lang_col, text_col).groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(counted["lang"].unique()))
    n = np.full((size, len(langs)), SMOOTHING)
    np.add.at(n, (counted["piece"].to_numpy(np.int64), [langs.index(x) for x in counted["lang"]]), counted["n"].to_numpy(float))
    return LanguageModel(langs, n / n.sum(0))


class Scorer:
    """Log-likelihoods of words by language, kept for a bounded number of words."""

    def __init__(self, model: LanguageModel, pieces: PieceTable):
        self.model, self.pieces = model, pieces
        self.at: dict[str, int] = {}
        self.used = 0
        self.logs = np.zeros((KEPT, len(model.langs)))

    def forward(self, words: list[str]) -> np.ndarray:
        """log of the summed probability of all segmentations of words of about one length.

        Positions are taken in blocks; what pieces can reach back to is carried over, and scaled from time to time.
        """
        sizes, table, reach = np.array([*map(len, words)]), self.pieces, self.pieces.longest
        n = int(sizes.max())
        text = "".join(words if sizes.min() == n else [w.ljust(n, "\0") for w in words])
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)
        shape, span = (len(words), len(self.model.langs)), min(n, max(2 * reach, SPAN // len(words)))
        out, scale, alpha = np.zeros(shape), np.zeros(shape), np.zeros((reach + span + 1, *shape))
        alpha[reach] = 1
        for start in range(0, n, span):
            end, low = min(n, start + span), max(0, start - reach + 1)
            at = reach - start  # where alpha of a position lies
            prefixes = table.prefixes(points[:, low:end].astype(np.uint64))
            found = {size: table.find(prefixes, size) for size in range(1, min(end - low, reach) + 1)}
            found[1][found[1] == table.missing] = table.missing - 1  # a character that no piece has
            met = {size: (rows != table.missing).any(0).tolist() for size, rows in found.items()}
            for i in range(start + 1, end + 1):
                here = alpha[at + i]
                here[:] = 0
                for size in range(1, min(i, reach) + 1):
                    if not met[size][i - size - low]:
                        continue
                    rows = found[size][:, i - size - low]
                    there = np.flatnonzero(rows != table.missing) if size > 1 else slice(None)
                    if size == 1 or len(there):
                        here[there] += alpha[at + i - size, there] * self.model.probabilities[rows[there]]
                if i % SCALED == 0:
                    by = here.copy()
                    alpha[max(0, at + i - reach) : at + i + 1] /= by
                    scale += np.log(by)
                ended = sizes == i
                if ended.any():
                    out[ended] = np.log(here[ended]) + scale[ended]
            alpha[: reach + 1] = alpha[at + end - reach : at + end + 1].copy()
        return out

    def learn(self, words: set[str], block: list[str]) -> None:
        if self.used + len(words) > KEPT:
            self.at.clear()
            self.used, words = 0, set(block)
        by_length: dict[int, list[str]] = {}
        for word in words:
            if has_letter(word):
                n = len(word)
                by_length.setdefault(n if n < 32 else 32 + int(8 * math.log2(n / 32)), []).append(word)
        start = self.used
        self.used += len(words)
        self.at.update((w, start + i) for i, w in enumerate(words))
        self.logs[start : start + len(words)] = 0
        for alike in by_length.values():
            many = max(1, SPAN // max(map(len, alike)))
            for i in range(0, len(alike), many):
                self.logs[[self.at[w] for w in alike[i : i + many]]] = self.forward([MARK + w for w in alike[i : i + many]])

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """Rows of summed logs of texts, a block of words at a time."""
        out = np.zeros((len(texts), len(self.model.langs)))
        words = [w for text in texts for w in text]
        owner = np.repeat(np.arange(len(texts)), [*map(len, texts)])
        for i in range(0, len(words), KEPT // 2):
            part = words[i : i + KEPT // 2]
            if new := {w for w in part if w not in self.at}:
                self.learn(new, part)
            logs = self.logs[np.fromiter(map(self.at.__getitem__, part), np.int64, len(part))]
            mine = owner[i : i + KEPT // 2]
            starts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            out[mine[starts]] += np.add.reduceat(logs, starts, axis=0)
            for word in {w for w in part if len(w) > LONG}:
                self.at.pop(word, None)
        return out


def predict(docs: DataFrame, model: LanguageModel, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row from its whole text alone; score is the posterior under equal priors.

    Null text, text without a letter, and a model without languages give ``und`` and score 0. Ties go to the first
    language in order. Repeated rows and null ids give a row each, an empty table none; other columns are ignored, also
    if they are named lang, text or like the columns of the result. A word of any length is summed over all segmentations.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary size x languages

    def run(batches):
        scorer = Scorer(shared.value, piece_table(model_file))
        langs = scorer.model.langs
        for batch in batches:
            texts = [words_of(t) if t else [] for t in batch.column(1).to_pylist()]
            logs_of = scorer.scores(texts) if langs else [None] * len(texts)
            found, sure = [], []
            for words, logs in zip(texts, logs_of):
                if not langs or not any(map(has_letter, words)):
                    found.append(UNDETERMINED)
                    sure.append(0.0)
                    continue
                best = int(logs.argmax())
                found.append(langs[best])
                sure.append(float(1 / np.exp(logs - logs[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(sure, pa.float64())], names=["id", "lang_pred", "score"])
        del scorer
        memory_returned()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def drop_rejected(docs: DataFrame, model: LanguageModel, model_file: str, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs in a learned language, with all their columns, whatever their names.

    A document goes if its text, by itself, has no letter (null and empty texts too) or no language with a posterior of
    ``least``. Rows of one id are one document: it goes if one of them does. Ties, repeats, empty tables and long texts are
    as in predict().
    """
    found = predict(docs, model, model_file, id_col, text_col)
    return without(docs, found.where((F.col("lang_pred") == UNDETERMINED) | (F.col("score") < least)).select(id_col), id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that the language model never learns from."""
    return remainder(id_col, 4) == 2
