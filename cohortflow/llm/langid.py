"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get one probability for each language. A word's probability is the sum over all
its segmentations into pieces, found by a forward pass over its letters; a text's is the product over its words. The
probabilities are learned by expectation maximisation (forward and backward passes over the same lattice) on a bounded
sample of documents of each language. Words are scored in batches of equal length, all languages at once, and each word
once for each task. Sums that come near the least double are worked out again in logarithms.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, letter_runs, ship, slices

START, LONGEST_PIECE, LONGEST_WORD = "▁", 16, 40
NOTHING, UNKNOWN = 0, 1  # rows of the table for no piece, and for a letter that is in no piece


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; a run over LONGEST_WORD letters is cut into such parts, which bounds a lattice."""
    found = letter_runs((text or "").lower())
    if any(len(w) > LONGEST_WORD for w in found):
        found = [w[i:i + LONGEST_WORD] for w in found for i in range(0, len(w), LONGEST_WORD)]
    return found


def vocabulary(path: str) -> list[str]:
    """The lower-case letter pieces of a sentencepiece model, with or without the mark of a word's start."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return sorted({p for p in every if (b := p.removeprefix(START)).isalpha() and b == b.lower() and len(p) <= LONGEST_PIECE} | {START})


def _lattices(words: list[str], row: dict[str, int]):
    """For words of one length: (words, {(from, to): table rows}) with the mark of a start before them."""
    by = defaultdict(list)
    for i, w in enumerate(words):
        by[len(w)].append(i)
    for n, at in by.items():
        marked = [START + words[i] for i in at]
        cells = {}
        for e in range(1, n + 2):
            for s in range(max(0, e - LONGEST_PIECE), e):
                default = UNKNOWN if e - s == 1 else NOTHING
                ids = np.fromiter((row.get(w[s:e], default) for w in marked), np.int64, len(marked))
                if ids.any():
                    cells[s, e] = ids
        yield np.array(at), n + 1, cells


def _forward(n: int, cells, p: np.ndarray, size: int) -> np.ndarray:
    a = np.zeros((n + 1, size, p.shape[1]))
    a[0] = 1
    for (s, e), ids in cells.items():  # in order of e
        a[e] += a[s] * p[ids]
    return a


def _log_forward(n: int, cells, p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithms of the sums for the words ``at`` of a lattice, however small they are."""
    with np.errstate(divide="ignore"):
        logs = np.log(p)
    a = np.full((n + 1, len(at), p.shape[1]), -np.inf)
    a[0] = 0
    for (s, e), ids in cells.items():
        a[e] = np.logaddexp(a[e], a[s] + logs[ids[at]])
    return a[n]


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    p: np.ndarray  # (pieces + 2) x languages
    prior: np.ndarray

    def scorer(self, limit: int = 400_000):
        """words -> summed log probabilities by language; each word is worked out once (a bounded memo)."""
        row = {x: i + 2 for i, x in enumerate(self.pieces)}
        memo: dict[str, int] = {}
        table = np.zeros((1024, len(self.languages)))

        def learn(words: set[str]) -> None:
            nonlocal table
            if len(memo) + len(words) > limit:
                memo.clear()
            new = list(words.difference(memo))
            while len(memo) + len(new) > len(table):
                table = np.concatenate([table, np.zeros_like(table)])
            base = len(memo)
            memo.update(zip(new, range(base, base + len(new)), strict=True))
            for at, n, cells in _lattices(new, row):
                total = _forward(n, cells, self.p, len(at))[n]
                small = np.flatnonzero((total < 1e-250).any(axis=1))  # near or below the least double
                table[base + at] = np.log(np.maximum(total, 1e-300))
                if len(small):
                    table[base + at[small]] = _log_forward(n, cells, self.p, small)

        def total(words: list[str]) -> np.ndarray:
            return table[np.fromiter(map(memo.__getitem__, words), np.int64, len(words))].sum(axis=0)

        return learn, total


def expectation_maximisation(words: list[str], counts: np.ndarray, pieces: list[str], rounds: int = 4, smooth: float = 0.05) -> np.ndarray:
    """Piece probabilities by language from word counts (words x languages). Unseen pieces keep a small share."""
    row = {x: i + 2 for i, x in enumerate(pieces)}
    lattices = list(_lattices(words, row))
    p = np.full((len(pieces) + 2, counts.shape[1]), 1.0 / len(pieces))
    p[UNKNOWN], p[NOTHING] = 1e-6, 0
    for _ in range(rounds):
        want = np.zeros_like(p)
        for at, n, cells in lattices:
            a, b = _forward(n, cells, p, len(at)), np.zeros((n + 1, len(at), counts.shape[1]))
            b[n] = 1
            for (s, e), ids in sorted(cells.items(), key=lambda c: -c[0][0]):
                b[s] += p[ids] * b[e]
            z = counts[at] / np.maximum(a[n], 1e-300)
            for (s, e), ids in cells.items():
                np.add.at(want, ids, a[s] * p[ids] * b[e] * z)
        want = want[2:] + smooth
        p[2:] = want / want.sum(axis=0)
    return p


def fit(docs: DataFrame, vocabulary_path: str, rows: int = 250) -> Model:
    """Learn from about ``rows`` documents of each language, whole texts, none of them held out. Ids and sources play no part."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id") & F.col("text").isNotNull())
    known = known.select(F.col("doc_id").cast("long"), "lang")
    # bounded by ``rows`` for each language, so it can be sent to every executor
    sample = labelled_sample(known, "doc_id", rows, "lang").withColumnRenamed("lang", "language")

    def count(batches):
        for part in slices(batches, "text"):
            for lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                w = words_of(t)
                if w:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(w)), pa.array(w)], names=["language", "word"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("language", "text")
    seen = ship(texts).mapInArrow(count, "language string, word string").groupBy("language", "word").agg(F.count(F.lit(1)).alias("n")).toPandas()
    languages, pieces = sorted(set(seen["language"])), vocabulary(vocabulary_path)
    words = sorted(set(seen["word"]))
    place, column = {w: i for i, w in enumerate(words)}, {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(words), len(languages)))
    counts[seen["word"].map(place).to_numpy(np.int64), seen["language"].map(column).to_numpy(np.int64)] = seen["n"].to_numpy(float)
    if not languages:
        return Model([], pieces, np.zeros((len(pieces) + 2, 0)), np.zeros(0))
    return Model(languages, pieces, expectation_maximisation(words, counts, pieces), np.full(len(languages), -np.log(len(languages))))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred and score (its posterior probability, all languages
    being equally likely before). A text that is null or has no letter is ``und`` with score 0, as is every text if no
    language was learned. Ties go to the first language by code point. A null id is not held out. Only id and text are read."""

    def run(batches):
        learn, total = model.scorer()
        for part in slices(batches, "text"):
            words = [words_of(t) for t in part.column(1).to_pylist()]
            if model.languages:
                learn(set().union(*words))
            found, score = [], []
            for w in words:
                if not w or not model.languages:
                    found.append("und")
                    score.append(0.0)
                    continue
                x = total(w) + model.prior
                x = np.exp(x - x.max())
                found.append(model.languages[int(x.argmax())])
                score.append(float(x.max() / x.sum()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string()), pa.array(score, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    out = ship(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
