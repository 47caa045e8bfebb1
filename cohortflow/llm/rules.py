"""Quality rules: base counts of a text, and Jensen-Shannon distances from language references.

Base rules look at one text: too few words, or too many of them in eight-word windows that come twice. The method compares
two histograms of a text with those of each language: its characters by class (:data:`CLASSES`), and its words as
the language's ``top`` commonest words and all others. The references are counted over every document whose language is
given and that the base rules pass. A text is held against the language it is nearest to. The distance is the root of the
Jensen-Shannon divergence to the base 2, so it lies between 0 and 1.

Histograms of short texts lie far from any reference by chance: of ``n`` draws over ``m`` classes the divergence is about
``(m - 1) / (8 n ln 2)``. The bounds widen by that much, and below a minimum length a histogram is not judged at all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import combine, cut_lineage, mix64, ship, slices

# Character classes. A byte of UTF-8 tells them; those that continue a character count for nothing.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c", "newline": b"\n", "sentence": b".,;:!?", "quote": b"'\"()-", "symbol": b"#*$%&|<>",
    "ascii": b"",                             # all other ASCII
    "latin": bytes(range(0xC3, 0xCA)),        # U+00C0 to U+027F
    "other": bytes([0xC2, *range(0xCA, 0xF5)]),
}
_NAMES = list(CLASSES)
_SYMBOL = _NAMES.index("symbol")
_CLASS = np.full(256, len(_NAMES), np.uint8)
_CLASS[:128] = _NAMES.index("ascii")
for _at, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes)] = _at

WINDOW = 8
_CHUNK = 1 << 22


@dataclass
class Reference:
    lang: str
    chars: np.ndarray       # share of each class
    words: dict[str, int]   # common word -> place
    shares: np.ndarray      # share of each common word, and of all others


@dataclass
class Limits:
    """Bounds of the base rules and of the distances; ``top`` common words a language, of languages with a thousandth of all words."""

    min_words: int = 20
    repeat_percent: int = 30
    top: int = 40
    char_bound: float = 0.32
    word_bound: float = 0.27
    judged_chars: int = 80
    judged_words: int = 20


# ------------------------------------------------------------------ counts of a slice of texts

class Counts:
    """Everything that is counted in a slice of whole texts, one entry a text."""

    def __init__(self, texts: pa.Array, limits: Limits):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        self.n = len(texts)
        self.classes = self._classes(texts)
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        self.dictionary = coded.dictionary
        at = coded.indices.to_numpy()
        length = pc.utf8_length(self.dictionary).to_numpy()  # white space at an end leaves an empty word
        real = length[at] > 0 if len(at) else np.zeros(0, bool)
        ends = np.r_[0, np.cumsum(real)][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        self.codes = at[real]
        self.words = np.diff(ends)
        self.doc = np.repeat(np.arange(self.n), self.words)
        self.word_chars = np.bincount(self.doc, length[self.codes], self.n).astype(np.int64)
        self.symbols = self.classes[:, _SYMBOL]
        self.repeated = self._repeated()
        self.failed = (self.words < limits.min_words) | (100 * self.repeated > limits.repeat_percent * self.words)

    def _classes(self, texts: pa.Array) -> np.ndarray:
        width = len(_NAMES) + 1
        out = np.zeros(self.n * width, np.int64)
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + self.n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        for lo in range(int(ends[0]), int(ends[-1]), _CHUNK):
            hi = min(lo + _CHUNK, int(ends[-1]))
            first, last = np.searchsorted(ends, [lo, hi - 1], "right") - 1
            inner = np.clip(ends[first:last + 2], lo, hi)
            doc = np.repeat(np.arange(last - first + 1), np.diff(inner))
            found = np.bincount(doc * width + _CLASS[data[lo:hi]], minlength=(last - first + 1) * width)
            out[first * width:(last + 1) * width] += found
        return out.reshape(self.n, width)[:, :-1]

    def _repeated(self) -> np.ndarray:
        """Words in windows that come twice or more in their text. Windows are sorted by hash; equal hashes are checked word
        for word, and hashed anew in the event of a clash."""
        m = len(self.codes) - WINDOW + 1
        if m <= 0:
            return np.zeros(self.n, np.int64)
        codes, whole = self.codes.astype(np.uint64), np.flatnonzero(self.doc[:m] == self.doc[WINDOW - 1:])
        for seed in range(1, 100):
            salt = mix64(codes + np.uint64(seed << 40))
            h = combine(salt, WINDOW)[whole] ^ mix64(self.doc[whole].astype(np.uint64) + np.uint64(seed))
            order = np.argsort(h, kind="stable")
            a, b = whole[order[:-1]], whole[order[1:]]
            same = h[order[:-1]] == h[order[1:]]
            a, b = a[same], b[same]
            if all(np.array_equal(codes[a + k], codes[b + k]) for k in range(WINDOW)) and np.array_equal(self.doc[a], self.doc[b]):
                break
        begins = np.zeros(len(codes) + 1, np.int64)
        hit = np.unique(np.r_[a, b])
        np.add.at(begins, hit, 1)
        np.add.at(begins, hit + WINDOW, -1)
        return np.bincount(self.doc[np.cumsum(begins[:-1]) > 0], minlength=self.n)

    def dup_lines(self, texts: pa.Array) -> np.ndarray:
        """Lines that hold a word and equal an earlier line of their text."""
        lists = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), "\n")
        coded = lists.flatten().dictionary_encode()
        real = pc.not_equal(pc.ascii_trim_whitespace(coded.dictionary), "").to_numpy(zero_copy_only=False)
        at = coded.indices.to_numpy()
        doc = np.repeat(np.arange(self.n), pc.list_value_length(lists).to_numpy())
        doc, at = doc[real[at]], at[real[at]]
        kinds = np.unique(doc * max(1, len(real)) + at) // max(1, len(real))
        return np.bincount(doc, minlength=self.n) - np.bincount(kinds, minlength=self.n)

    def lowered(self) -> pa.Array:
        return pc.ascii_lower(self.dictionary)


# ------------------------------------------------------------------ references

def _reference_rows(limits: Limits):
    """Rows (lang, kind, word, n): kind -1 counts the words of a language, -2 each of its words, others a character class."""
    def run(batches):
        for part in slices(batches, "text"):
            counts = Counts(part.column(1), limits)
            langs = part.column(0).dictionary_encode()
            names, of = langs.dictionary.to_pylist(), pc.fill_null(langs.indices, -1).to_numpy()
            low = counts.lowered().dictionary_encode()
            real = np.asarray(pc.utf8_length(low.dictionary)) > 0
            word_of = low.indices.to_numpy()[counts.codes] if len(counts.codes) else np.zeros(0, np.int64)
            for k, name in enumerate(names):
                mine = (of == k) & ~counts.failed
                if not mine.any():
                    continue
                n = np.bincount(word_of[mine[counts.doc]], minlength=len(low.dictionary))
                seen = np.flatnonzero((n > 0) & real)
                kinds = np.r_[np.arange(len(_NAMES)), -1, np.full(len(seen), -2)]
                total = np.r_[counts.classes[mine].sum(axis=0), counts.words[mine].sum(), n[seen]]
                word = pa.concat_arrays([pa.nulls(len(_NAMES) + 1, pa.string()), low.dictionary.take(pa.array(seen, pa.int64()))])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(kinds), pa.string()), pa.array(kinds, pa.int64()), word,
                                                  pa.array(total, pa.int64())], names=["lang", "kind", "word", "n"])
    return run


def references(docs: DataFrame, limits: Limits | None = None, text_col: str = "text", lang_col: str = "lang") -> list[Reference]:
    """One reference for each language that has a thousandth of all words at least (so at most 1000), by name. Counted over
    every document with a language that passes the base rules. Ties among common words go to the smaller word."""
    limits = limits or Limits()
    rows = ship(docs).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL")
    counted = cut_lineage(rows.mapInArrow(_reference_rows(limits), "lang string, kind long, word string, n long")
                          .groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")), "language-counts")
    total = counted.filter("kind = -1").agg(F.sum("n")).first()[0]
    if not total:
        return []
    sizes = {r.lang: r.n for r in counted.filter((F.col("kind") == -1) & (F.col("n") * 1000 >= total)).collect()}
    mine = counted.filter(F.col("lang").isin(list(sizes)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    words = mine.filter("kind = -2").withColumn("place", place).filter(F.col("place") <= limits.top).collect()
    chars = mine.filter("kind >= 0").collect()
    out = []
    for lang in sorted(sizes, key=lambda s: s.encode()):
        top = sorted((r for r in words if r.lang == lang), key=lambda r: r.place)
        hist = np.zeros(len(_NAMES))
        for r in chars:
            if r.lang == lang:
                hist[r.kind] = r.n
        n = np.array([r.n for r in top] + [sizes[lang] - sum(r.n for r in top)], float)
        out.append(Reference(lang, hist / hist.sum(), {r.word: at for at, r in enumerate(top)}, n / n.sum()))
    return out


# ------------------------------------------------------------------ verdicts

def js_distance(counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Root of the Jensen-Shannon divergence (base 2) of each row of counts from one distribution; 1 for a row of zeros."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    mid = (p + share) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / mid), 0).sum(axis=1) + np.where(share > 0, share * np.log2(share / mid), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip(d / 2, 0, 1)), 1.0)


def widened(bound: float, classes: int, n: np.ndarray) -> np.ndarray:
    """The bound for ``n`` draws: chance alone adds (classes - 1) / (8 n ln 2) to the divergence."""
    return np.sqrt(bound**2 + (classes - 1) / (8 * np.log(2) * np.maximum(n, 1)))


def _judge(refs: list[Reference], limits: Limits):
    def distances(counts: Counts):
        """(nearest language, distance of characters, of words), one entry a text."""
        low = counts.lowered().to_pylist()
        best = np.zeros(counts.n, np.int64)
        chars, words = np.full(counts.n, np.inf), np.full(counts.n, np.inf)
        for k, ref in enumerate(refs):
            m = len(ref.words) + 1
            place = np.array([ref.words.get(w, m - 1) for w in low], np.int64)
            hist = np.bincount(counts.doc * m + place[counts.codes], minlength=counts.n * m).reshape(counts.n, m) if len(low) else np.zeros((counts.n, m))
            c, w = js_distance(counts.classes, ref.chars), js_distance(hist, ref.shares)
            nearer = c + w < chars + words
            best[nearer], chars[nearer], words[nearer] = k, c[nearer], w[nearer]
        return best, chars, words

    def run(batches):
        for part in slices(batches, "text"):
            texts = part.column(1)
            counts = Counts(texts, limits)
            kept = ~counts.failed
            cols = [pa.nulls(counts.n, pa.string()), pa.nulls(counts.n, pa.float64()), pa.nulls(counts.n, pa.float64())]
            if refs:
                best, chars, words = distances(counts)
                size = counts.classes.sum(axis=1)
                by_chars, by_words = size >= limits.judged_chars, counts.words >= limits.judged_words
                kept &= ~(by_chars & (chars > widened(limits.char_bound, len(_NAMES), size)))
                kept &= ~(by_words & (words > widened(limits.word_bound, limits.top + 1, counts.words)))
                names = pa.array([r.lang for r in refs]).take(pa.array(best))
                cols = [pc.if_else(pa.array(by_chars | by_words), names, None), pa.array(chars, mask=~by_chars), pa.array(words, mask=~by_words)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c.astype(np.int64)) for c in (counts.words, counts.word_chars, counts.symbols, counts.dup_lines(texts), counts.repeated)),
                 pa.array(counts.failed), pa.array(kept), *cols],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                       "reference", "char_distance", "word_distance"])
    return run


def judge(docs: DataFrame, refs: list[Reference] | None = None, limits: Limits | None = None, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    and the nearest ``reference`` with its char_distance and word_distance (six decimals; null where the text is too short to be judged by
    them). ``refs`` are counted on ``docs`` unless given; without any, the base rules alone decide.

    A null, empty or blank text has no words and fails. A row's own language plays no part in its verdict, so a null one
    changes nothing. Null and repeated ids and repeated rows each have their own result; an empty table gives an empty one; other columns
    are ignored. Whole texts are read, of any length."""
    limits = limits or Limits()
    refs = references(docs, limits, text_col, lang_col) if refs is None else refs
    out = ship(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _judge(refs, limits), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, reference string, char_distance double, word_distance double")
    return out.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})
