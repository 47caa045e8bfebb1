"""Spelling variants by a bidirectional FM-index over the delimited vocabulary.

Two words are near if one inserted, deleted or replaced code point makes one of the other. A single error leaves one half of
a word as it is, so the search scheme has two parts: match the first half exactly and extend to the right across the second
with one error, or match the second half exactly and extend to the left across the first. The index holds the words of a
group, set between delimiters, as two Burrows-Wheeler transforms (of the text and of its reverse) in wavelet matrices; a pattern is a
pair of suffix-rank intervals, one in each, that stay in step when it grows at either end. All words of a group are
searched side by side, one step of numpy for all of them. What each word could be followed by is read off the wavelet matrix, so that
a step costs as much as there are continuations, not letters. A pattern delimited at both ends is one word, its rank the word's place.

A half has three code points at least, so near words agree in their first three or their last three: the vocabulary is dealt
twice, by those. Keys are packed into groups of about ``block`` words by hash; a key with more has blocks of its own, and each
block of words is searched for blocks of eight times as many. A word found by both parts is taken in the first. Each
group sends one row a word that found any: how many, and the best.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import starmap

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, grouped, ship, slices

#: Runs of letters after A-Z are lower-cased.
LETTERS = re.compile("[a-zÀ-ÿ]+")
HALF = 3
_SENTINEL, _EDGE = 0, 1  # symbols of the text's end and of a word's edge; letters follow


# ------------------------------------------------------------------ the index

class Wavelet:
    """Wavelet matrix of a sequence of small numbers."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.levels, self.ranks, self.zeros = levels, [], []
        cur = seq
        for level in range(levels - 1, -1, -1):
            bit = (cur >> level) & 1
            rank = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(1 - bit, out=rank[1:])
            self.ranks.append(rank)
            self.zeros.append(int(rank[-1]))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        symbols = np.arange(1 << levels)
        self.first = np.searchsorted(np.sort(seq), symbols)  # how many are smaller
        self.begin = self._down(symbols, np.zeros(1 << levels, np.int64), np.zeros(1 << levels, np.int64))[0]

    def _down(self, c, lo, hi):
        smaller = np.zeros(len(c), np.int64)
        for level, rank, zeros in zip(range(self.levels - 1, -1, -1), self.ranks, self.zeros, strict=True):
            one = ((c >> level) & 1).astype(bool)
            a, b = rank[lo], rank[hi]
            smaller += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - b, b)
        return lo, hi, smaller

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """For the symbols ``c`` in front of the suffixes lo to hi: their own interval, and how many smaller symbols stand there."""
        a, b, smaller = self._down(c, lo, hi)
        shift = self.first[c] - self.begin[c]
        return a + shift, b + shift, smaller

    def steps(self, lo: np.ndarray, hi: np.ndarray):
        """Every symbol in front of the suffixes lo to hi: (which interval, symbol, its own interval, smaller symbols)."""
        who, c, smaller = np.arange(len(lo)), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for rank, zeros in zip(self.ranks, self.zeros, strict=True):
            a, b = rank[lo].astype(np.int64), rank[hi].astype(np.int64)
            left, right = np.flatnonzero(b > a), np.flatnonzero(hi - lo > b - a)
            smaller = np.concatenate([smaller[left], smaller[right] + (b - a)[right]])
            c = np.concatenate([2 * c[left], 2 * c[right] + 1])
            who = np.concatenate([who[left], who[right]])
            lo, hi = np.concatenate([a[left], (zeros + lo - a)[right]]), np.concatenate([b[left], (zeros + hi - b)[right]])
        shift = self.first[c] - self.begin[c]
        return who, c, lo + shift, hi + shift, smaller


def suffixes(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array by doubling. The last symbol is the smallest and comes nowhere else."""
    n, width = len(text), 62 // bits
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = (key << bits) | np.r_[text[k:], np.zeros(min(k, n), np.int64)][:n]
    while True:
        order = np.argsort(key, kind="stable")
        new = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank * (n + 1) + np.r_[rank[width:] + 1, np.zeros(min(width, n), np.int64)][:n]
        width *= 2


class Index:
    """Bidirectional FM-index of distinct words in code-point order."""

    def __init__(self, words: list[str]):
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.letters = np.unique(points)
        length = np.fromiter(map(len, words), np.int64, len(words))
        self.bits = int(len(self.letters) + 1).bit_length()
        body = np.full(len(points) + len(words) + 1, _EDGE, np.int64)
        at = np.arange(len(points)) + 1 + np.repeat(np.arange(len(words)), length)
        body[at] = np.searchsorted(self.letters, points) + 2
        self.body, self.words, self._sides = body, words, {}

    def _side(self, right: bool) -> Wavelet:
        """The transform that grows patterns to the right (that of the reversed text) or to the left; built when first used."""
        if right not in self._sides:
            text = np.r_[self.body[::-1] if right else self.body, _SENTINEL]
            self._sides[right] = Wavelet(text[suffixes(text, self.bits) - 1], self.bits)
        return self._sides[right]

    def code(self, words: list[str]) -> np.ndarray:
        """Symbols of the words end to end; letters that the index lacks are its largest symbol plus one, which never follows."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.letters, points)
        known = at < len(self.letters)
        known[known] = self.letters[at[known]] == points[known]
        return np.where(known, at + 2, len(self.letters) + 2)

    def whole(self, n: int):
        """``n`` patterns of one edge: the interval in the text's suffixes, and in those of its reverse."""
        lo, hi = np.full(n, 1, np.int64), np.full(n, len(self.words) + 2, np.int64)
        return lo, hi, lo.copy(), hi.copy()

    def grow(self, right: bool, c: np.ndarray, at):
        """Patterns grown by one symbol each at the right or left end; empty intervals for those that do not occur."""
        lo, hi, rlo, rhi = at
        known = c < len(self.letters) + 2
        x = np.where(known, c, _EDGE)
        a, b, smaller = self._side(right).step(x, *((rlo, rhi) if right else (lo, hi)))
        b = np.where(known, b, a)
        if right:
            return lo + smaller, lo + smaller + (b - a), a, b
        return a, b, rlo + smaller, rlo + smaller + (b - a)

    def grown(self, right: bool, at):
        """Every way to grow the patterns by one symbol: (which pattern, symbol, the grown patterns)."""
        lo, hi, rlo, rhi = at
        who, c, a, b, smaller = self._side(right).steps(*((rlo, rhi) if right else (lo, hi)))
        if right:
            base = lo[who] + smaller
            return who, c, (base, base + (b - a), a, b)
        base = rlo[who] + smaller
        return who, c, (a, b, base, base + (b - a))

    def near(self, words: list[str], right: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``words``, place in the index) one error apart: with the first half exact and the error to its right,
        or the second half exact and the error to its left. Each pair comes once."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        half = size // 2 if right else size - size // 2
        flat, base = self.code(words), np.r_[0, np.cumsum(size)[:-1]] if len(words) else np.zeros(0, np.int64)

        def letter(q, p):
            """The p-th letter in the direction of the search; an edge past the last."""
            inside = p < size[q]
            i = np.where(inside, base[q] + (p if right else size[q] - 1 - p), 0)
            return np.where(inside, flat[i], _EDGE)

        def live(q, p, at):
            keep = np.flatnonzero(at[1] > at[0])
            return q[keep], p[keep], tuple(x[keep] for x in at)

        q = np.arange(len(words))
        p, at = np.zeros(len(words), np.int64), self.whole(len(words))
        clean = [np.zeros(0, np.int64), np.zeros(0, np.int64), tuple(np.zeros(0, np.int64) for _ in range(4))]
        while len(q):  # the exact half
            done = p == half[q]
            if done.any():
                clean = _both(clean, (q[done], p[done], tuple(x[done] for x in at)))
                q, p, at = q[~done], p[~done], tuple(x[~done] for x in at)
            q, p, at = live(q, p + 1, self.grow(right, letter(q, p), at))
        found = []
        spoilt = [np.zeros(0, np.int64), np.zeros(0, np.int64), tuple(np.zeros(0, np.int64) for _ in range(4))]
        while len(clean[0]) or len(spoilt[0]):
            # one error made: only the word's own letters, and its edge at the end, may follow
            q, p, at = spoilt
            over = p == size[q]
            q, p, at = live(q, p + 1, self.grow(right, letter(q, p), at))
            over = p == size[q] + 1
            found.append((q[over], at[0][over]))
            spoilt = [q[~over], p[~over], tuple(x[~over] for x in at)]
            # none yet: leave a letter out (of a run of equal ones the last), put one in or in place of another, or go on
            q, p, at = clean
            own, after = letter(q, p), letter(q, p + 1)
            out = np.flatnonzero((p < size[q]) & (own != after))
            spoilt = _both(spoilt, (q[out], p[out] + 1, tuple(x[out] for x in at)))
            who, c, more = self.grown(right, at)
            other = np.flatnonzero((c > _EDGE) & (c != own[who]))
            who, more = who[other], tuple(x[other] for x in more)
            spoilt = _both(spoilt, (q[who], p[who], more))
            inside = np.flatnonzero(p[who] < size[q[who]])
            spoilt = _both(spoilt, (q[who[inside]], p[who[inside]] + 1, tuple(x[inside] for x in more)))
            on = np.flatnonzero(p < size[q])
            q, p, at = q[on], p[on], tuple(x[on] for x in at)
            clean = live(q, p + 1, self.grow(right, letter(q, p), at))
        q, rank = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return q, rank - 2  # the text's end and its last edge come before the first word


def _both(a, b):
    return [np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), tuple(map(np.concatenate, zip(a[2], b[2], strict=True)))]


# ------------------------------------------------------------------ words of the documents

def _counted(drop_every: int | None, least: int):
    def words(doc: bytes, text: str, held: Counter):
        for run, n in Counter(LETTERS.findall(text)).items():
            if drop_every:
                h = zlib.crc32(run.encode(), zlib.crc32(doc))
                if h % drop_every == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1:]
            if len(run) >= least:
                held[run] += n

    def run(batches):
        for part in slices(batches, "text"):
            held: Counter = Counter()
            low = pc.ascii_lower(pc.fill_null(part.column(1).cast(pa.string()), ""))
            for doc, text in zip(part.column(0), low, strict=True):
                words(f"{doc.as_py() or ''}:".encode(), text.as_py(), held)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
    return run


def vocabulary(docs: DataFrame, min_length: int = 6, min_count: int = 5, drop_every: int | None = None, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Words of whole texts with their counts (word, n): runs of letters (:data:`LETTERS`, A-Z lower-cased) of ``min_length`` code points
    at least that come ``min_count`` times at least. With ``drop_every`` a run loses one letter where that number divides
    the crc32 of ``<id>:<run>`` (a null id is empty): misspellings to test with, the same on every run."""
    rows = ship(docs).select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(_counted(drop_every, min_length), "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ------------------------------------------------------------------ near words

def _search(chunk: int = 8192):
    """Groups of (grp, side, word, n, is_index, is_query), one side each, to rows (word, n_near, best_n, best)."""
    def run(batches):
        for g in grouped(batches, "grp"):
            right = g.column(1)[0].as_py() == 0
            base = g.filter(g.column(4)).select([2, 3]).sort_by("word")
            ask = g.filter(g.column(5)).column(2).to_pylist()
            words, n = base.column(0).to_pylist(), base.column(1).to_numpy()
            if not words or not ask:
                continue
            index = Index(words)
            for lo in range(0, len(ask), chunk):
                own = ask[lo:lo + chunk]
                q, v = index.near(own, right)
                if not right:  # those that keep the first half too were found to its right
                    twice = starmap(lambda i, j: words[j].startswith(own[i][:len(own[i]) // 2]), zip(q.tolist(), v.tolist(), strict=True))
                    keep = ~np.fromiter(twice, bool, len(q))
                    q, v = q[keep], v[keep]
                if not len(q):
                    continue
                order = np.lexsort((v, -n[v], q))
                q, v = q[order], v[order]
                first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own[i] for i in q[first]], pa.string()), pa.array(np.diff(np.r_[first, len(q)])),
                     pa.array(n[v[first]]), pa.array([words[j] for j in v[first]], pa.string())], names=["word", "n_near", "best_n", "best"])
    return run


def near_words(words: DataFrame, block: int = 50_000) -> DataFrame:
    """For each word that has any near word in ``words`` (word, n; distinct, six code points at least): word, n_near, best_n and best,
    the near word of largest n (ties: the smallest)."""
    total = words.count()
    groups, wide = max(1, -(-2 * total // block)), 8 * block
    sides = F.array(F.struct(F.lit(0).alias("side"), F.left("word", F.lit(HALF)).alias("key")),
                    F.struct(F.lit(1).alias("side"), F.right("word", F.lit(HALF)).alias("key")))
    dealt = words.select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.side", "s.key")
    heavy = dealt.groupBy("side", "key").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > block)
    rows = dealt.join(heavy, ["side", "key"], "left")
    own, mine = (F.pmod(F.xxhash64("word", F.lit(seed)), F.ceil(F.coalesce("many", F.lit(1)) / size))
                 for seed, size in ((1, block), (2, wide)))
    rows = rows.select("side", "key", "word", "n", "many", own.alias("own"), mine.alias("mine"))
    # a heavy key: every word goes as one to be found to each block of questions, and as a question to each block of words
    light = rows.filter("many IS NULL").select(
        (2 * F.pmod(F.xxhash64("key"), F.lit(groups)) + F.col("side")).alias("grp"), "side", "word", "n", F.lit(True).alias("is_index"), F.lit(True).alias("is_query"))
    label = 2 * groups + F.pmod(F.xxhash64("side", "key", "own", "mine"), F.lit(1 << 60)) * 2 + F.col("side")
    big = rows.filter("many IS NOT NULL")
    found = big.withColumn("mine", F.explode(F.sequence(F.lit(0), F.ceil(F.col("many") / wide) - 1))).select(
        label.alias("grp"), "side", "word", "n", F.lit(True).alias("is_index"), F.lit(False).alias("is_query"))
    asked = big.withColumn("own", F.explode(F.sequence(F.lit(0), F.ceil(F.col("many") / block) - 1))).select(
        label.alias("grp"), "side", "word", "n", F.lit(False).alias("is_index"), F.lit(True).alias("is_query"))
    spread = light.unionByName(found).unionByName(asked).repartitionById(2 * groups, F.pmod("grp", F.lit(2 * groups)).cast("int"))
    return ship(spread).sortWithinPartitions("grp").mapInArrow(_search(), "word string, n_near long, best_n long, best string").groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row (word, form): forms followed to the last. Every round doubles the way gone."""
    cur = cut_lineage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut_lineage(cur.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if further.filter("moved").isEmpty():
            return cur
        cur = further.drop("moved")


def variants(words: DataFrame, ratio: int = 5, block: int = 50_000) -> DataFrame:
    """One row for each word of ``words`` (word, n; see :func:`vocabulary`): word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n (ties: the smallest in code-point order), if that n is ``ratio`` (2 at least) times the word's own or more; ``root`` is the
    last of its forms, or the word. Words must be distinct, not null and have six code points or more; others are left out. Other
    columns are ignored; an empty table gives an empty result."""
    words = cut_lineage(words.select("word", "n").filter(F.length("word") >= 2 * HALF), "vocabulary")
    near = near_words(words, block)
    takes = F.col("best_n") >= ratio * F.col("n")
    got = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n")), "forms")
    last = roots(got.filter("form IS NOT NULL"))
    return got.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
