"""Packing tokenised documents into sequences of fixed length by swap-based local search.

Spark tokenises where the documents are (whole texts; a bounded memo holds the ids of runs of letters), keeps one small row for
each piece, and deals the pieces into shards of a bounded number of rows. Each shard is packed on its own: best fit
in descending order of length gives a start; local search then takes the emptiest bin and moves its pieces out, by a
plain move, a one-for-one or a two-for-one exchange with a fuller bin. Each step shifts ids from an emptier bin to a
fuller one, so the sum of squared fills grows and the search ends. It ends earlier at the lower bound, or when ``patience``
bins in a row resist; two-for-one exchanges look at the pairs at most three places apart in a bin. Both only bound the
search: no piece is left out. A shard can waste at most what its own search leaves, so shards are large.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, ship, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- tokens

class WordIds:
    """Ids of whole texts, word by word: the vocabulary's splitter never joins over white space, and always parts a run
    of letters from the punctuation behind it. So a word's ids are those of its letters and those of its tail. Each
    distinct word of a slice is looked at once, and only letters that are new go through the tokenizer, many at a time."""

    TAIL = b".,!?;:|$%&*#"  # no apostrophe: the splitter treats some of its uses as one with letters

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.letters: dict[str, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}
        self.limit = limit
        ends = [i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]
        self.ends = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.ends[ends] = True

    def _each(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(words), 20_000):
            found = self.tok.encode_batch_fast(words[lo:lo + 20_000], add_special_tokens=False)
            out.extend(np.array(e.ids, "<u4").tobytes() for e in found)
        return out

    def _runs(self, runs: list[str]) -> list[bytes]:
        """Ids of runs of letters: one text of all of them, cut where a word's last id is."""
        ids = np.array(self.tok.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, "<u4")
        last = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(last) != len(runs):  # a letter whose lower case isn't only letters
            return self._each(runs)
        cut, first = ids.tobytes(), 0
        out = []
        for end in last.tolist():
            out.append(cut[first:end])
            first = end
        return out

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of some distinct words."""
        letters, tails = self.letters, self.tails
        if len(letters) > self.limit:
            letters.clear()
        if len(tails) > self.limit // 10:
            tails.clear()
            tails[b""] = b""
        keys: list = []
        for w in words:
            head = w.rstrip(self.TAIL)
            run = head.decode()
            keys.append((run.lower() if run.isascii() else run, w[len(head):]) if run.isalpha() else None)
        runs = list({k[0] for k in keys if k}.difference(letters))
        for lo in range(0, len(runs), 20_000):
            letters.update(zip(runs[lo:lo + 20_000], self._runs(runs[lo:lo + 20_000]), strict=True))
        new = list({k[1] for k in keys if k}.difference(tails))
        tails.update(zip(new, self._each([t.decode() for t in new]), strict=True))
        whole = iter(self._each([w.decode() for w, k in zip(words, keys, strict=True) if not k]))
        return [letters[k[0]] + tails[k[1]] if k else next(whole) for k in keys]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts, end to end, and where each text's begin (one more than there are texts)."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        each = self.words(coded.dictionary.cast(pa.binary()).to_pylist())
        n = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat, start, at = np.frombuffer(b"".join(each), "<u4"), np.cumsum(n) - n, coded.indices.to_numpy()
        length = n[at]
        ends = np.cumsum(length)
        place = np.repeat(start[at] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)
        return flat[place], np.r_[0, ends][lists.offsets.to_numpy()]


_TOKENIZERS: dict[str, WordIds] = {}


def _tokens(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, vocabulary: str, length: int, end_id: int, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row for each piece of each document: ids of the whole text and ``end_id``, cut only where longer."""

    def run(batches):
        ids_of, end = _tokens(vocabulary), np.array([end_id], "<u4").tobytes()
        for part in slices(batches, "text"):
            every, at = ids_of(part.column(1))
            rows = []
            for d, lo, hi in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                ids = every[lo:hi].tobytes() + end
                for k, x in enumerate(range(0, len(ids), 4 * length)):
                    cut = ids[x:x + 4 * length]
                    rows.append((d, k, x // 4, len(cut) // 4, zlib.crc32(cut)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
        ids_of.letters.clear()  # a worker that waits for its next task holds no memo

    return ship(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
                       ).mapInArrow(run, PIECES)


# ---------------------------------------------------------------- one shard

def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit in descending order: each piece goes to the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted distinct rooms that some open bin has
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        at = bisect.bisect_left(rooms, s)
        if at == len(rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
        bins[b].append(i)
        if room - s:
            if room - s not in by_room:
                by_room[room - s] = []
                bisect.insort(rooms, room - s)
            by_room[room - s].append(b)
    return bins


class _Search:
    """Local search over the bins of one shard."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.sizes, self.bins, self.capacity = sizes, bins, capacity
        self.bin_of = np.empty(len(sizes), np.int64)
        for b, items in enumerate(bins):
            self.bin_of[items] = b
        self.fill = np.bincount(self.bin_of, weights=sizes, minlength=len(bins)).astype(np.int64)

    def _put(self, item: int, b: int) -> None:
        a = self.bin_of[item]
        self.bins[a].remove(item)
        self.bins[b].append(item)
        self.bin_of[item] = b
        self.fill[a] -= self.sizes[item]
        self.fill[b] += self.sizes[item]

    def _targets(self, source: int) -> np.ndarray:
        ok = (self.fill >= self.fill[source]) & (self.fill < self.capacity) & (self.fill > 0)
        ok[source] = False
        return ok

    def _step(self, source: int) -> bool:
        """One improving move or exchange out of ``source``; False if there is none."""
        ok = self._targets(source)
        room = np.where(ok, self.capacity - self.fill, -1)
        items = sorted(self.bins[source], key=lambda i: (-self.sizes[i], i))
        for p in items:  # move: the fullest bin that takes it
            s = self.sizes[p]
            fits = np.flatnonzero(room >= s)
            if len(fits):
                self._put(p, int(fits[np.argmin(room[fits])]))
                return True
        held = np.flatnonzero(ok[self.bin_of])
        size, its_room = self.sizes[held], room[self.bin_of[held]]
        for p in items:  # one for one: the exchange that shifts most
            gain = self.sizes[p] - size
            fits = np.flatnonzero((gain > 0) & (gain <= its_room))
            if len(fits):
                q = int(held[fits[np.argmax(gain[fits])]])
                b = int(self.bin_of[q])
                self._put(q, source)
                self._put(p, b)
                return True
        order = held[np.argsort(self.bin_of[held], kind="stable")]
        for gap in (1, 2, 3):  # two for one, over pairs that lie close in the same bin
            a, b = order[:-gap], order[gap:]
            same = self.bin_of[a] == self.bin_of[b]
            a, b = a[same], b[same]
            both, r = self.sizes[a] + self.sizes[b], room[self.bin_of[a]]
            for p in items:
                gain = self.sizes[p] - both
                fits = np.flatnonzero((gain > 0) & (gain <= r))
                if len(fits):
                    k = fits[np.argmax(gain[fits])]
                    t = int(self.bin_of[a[k]])
                    self._put(int(a[k]), source)
                    self._put(int(b[k]), source)
                    self._put(p, t)
                    return True
        return False

    def run(self, patience: int) -> None:
        """Empty the emptiest bins until the lower bound is met or ``patience`` bins in a row resist."""
        least = -(-int(self.sizes.sum()) // self.capacity)
        stuck: set[int] = set()
        resisted = 0
        while resisted < patience and np.count_nonzero(self.fill) > least:
            order = np.argsort(np.where(self.fill > 0, self.fill, self.capacity + 1), kind="stable")
            source = next((int(b) for b in order[:len(stuck) + 1] if int(b) not in stuck and self.fill[b]), None)
            if source is None:
                break
            while self.bins[source] and self._step(source):
                pass
            if self.bins[source]:
                stuck.add(source)
                resisted += 1
            else:
                resisted = 0


def pack_sizes(sizes: np.ndarray, capacity: int, patience: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size; bins are numbered from 0 without gaps."""
    sizes = np.asarray(sizes, np.int64)
    search = _Search(sizes, best_fit(sizes, capacity), capacity)
    search.run(patience)
    bin_of, offset, n = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for items in search.bins:
        if items:
            items = sorted(items)
            bin_of[items], offset[items] = n, np.cumsum([0, *sizes[items][:-1]])
            n += 1
    return bin_of, offset


def pack(docs: DataFrame, vocabulary: str, length: int = 4096, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", shard_rows: int = 100_000, patience: int = 40) -> DataFrame:
    """Pack every document of ``docs`` into sequences of at most ``length`` ids.

    Returns one row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text
    is the single ``end_id``. Rows that repeat an id are packed as often as they come. A null id stays null. An empty
    table gives no rows. Other columns of ``docs`` are not read. ``shard_rows`` is the mean number of
    pieces that one task packs: shards are as few as that allows, and no piece is left out. Pieces are dealt by a hash of
    (id, piece, ids), so rows that agree in all three meet in one shard. ``patience``: bins in a row that may resist.
    """
    cut = cut_lineage(pieces(docs, vocabulary, length, end_id, id_col, text_col), "pieces")
    n = cut.filter(F.col("length") < length).count()
    shards = max(1, -(-n // shard_rows))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", na_position="first")
        bins, offset = pack_sizes(pdf["length"].to_numpy(), length, patience)
        return pdf.drop(columns="shard").assign(sequence_id=(bins * shards + pdf["shard"].to_numpy()) * 2, offset=offset)

    open_ = cut.filter(F.col("length") < length).withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    full = cut.filter(F.col("length") == length).select(
        "*", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed = open_.groupBy("shard").applyInPandas(shard, f"{PIECES}, sequence_id long, offset long")
    return packed.unionByName(full)
