"""Removing passages that repeat across documents, by prefix-partitioned suffix trees over words.

Every position of a document starts a suffix. Only tree nodes at a depth of ``window`` words or more count. They are
found in two steps.

Candidates: of the ``SPAN`` shorter runs of words that a window holds, the one with the least hash stands for it, so that
windows with equal words are stood for by equal runs, and about one suffix in three is dealt: its run's hash (the label) goes to a group by a
prefix of variable length: one word, or as many more as it takes until the prefix has few enough suffixes (counted over
the whole corpus) to be held in memory; what is still too common after ``DEPTHS`` is dealt by its whole label. Small
prefixes share a group. Equal labels always meet: they have the same prefixes. A label that two documents have goes back
to them; neighbouring windows with such labels join into regions, and every repeat lies inside one region of each document.

Trees: a repeat that can't grow to the left starts at a window that somewhere has another word before it (a fork: 32 bits of
each of the ``SPAN`` words before a run travel with its label, and the answer tells at which of them occurrences part), or which
starts a region. Only suffixes that start there go on, as word hashes up to the end of the region. They are dealt by
the least hash of ``KEY`` words in their first window, so that neighbouring suffixes of a region mostly travel as one piece, and
where such a key has more than ``TREE_WORDS`` words by the whole first window;
equal pieces travel once, with their smallest document. A task sorts the suffixes of its pieces by their words, and the
common prefixes of neighbours give the internal nodes. Of the nodes above a suffix, the deepest with a smaller document is
its repeat: its depth is the length, its smallest document the owner. Labels only choose candidates; every word of a
repeat is compared.

Within a slice of documents a label's later documents travel apart from its smallest one, without the word before, but to the
same group: a passage that half the corpus shares costs its group seven or eight bytes a label for each document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import combine, cut_lineage, grouped, mix64, ship, slice_words, slices

DEPTHS = (1, 2, 3, 5)
SPAN = 5
KEY = 4
TREE_WORDS, BATCH_WORDS = 4_000_000, 250_000
LABEL = 6  # bytes that travel of a label
_LABEL = np.uint64((1 << 8 * LABEL) - (1 << SPAN))  # its last bits tell forks
ROWS = "grp int, base long, steps binary, labels binary, before binary, base2 long, steps2 binary, labels2 binary"


def _pack(x: np.ndarray, n: int) -> bytes:
    """The low ``n`` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _unpack(x: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(x) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(x, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


def _run(window: int) -> int:
    """Words of the runs that stand for windows."""
    return max(1, window - SPAN + 1)


def standing(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the words ``h`` the place of the run that stands for it (the first of the least), and the hash of the run at each place."""
    run = _run(window)
    gram, n = combine(h, run), len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), gram
    coarse = gram & ~np.uint64(7)  # the last bits hold how far on a run is, so that the first of equal ones is the least
    best = coarse[:n].copy()
    for k in range(1, window - run + 1):
        np.minimum(best, coarse[k:k + n] + np.uint64(k), out=best)
    return np.arange(n) + (best & np.uint64(7)).astype(np.int64), gram


def _suffixes(part: pa.RecordBatch, window: int):
    """Of a slice: word hashes laid end to end, the row of each, and the places of the runs that stand for windows, with their hashes."""
    h, at = slice_words(part.column(1))
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
    place, gram = standing(h, window)
    inside = (row[:len(place)] == row[window - 1:]) & known[row[:len(place)]] if len(place) else np.empty(0, bool)
    starts = np.unique(place[inside])
    return h, row, starts, gram[starts]


def _words_before(h: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """32 bits of each of the ``SPAN`` words before each place, the nearest first; 0 stands for those before a document's first."""
    out = np.zeros((len(at), SPAN), "<u4")
    for k in range(1, SPAN + 1):
        own = (at >= k) & (row[at - k] == row[at])
        out[:, k - 1] = np.where(own, np.maximum(h[at - k].astype(np.uint32), 1), 0)
    return out


def _parting(label: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels (sorted, those that fork) and, as bits, at which words before them two occurrences part that agree in all nearer ones."""
    whole = before[:, 0].astype(np.uint64)
    for k in range(1, SPAN):
        whole = mix64(whole) + before[:, k]
    order = np.argsort(label, kind="stable")
    first = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]])
    apart = np.minimum.reduceat(whole[order], first) < np.maximum.reduceat(whole[order], first)
    keep = order[np.repeat(apart, np.diff(np.r_[first, len(order)]))]
    if not len(keep):
        return label[:0], np.empty(0, np.uint64)
    keep = keep[np.lexsort((*before[keep].T[::-1], label[keep]))]
    label, before = label[keep], before[keep]
    new = np.r_[True, label[1:] != label[:-1]]
    bits, open_ = np.zeros(len(label), np.uint64), ~new
    for k in range(SPAN):
        part = open_ & np.r_[False, before[1:, k] != before[:-1, k]]
        bits[part] = 1 << k
        open_ &= ~part
    first = np.flatnonzero(new)
    return label[first], np.bitwise_or.reduceat(bits, first)


def _buckets(h: np.ndarray, starts: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    return (combine(h, depth)[starts] >> np.uint64(40)).astype(np.int64) % buckets


def table_size(text_bytes: int, group_suffixes: int) -> int:
    """Buckets for prefixes at each depth: sixteen for each group that is to be expected (a word and its blank take six bytes, say),
    2^14 at least and 2^22 at most (128 MB of counts). The number decides where suffixes meet, not what is found."""
    groups = max(1, text_bytes // 6 // group_suffixes)
    return 1 << min(22, max(14, (16 * groups - 1).bit_length()))


def _prefix_counts(docs: DataFrame, window: int, group_suffixes: int) -> np.ndarray:
    """Suffixes to be dealt by hashed prefix at each of DEPTHS, from the counts of all prefixes (runs that stand for windows start at two in
    SPAN + 1 places): one bounded array."""
    buckets = table_size(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, group_suffixes)

    def run(batches):
        total = np.zeros((len(DEPTHS), buckets), np.int64)
        for part in slices(batches, "text"):
            h, _ = slice_words(part.column(1))
            for k, depth in enumerate(DEPTHS):
                total[k] += np.bincount(_buckets(h, slice(None), min(depth, _run(window)), buckets), minlength=buckets)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k * buckets + b), pa.array(total[k, b])], names=["slot", "n"])

    out = np.zeros(len(DEPTHS) * buckets, np.int64)
    for r in docs.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.slot] = -(-2 * r.n // (SPAN + 1))
    return out.reshape(len(DEPTHS), buckets)


def plan_groups(counts: np.ndarray, group_suffixes: int) -> tuple[np.ndarray, int]:
    """For each depth and bucket the group of that prefix, or -1 where it has to be extended; the number of groups.
    Prefixes are put into groups in natural order, each group being closed when it is full."""
    groups = np.full(counts.shape, -1, np.int64)
    total = max(1, int(counts[0].sum()))
    n = max(1, -(-total // group_suffixes))
    for k in range(len(counts)):
        small = np.flatnonzero((counts[k] > 0) & (counts[k] <= group_suffixes))
        size = np.cumsum(counts[k][small])
        # deeper prefixes are counted over all suffixes, so they are spread over all groups again
        groups[k][small] = (size - 1) // group_suffixes % n if len(small) else 0
    return groups, n


def _route(h, starts, labels, groups, n, run):
    out = np.full(len(starts), -1, np.int64)
    for k, depth in enumerate(DEPTHS):
        left = np.flatnonzero(out < 0)
        if not len(left):
            break
        out[left] = groups[k][_buckets(h, starts[left], min(depth, run), groups.shape[1])]
    left = out < 0
    out[left] = (labels[left] % np.uint64(n)).astype(np.int64)
    return out


def _steps(doc: np.ndarray) -> tuple[int, bytes]:
    d = np.diff(doc, prepend=doc[:1])
    most = int(d.max()) if len(d) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return int(doc[0]) if len(doc) else 0, d.astype(f"<u{width}").tobytes()


def _unsteps(base: int, steps: bytes, n: int) -> np.ndarray:
    return base + np.cumsum(np.frombuffer(steps, f"<u{len(steps) // n}").astype(np.int64)) if n else np.empty(0, np.int64)


def _deal(window: int, groups: np.ndarray, n: int):
    def run(batches):
        for part in slices(batches, "text"):
            h, row, starts, label = _suffixes(part, window)
            if not len(starts):
                continue
            ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            label, doc = label & _LABEL, ids[row[starts]]
            order = np.lexsort((doc, label))
            label, doc, at = label[order], doc[order], starts[order]
            new = np.r_[True, label[1:] != label[:-1]]
            before = _words_before(h, row, at)
            least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            again = np.r_[False, (label[1:] == label[:-1]) & (doc[1:] == doc[:-1])]
            later = (doc > least) & ~again
            grp = _route(h, at, label, groups, n, _run(window))
            rows = []
            # one record for a label and its least document, and more if the words before it differ within the slice
            other = np.flatnonzero(~new & (before != before[np.flatnonzero(new)[np.cumsum(new) - 1]]).any(axis=1))
            keep = np.r_[np.flatnonzero(new), other, np.flatnonzero(later)]
            doc = np.r_[doc[new], least[other], doc[later]]
            later = np.repeat([False, True], [len(keep) - later.sum(), later.sum()])
            grp, label, before = grp[keep], label[keep], before[keep]
            keep = np.lexsort((doc, later, grp))
            g, lat = grp[keep], later[keep]
            cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(g)], strict=True):
                mid = lo + int(np.count_nonzero(~lat[lo:hi]))
                one, two = keep[lo:mid], keep[mid:hi]
                rows.append((int(g[lo]), *_steps(doc[one]), _pack(label[one], LABEL), before[one].tobytes(),
                             *_steps(doc[two]), _pack(label[two], LABEL)))
            types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                             names=["grp", "base", "steps", "labels", "before", "base2", "steps2", "labels2"])
    return run


def _places(doc: np.ndarray, n: int) -> np.ndarray:
    return (doc ^ (doc >> 15) ^ (doc >> 31)) % n


def _place(id_col, text_col, n: int):
    """The same in Spark; rows with a null id are spread by their text."""
    d = F.coalesce(id_col, F.xxhash64(text_col))
    return F.pmod(d.bitwiseXOR(F.shiftright(d, 15)).bitwiseXOR(F.shiftright(d, 31)), F.lit(n)).cast("int")


def _nodes(places: int):
    """The labels of each group that two documents have, with all documents that have them, and whether they fork to the left.
    The answers go back packed by the place of the document."""
    def run(batches):
        for group in grouped(batches, "grp"):
            col = {n: group.column(i).to_pylist() for i, n in enumerate(group.schema.names)}
            one, two = (_unpack(b"".join(col[n]), LABEL) for n in ("labels", "labels2"))
            doc = np.concatenate([_unsteps(b, s, len(x) // LABEL) for base, steps, labels in (("base", "steps", "labels"), ("base2", "steps2", "labels2"))
                                  for b, s, x in zip(col[base], col[steps], col[labels], strict=True)])
            fork, bits = _parting(one, np.frombuffer(b"".join(col["before"]), "<u4").reshape(-1, SPAN))
            label = np.r_[one, two]
            order = np.lexsort((doc, label))
            label, doc = label[order], doc[order]
            new = np.r_[True, label[1:] != label[:-1]]
            first, node = np.flatnonzero(new), np.cumsum(new) - 1
            if len(fork):
                at = np.minimum(np.searchsorted(fork, label), len(fork) - 1)
                label = np.where(fork[at] == label, label | bits[at], label)
            shared = doc[first] < doc[np.r_[first[1:], len(doc)] - 1]
            hit = shared[node] & (new | np.r_[True, doc[1:] != doc[:-1]])
            doc, label = doc[hit], label[hit]
            if not len(doc):
                continue
            place = _places(doc, places)
            order = np.lexsort((doc, place))
            doc, label, place = doc[order], label[order], place[order]
            cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            rows = [(int(place[a]), *_steps(doc[a:b]), _pack(label[a:b], LABEL)) for a, b in zip(cuts, np.r_[cuts[1:], len(doc)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["__place", "__base", "__steps", "__labels"])
    return run


def _candidates(docs: DataFrame, window: int, group_suffixes: int) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) and, ahead of each place's rows, the labels that its documents share with others:
    both reach a place by one shuffle, sorted so that a task holds one place's labels and streams its texts."""
    narrow = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    groups, n = plan_groups(_prefix_counts(narrow, window, group_suffixes), group_suffixes)
    places = n // 2 * 2 + 1
    dealt = narrow.mapInArrow(_deal(window, groups, n), ROWS)
    hits = dealt.repartitionById(n, F.col("grp")).sortWithinPartitions("grp").mapInArrow(
        _nodes(places), "__place int, __base long, __steps binary, __labels binary").withColumn("__kind", F.lit(0))
    rows = narrow.filter("doc_id IS NOT NULL").select(
        "doc_id", "text", _tag("text").alias("tag"), _place(F.col("doc_id"), F.col("text"), places).alias("__place"), F.lit(1).alias("__kind"))
    both = rows.unionByName(hits, allowMissingColumns=True)
    return both.repartitionById(places, F.col("__place")).sortWithinPartitions("__place", "__kind").select(
        "doc_id", "text", "tag", "__place", "__kind", "__base", "__steps", "__labels")


def _tag(text_col: str):
    """Tells rows of one id apart."""
    return F.xxhash64(F.col(text_col).cast("binary"))


class _Labels:
    """Covered labels of one place, by document."""

    def __init__(self):
        self.parts, self.doc, self.label = [], np.empty(0, np.int64), np.empty(0, np.uint64)

    def add(self, base, steps, labels) -> None:
        self.parts.append((_unsteps(base, steps, len(labels) // LABEL), _unpack(labels, LABEL)))

    def of(self, doc) -> np.ndarray:
        if self.parts:
            doc_, label = np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts])
            order = np.lexsort((label, doc_))
            self.doc, self.label, self.parts = doc_[order], label[order], []
        if doc is None:
            return self.label[:0]
        return self.label[np.searchsorted(self.doc, doc):np.searchsorted(self.doc, doc, "right")]


def _regions(window: int):
    """Over the rows of :func:`_candidates`: each run of neighbouring windows that have shared labels, with its word hashes and the
    offsets (offs) at which a repeat can start."""
    def run(batches):
        labels, at = _Labels(), None
        for part in slices(batches, "text"):
            col = {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names) if n != "text"}
            hashes, ends = slice_words(part.column(part.schema.get_field_index("text")))
            out = []
            for i, (p, kind) in enumerate(zip(col["__place"], col["__kind"], strict=True)):
                if p != at:
                    labels, at = _Labels(), p
                if kind == 0:
                    labels.add(col["__base"][i], col["__steps"][i], col["__labels"][i])
                    continue
                known, h = labels.of(col["doc_id"][i]), hashes[ends[i]:ends[i + 1]]
                if not len(known) or len(h) < window:
                    continue
                place, gram = standing(h, window)
                own = gram[place] & _LABEL
                at_known = np.minimum(np.searchsorted(known, own), len(known) - 1)  # a label comes once, with any last bits
                hit = known[at_known] & _LABEL == own
                parts = (known[at_known] >> (place - np.arange(len(place))).astype(np.uint64)) & np.uint64(1)
                start = hit & ((parts > 0) | np.r_[True, ~hit[:-1]])
                edges = np.flatnonzero(np.diff(np.r_[0, hit, 0]))
                out += [(col["doc_id"][i], col["tag"][i], int(a), h[a:b + window - 1].tobytes(), np.flatnonzero(start[a:b]).astype(np.int32))
                        for a, b in zip(edges[::2], edges[1::2], strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                    pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())), strict=True)],
                    names=["doc_id", "tag", "start", "words", "offs"])
    return run


def _pieces(window: int):
    """Of regions with the offsets of their starts, one piece for each key: from its first start (at, in the region) to the
    region's end, with a hash of its words and the offsets of its starts (offs, in the piece)."""
    k = min(KEY, window)

    def run(batches):
        for part in slices(batches, "words"):
            col = {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}
            out = []
            for doc, tag, start, offs, words in zip(*(col[n] for n in ("doc_id", "tag", "start", "offs", "words")), strict=True):
                gram = combine(np.frombuffer(words, np.uint64), k)
                off = np.array(offs, np.int64)
                key = np.min([gram[off + j] for j in range(window - k + 1)], axis=0)
                for x in np.unique(key):
                    o = off[key == x]
                    rest, at = words[8 * int(o[0]):], (o - o[0]).astype(np.int32)
                    out.append((int(x.view(np.int64)), hashlib.md5(at.tobytes() + rest).digest(), doc, tag, start, int(o[0]), len(rest) // 8, at))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                    pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)],
                    names=["key", "piece", "doc_id", "tag", "start", "at", "words", "offs"])
    return run


def sort_suffixes(pieces: list[np.ndarray], of: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by their words of the suffixes that start at ``off`` of the pieces ``of``, and the words each has in common
    with the one before. Few suffixes are compared as they are; many of long pieces by :func:`double`."""
    size = np.array([len(p) for p in pieces], np.int64)
    if (size[of] - off).sum() > 64 * size.sum():
        return double(pieces, (np.cumsum(size + 1) - size - 1)[of] + off)
    held = [p.tobytes() for p in pieces]
    tails = [held[i][8 * o:] for i, o in zip(of.tolist(), off.tolist(), strict=True)]
    order = sorted(range(len(tails)), key=tails.__getitem__)  # any order of the words will do, if it is the same for all
    common = np.zeros(len(order), np.int64)
    for k, (i, j) in enumerate(zip(order, order[1:], strict=False), 1):
        a, b = pieces[of[i]][off[i]:], pieces[of[j]][off[j]:]
        n = min(len(a), len(b))
        apart = a[:n] != b[:n]
        common[k] = apart.argmax() if apart.any() else n
    return np.array(order, np.int64), common


def double(pieces: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`sort_suffixes` for the places ``at`` of the pieces laid end to end with one place between them: ranks of twice the
    length are made until all differ."""
    size = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(size + 1) - 1
    rank = np.empty(int(ends[-1]) + 1, np.int64)
    word = np.ones(len(rank), bool)
    word[ends] = False
    rank[ends] = np.arange(len(ends))
    rank[word] = np.unique(np.concatenate(pieces), return_inverse=True)[1] + len(ends)
    ranks, step = [rank], 1
    while len(np.unique(rank)) < len(rank):
        after = np.full(len(rank), 0, np.int64)
        after[:-step] = rank[step:] + 1
        rank = np.unique(rank * (2 * len(ranks[0]) + 2) + after, return_inverse=True)[1]
        ranks.append(rank)
        step *= 2
    order = np.argsort(rank[at])
    a, b = at[order][:-1], at[order][1:]
    common = np.zeros(len(a), np.int64)
    for k in reversed(range(len(ranks))):
        common += (ranks[k][a + common] == ranks[k][b + common]).astype(np.int64) << k
    return order, np.r_[0, common]


def tree(depth: list[int], low: list[int], common: list[int]) -> list[tuple[int, int, int, int]]:
    """The suffix tree over sorted leaves: their lengths, smallest documents and words in common with the one before. For each
    leaf: depth and owner of the deepest node above its smallest document that a smaller one has too (0, 0 without), and
    the same for its other documents."""
    leaves, doc, depth, low = len(depth), low, list(depth), list(low)
    up, path, own = [-1] * leaves, [], list(range(leaves))

    def close(node: int, parent: int) -> None:
        up[node], low[parent] = parent, min(low[parent], low[node])

    for k in range(leaves):
        while k and depth[path[-1]] > common[k]:
            node = path.pop()
            if not path or depth[path[-1]] < common[k]:
                depth.append(common[k])
                low.append(low[node])
                up.append(-1)
                path.append(len(depth) - 1)
            close(node, path[-1])
        if k and depth[k] == common[k]:  # nothing is longer than the leaf before: the two are equal
            own[k] = path[-1]
            low[own[k]] = min(low[own[k]], low[k])
        else:
            path.append(k)
    while len(path) > 1:
        node = path.pop()
        close(node, path[-1])
    # the nearest node above with a smaller document; parents are shorter, so they come first
    above = [-1] * len(depth)
    for node in sorted(range(len(depth)), key=depth.__getitem__):
        parent = up[node]
        if parent >= 0:
            above[node] = parent if low[parent] < low[node] else above[parent]
    out = []
    for k in range(leaves):
        node = own[k] if low[own[k]] < doc[k] else above[own[k]]
        out.append((*((depth[node], low[node]) if node >= 0 else (0, 0)), depth[k], low[own[k]]))
    return out


def _tree_of(rows: list[tuple]) -> pa.RecordBatch:
    """The repeats of whole groups of pieces (key, grp, piece, least, offs, words)."""
    pieces = [np.frombuffer(r[5], np.uint64) for r in rows]
    count = np.array([len(r[4]) for r in rows])
    size = np.array([len(p) for p in pieces], np.int64)
    off, of = np.concatenate([r[4] for r in rows]).astype(np.int64), np.repeat(np.arange(len(rows)), count)
    order, common = sort_suffixes(pieces, of, off)
    nodes = tree((size[of] - off)[order].tolist(), np.array([r[3] for r in rows], np.int64)[of][order].tolist(), common.tolist())
    found = np.empty((len(off), 4), np.int64)
    found[order] = nodes
    ends = pa.array(np.r_[0, np.cumsum(count)], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()),
                                       pa.array([r[3] for r in rows], pa.int64()), *(pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x)))
                                                                                   for x in (off, *found.T))],
                                      names=["key", "piece", "least", "offs", "length", "owner", "length2", "owner2"])


def _split(window: int):
    """Pieces (key, piece, least, offs, words, heavy) with the group they meet in: their key, or for each start of a heavy one
    its whole first window."""
    def run(batches):
        for part in slices(batches, "words"):
            rows = []
            for key, piece, least, offs, words, heavy in zip(*(part.column(i).to_pylist() for i in range(6)), strict=True):
                if not heavy:
                    rows.append((key, key, piece, least, offs, words))
                    continue
                label = combine(np.frombuffer(words, np.uint64), window)[offs].view(np.int64)
                for x in np.unique(label):
                    o = np.array(offs)[label == x]
                    rows.append((key, int(x), piece, least, o, words))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.binary()), strict=True)],
                names=["key", "grp", "piece", "least", "offs", "words"])
    return run


def _trees(batches):
    rows, held = [], 0
    for group in grouped(batches, "grp"):
        new = list(zip(*(group.column(i).to_pylist() for i in range(6)), strict=True))
        rows += new
        held += sum(len(r[5]) for r in new) // 8
        if held >= BATCH_WORDS:
            yield _tree_of(rows)
            rows, held = [], 0
    if rows:
        yield _tree_of(rows)


def _staged(df: DataFrame, name: str) -> DataFrame:
    """:func:`cut_lineage`, after which the shuffle files of ``df`` go: nothing reads them again."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = conf.get(key, None)
    conf.set(key, "true")
    try:
        return cut_lineage(df, name)
    finally:
        conf.unset(key) if old is None else conf.set(key, old)


def repeats(docs: DataFrame, window: int, group_suffixes: int) -> DataFrame:
    """Of the rows of ``docs`` (doc_id, text) that have any: doc_id, tag and found, the deepest node with a smaller document at
    each place where a repeat can start (start, length, owner)."""
    regions = _staged(_candidates(docs, window, group_suffixes).mapInArrow(
        _regions(window), "doc_id long, tag long, start long, words binary, offs array<int>"), "regions")
    row = ["doc_id", "tag", "start"]
    pieces = _staged(regions.mapInArrow(
        _pieces(window), "key long, piece binary, doc_id long, tag long, start long, at long, words long, offs array<int>"), "pieces")
    first = pieces.groupBy("key", "piece").agg(F.min(F.struct(*row, "at", "words", "offs")).alias("x")).select("key", "piece", "x.*")
    heavy = first.groupBy("key").agg(F.sum("words").alias("n")).filter(F.col("n") > TREE_WORDS).select("key", F.lit(True).alias("heavy"))
    whole = first.drop("words").join(heavy, "key", "left").join(regions.select(*row, "words"), row).selectExpr(
        "key", "piece", "doc_id AS least", "offs", "substring(words, CAST(8 * at + 1 AS INT)) AS words", "coalesce(heavy, false) AS heavy")
    nodes = whole.mapInArrow(_split(window), "key long, grp long, piece binary, least long, offs array<int>, words binary").repartition(
        "grp").sortWithinPartitions("grp").mapInArrow(_trees, "key long, piece binary, least long, offs array<long>, length array<long>, "
                                                      "owner array<long>, length2 array<long>, owner2 array<long>")
    found = pieces.drop("offs").join(nodes, ["key", "piece"]).selectExpr(
        "doc_id", "tag", "start + at AS start", "offs", "IF(doc_id = least, length, length2) AS length", "IF(doc_id = least, owner, owner2) AS owner").selectExpr("doc_id", "tag", f"""filter(transform(
        arrays_zip(offs, length, owner),
        x -> struct(start + x.offs AS start, x.length AS length, x.owner AS owner)), x -> x.length >= {window}) AS found""")
    return _staged(found.filter("size(found) > 0").groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("found")).alias("found")), "repeats")


def _maximal(found) -> list[dict]:
    """The repeats that no other one holds, in order."""
    out, end = [], 0
    for r in sorted(found or (), key=lambda r: r["start"]):
        if r["start"] + r["length"] > end:
            out.append(r)
            end = r["start"] + r["length"]
    return out


def _with_repeats(docs: DataFrame, id_col: str, text_col: str, window: int, group_suffixes: int) -> DataFrame:
    """``docs`` with the column __found."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = repeats(narrow, window, group_suffixes).select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), F.col("found").alias("__found"))
    return docs.join(found, (F.col(id_col).cast("long") == F.col("__id")) & (_tag(text_col) == F.col("__tag")), "left").drop("__id", "__tag")


def _streamed(text_at: int, emit):
    """Run over the rows of :func:`_with_repeats`; ``emit`` makes a batch of (rows, their words, what goes, repeats)."""
    def run(batches):
        for part in slices(_with_text(batches, text_at), "__text"):
            out = []
            for t, found in zip(part.column(part.num_columns - 1).to_pylist(), part.column(part.num_columns - 2).to_pylist(), strict=True):
                words, spans = (t or b"").split(), _maximal(found)
                gone = np.zeros(len(words), bool)
                for r in spans:
                    gone[r["start"]:r["start"] + r["length"]] = True
                out.append((words, gone, spans))
            yield emit(part, out)
    return run


def _with_text(batches, text_at: int):
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, b.column(text_at).cast(pa.binary())], names=[*b.schema.names, "__text"])


def _kept(words: list[bytes], gone: np.ndarray) -> str:
    return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words).decode()


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
                   group_suffixes: int = 1_000_000) -> DataFrame:
    """Remove from each document every word under a window of ``window`` words that also starts in a document with a
    smaller id. Windows are judged on the input.

    Returns one row for each row of ``docs``: doc_id, n_words, n_removed, kept (the words left, joined by one space)
    and spans (the maximal repeats removed: start, length in words, owner). A span is a passage that as a whole is in a
    document with a smaller id, the smallest such id being the owner, and that is not part of a longer one; spans in order of
    start, which may meet or overlap. A null or empty text has no words. A repeat within
    one document alone stays. Rows that share an id count as one document. A row with a null id keeps all its words and
    takes nothing from others. Other columns are not read. ``group_suffixes`` bounds the suffixes of one group.
    """
    def emit(rows, found):
        cols = [rows.column(0), pa.array([len(w) for w, _, _ in found], pa.int64()), pa.array([int(g.sum()) for _, g, _ in found], pa.int64()),
                pa.array([_kept(w, g) for w, g, _ in found], pa.string()),
                pa.array([s for _, _, s in found], pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "owner")])))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    narrow = ship(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _with_repeats(narrow, "doc_id", "text", window, group_suffixes).mapInArrow(_streamed(
        1, emit), "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,length:long,owner:long>>")


def without_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
                    group_suffixes: int = 1_000_000) -> DataFrame:
    """``docs`` with the words of :func:`remove_repeats` taken out of the texts; texts without repeats are unchanged."""
    n, at = len(docs.columns), docs.columns.index(text_col)

    def emit(rows, found):
        old = rows.column(at).to_pylist()
        new = pa.array([_kept(w, g) if g.any() else t for t, (w, g, _) in zip(old, found, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([new if k == at else rows.column(k) for k in range(n)], names=rows.schema.names[:n])

    return _with_repeats(ship(docs), id_col, text_col, window, group_suffixes).mapInArrow(_streamed(at, emit), docs.schema)
