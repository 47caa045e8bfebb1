import random
import re

import time

import numpy as np
import pytest
from cohortflow.llm import substrings
from cohortflow.llm.common import table
from cohortflow.llm.substrings import plan_groups, remove_repeats, without_repeats

from .conftest import SF


def brute(rows, window=13):
    first = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i:i + window])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i:i + window])] < d:
                gone[i:i + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


def test_equals_brute_force_on_documents(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(remove_repeats(docs, group_suffixes=500)) == sorted(brute(rows), key=str)


def test_edge_cases(make):
    rng = random.Random(1)
    common = " ".join(f"w{i}" for i in range(20))
    text = lambda: " ".join(rng.choice(("a", "b")) for _ in range(200))
    rows = [(5, None), (6, ""), (7, " \n\t"), (None, common), (3, common), (2, common), (2, common), (9, f"x {common} y"),
            (10, "w1 w2"), (11, common.replace(" ", " ")), (12, f"{common} {common}"), (13, text()), (14, text()), (15, text() * 40)]
    got = remove_repeats(make(rows).withColumnRenamed("lang", "labels").withColumnRenamed("source", "grp"))
    assert rows_of(got) == sorted(brute(rows), key=str)
    assert rows_of(remove_repeats(make([]))) == []


def test_spans_are_maximal(make):
    a = " ".join(f"w{i}" for i in range(40))
    got = {r.doc_id: r.spans for r in remove_repeats(make([(1, a), (2, f"p q {a} r")])).collect()}
    assert got[1] == [] and [(s.start, s.length) for s in got[2]] == [(2, 40)]


def test_common_prefixes_are_extended():
    counts = np.zeros((len(substrings.DEPTHS), 1 << 14), np.int64)
    counts[0, :3], counts[1, 5:9] = (900, 40, 60), (500, 100, 100, 100)
    groups, n = plan_groups(counts, 100)
    assert n == 10 and groups[0, 0] == -1 and groups[0, 1] >= 0 and groups[1, 5] == -1 and groups[1, 6] >= 0


def test_documents_form_keeps_columns(make):
    a = " ".join(f"w{i}" for i in range(40))
    docs = make([(1, a, "en", "s", 3), (2, f"p  q {a} r", None, "s", 4), (3, None, "de", None, None), (None, a, "x", "y", 1), (4, "two  words", "en", "s", 2)])
    got = without_repeats(docs)
    assert got.schema.names == docs.schema.names
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [
        (1, a, "en", "s", 3), (2, "p q r", None, "s", 4), (3, None, "de", None, None), (None, a, "x", "y", 1), (4, "two  words", "en", "s", 2)]))


def brute_spans(rows, window=13):
    """(start, length, owner) of each document by comparing every pair of positions."""
    split = [(d, (t or "").split()) for d, t in rows if d is not None]
    out = {}
    for d, w in split:
        best = {}
        for i in range(len(w)):
            for e, v in split:
                for j in range(len(v)) if e < d else ():
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    if n >= window:
                        best[i] = min(best.get(i, (0, 0)), (-n, e))
        spans, end = [], 0
        for i, (n, e) in sorted(best.items()):
            if i - n > end:
                spans.append((i, -n, e))
                end = i - n
        out.setdefault(d, set()).add(tuple(spans))
    return out


def test_table_of_prefixes_grows_with_the_corpus():
    assert substrings.table_size(0, 10**6) == substrings.table_size(10**9, 10**6) == 1 << 14
    assert substrings.table_size(10**12, 10**6) == 1 << 22 == substrings.table_size(10**14, 10**6)
    assert 1 << 14 < substrings.table_size(10**11, 10**6) < 1 << 22


def spans_of(df):
    out = {}
    for r in df.collect():
        if r.doc_id is not None:
            out.setdefault(r.doc_id, set()).add(tuple((s.start, s.length, s.owner) for s in r.spans))
    return out


def test_passages_side_by_side_are_two_repeats(make):
    a, b = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    got = spans_of(remove_repeats(make([(1, a), (2, b), (3, f"{a} {b}")])))
    assert got[3] == {((0, 20, 1), (20, 20, 2))}


@pytest.mark.parametrize("tree_words", [4_000_000, 60])
def test_spans_equal_brute_force(make, monkeypatch, tree_words):
    monkeypatch.setattr(substrings, "TREE_WORDS", tree_words)  # with few, every key is heavy
    rng = random.Random(5)
    base = [[f"w{rng.randrange(3000)}" for _ in range(60)] for _ in range(3)]
    rows = [(None, " ".join(base[0])), (8, " ".join(base[0])), (8, " ".join(base[1][:30])), (8, " ".join(base[1][:30])), (4, " ".join(["a"] * 30)),
            (5, " ".join(["a"] * 40)), (6, " ".join(["a"] * 20 + ["b"] + ["a"] * 25))]
    for d in range(10, 34):
        w = []
        for _ in range(3):
            p = rng.choice(base)
            lo = rng.randrange(40)
            w += p[lo:lo + rng.randrange(5, 50)] + [f"x{d}"] * rng.randrange(2)
        rows.append((d, " ".join(w)))
    rng.shuffle(rows)
    assert spans_of(remove_repeats(make(rows, 5), group_suffixes=300)) == brute_spans(rows)
    if tree_words > 60:
        assert spans_of(remove_repeats(make(rows, 5), window=4)) == brute_spans(rows, 4)


def test_tree_compares_words_not_labels():
    pieces, docs = [np.array(x, np.uint64) for x in ([1, 2, 3, 4], [9, 8, 7], [1, 2, 3, 5, 6], [1, 2, 3])], [7, 2, 5, 6]
    order, common = substrings.double(pieces, np.array([0, 5, 9, 15]))
    assert order.tolist() == [3, 0, 2, 1] and common.tolist() == [0, 3, 3, 0]
    got = substrings.tree([len(pieces[k]) for k in order], [docs[k] for k in order], common.tolist())
    assert got == [(3, 5, 3, 5), (3, 5, 4, 7), (0, 2, 5, 5), (0, 0, 3, 2)]
    assert [g[:2] for g in substrings.tree([3, 3, 3, 5], [1, 2, 3, 4], [0, 3, 3, 3])] == [(0, 0), (3, 1), (3, 1), (3, 1)]


@pytest.mark.parametrize("window", [1, 3, 5, 6, 13])
def test_equal_windows_are_stood_for_by_equal_runs(window):
    rng = np.random.default_rng(window)
    h = rng.integers(0, 4, 400).astype(np.uint64)
    place, gram = substrings.standing(h, window)
    run = max(1, window - substrings.SPAN + 1)
    seen = {}
    for i, p in enumerate(place.tolist()):
        assert i <= p <= i + window - run and gram[p] == min(gram[i:i + window - run + 1])
        assert seen.setdefault(tuple(h[i:i + window].tolist()), p - i) == p - i
    assert len(place) == 400 - window + 1 and not len(substrings.standing(h[:window - 1], window)[0])


def test_both_ways_to_sort_suffixes_agree():
    rng = np.random.default_rng(4)
    for _ in range(30):
        pieces = [rng.integers(0, 3, rng.integers(1, 40)).astype(np.uint64) for _ in range(rng.integers(1, 12))]
        of = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        off = np.concatenate([np.arange(len(p)) for p in pieces])
        size = np.array([len(p) for p in pieces])
        results = []
        for order, common in (substrings.sort_suffixes(pieces, of, off), substrings.double(pieces, (np.cumsum(size + 1) - size - 1)[of] + off)):
            doc = rng.permutation(1000)[:len(pieces)] if not results else doc  # noqa: F821
            nodes = substrings.tree((size[of] - off)[order].tolist(), doc[of][order].tolist(), common.tolist())
            back = [None] * len(order)
            for k, x in zip(order.tolist(), nodes, strict=True):
                back[k] = x
            results.append(back)
        assert results[0] == results[1]


def test_very_long_repetitive_texts(make):
    n = 200_000
    docs = make([(1, "word " * n), (2, "word " * (n - 1000)), (3, "a " + "word " * (n + 5))])
    docs.count()
    remove_repeats(make([(1, "warm"), (2, "up")])).collect()
    began = time.time()
    got = {r.doc_id: (r.n_removed, [(s.start, s.length, s.owner) for s in r.spans]) for r in remove_repeats(docs).collect()}
    took = time.time() - began
    assert got == {1: (0, []), 2: (n - 1000, [(0, n - 1000, 1)]), 3: (n + 5, [(k, n, 1) for k in range(1, 7)])}
    assert took < 25  # the whole query with its jobs; the trees take a small part
    size, at = n, np.arange(n)
    piece = [np.full(size, 7, np.uint64)]
    began = time.time()
    order, common = substrings.sort_suffixes(piece, np.zeros(n, np.int64), at)
    substrings.tree((size - at)[order].tolist(), [1] * n, common.tolist())
    assert time.time() - began < 10
