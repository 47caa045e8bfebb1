import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from cohortflow.llm.common import table
from cohortflow.llm.variants import Index, Wavelet, near_words, roots, suffixes, variants, vocabulary

from .conftest import SF


def near(a, b):
    """One inserted, deleted or replaced code point apart."""
    a, b = sorted((a, b), key=len)
    at = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[at + 1:] == b[at + 1:] if len(a) == len(b) else a[at:] == b[at + 1:])


def brute(vocab, ratio=5):
    out = {}
    for w, n in vocab.items():
        close = [v for v in vocab if abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(close, key=lambda v: (-vocab[v], v), default=None)
        form = best if best and vocab[best] >= ratio * n else None
        out[w] = [w, form, w, n, len(close), vocab[form] if form else None]
    for row in out.values():
        while out[row[2]][1]:
            row[2] = out[row[2]][1]
    return sorted(map(tuple, out.values()))


def counted(docs, drop=199):
    out = Counter()
    for i, text in docs:
        for run in regex.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop and h % drop == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def test_suffix_array_and_wavelet_matrix():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 500):
        text = np.r_[rng.integers(1, 4, n), 0]
        assert suffixes(text, 2).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
    seq = rng.integers(0, 11, 300)
    w = Wavelet(seq, 4)
    for lo, hi in ((0, 300), (7, 7), (20, 90), (299, 300)):
        for c in range(11):
            a, b, smaller = (int(x[0]) for x in w.step(np.array([c]), np.array([lo]), np.array([hi])))
            below = int((seq < c).sum())
            assert (a, b) == (below + int((seq[:lo] == c).sum()), below + int((seq[:hi] == c).sum()))
            assert smaller == int((seq[lo:hi] < c).sum())
        who, c, a, b, smaller = w.steps(np.array([lo, lo]), np.array([hi, lo]))
        assert sorted(c.tolist()) == sorted(set(seq[lo:hi].tolist())) and not who.any()
        assert all((x, y) == (int(i[0]), int(j[0])) for x, y, (i, j, _) in zip(a, b, (w.step(np.array([s]), np.array([lo]), np.array([hi])) for s in c), strict=True))


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefghijklmnopqrstuvwxyzßéÿ𝒳"])
def test_index_against_all_pairs(letters):
    rng = random.Random(len(letters))
    for size in (1, 2, 60, 400):
        words = sorted({"".join(rng.choices(letters, k=rng.randint(6, 9))) for _ in range(size)})
        ask = sorted({"".join(rng.choices(letters + "z", k=rng.randint(6, 9))) for _ in range(20)} | set(words[:30]))
        index, got = Index(words), []
        for right in (True, False):
            pairs = [(ask[i], words[j]) for i, j in zip(*(x.tolist() for x in index.near(ask, right)), strict=True)]
            assert len(pairs) == len(set(pairs))
            assert all(v.startswith(w[:len(w) // 2]) if right else v.endswith(w[len(w) // 2:]) for w, v in pairs)
            got += pairs
        assert set(got) == {(w, v) for w in ask for v in words if near(w, v)}


@pytest.mark.parametrize("block", [50_000, 40, 3])
def test_against_all_pairs(spark, block):
    rng = random.Random(7)
    base = ["".join(rng.choices("abcd", k=rng.randint(6, 8))) for _ in range(150)] + ["prefix" + "".join(rng.choices("xyz", k=3)) for _ in range(200)]
    vocab = {w: rng.choice([5, 6, 30, 200, 1500]) for w in base}
    vocab |= {"ééééééé": 9, "éééééé": 50, "long" * 400: 7, "long" * 399 + "lon": 99}
    df = spark.createDataFrame([(w, n, 0) for w, n in vocab.items()], "word string, n long, n_near long").repartition(5)
    assert sorted(map(tuple, variants(df, block=block).collect())) == brute(vocab)
    got = near_words(df.drop("n_near"), block)
    assert got.count() == got.select("word").distinct().count() == sum(r[4] > 0 for r in brute(vocab))


def test_chains_of_forms(spark):
    names = [f"w{i:03}" for i in range(40)]
    forms = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "word string, form string")
    assert {r.word: r.root for r in roots(forms).collect()} == {w: names[-1] for w in names[:-1]}
    chain = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125}
    got = {r.word: r.root for r in variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"aabbbb"} and {r[0]: r[2] for r in brute(chain)} == got


def test_whole_table(spark):
    docs = table(spark, SF.replace("sf0.001", "sf0.01"), "documents")
    vocab = counted([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert {r.word: r.n for r in vocabulary(docs, drop_every=199).collect()} == vocab
    short = dict(sorted(vocab.items())[::3])
    got = variants(spark.createDataFrame(list(short.items()), "word string, n long"), block=300).collect()
    assert sorted(map(tuple, got)) == brute(short)


def test_odd_documents(spark, make):
    rows = [(i, t, None, None, 1) for i, t in enumerate(["Élan ÉLAN élanxx", None, "", " ", "tension " * 9 + "tensiom", "x" * 300_000 + " tensiom" * 9, "a1b2c3", "münchen×÷ß " * 5])]
    rows += [(None, "tensiom", None, None, 1), (4, "tension", "en", "s", 2), (4, "tension", "en", "s", 2)]
    got = {r.word: r.n for r in vocabulary(make(rows, 4), drop_every=199).collect()}
    assert got == counted([r[:2] for r in rows]) and got["tensiom"] >= 9
    out = sorted(map(tuple, variants(vocabulary(make(rows, 4))).collect()))
    assert out == brute(counted([r[:2] for r in rows], None)) and vocabulary(make([])).collect() == []
    assert variants(vocabulary(make([]))).collect() == [] and variants(vocabulary(make([]))).columns == ["word", "form", "root", "n", "n_near", "form_n"]
