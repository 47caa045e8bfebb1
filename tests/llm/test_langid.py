import math
import zlib

import numpy as np
import public_tokenizers
from cohortflow.llm.common import table
from cohortflow.llm.langid import START, Model, expectation_maximisation, fit, identify, vocabulary, words_of

from .conftest import SF

VOCAB = public_tokenizers.path("piece_bpe_32k.model")


def by_hand(word, p):
    """Sum over all segmentations, by enumeration."""
    if not word:
        return 1.0
    return sum(p.get(word[:k], 1e-6 if k == 1 else 0.0) * by_hand(word[k:], p) for k in range(1, len(word) + 1))


def test_forward_sums_all_segmentations():
    pieces = [START, START + "a", "a", "ab", "b", "ba", "bab"]
    rng = np.random.default_rng(0)
    p = rng.random((len(pieces) + 2, 2)) / 10
    p[0], p[1] = 0, 1e-6
    learn, total = Model(["x", "y"], pieces, p, np.zeros(2)).scorer()
    words = ["abab", "bbbab", "a", "zab", "ba"]
    learn(set(words))
    for w in words:
        for k in range(2):
            own = {x: p[i + 2, k] for i, x in enumerate(pieces)}
            assert math.isclose(total([w])[k], math.log(by_hand(START + w, own)), rel_tol=1e-9)


def test_likelihood_rises_with_each_round():
    words, pieces = ["abab", "aba", "b", "bab"], [START, "a", "b", "ab", "aba"]
    counts = np.array([[5.0], [3], [1], [4]])
    last = -np.inf
    for rounds in range(1, 6):
        p = expectation_maximisation(words, counts, pieces, rounds, smooth=1e-9)
        learn, total = Model(["x"], pieces, p, np.zeros(1)).scorer()
        learn(set(words))
        now = sum(c * total([w])[0] for w, (c,) in zip(words, counts))
        assert now >= last - 1e-9
        last = now


def test_held_out_accuracy(spark):
    docs = table(spark, SF.replace("sf0.001", "sf0.01"), "documents")
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = identify(docs, fit(docs, VOCAB)).collect()
    assert len(got) == len(want) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r.lang_pred == want[r.doc_id] for r in got if r.held_out]
    assert np.mean(out) >= 0.98 and all(0 <= r.score <= 1 for r in got)


def test_edge_cases(make):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([("le chat est noir", "fr"), ("the cat is black", "en")] * 20)]
    rows += [(100, None, "en", None), (101, "", "fr", "s"), (102, "123 !!", "en", "s"), (103, "x" * 100_000, None, "s"),
             (None, "the cat", "en", "s"), (104, "the cat", None, "s"), (104, "the cat", None, "s"), (105, "中文 ẞß", "en", "s")]
    docs = make(rows).withColumnRenamed("n_chars", "language").withColumnRenamed("source", "y")
    model = fit(docs, VOCAB)
    got = sorted(((str(r.doc_id), r.lang_pred, round(r.score, 3)) for r in identify(docs, model).collect()))
    assert len(got) == len(rows) and [g for g in got if g[0] in ("100", "101", "102")] == [(x, "und", 0.0) for x in ("100", "101", "102")]
    assert [g[1] for g in got if g[0] in ("104", "None")] == ["en"] * 3 and model.languages == ["en", "fr"]
    empty = make([])
    assert identify(empty, fit(empty, VOCAB)).collect() == []
    assert {r.lang_pred for r in identify(make([(1, "text")]), fit(empty, VOCAB)).collect()} == {"und"}


def test_vocabulary_and_words():
    pieces = vocabulary(VOCAB)
    assert START in pieces and START + "the" in pieces and len(pieces) > 5000 and all(p == p.lower() for p in pieces)
    assert words_of("It's A1b_c Ñandú") == ["it", "s", "a", "b", "c", "ñandú"] and words_of(None) == []


def test_numerals_are_no_letters(make):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([("le chat est noir", "fr"), ("the cat is black", "en")] * 20)]
    model = fit(make(rows), VOCAB)
    odd = ["½ ² ①", "Ⅷ ⅓ ٣", "一 ½", "_ __", "ª"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(make(list(enumerate(odd))), model).collect()}
    assert [got[i] == ("und", 0.0) for i in range(5)] == [not any(map(str.isalpha, t)) for t in odd] == [True, True, False, True, False]
    assert words_of("x²y ½a_b") == ["x", "y", "a", "b"]


def test_sums_below_the_least_double():
    pieces = [START, "a", "b"]
    p = np.zeros((5, 2))
    p[1], p[2:] = 1e-12, 1e-9
    p[3, 1] = 2e-9
    learn, total = Model(["x", "y"], pieces, p, np.zeros(2)).scorer()
    words = ["a" * 40, "q" * 40, "ab" * 20, "a"]
    learn(set(words))
    want = {"a" * 40: (41 * math.log(1e-9), math.log(1e-9) + 40 * math.log(2e-9)), "q" * 40: (math.log(1e-9) + 40 * math.log(1e-12),) * 2,
            "ab" * 20: (41 * math.log(1e-9), 21 * math.log(1e-9) + 20 * math.log(2e-9)), "a": (2 * math.log(1e-9), math.log(1e-9) + math.log(2e-9))}
    for w in words:
        assert np.allclose(total([w]), want[w], rtol=1e-9)


def test_identify_against_plain_python(spark, make):
    """Every text of a small table: log of the sum over segmentations by recursion, posterior by hand."""
    docs = table(spark, SF, "documents").limit(40)
    model = fit(table(spark, SF, "documents"), VOCAB, rows=20)
    row = {x: i + 2 for i, x in enumerate(model.pieces)}

    def word(w, k, memo):
        if not w:
            return 0.0
        if w not in memo:
            parts = [math.log(model.p[row.get(w[:n], 1 if n == 1 else 0), k]) + word(w[n:], k, memo) for n in range(1, min(16, len(w)) + 1)
                     if n == 1 or w[:n] in row]
            top = max(parts)
            memo[w] = top + math.log(sum(math.exp(x - top) for x in parts))
        return memo[w]

    memos = [{} for _ in model.languages]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in identify(make(rows), model).collect()}
    for i, text in rows:
        logs = [sum(word(START + w, k, memos[k]) for w in words_of(text)) for k in range(len(model.languages))]
        top = max(logs)
        share = [math.exp(x - top) for x in logs]
        if words_of(text):
            assert got[i].lang_pred == model.languages[logs.index(top)] and math.isclose(got[i].score, 1 / sum(share), rel_tol=1e-6)
