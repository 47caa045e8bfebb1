import re

import numpy as np
import pytest
from cohortflow.llm.common import table
from cohortflow.llm.mixing import mix, mixed, sainte_lague, targets
from hypothesis import given, settings
from hypothesis import strategies as st

from .conftest import SF


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets_by_hand(rows, weights=(3, 1, 2)):
    """rows: (doc_id, text, source). Shares again, one source after the other, until none is above."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), {s for s in names if sizes[s]}, dict.fromkeys(names, 0.0)
    while open_:
        total = sum(w[s] for s in open_)
        share = {s: left * w[s] / total for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return sizes, out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return sizes, out


def check(rows, got, block=64, shards=1):
    sizes, want = targets_by_hand(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(x.length * x.times for x in r.runs)
        assert all(x.start >= 0 and x.start + x.length <= r.size for x in r.runs)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= block * (1 + 2 * shards), (s, taken[s], want[s])
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), size(t)) for d, t, _ in rows)


def test_documents(spark):
    docs = table(spark, SF.replace("sf0.001", "sf0.01"), "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    one = mix(docs).collect()
    check(rows, one)
    again = mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, one)) == sorted(map(key, again))
    check(rows, mix(docs, shard_words=2000).collect(), shards=20)


def test_edge_cases(make):
    word = "w " * 1000
    rows = [(1, None, "en", "a"), (2, "", "en", "b"), (3, " \n\t", "en", None), (4, word, "en", "a"), (4, word, "en", "a"), (5, word * 9, "en", "B"),
            (6, word, "en", None), (None, word, "en", "\U0001f600"), (7, word * 40, "en", "￿"), (8, "one", "en", "tiny")]
    docs = make(rows).withColumnRenamed("n_chars", "size").withColumnRenamed("lang", "row")
    got = mix(docs).collect()
    check([(d, t, s) for d, t, _, s in rows], got)
    assert mix(make([])).collect() == []
    assert [r.taken for r in mix(make([(1, None), (2, "")])).collect()] == [0, 0]


def test_mixed_documents_hold_the_taken_words(make):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(150 + 40 * i)), "en", f"s{i % 3}", 1) for i in range(9)]
    docs = make(rows)
    taken = {r.doc_id: r for r in mix(docs).collect()}
    out = mixed(docs).collect()
    assert {k: sum(size(r.text) for r in out if r.doc_id == k) for k in taken} == {k: r.taken for k, r in taken.items()}
    text = {r[0]: r[1] for r in rows}
    for r in out:
        own = text[r.doc_id].split()
        assert set(r.text.split()) <= set(own) and (r.lang, r.n_chars) == ("en", 1)
        assert size(r.text) < len(own) or r.text == text[r.doc_id]
    assert mixed(docs).columns == docs.columns


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(0, 50)), min_size=1, max_size=12), st.integers(0, 200))
def test_sainte_lague_is_the_highest_quotients(parties, seats):
    votes, most = [float(v) for v, _ in parties], [m for _, m in parties]
    got = sainte_lague(votes, seats, most)
    assert sum(got) == min(seats, sum(most)) or sum(votes) == 0
    if sum(votes):
        taken = [votes[i] / (2 * k + 1) for i in range(len(votes)) for k in range(got[i])]
        free = [votes[i] / (2 * got[i] + 1) for i in range(len(votes)) if got[i] < most[i]]
        assert not taken or not free or min(taken) >= max(free) - 1e-9


def test_targets_stop_and_are_shared_again():
    assert targets([10, 100, 100], [3, 1, 2], 150, 2) == pytest.approx([20, 130 / 3, 260 / 3])
    assert targets([0, 10], [3, 1], 15, 2) == [0.0, 15.0] and np.sum(targets([5] * 7, [3, 1, 2, 3, 1, 2, 3], 52.5, 2)) == pytest.approx(52.5)


def test_repeated_rows_are_mixed_each_on_its_own(make):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(1, text, "en", "a", 1)] * 4 + [(None, text, "en", "a", 1)] * 3 + [(i, " ".join(f"x{i}_{k}" for k in range(70 + i)), "en", f"s{i % 3}", 1) for i in range(2, 20)]
    docs = make(rows)
    words = {}
    for r in mixed(docs, block=16).collect():
        words[r.doc_id, r.text.split()[0][:1]] = words.get((r.doc_id, r.text.split()[0][:1]), 0) + size(r.text)
    taken = {}
    for r in mix(docs, block=16).collect():
        k = r.doc_id, "x" if r.doc_id and r.doc_id > 1 else "w"
        taken[k] = taken.get(k, 0) + r.taken
    assert {k: v for k, v in taken.items() if v} == words
    assert words.get((1, "w"), 0) <= 800 and words.get((None, "w"), 0) <= 600
    have, want = targets_by_hand([(d, t, s) for d, t, _, s, _ in rows])
    for name in have:
        got = sum(v for (d, _), v in words.items() if next(r[3] for r in rows if r[0] == d) == name)
        assert abs(got - want[name]) <= 3 * 16


def test_order_of_rows_without_ids_does_not_matter(make):
    rows = [(None if i % 2 else i, " ".join(f"w{i}_{k}" for k in range(50)), "en", "a" if i < 30 else "b", 1) for i in range(42)]
    one, two = (sorted((r.doc_id is None, r.doc_id, r.text, r.source) for r in mixed(make(x, p), block=16).collect()) for x, p in ((rows, 3), (rows[::-1], 5)))
    assert one == two
