import hashlib
import random
import time

import numpy as np
from cohortflow.llm.common import table
from cohortflow.llm.lzprint import _places, fingerprint, fingerprints, least_hashes, likeness, neighbours, short, written

from .conftest import SF


def phrases(text):
    """LZ78 by the book: the longest known phrase and one more code point."""
    known, p = {""}, ""
    for c in text:
        if p + c in known:
            p += c
        else:
            known.add(p + c)
            p = ""
    return known - {""}


def values(text):
    return short(least_hashes(sorted(phrases(text))))


def brute(rows):
    """rows: (doc_id, text) with distinct ids."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: r[0], reverse=True)
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(t) // 3
        edited = t[:len(t) - k] + after[:k]
        a, b = values(t), values(edited)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), written(a), written(b), likeness(a, b), likeness(a, values(after))))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force_on_documents(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    assert rows_of(neighbours(docs, range_rows=23)) == want and rows_of(neighbours(docs)) == want
    assert np.mean([w[5] for w in want]) > 0.4 > 0.2 > np.mean([w[6] for w in want])


def test_edge_cases(make):
    rng = random.Random(2)
    rows = [(3, None), (5, ""), (-4, "a"), (9, "ab"), (11, "abc" * 50), (1, "\U0001f600é" * 30), (20, "x"), (21, "".join(rng.choice("ab") for _ in range(50_000)))]
    for n in (1, 3, 100):
        assert rows_of(neighbours(make(rows).withColumnRenamed("lang", "tie").withColumnRenamed("source", "rng"), range_rows=n)) == brute(rows)
    assert rows_of(neighbours(make([(7, "abcabc")]))) == brute([(7, "abcabc")])
    assert neighbours(make([])).collect() == []
    got = neighbours(make([(1, "same text"), (1, "same text"), (1, "other"), (None, "x"), (None, None)]), range_rows=1).collect()
    assert len(got) == 5 and sorted(r.n_chars for r in got) == [0, 1, 5, 9, 9]
    assert len({r.fingerprint for r in got if r.n_chars == 9}) == 1


def test_plain_fingerprints_agree(make):
    rows = [(1, "abracadabra" * 9), (2, None), (3, "abracadabra" * 9)]
    got = {r.doc_id: r.fingerprint for r in fingerprint(make(rows)).collect()}
    assert got[1] == got[3] == written(fingerprints(rows[0][1], 40, "zz")[0]) and set(got[2]) == {"0"}


def test_places_follow_the_order(spark):
    """Ranges by bisection against a plain count; an id that is several cuts, and rows without id, fill their ranges evenly and in order."""
    rng = random.Random(5)
    cuts = [-(1 << 63), -7, 0, 4, 4, 4, 9, (1 << 63) - 1]
    rows = [(rng.choice([None, 4, -(1 << 63), (1 << 63) - 1, *range(-9, 12)]), rng.randrange(-(1 << 63), 1 << 63)) for _ in range(3000)]
    place, ranges = _places(cuts, 5)
    got = [(r.doc_id, r.tie, r.rng) for r in spark.createDataFrame(rows, "doc_id long, tie long").select("*", place).collect()]
    for d, _, r in got:
        above, upto = (sum(c > d for c in cuts), sum(c >= d for c in cuts)) if d is not None else (len(cuts), ranges - 1)
        assert (above + 1 <= r <= upto) if d == 4 else (above <= r <= upto) if d is None else r == upto
    ordered = sorted(got, key=lambda x: (x[0] is None, -(x[0] or 0), -x[1]))
    assert [x[2] for x in ordered] == sorted(x[2] for x in got) and max(x[2] for x in got) == ranges - 1
    for d, n in ((4, 3), (None, 5)):
        counts = np.unique([x[2] for x in got if x[0] == d], return_counts=True)[1]
        assert len(counts) == n and counts.max() < 1.6 * counts.mean()


def test_one_id_and_no_id_hold_many_rows(make):
    """A third of the rows share an id, a third have none: the result is that of the order by (id, hash of the text), whatever the ranges."""
    rows = [((7, None, i)[i % 3], f"text {i} " * (i % 5)) for i in range(300)]
    assert rows_of_any(neighbours(make(rows), range_rows=10)) == rows_of_any(neighbours(make(rows), range_rows=10_000))


def rows_of_any(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_many_ranges_are_found_quickly(spark):
    """20,000 ranges for 200,000 rows cost a bisection a row, not a scan over all bounds."""
    start = time.time()
    ids = spark.range(200_000).selectExpr("id as doc_id", "xxhash64(id) as tie")
    place, ranges = _places(list(range(0, 200_000, 10)), 1)
    assert ids.select(place).groupBy("rng").count().agg({"count": "max"}).first()[0] == 10 and ranges == 20_001
    assert time.time() - start < 15
