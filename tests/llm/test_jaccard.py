import random
import re

import numpy as np
from cohortflow.llm import jaccard
from cohortflow.llm.common import component_labels, cut_lineage, table
from cohortflow.llm.jaccard import jaccard_join, keep_one, least_agreements

from .conftest import SF


def sets_of(rows, size=5):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        out.append(frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, threshold=0.8):
    """(doc_id, class_id, copy_id, n_links, n_class_links) for rows with distinct ids."""
    sets = sets_of(rows)
    index, n = {}, len(rows)
    for i, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    links = [set() for _ in rows]
    for i, s in enumerate(sets):
        near = {}
        for g in s:
            for j in index[g]:
                near[j] = near.get(j, 0) + 1
        links[i] = {j for j, c in near.items() if j != i and c >= threshold * (len(s) + len(sets[j]) - c)}
    root = list(range(n))
    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for i in range(n):
        for j in links[i]:
            root[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[find(i)] = min(d, first.get(find(i), d))
    copy = {}
    for (d, _), s in zip(rows, sets):
        copy[s] = min(d, copy.get(s, d)) if s else d
    return sorted((d, first[find(i)], copy[sets[i]] if sets[i] else d, len(links[i]),
                   len({sets[j] for j in links[i]} - {sets[i]})) for i, (d, _) in enumerate(rows))


def rows_of(df):
    return sorted((r.doc_id, r.class_id, r.copy_id, r.n_links, r.n_class_links) for r in df.collect())


def test_equals_brute_force_on_documents(spark):
    docs = table(spark, SF.replace("sf0.001", "sf0.01"), "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got, want = rows_of(jaccard_join(docs)), brute(rows)
    assert got == want and any(x[3] for x in want) and any(x[4] for x in want)


def test_large_group_is_cut_into_blocks(make):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(150):
        w = base[:]
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((d, " ".join(w)))
    rows += [(200 + k, rows[3][1]) for k in range(40)] + [(300 + k, " ".join(rng.choice("abcdef") for _ in range(50))) for k in range(30)]
    assert rows_of(jaccard_join(make(rows), block=16)) == brute(rows)


def test_edge_cases(make):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "a b"), (5, "a b c"), (6, " \n"), (7, "long " * 30_000), (8, "long " * 20_000)]
    got = jaccard_join(make(rows).withColumnRenamed("lang", "node").withColumnRenamed("source", "key"))
    assert rows_of(got) == [(1, 1, 1, 0, 0), (2, 2, 2, 0, 0), (3, 3, 3, 1, 0), (4, 3, 3, 1, 0), (5, 5, 5, 0, 0), (6, 6, 6, 0, 0), (7, 7, 7, 1, 0), (8, 7, 7, 1, 0)]
    t = " ".join(f"w{i}" for i in range(60))
    odd = jaccard_join(make([(9, t), (9, t), (9, "other text"), (None, t + " more"), (None, "x y z")])).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in odd) == [
        ("9", "9", 0), ("9", "9", 2), ("9", "9", 2), ("None", "9", 2), ("None", "None", 0)]
    assert jaccard_join(make([])).collect() == []


def test_one_of_each_class_stays(make):
    t = " ".join(f"w{i}" for i in range(60))
    docs = make([(5, t), (3, t + " more"), (4, "else"), (6, None)])
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == [3, 4, 6]


def test_posterior_bounds():
    from math import comb
    for k, need in enumerate(least_agreements(0.8, 1e-6)):
        n = 16 * (k + 1)
        tail = lambda m: sum(comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(m + 1))
        assert tail(need) >= 1e-6 and (need == 0 or tail(need - 1) < 1e-6)


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, int(x)) for x in rng.integers(101, 140, 60)] + [(500, 400)]
    got = {r.node: r.root for r in component_labels(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **{n: 100 for e in edges for n in e if 100 <= n < 140}, 500: 400, 400: 400}


def test_rows_are_kept_by_row_not_by_id(make):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (7, a), (7, b), (3, c), (3, c + " tail"), (7, b), (None, b), (None, "only here"), (None, a), (None, None), (None, None), (8, ""), (8, " "), (8, "")]
    docs = make(rows, 4).withColumnRenamed("lang", "node").withColumnRenamed("source", "tag")
    kept = sorted(((r.doc_id, r.text) for r in keep_one(docs).collect()), key=str)
    by_class = [x for x in kept if x[0] == 3]
    assert len(by_class) == 1 and by_class[0][1] in (c, c + " tail")
    assert [x for x in kept if x[0] != 3] == sorted([(1, a), (7, b), (None, "only here"), (None, None), (8, ""), (8, " ")], key=str)
    assert keep_one(docs).columns == docs.columns
    again = sorted(((r.doc_id, r.text) for r in keep_one(docs.repartition(7)).collect()), key=str)
    assert again == kept


def near_copies(n, length=60, seed=3):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(length)]
    out = []
    for d in range(n):
        w = base[:]
        w[rng.randrange(length)] = f"x{d}"
        out.append(" ".join(w))
    return out


def test_near_copies_cost_rows_in_proportion(spark, make, monkeypatch):
    written = {}

    def counting(df, name="stage"):
        out = cut_lineage(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "cut_lineage", counting)
    n = 1500
    got = jaccard_join(make(list(enumerate(near_copies(n)))), block=256).collect()
    assert {r.class_id for r in got} == {0} and all(r.n_links > 0 for r in got)
    assert written["candidates"] <= jaccard.BANDS * n * 6 and written["links"] <= jaccard.BANDS * n * 6


def test_many_rows_without_an_id(make):
    texts = near_copies(400)
    got = jaccard_join(make([(None, t) for t in texts])).collect()
    want = {r.doc_id: r.n_links for r in jaccard_join(make(list(enumerate(texts)))).collect()}
    assert sorted(r.n_links for r in got) == sorted(want.values()) and len(keep_one(make([(None, t) for t in texts])).collect()) == 1
