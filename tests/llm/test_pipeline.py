"""The pipeline against brute force, stage by stage: each on what its predecessor kept."""

import corpus_pipeline as P
import pytest
from cohortflow.llm import toxicity
from cohortflow.llm.common import cut_lineage, table

from .conftest import SF
from .test_jaccard import brute as classes
from .test_mixing import size, targets_by_hand
from .test_packing import check as check_packing
from .test_substrings import brute as repeats


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, fn in P.STAGES:
        made = cut_lineage(fn(spark, docs, SF), name)
        out.append((name, docs, made))
        docs = made
    return {name: (before, after) for name, before, after in out}


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stage_list():
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_copies", "repeated_passages", "source_mix", "packing"] and P.ORACLE_SQL is None


def test_columns_stay(spark, stages):
    columns = table(spark, SF, "documents").columns
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "packing")


def test_toxic_documents_go(spark, stages):
    before, after = (rows(x) for x in stages["toxicity"])
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    weight = model.word_scores()
    bad = {d for d, r in before.items() if sum(weight[w] for w in toxicity.distinct_words(r.text)) >= model.thetas[0]}
    assert set(before) - set(after) == bad and all(after[d] == before[d] for d in after)


def test_one_of_each_class_stays(stages):
    before, after = (rows(x) for x in stages["near_copies"])
    first = {d: c for d, c, *_ in classes([(d, r.text) for d, r in before.items()])}
    assert set(after) == {d for d in before if first[d] == d} and all(after[d] == before[d] for d in after)


def test_repeats_are_cut(stages):
    before, after = (rows(x) for x in stages["repeated_passages"])
    want = {d: (n, kept) for d, _, n, kept in repeats([(d, r.text) for d, r in before.items()])}
    assert set(after) == set(before)
    for d, r in after.items():
        assert r.text == (want[d][1] if want[d][0] else before[d].text) and r.n_chars == len(r.text)


def test_sources_meet_their_targets(stages):
    before, after = stages["source_mix"]
    old, new = rows(before), after.collect()
    _, want = targets_by_hand([(d, r.text, r.source) for d, r in old.items()])
    for source, target in want.items():
        assert abs(sum(size(r.text) for r in new if r.source == source) - target) <= 64 * 3
    for d, r in old.items():
        assert sum(size(x.text) for x in new if x.doc_id == d) <= 2 * size(r.text)


def test_all_is_packed(stages):
    before, after = stages["packing"]
    used, least = check_packing([(r.doc_id, r.text) for r in before.collect()], after.collect(), 4096)
    assert used <= least + 1


def test_run_and_query_are_the_stages(spark, stages):
    from cohortflow.llm.queries import QUERIES
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    want = sorted(map(tuple, stages["packing"][1].select(key).collect()))
    assert sorted(map(tuple, QUERIES["pipeline"](spark, SF).select(key).collect())) == want


def test_empty_and_odd_documents(spark, make, tmp_path):
    """Every stage on an empty table, and on nulls, empty texts, repeated rows and a clashing column."""
    for t in ("labels",):
        table(spark, SF, t).write.parquet(str(tmp_path / f"{t}.parquet"))
    word = " ".join(f"w{i}" for i in range(300))
    odd = make([(1, None), (2, ""), (3, word), (3, word), (4, word + " x"), (None, "alone"), (5, "other words here", None, None)]).withColumnsRenamed({"lang": "labels"})
    for docs in (make([]), odd):
        for name, fn in P.STAGES:
            made = cut_lineage(fn(spark, docs, str(tmp_path)), f"odd-{name}")
            assert name == "packing" or made.columns == docs.columns
            docs = made
    assert 3 in {r.doc_id for r in docs.collect()}
