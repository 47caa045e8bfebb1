import zlib

import numpy as np
import public_tokenizers
from cohortflow.llm.common import table
from cohortflow.llm.packing import best_fit, pack, pack_sizes
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from .conftest import SF

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def check(rows, out, length):
    tok = Tokenizer.from_file(VOCAB)
    want = []
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), length)):
            cut = np.array(ids[at:at + length], "<u4")
            want.append((d, k, at, len(cut), zlib.crc32(cut.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=str) == sorted(want, key=str)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= length
    return len(bins), -(-sum(r.length for r in out) // length)


def test_documents_round_trip_and_tight(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    used, least = check(rows, pack(docs, VOCAB).collect(), 4096)
    assert used <= least + 1


def test_edge_cases(make):
    odd = ["Ünḯ co de ẞΣ ς", "a\x1cb \x0b\x0c c d", "<|endoftext|> x<|startoftext|>y", "it's WE'LL 12ä", "́ ́a", "x" * 3000]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "same"), (4, "same"), (4, "other"), (None, "nothing"), (5, "word " * 900), *((10 + i, t) for i, t in enumerate(odd))]
    docs = make(rows).withColumnRenamed("lang", "shard").withColumnRenamed("source", "length")
    check(rows, pack(docs, VOCAB, length=64).collect(), 64)
    check(rows, pack(docs, VOCAB, length=64, shard_rows=5).collect(), 64)
    assert pack(make([]), VOCAB).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_local_search_never_worsens(sizes):
    sizes = np.array(sizes)
    bins, offset = pack_sizes(sizes, 100)
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= 100 and fill.min() > 0 and len(fill) <= len(best_fit(sizes, 100))


def test_exchanges_reach_the_optimum_that_best_fit_misses():
    sizes = np.array([6, 5, 5, 4, 4, 3, 3])  # 30 = 3 x 10; best fit in descending order takes 4 bins or 3
    assert pack_sizes(sizes, 10)[0].max() + 1 == 3
    rng = np.random.default_rng(3)
    cuts = [np.diff(np.r_[0, np.sort(rng.choice(np.arange(1, 4096), 3, False)), 4096]) for _ in range(200)]
    sizes = rng.permutation(np.concatenate(cuts))
    assert pack_sizes(sizes, 4096)[0].max() + 1 <= 201 <= len(best_fit(sizes, 4096)) + 1
