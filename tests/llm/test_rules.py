import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cohortflow.llm import rules
from cohortflow.llm.common import table
from cohortflow.llm.rules import CLASSES, Counts, Limits, judge, js_distance, references, widened
from pyspark.sql import functions as F

from .conftest import SF


def base(text):
    """The base counts, straight from their definition."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n)


def classes(text):
    out = dict.fromkeys(CLASSES, 0)
    for c in text:
        if ord(c) < 128:
            out[next((k for k, v in CLASSES.items() if k not in ("latin", "other") and ord(c) in v), "ascii")] += 1
        else:
            out["latin" if 0xC0 <= ord(c) < 0x280 else "other"] += 1
    return list(out.values())


ODD = ["", None, " \n\t ", "one", "a b c d e f g h a b c d e f g h", "x " * 500, "l1\nl1\n\nl1 \n \nl2\nl2", "ÀÿĀɿʀ ½ € 𝒳 \x85\xa0z",
       "a b c\x1cd", "# * $ % & | < > #*", "w" * 9_000_000 + " tail", "one two three four five six seven eight nine " * 3]


@pytest.mark.parametrize("chunk", [1 << 22, 7])
def test_counts_of_odd_texts(monkeypatch, chunk):
    odd = ODD if chunk > 100 else [t for t in ODD if not t or len(t) < 5000]
    monkeypatch.setattr(rules, "_CHUNK", chunk)
    texts = pa.array(["skipped", *odd])[1:]
    got = Counts(texts, Limits())
    lines = got.dup_lines(texts)
    for i, t in enumerate(odd):
        assert (got.words[i], got.word_chars[i], got.symbols[i], lines[i], got.repeated[i], bool(got.failed[i])) == base(t), i
        assert got.classes[i].tolist() == classes(t or "")


def test_repeats_across_documents_do_not_count():
    text = "one two three four five six seven eight nine ten"
    assert Counts(pa.array([text, text]), Limits()).repeated.tolist() == [0, 0]


def test_distance():
    share = np.array([0.5, 0.25, 0.25])
    assert js_distance(np.array([[2, 1, 1], [0, 0, 0]]), share).tolist() == [0.0, 1.0]
    assert js_distance(np.array([[0, 0, 0, 5]]), np.array([0.5, 0.25, 0.25, 0]))[0] == 1.0
    p, m = np.array([1, 0, 0]), np.array([0.75, 0.125, 0.125])
    want = np.sqrt((np.log2(1 / 0.75) + (0.5 * np.log2(0.5 / 0.75) + 0.5 * np.log2(2))) / 2)
    assert abs(js_distance(p[None], share)[0] - want) < 1e-12 and m.sum() == 1
    assert widened(0.3, 41, np.array([1, 50, 10**9]))[2] < 0.3001


def plain(rows, limits):
    """The whole method in plain Python: (counts..., failed, kept, reference, distances) of each text."""
    words = {}
    chars = {}
    for _, text, lang, *_ in rows:
        if lang is not None and not base(text)[5]:
            words.setdefault(lang, Counter()).update(w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text))
            chars[lang] = chars.get(lang, 0) + np.array(classes(text))
    total = sum(c.total() for c in words.values())
    refs = []
    for lang in sorted(words):
        if words[lang].total() * 1000 >= total:
            top = sorted(words[lang], key=lambda w: (-words[lang][w], w))[:limits.top]
            n = [words[lang][w] for w in top]
            refs.append((lang, chars[lang] / chars[lang].sum(), top, np.array([*n, words[lang].total() - sum(n)]) / words[lang].total()))
    out = []
    for _, text, *_ in rows:
        b, low = base(text), Counter(w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        best = (9, "", 9, 9)
        for lang, cs, top, ws in refs:
            hist = [low[w] for w in top]
            c, w = js_distance(np.array([classes(text or "")]), cs)[0], js_distance(np.array([[*hist, low.total() - sum(hist)]]), ws)[0]
            best = min(best, (c + w, lang, c, w))
        size = len(text or "")
        far = (size >= 80 and best[2] > widened(0.32, 11, size)) or (b[0] >= 20 and best[3] > widened(0.27, 41, b[0]))
        out.append((*b, not b[5] and not far, best[1] if size >= 80 or b[0] >= 20 else None,
                    float(round(best[2], 6)) if size >= 80 else None, float(round(best[3], 6)) if b[0] >= 20 else None))
    return out


def test_against_plain_python(spark, make):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    rows += [(10**6 + i, t, "en") for i, t in enumerate(ODD) if not t or len(t) < 5000] + [(None, rows[0][1], None), rows[1], (5, rows[2][1], "xx")]
    def key(r):
        return tuple((x is not None, x) for x in r)
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.reference,
            r.char_distance, r.word_distance) for r in judge(make([(*r, "s", 1) for r in rows], 7)).collect()]
    want = [(r[0], *w) for r, w in zip(rows, plain(rows, Limits()), strict=True)]
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:9] == w[:9]
        assert all(a == b or abs(a - b) < 2e-6 for a, b in zip(g[9:], w[9:], strict=True))


def test_labelled_documents(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    got = judge(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").filter("NOT base_failed")
    share = {r.quality: r.share for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] >= 0.995 and share[0] <= 0.1


def test_no_references_and_empty(spark, make):
    text = " ".join(f"w{i}" for i in range(30))
    got = {r.doc_id: r for r in judge(make([(1, text, None, None, 1), (2, "short", None, None, 1), (3, None, None, None, None)])).collect()}
    assert [got[i].kept for i in (1, 2, 3)] == [True, False, False] and got[1].reference is None
    assert judge(make([])).collect() == [] and references(make([])) == []
    renamed = make([(1, text)]).select(F.col("doc_id").alias("i"), F.col("text").alias("t"), F.lit("x").alias("kept"), F.lit("en").alias("l"))
    assert judge(renamed, id_col="i", text_col="t", lang_col="l").first().doc_id == 1
