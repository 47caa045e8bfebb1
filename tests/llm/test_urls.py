import itertools
import math
import re
from collections import Counter

import regex
from cohortflow.llm.common import table
from cohortflow.llm.urls import RULES, judge, parts, segments, split, word_counts
from pyspark.sql import functions as F

from .conftest import SF


def parts_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min([i for c in "?#" if (i := rest.find(c)) >= 0], default=len(rest))
    return "".join(c.lower() if c.isascii() else c for c in host), rest[:cut]


def rule_by_hand(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    r = max(fit, key=lambda r: len(r.name), default=None)
    return (r.name, r.verdict) if r else (None, None)


def tokens(host, path, counts, total):
    out = [w for name in regex.findall(r"\p{L}+|[0-9]+", host.lower()) for w in ([f"#{len(name)}"] if name[0].isdecimal() else split(name, counts, total))]
    return out + ["/" + (f"#{len(t)}" if t[0].isdigit() else t) for t in re.findall(r"[^\W\d_]+|[0-9]+", path.lower())]


def verdicts_by_hand(rows):
    counts = Counter(w for _, _, html in rows for w in regex.findall(r"\p{L}+", re.sub("<[^>]*>", " ", (html or "").lower())))
    total = max(1, sum(counts.values()))
    urls = [parts_by_hand(u) for _, u, _ in rows]
    n, share = [Counter(), Counter()], [1, 1]
    for h, p in urls:
        v = rule_by_hand(h, p)[1]
        if v:
            y = int(v == "block")
            share[y] += 1
            n[y].update(tokens(h, p, counts, total))
    seen, size = n[0].keys() | n[1].keys(), [sum(c.values()) for c in n]
    out = []
    for (i, _, _), (h, p) in zip(rows, urls):
        name, v = rule_by_hand(h, p)
        s = math.log(share[1] / share[0]) + sum(
            math.log((n[1][t] + 1) / (size[1] + len(seen) + 1)) - math.log((n[0][t] + 1) / (size[0] + len(seen) + 1))
            for t in tokens(h, p, counts, total) if t in seen)
        out.append((i, h, p, name, v or ("block" if s > 0 else "allow"), None if v else s))
    return out


def same(got, want):
    key = lambda r: str(tuple(r)[:4])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [tuple(g)[:5] for g in got] == [w[:5] for w in want]
    assert all(g[5] == w[5] or abs(g[5] - w[5]) < 1e-4 for g, w in zip(got, want))


def test_equals_brute_force_on_pages(spark):
    pages = table(spark, SF.replace("sf0.001", "sf0.01"), "pages")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    got = judge(pages).collect()
    same(got, verdicts_by_hand(rows))
    assert {r.verdict for r in got if r.rule is None} and {r.rule for r in got} > {"com/", None}


ODD = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "a://b://c/d", "http://x.com", "http://com/", "http://notcom/", "http://x.com?/en/",
       "http://example.com/en", "http://m.example.com/en/", "http://www.example.com/en/1", "http://a.www.example.com/en/1", "http://x.net/fr/", "http://x.net/fr",
       "https://bücher.example.org/straße/1", "http://thecatsat.org/dog\n/x", "http://u:p@h.net:80/es/" + "x" * 50_000, "http://" + "the" * 400 + ".org/",
       "http://für2024katze.example.org/a", "http://12.34.5/x", "http://donaudampfschifffahrtsgesellschaftsauto.org/", "http://ÜBER.example.org/½"]


def test_edge_cases(spark):
    rows = [(i, u, h) for i, (u, h) in enumerate(zip(ODD, itertools.cycle([None, "", "<p>the cat sat <b>on</b> für Donaudampfschifffahrtsgesellschaft", "<unclosed the the"])))]
    rows += [(3, "http://x.com/a", "the"), (3, "http://x.com/a", "the"), (None, "http://x.org/a", "the")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, tokens string").withColumnRenamed("tokens", "host")
    same(judge(df).collect(), verdicts_by_hand(rows))
    none = judge(df.filter("page_id = 999"))
    assert none.collect() == [] and none.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    alone = judge(df.filter("page_id is null")).collect()
    assert [(r.verdict, r.score) for r in alone] == [("allow", 0.0)]


def test_parts(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)], "i int, u string")
    host, path = parts(F.col("u"))
    assert [tuple(r) for r in df.orderBy("i").select(host, path).collect()] == [parts_by_hand(u) for u in ODD]


def test_viterbi_is_the_best_segmentation(spark):
    known, total = {"the": 50, "cat": 10, "thecat": 1, "at": 30, "sat": 9, "c": 2}, 1000

    def p(words):
        return sum(math.log(known[w] / total) if w in known else -math.log(total) - 2.302585 * len(w) for w in words)

    def every(s):
        return [[]] if not s else [[s[:k], *r] for k in range(1, len(s) + 1) for r in every(s[k:])]

    for name in ("thecatsat", "catx", "zzz", "a", "thecat"):
        assert math.isclose(p(split(name, known, total)), max(map(p, every(name))))
    texts = spark.createDataFrame([("the the cat",), ("<the> cat sat",), (None,)], "t string")
    counts = word_counts(texts, "t")
    assert {r.word: r.n for r in counts.collect()} == {"the": 2, "cat": 2, "sat": 1}
    names = spark.createDataFrame([("thecatsat",), ("qq",)], "name string")
    assert {r.name: r.words for r in segments(names, counts).collect()}["thecatsat"] == ["the", "cat", "sat"]
