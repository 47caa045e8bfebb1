"""Judging urls: rules first, then a multinomial naive Bayes over segmented host and path tokens.

Names in hosts are split into words by a unigram Viterbi. The unigrams are the words of the pages' own texts, counted over all
of them. They are never sent anywhere as a whole: each distinct name is cut into its substrings, these meet their
counts in a join, and the name's few known words are then enough to split it. The naive Bayes learns from the pages that a
rule decides, since urls have no other labels, and judges the rest. Its tokens are hashed into a fixed number of
buckets, so the model has a fixed size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, grouped, letter_runs, ship, slices

BUCKETS = 1 << 18
LONGEST = 63  # letters of a word that can be found in a name: no label of a host is longer
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
         Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def parts(url):
    """(host, path) columns of a url column; both are empty if it is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matched(host, path, rules: tuple[Rule, ...]):
    """(rule, verdict) of the longest rule that fits, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def word_counts(texts: DataFrame, col: str) -> DataFrame:
    """(word, n) over all texts: whole runs of letters outside of tags, in lower case."""
    tag = re.compile("<[^>]*>")

    def run(batches):
        for part in slices(batches, "text"):
            n = Counter()
            for t in part.column(0).to_pylist():
                if t:
                    n.update(letter_runs(tag.sub(" ", t.decode().lower())))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])

    return texts.select(F.col(col).cast("binary").alias("text")).mapInArrow(run, "word string, n long").groupBy(
        "word").agg(F.sum("n").alias("n"))


def split(name: str, known: dict[str, int], total: int) -> list[str]:
    """The likeliest segmentation of a name: a known word has probability n / total, an unknown one 1 / (total * 10^length)."""
    best, back = [0.0], [0]
    for e in range(1, len(name) + 1):
        top, at = -math.inf, e - 1
        for s in range(max(0, e - LONGEST), e):
            n = known.get(name[s:e], 0)
            p = best[s] + (math.log(n / total) if n else -math.log(total) - 2.302585 * (e - s))
            if p > top:
                top, at = p, s
        best.append(top)
        back.append(at)
    out, e = [], len(name)
    while e:
        out.append(name[back[e]:e])
        e = back[e]
    return out[::-1]


def _segment(total: int):
    def run(batches):
        for g in grouped(batches, "name"):
            name = g.column(0)[0].as_py()
            known = {w: n for w, n in zip(g.column(1).to_pylist(), g.column(2).to_pylist(), strict=True) if n is not None}
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([split(name, known, total)], pa.list_(pa.string()))], names=["name", "words"])
    return run


def segments(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) for distinct names of letters."""
    total = max(1, counts.agg(F.sum("n")).first()[0] or 0)
    subs = names.select("name", F.explode(F.expr(
        f"array_distinct(flatten(transform(sequence(1, length(name)), i -> transform(sequence(1, least({LONGEST}, length(name) - i + 1)), "
        "k -> substring(name, i, k)))))")).alias("word"))
    parts_ = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = subs.join(counts, "word").select("name", "word", "n")
    # every name stays, also one without any known word
    every = found.unionByName(names.select("name", F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("n")))
    return every.repartition(parts_, "name").sortWithinPartitions("name").mapInArrow(_segment(total), "name string, words array<string>")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, smooth: float = 1.0, id_col: str = "page_id", url_col: str = "url",
          text_col: str = "html") -> DataFrame:
    """Judge every url. Returns one row for each row of ``pages``: page_id, host, path, rule, verdict and score (the log odds of
    ``block``; null where a rule decides). A null url, or one without ``://``, has an empty host and path and no tokens: the
    classes' shares decide, and equal ones allow. Without any page that a rule decides all shares are equal. Texts may be null.
    Rows that repeat an id are judged one by one. Other columns are not read.
    """
    host, path = parts(F.col(url_col))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    base = ship(pages).select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("known"))
    base = cut_lineage(base, "urls")

    # words of every distinct host: runs of letters are segmented, runs of digits stand for their length
    hosts = base.select("host").distinct().withColumn("names", F.regexp_extract_all(F.lower("host"), F.lit(r"(\p{L}+|[0-9]+)"), F.lit(1)))
    pairs = hosts.select("host", F.posexplode("names").alias("at", "name"))
    digits = F.col("name").rlike("^[0-9]")
    counts = cut_lineage(word_counts(pages, text_col), "words")  # the total and the join read it
    numbers = pairs.filter(digits).select("name").distinct().select("name", F.array(F.concat(F.lit("#"), F.length("name").cast("string"))).alias("words"))
    known = segments(pairs.filter(~digits).select("name").distinct(), counts).unionByName(numbers)
    # one row for each name; hosts that share a frequent name are spread by the join's own handling of skew
    by_host = pairs.join(known, "name").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("w")).select(
        F.col("host").alias("__host"), F.flatten(F.col("w.words")).alias("words"))
    in_path = F.transform(F.regexp_extract_all(F.lower("path"), F.lit(r"([\p{L}]+|[0-9]+)"), F.lit(1)),
                          lambda t: F.concat(F.lit("/"), F.when(t.rlike("^[0-9]"), F.concat(F.lit("#"), F.length(t).cast("string"))).otherwise(t)))
    tokens = F.concat(F.coalesce("words", F.array().cast("array<string>")), in_path)
    urls = cut_lineage(base.join(by_host, F.col("host") == F.col("__host"), "left").select(
        "page_id", "host", "path", "rule", "known", F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int")).alias("tokens")), "tokens")

    # the model: counts of BUCKETS buckets and two classes at most
    labelled = urls.filter(F.col("known").isNotNull()).select((F.col("known") == "block").cast("int").alias("y"), "tokens")
    share = {r.y: r.n for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = np.zeros((2, BUCKETS))
    for r in labelled.select("y", F.explode("tokens").alias("t")).groupBy("y", "t").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        n[r.y, r.t] = r.n
    seen = int(np.count_nonzero(n.sum(axis=0)))
    odds = np.log((n[1] + smooth) / (n[1].sum() + smooth * (seen + 1))) - np.log((n[0] + smooth) / (n[0].sum() + smooth * (seen + 1)))
    odds[n.sum(axis=0) == 0] = 0  # a token that was never seen says nothing
    prior = math.log((share.get(1, 0) + 1) / (share.get(0, 0) + 1))
    odds = odds.astype(np.float32)

    def run(batches):
        for b in batches:
            col = b.column(5)
            lists = pa.array(col) if not isinstance(col, pa.ChunkedArray) else col.combine_chunks()
            flat, n = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy())
            score = np.bincount(np.repeat(np.arange(len(n)), n), odds[flat].astype(float), minlength=len(n)) + prior
            own = b.column(4).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([k or ("block" if s > 0 else "allow") for k, s in zip(own, score, strict=True)], pa.string()),
                                              pa.array([None if k else float(s) for k, s in zip(own, score, strict=True)], pa.float64())],
                                             names=["page_id", "host", "path", "rule", "verdict", "score"])

    kind = base.schema["page_id"].dataType.simpleString()
    return urls.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
