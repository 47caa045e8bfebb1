"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .common import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_nearest_neighbours(spark, sf_dir):
    from .ann import nearest
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))


@query
def op2_language_id(spark, sf_dir):
    from .langid import fit, identify
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs, public_tokenizers.path("piece_bpe_32k.model")))


@query
def op3_ngram_jaccard_join(spark, sf_dir):
    from .jaccard import jaccard_join
    return jaccard_join(table(spark, sf_dir, "documents"))


@query
def op4_substring_dedup(spark, sf_dir):
    from .substrings import remove_repeats
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op5_source_mixing(spark, sf_dir):
    from .mixing import mix
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op6_url_filters(spark, sf_dir):
    from .urls import judge
    return judge(table(spark, sf_dir, "pages"))


@query
def op7_lz_fingerprints(spark, sf_dir):
    from .lzprint import neighbours
    return neighbours(table(spark, sf_dir, "documents"))


@query
def op8_best_fit_packing(spark, sf_dir):
    from .packing import pack
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_toxicity(spark, sf_dir):
    from .toxicity import fit, score
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


@query
def op10_quality(spark, sf_dir):
    from .quality import fit, score
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


@query
def op11_whitening(spark, sf_dir):
    from .whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_quality_rules(spark, sf_dir):
    from .rules import judge
    return judge(table(spark, sf_dir, "documents"))


@query
def op13_spelling_variants(spark, sf_dir):
    from .variants import variants, vocabulary
    return variants(vocabulary(table(spark, sf_dir, "documents"), drop_every=199))


ORACLE_SQL["op4_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                             '[\x20\x09-\x0D]+') AS a FROM documents),
e AS (SELECT doc_id, CASE WHEN a = [''] THEN [] ELSE a END AS w FROM d),
s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM e WHERE len(w) >= 13),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS k FROM s),
f AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
h AS (SELECT g.doc_id, g.i FROM g JOIN f USING (k) WHERE g.doc_id > f.least),
c AS (SELECT DISTINCT doc_id, i + o AS i FROM h, generate_series(0, 12) AS t(o)),
x AS (SELECT e.doc_id, u.i, e.w[u.i] AS word FROM e, unnest(generate_series(1, len(e.w))) AS u(i)),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept, count(*) AS n_kept
      FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i WHERE c.doc_id IS NULL GROUP BY x.doc_id)
SELECT e.doc_id, CAST(len(e.w) AS BIGINT) AS n_words, CAST(len(e.w) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM e LEFT JOIN k ON k.doc_id = e.doc_id
"""


@query
def pipeline(spark, sf_dir):
    from corpus_pipeline import run
    return run(spark, sf_dir)

ORACLE_SQL["op3_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                    '[\x20\x09-\x0D]+') AS a FROM documents),
e AS (SELECT doc_id, CASE WHEN a = [''] THEN [] ELSE a END AS w FROM d),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM e),
c AS (SELECT doc_id, g, len(g) AS n, CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY g) END AS copy_id FROM s),
r AS (SELECT copy_id, any_value(g) AS g, any_value(n) AS n, count(*) AS copies FROM c WHERE n > 0 GROUP BY copy_id),
x AS (SELECT copy_id, n, unnest(g) AS k FROM r),
j AS (SELECT a.copy_id AS u, b.copy_id AS v, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS hits
      FROM x a JOIN x b ON a.k = b.k AND a.copy_id < b.copy_id GROUP BY ALL),
l AS (SELECT u, v FROM j WHERE hits >= 0.8 * (m + n - hits) - 1e-9),
t AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
p AS (SELECT copy_id AS node, copy_id AS seen FROM r UNION SELECT p.node, t.v FROM p JOIN t ON t.u = p.seen),
f AS (SELECT node, min(seen) AS class_id FROM p GROUP BY node),
q AS (SELECT t.u AS node, count(*) AS n_class_links, sum(r.copies) AS docs FROM t JOIN r ON r.copy_id = t.v GROUP BY t.u)
SELECT c.doc_id, coalesce(f.class_id, c.doc_id) AS class_id, c.copy_id,
       CAST(coalesce(r.copies, 1) - 1 + coalesce(q.docs, 0) AS BIGINT) AS n_links,
       CAST(coalesce(q.n_class_links, 0) AS BIGINT) AS n_class_links, CAST(c.n AS BIGINT) AS n_shingles
FROM c LEFT JOIN r ON r.copy_id = c.copy_id AND c.n > 0 LEFT JOIN f ON f.node = r.copy_id LEFT JOIN q ON q.node = r.copy_id
"""


ORACLE_SQL["op12_quality_rules"] = r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, lang, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM l WHERE len(w) >= 8),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM s),
h AS (SELECT doc_id, unnest(list(i)) AS i FROM g GROUP BY doc_id, k HAVING count(*) > 1),
v AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM h, generate_series(0, 7) AS x(o) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) - count(DISTINCT y) AS n FROM
        (SELECT doc_id, unnest(string_split(t, chr(10))) AS y FROM d) WHERE regexp_matches(y, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT doc_id, lang, t, w, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             coalesce(n.n, 0) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words,
             len(w) < 20 OR 100 * coalesce(v.n, 0) > 30 * len(w) AS base_failed,
             list_transform(['[^a-z]', '[^A-Z]', '[^0-9]', '[^ \t\r\x0b\x0c]', '[^\n]', '[^.,;:!?]', '[^''"()-]', '[^#*$%&|<>]',
                             '[^\x00-\x08\x0e-\x1f+/=@\[\\\]^_`{}~\x7f]', '[^\x{C0}-\x{27F}]', '[\x00-\x7f\x{C0}-\x{27F}]'],
                            lambda r: length(regexp_replace(t, r, '', 'g'))) AS a
      FROM l LEFT JOIN v USING (doc_id) LEFT JOIN n USING (doc_id)),
o AS (SELECT doc_id, lang, base_failed, unnest(w) AS x FROM c),
p AS (SELECT doc_id, lang, base_failed, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM o),
z AS (SELECT lang, count(*) AS total FROM p WHERE lang IS NOT NULL AND NOT base_failed GROUP BY lang),
r AS (SELECT lang, total FROM z WHERE total * 1000 >= (SELECT sum(total) FROM z)),
f AS (SELECT lang, x, count(*) AS n FROM p JOIN r USING (lang) WHERE NOT base_failed GROUP BY lang, x
      QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, x) <= 40),
ws AS (SELECT lang, x, n / total AS share FROM f JOIN r USING (lang) UNION ALL
       SELECT lang, NULL, 1 - sum(n) / any_value(total) FROM f JOIN r USING (lang) GROUP BY lang),
cc AS (SELECT doc_id, lang, base_failed, unnest(a) AS n, unnest(generate_series(1, 11)) AS k FROM c),
cs AS (SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS share FROM cc JOIN r USING (lang) WHERE NOT base_failed GROUP BY lang, k),
dw AS (SELECT p.doc_id, f.lang, f.x, count(*) AS n FROM p JOIN f ON f.x = p.x GROUP BY ALL),
dn AS (SELECT doc_id, lang, x, n FROM dw UNION ALL
       SELECT c.doc_id, r.lang, NULL, c.n_words - coalesce(sum(dw.n), 0) FROM c CROSS JOIN r
       LEFT JOIN dw ON dw.doc_id = c.doc_id AND dw.lang = r.lang GROUP BY c.doc_id, r.lang, c.n_words),
jw AS (SELECT c.doc_id, ws.lang, sqrt(greatest(0, sum(
              CASE WHEN coalesce(dn.n, 0) > 0 THEN dn.n / c.n_words * log2((dn.n / c.n_words) / ((dn.n / c.n_words + share) / 2)) ELSE 0 END
              + CASE WHEN share > 0 THEN share * log2(share / ((coalesce(dn.n, 0) / c.n_words + share) / 2)) ELSE 0 END)) / 2) AS w
       FROM c CROSS JOIN ws LEFT JOIN dn ON dn.doc_id = c.doc_id AND dn.lang = ws.lang AND dn.x IS NOT DISTINCT FROM ws.x
       WHERE c.n_words > 0 GROUP BY c.doc_id, ws.lang),
jc AS (SELECT y.doc_id, cs.lang, sqrt(greatest(0, sum(
              CASE WHEN y.n > 0 THEN y.n / m * log2((y.n / m) / ((y.n / m + share) / 2)) ELSE 0 END
              + CASE WHEN share > 0 THEN share * log2(share / ((y.n / m + share) / 2)) ELSE 0 END)) / 2) AS ch
       FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS m FROM cc) y JOIN cs USING (k) WHERE m > 0 GROUP BY y.doc_id, cs.lang),
b AS (SELECT jw.doc_id, jw.lang AS reference, w AS wd, ch FROM jw JOIN jc ON jc.doc_id = jw.doc_id AND jc.lang = jw.lang
      QUALIFY row_number() OVER (PARTITION BY jw.doc_id ORDER BY w + ch, jw.lang) = 1)
SELECT c.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(a[8] AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND (length(t) < 80 OR ch IS NULL OR ch <= sqrt(0.32 * 0.32 + 10 / (8 * ln(2) * length(t))))
         AND (n_words < 20 OR wd IS NULL OR wd <= sqrt(0.27 * 0.27 + 40 / (8 * ln(2) * n_words))) AS kept,
       CASE WHEN length(t) >= 80 OR n_words >= 20 THEN reference END AS reference,
       CASE WHEN length(t) >= 80 THEN round(ch, 6) END AS char_distance, CASE WHEN n_words >= 20 THEN round(wd, 6) END AS word_distance
FROM c LEFT JOIN b ON b.doc_id = c.doc_id
"""

ORACLE_SQL["op13_spelling_variants"] = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
a AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS r
      FROM documents),
b AS (SELECT doc_id, r, count(*) AS n FROM a GROUP BY doc_id, r),
c AS (SELECT r, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r, ''),
             lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END)) AS s FROM b),
h AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295, s), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS h FROM c, crc),
e AS (SELECT CASE WHEN h % 199 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
i AS (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM v),
d AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS d FROM i),
p AS (SELECT x.word, y.word AS other, y.n FROM d x JOIN v y ON y.word = x.d UNION
      SELECT y.word, x.word, x.n FROM d x JOIN v y ON y.word = x.d UNION
      SELECT x.word, y.word, y.n FROM d x JOIN d y ON x.d = y.d AND x.i = y.i AND x.word <> y.word),
q AS (SELECT word, count(*) AS n_near, max(n) AS m FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN m END AS form_n,
             CASE WHEN m >= 5 * v.n THEN (SELECT min(p.other) FROM p WHERE p.word = v.word AND p.n = m) END AS form
      FROM v LEFT JOIN q ON q.word = v.word),
g AS (SELECT word, word AS at FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, g.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM f JOIN g ON g.word = f.word JOIN f AS l ON l.word = g.at AND l.form IS NULL
"""
