"""The queries of this package by name, and the SQL that recomputes those that SQL can express."""

from __future__ import annotations

from llm.collocations import op13_misra_gries
from llm.decontaminate import op7_cgk_lsh
from llm.hard_negatives import op11_strassen
from llm.language_id import op12_byte_cnn
from llm.language_model import op3_stupid_backoff
from llm.near_duplicates import op2_chosen_path
from llm.packing import op5_cost_balanced
from llm.pages import op9_max_subsequence
from llm.quality import op4_compression_bands
from llm.secrets import op6_blob_ledger
from llm.substrings import op10_count_min
from llm.tokens import op8_longest_match
from llm.toxicity import op1_nnpu

QUERIES = {f.__name__: f for f in (
    op1_nnpu, op2_chosen_path, op3_stupid_backoff, op4_compression_bands, op5_cost_balanced, op6_blob_ledger, op7_cgk_lsh,
    op8_longest_match, op9_max_subsequence, op10_count_min, op11_strassen, op12_byte_cnn, op13_misra_gries)}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op2_chosen_path": rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
one AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM one a JOIN one b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
smallest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sets s JOIN smallest l USING (doc_id)
""",
    "op3_stupid_backoff": rf"""
WITH words AS (SELECT doc_id, {WORDS} AS w FROM documents),
one AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS before
        FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
size AS (SELECT doc_id, len(w) AS n_words, sum(len(w)) OVER () - len(w) AS others FROM words),
c1 AS (SELECT word, count(*) AS n FROM one GROUP BY word),
own1 AS (SELECT doc_id, word, count(*) AS n FROM one GROUP BY doc_id, word),
c2 AS (SELECT before, word, count(*) AS n FROM one WHERE before IS NOT NULL GROUP BY before, word),
own2 AS (SELECT doc_id, before, word, count(*) AS n FROM one WHERE before IS NOT NULL GROUP BY doc_id, before, word),
rest1 AS (SELECT doc_id, word, c1.n - own1.n AS n FROM own1 JOIN c1 USING (word)),
rest2 AS (SELECT doc_id, before, word, c2.n - own2.n AS n FROM own2 JOIN c2 USING (before, word)),
scored AS (
  SELECT o.doc_id, CASE
    WHEN b.n > 0 THEN ln(b.n) - ln(h.n)
    ELSE (CASE WHEN o.before IS NULL THEN 0 ELSE ln(0.4) END)
         + ln((CASE WHEN u.n > 0 THEN u.n ELSE 0.4 END)::DOUBLE / (s.others + 1)) END AS score
  FROM one o JOIN size s ON s.doc_id = o.doc_id
  JOIN rest1 u ON u.doc_id = o.doc_id AND u.word = o.word
  LEFT JOIN rest2 b ON b.doc_id = o.doc_id AND b.before = o.before AND b.word = o.word
  LEFT JOIN rest1 h ON h.doc_id = o.doc_id AND h.word = o.before)
SELECT s.doc_id, s.n_words, round(coalesce(t.total, 0.0), 3) AS log_score, round(t.total / s.n_words, 6) AS mean_log_score
FROM size s LEFT JOIN (SELECT doc_id, sum(score) AS total FROM scored GROUP BY doc_id) t USING (doc_id)
""",
    "op10_count_min": rf"""
WITH words AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS run
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, unnest(range(0, 20)) AS t(k)),
one AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
kept AS (SELECT o.doc_id, count(*) AS n, string_agg(o.word, ' ' ORDER BY o.i) AS text
         FROM one o ANTI JOIN gone g ON g.doc_id = o.doc_id AND g.i = o.i GROUP BY o.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words d LEFT JOIN kept k USING (doc_id)
""",
    "op11_strassen": """
WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 10
""",
    "op13_misra_gries": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
      FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
size AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
one AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
      FROM one, unnest(range(1, 6)) AS t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k AS m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, g.k, x.f AS l, y.f AS r, CAST(size.n AS HUGEINT) AS n
  FROM c JOIN unnest(range(1, 5)) AS g(k) ON g.k < c.m
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : g.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[g.k + 1 : c.m], ' ') JOIN size ON size.lang = c.lang),
best AS (SELECT *, (1000::HUGEINT * a * n) // (l::HUGEINT * r) AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY (1000::HUGEINT * a * n) // (l::HUGEINT * r), k) = 1),
inside AS (SELECT c.lang, array_to_string(c.w[s.i : s.i + s.m - 1], ' ') AS phrase, max(c.a) AS longer
  FROM c JOIN (SELECT i, m FROM unnest(range(1, 5)) AS u(i), unnest(range(2, 5)) AS v(m)) s ON s.m < c.m AND s.i + s.m - 1 <= c.m GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR i.longer < b.a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) <= 2000
""",
}
