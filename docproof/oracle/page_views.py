"""Views for OCR boxes: the running line state, merged lines, and fused engines."""

from . import VIEWS
from .text_views import normalise, trigrams

VIEWS["ordered_tokens"] = """
SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, line, word) AS i FROM tokens"""
# The running level over the distinct y of a page; a y with n tokens halves the distance n times.
VIEWS["levels"] = """
SELECT doc_id, page_no, y0, count(*) AS n,
  row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0) AS i FROM tokens GROUP BY doc_id, page_no, y0"""
VIEWS["level_walk"] = """
SELECT doc_id, page_no, i, y0, CAST(y0 AS DOUBLE) AS level, CAST(1 AS INTEGER) AS line_no FROM levels WHERE i = 1
UNION ALL
SELECT t.doc_id, t.page_no, t.i, t.y0,
  CASE WHEN abs(t.y0 - w.level) <= 12 THEN list_reduce(range(t.n), lambda a, x: (a + t.y0) / 2, w.level) ELSE CAST(t.y0 AS DOUBLE) END,
  CAST(CASE WHEN abs(t.y0 - w.level) <= 12 THEN w.line_no ELSE w.line_no + 1 END AS INTEGER)
FROM level_walk w JOIN levels t ON t.doc_id = w.doc_id AND t.page_no = w.page_no AND t.i = w.i + 1"""
VIEWS["token_lines"] = """
SELECT t.*, w.line_no FROM ordered_tokens t JOIN level_walk w ON t.doc_id = w.doc_id AND t.page_no = w.page_no AND t.y0 = w.y0"""
VIEWS["merged_lines"] = """
SELECT doc_id, page_no, line_no, string_agg(text, ' ' ORDER BY i) AS text, round_even(list_reduce(list(confidence ORDER BY i), lambda a, b: a + b) / count(*), 6) AS confidence,
  min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS tokens
FROM token_lines GROUP BY doc_id, page_no, line_no"""
_norm = f"lower({normalise('text')})"
VIEWS["second_lines"] = f"""
SELECT *, CASE WHEN norm <> '' THEN {trigrams('norm')} ELSE [] END AS g
FROM (SELECT doc_id, page_no, line_no AS ord, text, confidence, {_norm} AS norm FROM merged_lines) m"""
VIEWS["first_lines"] = f"""
SELECT *, CASE WHEN norm <> '' THEN {trigrams('norm')} ELSE [] END AS g FROM (SELECT *, {_norm} AS norm FROM primary_lines) p"""


def alike(a: str, b: str) -> str:
    """Jaccard of two gram lists, tried only where their sizes allow it."""
    shared = f"len(list_intersect({a}, {b}))"
    return (f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 OR len({a}) < 0.74 * len({b}) OR len({b}) < 0.74 * len({a}) THEN false "
            f"ELSE {shared} / (len({a}) + len({b}) - {shared}) >= 0.75 END)")


VIEWS["line_wins"] = f"""
SELECT p.doc_id, p.page_no, p.ord, min(s.ord) AS s_ord
FROM first_lines p JOIN second_lines s ON p.doc_id = s.doc_id AND p.page_no = s.page_no AND s.confidence > p.confidence
WHERE {alike('p.g', 's.g')} GROUP BY p.doc_id, p.page_no, p.ord"""
VIEWS["fused"] = """
SELECT p.doc_id, p.page_no, p.ord, coalesce(s.text, p.text) AS text, coalesce(s.confidence, p.confidence) AS confidence,
  CASE WHEN s.ord IS NULL THEN 'primary' ELSE 'fused' END AS engine, coalesce(s.g, p.g) AS g
FROM first_lines p LEFT JOIN line_wins w ON p.doc_id = w.doc_id AND p.page_no = w.page_no AND p.ord = w.ord
LEFT JOIN second_lines s ON s.doc_id = w.doc_id AND s.page_no = w.page_no AND s.ord = w.s_ord"""
# Secondary lines unlike every fused line, then a walk in order that keeps those unlike all kept so far.
VIEWS["known_lines"] = f"""
SELECT DISTINCT s.doc_id, s.page_no, s.ord FROM second_lines s JOIN fused f ON f.doc_id = s.doc_id AND f.page_no = s.page_no
WHERE {alike('s.g', 'f.g')}"""
VIEWS["open_lines"] = """
SELECT s.*, row_number() OVER (PARTITION BY s.doc_id, s.page_no ORDER BY s.ord) AS i FROM second_lines s
LEFT JOIN known_lines k ON s.doc_id = k.doc_id AND s.page_no = k.page_no AND s.ord = k.ord
WHERE s.norm <> '' AND k.ord IS NULL"""
VIEWS["keep_walk"] = f"""
SELECT doc_id, page_no, i, [g] AS kept, true AS keeps FROM open_lines WHERE i = 1
UNION ALL
SELECT doc_id, page_no, i, CASE WHEN fresh THEN list_append(kept, g) ELSE kept END, fresh FROM (
  SELECT o.doc_id, o.page_no, o.i, w.kept, o.g, len(list_filter(w.kept, lambda k: {alike('k', 'o.g')})) = 0 AS fresh
  FROM keep_walk w JOIN open_lines o ON o.doc_id = w.doc_id AND o.page_no = w.page_no AND o.i = w.i + 1) n"""
VIEWS["secondary_kept"] = """
SELECT o.doc_id, o.page_no, o.ord, o.text, o.confidence FROM open_lines o
JOIN keep_walk w ON o.doc_id = w.doc_id AND o.page_no = w.page_no AND o.i = w.i AND w.keeps"""
