"""SQL of the candidate, matching and box-fold queries, for the oracle alone."""

from __future__ import annotations

from ..functions import text as T


def normal(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def cleaned(c: str) -> str:
    c = f"regexp_replace({normal(c)}, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')"
    for p in (T.FORMS, T.DOSAGE, T.FREQUENCY, T.ROUTE):
        c = f"regexp_replace({c}, '{p}', '', 'gi')"
    return normal(c)


def all_found(c: str, p: str, upper: bool) -> str:
    found = f"list_transform(regexp_extract_all({c}, '(?i){p}'), lambda x: {'upper(' + normal('x') + ')' if upper else normal('x')})"
    return f"array_to_string(list_filter({found}, lambda x, i: list_position({found}, x) = i), '; ')"


STOP = ", ".join(f"'{t}'" for t in T.STOP_TOKENS)

#: cands(text, cands): the candidates of every distinct text of ``texts``.
CANDIDATES = f"""
c1 AS (SELECT text, {cleaned('text')} AS whole FROM texts),
c2 AS (SELECT text, whole, regexp_extract_all(whole, '[A-Za-z][A-Za-z0-9-]*') AS t FROM c1),
c3 AS (SELECT text, list_concat([whole], t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])) AS pieces FROM c2),
c4 AS (SELECT text, list_filter(list_transform(pieces, lambda x: {cleaned('x')}), lambda x: length(x) > 1 AND lower(x) NOT IN ({STOP})) AS fit FROM c3),
cands AS (SELECT text, list_filter(fit, lambda x, i: list_position(list_transform(fit, lambda y: lower(y)), lower(x)) = i) AS cands FROM c4)"""

#: ratios(a, b, ratio) of the rows of ``asked``: Ratcliff-Obershelp, by the longest common block, first in a and then in b.
RATIOS = """
seg(a, b, s, t, k) AS (
  SELECT a, b, a, b, 0 FROM asked
  UNION ALL
  SELECT a, b, unnest([s[1:i - 1], s[i + m:]]), unnest([t[1:j - 1], t[j + m:]]), unnest([m, 0]) FROM (
    SELECT a, b, s, t, m, i, strpos(t, s[i:i + m - 1]) AS j FROM (
      SELECT a, b, s, t, top.m AS m, -top.i AS i FROM (
        SELECT a, b, s, t, list_max(list_filter(flatten(list_transform(range(1, length(s) + 1), lambda i: list_transform(range(1, length(s) - i + 2),
          lambda m: CASE WHEN contains(t, s[i:i + m - 1]) THEN {'m': m, 'i': -i} END))), lambda x: x IS NOT NULL)) AS top
        FROM seg WHERE s <> '' AND t <> '') q WHERE top IS NOT NULL) q) q),
ratios AS (SELECT a, b, 2.0 * sum(k) / (length(a) + length(b)) AS ratio FROM seg GROUP BY a, b)"""

#: best(text, drug, score, matched_candidate). Pairs whose letters can't reach what another name surely has aren't compared.
BEST = f"""{CANDIDATES},
pieces AS (SELECT text, unnest(cands) AS candidate, generate_subscripts(cands, 1) AS c FROM cands),
lex AS (SELECT p_name AS drug, lower(p_name) AS b, row_number() OVER (ORDER BY p_name) AS d FROM (SELECT DISTINCT p_name FROM part) q),
pairs AS (SELECT a, b, list_sum(list_transform(list_distinct(string_split(a, '')), lambda x: least(length(a) - length(replace(a, x, '')), length(b) - length(replace(b, x, ''))))) * 2.0 / (length(a) + length(b)) AS most,
  CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) * 1.0 / greatest(length(a), length(b)) ELSE 0.0 END AS sure,
  list_max(list_transform(range(0, least(length(a), length(b)) + 1), lambda i: CASE WHEN a[1:i] = b[1:i] OR right(a, i) = right(b, i) THEN i ELSE 0 END)) * 2.0 / (length(a) + length(b)) AS least_ratio
  FROM (SELECT DISTINCT lower(candidate) AS a FROM pieces) p, (SELECT DISTINCT b FROM lex) l),
kept AS (SELECT * FROM (SELECT *, max(greatest(sure, least_ratio)) OVER (PARTITION BY a) AS floor FROM pairs) q WHERE most >= floor - 1e-9),
asked AS (SELECT a, b FROM kept WHERE a <> b),{RATIOS},
scored AS (SELECT k.a, k.b, CASE WHEN k.a = k.b THEN 1.0 ELSE greatest(coalesce(r.ratio, 0.0), k.sure) END AS score FROM kept k LEFT JOIN ratios r ON k.a = r.a AND k.b = r.b),
ranked AS (SELECT p.text, l.drug, s.score, p.candidate, row_number() OVER (PARTITION BY p.text ORDER BY s.score DESC, length(l.drug) DESC, p.c, l.d) AS n
  FROM pieces p JOIN scored s ON lower(p.candidate) = s.a JOIN lex l ON l.b = s.b),
best AS (SELECT c.text, coalesce(drug, '') AS drug, round_even(coalesce(score, 0.0), 4) AS score, coalesce(candidate, '') AS matched_candidate
  FROM cands c LEFT JOIN (SELECT * FROM ranked WHERE n = 1) r ON c.text = r.text)"""

#: entities over rows(line_id, ocr_text).
ENTITIES = f"""texts AS (SELECT DISTINCT ocr_text AS text FROM rows),{BEST},
e0 AS (SELECT line_id, ocr_text, drug, score, matched_candidate, {all_found('ocr_text', T.DOSAGE, False)} AS dosage,
  {all_found('ocr_text', T.FREQUENCY, True)} AS frequency, {all_found('ocr_text', T.ROUTE, True)} AS route FROM rows JOIN best ON ocr_text = text),
entities AS (SELECT line_id, ocr_text, CASE WHEN drug <> '' AND score >= 0.72 THEN drug ELSE '' END AS medicine_name, score AS medicine_match_score, matched_candidate, dosage, frequency, route,
  CASE WHEN (drug <> '' AND score >= 0.72) OR dosage <> '' OR frequency <> '' OR route <> '' THEN 'yes' ELSE 'no' END AS keep_for_output,
  CASE WHEN drug <> '' AND score >= 0.72 THEN 'matched' WHEN dosage <> '' OR frequency <> '' OR route <> '' THEN 'dose_only' ELSE 'ignored_non_medicine' END AS validation_status FROM e0)"""

LINE_ROWS = f"rows AS (SELECT line_id, {normal('text')} AS ocr_text FROM rx)"


def fold(source: str, order: str, joins: str) -> str:
    """folded(page_id, x1..y2): boxes of ``source`` in order, each joins the last one p so far if ``joins`` holds for it and b."""
    grown = ", ".join(f"CASE WHEN j THEN {f}(p.{c}, b.{c}) ELSE b.{c} END" for c, f in (("x1", "least"), ("y1", "least"), ("x2", "greatest"), ("y2", "greatest")))
    return f"""
o AS (SELECT page_id, x1, y1, x2, y2, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS k FROM {source}),
f(page_id, k, n, x1, y1, x2, y2) AS (
  SELECT page_id, k, 1, x1, y1, x2, y2 FROM o WHERE k = 1
  UNION ALL
  SELECT page_id, k, n + CASE WHEN j THEN 0 ELSE 1 END, {grown.replace('p.', 'p').replace('b.', 'b')} FROM (
    SELECT b.page_id, b.k, p.n, {', '.join(f'p.{c} AS p{c}, b.{c} AS b{c}' for c in ('x1', 'y1', 'x2', 'y2'))}, {joins} AS j FROM f p JOIN o b ON b.page_id = p.page_id AND b.k = p.k + 1) q),
folded AS (SELECT page_id, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY page_id, n ORDER BY k DESC) AS last FROM f) q WHERE last = 1)"""


_OVERLAP = "least(p.y2, b.y2) - greatest(p.y1, b.y1)"
BANDS = fold("rx", "y1, x1, x2, y2", f"({_OVERLAP} > 0 OR abs((p.y1 + p.y2) / 2.0 - (b.y1 + b.y2) / 2.0) <= greatest(4.0, 0.65 * (p.y2 - p.y1)))")
WORDS = fold("rx", "x1, y1, x2, y2", f"(b.x1 - p.x2 <= 4 AND {_OVERLAP} > -greatest(4, CAST(trunc(0.35 * (p.y2 - p.y1)) AS INT)))")

#: grown(page_id, boxes, k): small boxes, in order, each grow the nearest wide one.
ATTACHED = """
big AS (SELECT page_id, list({'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} ORDER BY x1, y1, x2, y2) AS boxes FROM rx WHERE x2 - x1 >= 60 GROUP BY page_id),
small AS (SELECT page_id, x1, y1, x2, y2, row_number() OVER (PARTITION BY page_id ORDER BY x1, y1, x2, y2) AS k FROM rx WHERE x2 - x1 < 60),
grown(page_id, boxes, k) AS (
  SELECT page_id, boxes, CAST(0 AS BIGINT) FROM big
  UNION ALL
  SELECT page_id, list_transform(boxes, lambda w, i: CASE WHEN i = list_position(d, list_min(d)) AND d[i] <= 40
    THEN {'x1': least(w.x1, x1), 'y1': least(w.y1, y1), 'x2': greatest(w.x2, x2), 'y2': greatest(w.y2, y2)} ELSE w END), k FROM (
    SELECT g.page_id, g.boxes, s.k, s.x1, s.y1, s.x2, s.y2, list_transform(g.boxes, lambda w: greatest(0.0, w.x1 - (s.x1 + s.x2) / 2.0, (s.x1 + s.x2) / 2.0 - w.x2)
      + abs((s.y1 + s.y2) / 2.0 - (w.y1 + w.y2) / 2.0) * 0.35) AS d FROM grown g JOIN small s ON s.page_id = g.page_id AND s.k = g.k + 1) q)"""

#: placed(page_id, bands, k): boxes by their middles each join the first band whose middle is near.
FIRST_FIT = """
o AS (SELECT page_id, x1, y1, x2, y2, row_number() OVER (PARTITION BY page_id ORDER BY (y1 + y2) / 2.0, x1, y1, x2, y2) AS k FROM rx),
placed(page_id, bands, k) AS (
  SELECT page_id, [{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}], k FROM o WHERE k = 1
  UNION ALL
  SELECT page_id, CASE WHEN spot IS NULL THEN list_append(bands, {'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}) ELSE list_transform(bands, lambda b, i: CASE WHEN i = spot
    THEN {'x1': least(b.x1, x1), 'y1': least(b.y1, y1), 'x2': greatest(b.x2, x2), 'y2': greatest(b.y2, y2)} ELSE b END) END, k FROM (
    SELECT p.page_id, p.bands, o.k, o.x1, o.y1, o.x2, o.y2, list_position(list_transform(p.bands, lambda b: abs((o.y1 + o.y2) / 2.0 - (b.y1 + b.y2) / 2.0) <= greatest(7, CAST(trunc(0.55 * greatest(1, b.y2 - b.y1)) AS INT))), true) AS spot
    FROM placed p JOIN o ON o.page_id = p.page_id AND o.k = p.k + 1) q)"""
