"""SQL of the operators that SQL can express, over whole tables, for the oracle alone."""

from __future__ import annotations

import math

from . import license_scan as L
from . import mixing as M
from . import quality_rules as Q
from .warc_revisits import TRACKING

WHITE = r"\x20\x09-\x0D"
WORDS = f"regexp_extract_all(coalesce(text, ''), '[^{WHITE}]+')"
LOWER = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def lowered_words(column: str) -> str:
    return f"regexp_extract_all({LOWER.format(c=column)}, '[^{WHITE}]+')"


def strings(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


MIXING = f"""
WITH s AS (SELECT doc_id, source, len({WORDS}) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
t0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
t1 AS (SELECT *, list_extract([{', '.join(f'{w}.0' for w in M.WEIGHTS)}], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(M.WEIGHTS)} AS INT) + 1)::DOUBLE AS weight, CAST({M.CAP} * source_size AS DOUBLE) AS cap FROM t0),
t2 AS (SELECT *, cap / weight AS full_at FROM t1),
t3 AS (SELECT *, coalesce(sum(cap) OVER w, 0.0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0) AS open, sum(source_size) OVER () * {M.SHARE}::DOUBLE AS every
  FROM t2 WINDOW w AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t4 AS (SELECT *, (every - capped) / open AS level FROM t3),
t5 AS (SELECT arg_min(level, full_at) AS level FROM t4 WHERE level <= full_at),
t AS (SELECT t4.source, t4.source_size, CASE WHEN t5.level IS NULL THEN cap ELSE least(cap, t5.level * weight) END AS target FROM t4, t5),
p AS (SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
  coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(CASE WHEN source_size > 0 THEN budget // greatest(source_size, 1) ELSE 0 END * size
  + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // greatest(source_size, 1) ELSE 0 END * source_size - start)) AS BIGINT) AS taken FROM p"""

REPEATED_BYTES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS h FROM documents),
w AS (SELECT r, unnest(range(octet_length(h))) AS i, unnest(list_transform(range(octet_length(h)), lambda i: h[i + 1:i + 1])) AS x,
  unnest(list_transform(range(octet_length(h)), lambda i: CASE WHEN i + 200 <= octet_length(h) THEN hash(h[i + 1:i + 200]) END)) AS k FROM d),
f AS (SELECT r, i, x, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 THEN 1 ELSE 0 END AS starts FROM w),
g AS (SELECT r, i, x, max(starts) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS opens FROM g),
a AS (SELECT r, sum(gone) AS n_removed, sum(opens) AS n_spans, string_agg(CASE WHEN gone = 0 THEN hex(x) ELSE '' END, '' ORDER BY i) AS kept FROM e GROUP BY r)
SELECT doc_id, CAST(octet_length(h) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a ON d.r = a.r"""

CONTAMINATION = f"""
WITH i0 AS (SELECT row_number() OVER () AS i, item_id, {lowered_words('text')} AS w FROM benchmark),
items AS (SELECT i, item_id, least(5, len(w)) AS width, list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda k: array_to_string(w[k:k + least(5, len(w)) - 1], ' '))) AS s FROM i0 WHERE len(w) > 0),
asked AS (SELECT i, width, unnest(s) AS shingle FROM items),
d AS (SELECT row_number() OVER () AS r, doc_id, {lowered_words('text')} AS w FROM documents),
docs AS (SELECT DISTINCT r, width, unnest(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k:k + width - 1], ' '))) AS shingle FROM d, (SELECT DISTINCT width FROM items) q WHERE len(w) >= width),
shared AS (SELECT r, i, count(*) AS n FROM docs JOIN asked USING (width, shingle) GROUP BY r, i)
SELECT doc_id, item_id, n AS n_shared, CAST(len(s) AS BIGINT) AS n_shingles, n::DOUBLE / len(s) AS containment FROM shared JOIN items USING (i) JOIN d USING (r) WHERE 5 * n >= 4 * len(s)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {lowered_words('text')} AS w FROM documents),
s0 AS (SELECT doc_id, md5(array_to_string(w, ' ')) AS class, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) END AS s FROM d),
heads AS (SELECT class, min(doc_id) AS rep, any_value(s) AS s, len(any_value(s)) AS n FROM s0 WHERE len(s) > 0 GROUP BY class),
x AS (SELECT rep, n, unnest(s) AS shingle FROM heads),
freq AS (SELECT shingle, count(*) AS df FROM x GROUP BY shingle),
ranked AS (SELECT rep, n, shingle, row_number() OVER (PARTITION BY rep ORDER BY df, shingle) AS k FROM x JOIN freq USING (shingle)),
prefix AS (SELECT rep, n, shingle FROM ranked WHERE k <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1),
asked AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM prefix a JOIN prefix b ON a.shingle = b.shingle AND a.rep < b.rep AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
links AS (SELECT a, b FROM (SELECT a, b, p.n AS n, q.n AS m, len(list_intersect(p.s, q.s)) AS shared FROM asked JOIN heads p ON a = p.rep JOIN heads q ON b = q.rep) z WHERE 100 * shared >= 80 * (n + m - shared)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
component AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s0.s) AS BIGINT) AS n_shingles, coalesce(c, rep, doc_id) AS component_id, doc_id = coalesce(c, rep, doc_id) AS kept, upper(class) AS class
FROM s0 LEFT JOIN heads USING (class) LEFT JOIN component ON rep = a"""

_STARTS = ", ".join(
    f"list_filter(range(0, len(w) - {len(p.split()) - 1}), lambda k: {' AND '.join(f"w[k + {j + 1}] = '{x}'" for j, x in enumerate(p.split()))})" for p in L.BASE
)
_LABELS = strings(list(L.BASE.values()))


def _template(k: int) -> str:
    label, notice, key = L.TEMPLATES[k]
    at = f" {notice} ".index(f" {key} ")
    at = len(notice[:at].split())
    return f"({k}, '{label}', {strings(notice.split())}, {strings(key.split())}, {at})"


LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER.format(c='text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT r, doc_id, w, [{_STARTS}] AS places FROM d),
t(k, label, words, key, place) AS (VALUES {', '.join(_template(k) for k in range(len(L.TEMPLATES)))}),
keys AS (SELECT r, label, words, unnest(list_filter(range(0, len(w) - len(key) + 1), lambda i: w[i + 1] = key[1] AND w[i + 1:i + len(key)] = key)) - place AS start, w FROM d, t WHERE list_has_all(w, key)),
scored AS (SELECT r, label, list_sum(list_transform(range(1, len(words) + 1), lambda j: CASE WHEN start + j >= 1 AND w[start + j] = words[j] THEN 1 ELSE 0 END))::DOUBLE / len(words) AS score FROM keys),
found AS (SELECT r, list(label) AS labels, max(score) AS score FROM scored WHERE score >= {L.MIN_SCORE} GROUP BY r),
c AS (SELECT r, doc_id, w, flatten(places) AS starts, list_filter({_LABELS}, lambda x, i: len(places[i]) > 0) AS base FROM b)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found.labels, [])))), ',') AS labels, CASE WHEN len(starts) > 0 THEN 1.0::DOUBLE ELSE coalesce(found.score, 0.0) END AS score FROM c LEFT JOIN found USING (r)"""

REPEATED_WINDOWS = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, {WORDS} AS w FROM documents),
x AS (SELECT r, k, w[k] AS word, CASE WHEN k + 19 <= len(w) THEN array_to_string(w[k:k + 19], ' ') END AS win FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d) q),
y AS (SELECT r, k, word, CASE WHEN win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY r, k) > 1 THEN 1 ELSE 0 END AS starts FROM x),
z AS (SELECT r, k, word, max(starts) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM y),
a AS (SELECT r, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (gone = 0) AS kept FROM z GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (r)"""

_LOG = repr(math.log(Q.GAMMA))
_VALUE = f"CASE WHEN bucket = {Q.ZERO} THEN 0.0 ELSE exp(bucket * {_LOG}) * {2 / (Q.GAMMA + 1)!r} END"
QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
x AS (SELECT r, k, CASE WHEN k + 4 <= len(w) THEN array_to_string(w[k:k + 4], ' ') END AS win FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d) q),
y AS (SELECT r, k, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY r, win) > 1 THEN 1 ELSE 0 END AS starts FROM x),
z AS (SELECT r, sum(gone) AS n_repeat_words FROM (SELECT r, max(starts) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS gone FROM y) q GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^{WHITE}]')) AS lines FROM d),
m AS (SELECT d.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda s: length(s))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN l USING (r) LEFT JOIN z USING (r)),
v AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0::DOUBLE END AS symbol_share,
  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0::DOUBLE END AS dup_line_share, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0::DOUBLE END AS word_length FROM m),
u AS (SELECT lang, source, unnest(['symbol_share', 'dup_line_share', 'word_length']) AS measure, unnest([symbol_share, dup_line_share, word_length]) AS x FROM v),
sketch AS (SELECT lang, source, measure, CASE WHEN x > 0 THEN CAST(ceil(round(ln(x) / {_LOG}, 9)) AS INT) ELSE {Q.ZERO} END AS bucket, count(*) AS n FROM u GROUP BY 1, 2, 3, 4),
wide AS (SELECT lang, measure, bucket, {Q.PRIOR}.0 * n / sum(n) OVER (PARTITION BY lang, measure) AS weight FROM (SELECT lang, measure, bucket, sum(n)::DOUBLE AS n FROM sketch GROUP BY 1, 2, 3) q),
merged AS (SELECT lang, source, measure, bucket, sum(weight) AS weight FROM (SELECT lang, source, measure, bucket, n::DOUBLE AS weight FROM sketch UNION ALL
  SELECT g.lang, g.source, g.measure, w.bucket, w.weight FROM (SELECT DISTINCT lang, source, measure FROM sketch) g JOIN wide w ON g.lang IS NOT DISTINCT FROM w.lang AND g.measure = w.measure) q GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, {_VALUE} AS value, sum(weight) OVER (PARTITION BY lang, source, measure ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(weight) OVER (PARTITION BY lang, source, measure) AS every FROM merged),
q AS (SELECT lang, source, measure, min(value) FILTER (upto >= every * 0.25 - 1e-6) AS q1, min(value) FILTER (upto >= every * 0.5 - 1e-6) AS q2, min(value) FILTER (upto >= every * 0.75 - 1e-6) AS q3 FROM ranked GROUP BY 1, 2, 3),
scale AS (SELECT q.lang, q.source, q.measure, any_value(q2) AS q2, greatest(any_value(q3 - q1) / {Q.QUARTILES_APART}, sum(weight * abs(value - q2)) / any_value(every)) AS s
  FROM q JOIN ranked k ON q.lang IS NOT DISTINCT FROM k.lang AND q.source IS NOT DISTINCT FROM k.source AND q.measure = k.measure GROUP BY 1, 2, 3),
limits AS (SELECT lang, source, {', '.join(f"max(CASE WHEN measure = '{m}' THEN q2 {op} {Q.SPREAD} * s END) AS {edge}_{m}" for m, low in Q.MEASURES.items() for edge, op in (('high', '+'), ('low', '-')))} FROM scale GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed
 AND CASE WHEN word_chars > 0 THEN (n_symbols - {Q.CHANCE} * sqrt(n_symbols)) / word_chars ELSE 0.0 END <= high_symbol_share + 1e-9
 AND CASE WHEN n_lines > 0 THEN (n_dup_lines - {Q.CHANCE} * sqrt(n_dup_lines)) / n_lines ELSE 0.0 END <= high_dup_line_share + 1e-9
 AND word_length * (1 - {Q.CHANCE} / 2 / sqrt(greatest(n_words, 1))) <= high_word_length + 1e-9 AND word_length * (1 + {Q.CHANCE} / 2 / sqrt(greatest(n_words, 1))) >= low_word_length - 1e-9 AS kept,
 symbol_share, dup_line_share, word_length FROM v JOIN limits ON v.lang IS NOT DISTINCT FROM limits.lang AND v.source IS NOT DISTINCT FROM limits.source"""

REVISITS = f"""
WITH p AS (SELECT page_id AS p, url, '"' || md5(coalesce(html, '')) || '"' AS tag, md5(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS length,
  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://', '', 'i') AS bare FROM pages),
c AS (SELECT *, coalesce(regexp_replace(lower(regexp_extract(split_part(bare, '?', 1), '^[^/]*')), ':(80|443)$', '') || regexp_replace(regexp_extract(split_part(bare, '?', 1), '/.*$'), '/+$', '')
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END, '') AS canonical
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))) AS kept FROM p) q),
v AS (SELECT p AS page, url, canonical, 2 * p + 1 AS record_id, CASE WHEN p % 11 = 0 THEN 2 * p - 1 ELSE 2 * p + 1 END AS ts,
  CASE WHEN p % 5 = 0 THEN NULL WHEN p % 7 = 0 THEN '"outdated"' ELSE tag END AS sent FROM c),
f AS (SELECT v.*, arg_max(struct_pack(id := 2 * c.p, p := c.p, tag := c.tag, digest := c.digest, length := c.length), (2 * c.p, 2 * c.p)) FILTER (c.p IS NOT NULL) AS o
  FROM v LEFT JOIN c ON c.canonical = v.canonical AND (c.url IS NULL) = (v.url IS NULL) AND 2 * c.p <= v.ts GROUP BY ALL),
g AS (SELECT *, CASE WHEN o IS NULL THEN 'no_antecedent' WHEN coalesce(sent = o.tag, page % 365 = o.p % 365) THEN 'resolved' ELSE 'mismatch' END AS status FROM f)
SELECT record_id, CASE WHEN url IS NOT NULL THEN canonical END AS canonical, ts, o.id AS refers_to, status, CASE WHEN status = 'resolved' THEN 'cache-control: max-age=90' || chr(10) || 'content-length: ' || o.length
 || chr(10) || 'content-type: text/html' || chr(10) || 'date: at ' || page || chr(10) || 'etag: ' || o.tag END AS headers, CASE WHEN status = 'resolved' THEN o.digest END AS digest, CASE WHEN status = 'resolved' THEN o.length END AS length FROM g"""

_TERMS = "regexp_extract_all(" + LOWER.format(c="text") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
LEXICAL_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) q GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY term, n_docs),
i AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS w FROM benchmark),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM (SELECT i, item_id, unnest(w) AS term FROM i) q JOIN f USING (term) JOIN p USING (term), c GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0) q WHERE rank <= 50"""

# DuckDB has no crc32; this is the bitwise rule of its polynomial over the digits of conv_id.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), "
    "lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT)"
)
PREFIX_TRIE = f"""
WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS k, md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, len(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id AS c, count(*) AS own, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
m AS (SELECT n.*, least(n.h, coalesce(b.own, 0)) AS head FROM n LEFT JOIN n b ON b.c = n.base),
z AS (SELECT c, head + greatest(own - h, 0) AS len FROM m),
r AS (SELECT m.c, o.k + 1 AS d, o.t, o.chars FROM m JOIN o ON o.c = m.base AND o.k < m.h UNION ALL SELECT m.c, o.k - m.h + m.head + 1, o.t, o.chars FROM m JOIN o ON o.c = m.c AND o.k >= m.h),
p AS (SELECT c, d, string_agg(t, '') OVER (PARTITION BY c ORDER BY d) AS p, chars FROM r UNION ALL SELECT c, 0, '', 0 FROM z),
nodes AS (SELECT p, d, min(c) AS c, CAST(count(*) AS BIGINT) AS n_convs, any_value(chars) AS chars FROM p GROUP BY p, d),
up AS (SELECT x.*, y.c AS parent FROM nodes x LEFT JOIN nodes y ON y.d = x.d - 1 AND y.p = left(x.p, CAST(32 * (x.d - 1) AS INT))),
kids AS (SELECT parent AS c, d - 1 AS d, CAST(count(*) AS BIGINT) AS n_children FROM up WHERE d > 0 GROUP BY 1, 2),
own AS (SELECT u.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * chars AS saved FROM up u LEFT JOIN kids USING (c, d)),
below AS (SELECT a.p, CAST(sum((own.n_children = 0)::INT) AS BIGINT) AS n_leaves, CAST(sum(own.saved) AS BIGINT) AS saved_tokens FROM own JOIN p a ON a.c = own.c AND a.d <= own.d GROUP BY a.p),
ends AS (SELECT p.p, string_agg(CAST(z.c AS VARCHAR), ',' ORDER BY z.c) AS ends FROM z JOIN p ON p.c = z.c AND p.d = z.len GROUP BY p.p)
SELECT own.c AS conv_id, CAST(own.d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM own JOIN below USING (p) LEFT JOIN ends USING (p)"""

ORACLE_SQL = {
    "op2_mixing": MIXING, "op3_suffix_dedup": REPEATED_BYTES, "op4_decontamination": CONTAMINATION, "op5_near_dedup": NEAR_DUPLICATES,
    "op6_license_scan": LICENSES, "op7_substring_dedup": REPEATED_WINDOWS, "op9_quality_rules": QUALITY, "op10_warc_revisits": REVISITS,
    "op11_lexical_search": LEXICAL_SEARCH, "op12_prefix_trie": PREFIX_TRIE,
}
