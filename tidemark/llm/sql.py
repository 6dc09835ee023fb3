"""DuckDB SQL for the results of the operators that SQL can express."""

from __future__ import annotations

from . import fingerprints, quality

WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
BLANK = r"regexp_replace({}, '[\x20\x09-\x0D]+', '{}', 'g')"

# Base 32 of a hexadecimal digest, five bits a letter: DuckDB has no function for it.
WARC = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS best, array_to_string(list_transform(range(0, 40), lambda i: format('{:04b}', ('0x' || substr(x, i::BIGINT + 1, 1))::INTEGER)), '') AS bits FROM h)
SELECT page_id, n AS payload_bytes,
      array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda k: substr(bits, (5 * j + k + 1)::BIGINT, 1)::INTEGER * [16, 8, 4, 2, 1][k + 1]))::BIGINT, 1)), '') AS payload_digest,
      CASE WHEN page_id < best THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < best THEN best END AS refers_to
FROM t
"""

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, {WORDS} AS w FROM d),
three AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM three) WHERE c > 1),
again AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
l AS (SELECT rid, k, line FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l GROUP BY rid),
base AS (SELECT d.rid, d.doc_id, len(w.w) AS n_words, length({BLANK.format('t', '')}) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN again USING (rid)),
nl AS (SELECT rid, host, line, len(string_split(line, ' ')) AS n
      FROM (SELECT l.rid, d.host, trim(translate({BLANK.format('l.line', ' ')}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS line FROM l JOIN d USING (rid))),
per_line AS (SELECT host, line, count(DISTINCT rid) AS n_docs FROM nl GROUP BY ALL),
hosts AS (SELECT host, count(*) AS n FROM d GROUP BY host),
freq AS (SELECT host, line FROM per_line JOIN hosts USING (host) WHERE n_docs > {quality.MIN_DOCS} AND n_docs > {quality.MAX_SHARE} * n),
cut AS (SELECT rid, sum(n) AS n FROM nl JOIN freq USING (host, line) GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - coalesce(cut.n, 0) >= {quality.MIN_LEFT} * n_words AS kept,
      coalesce(cut.n, 0)::BIGINT AS n_cut
FROM base LEFT JOIN cut USING (rid)
"""

LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, pos, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS clean
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d)),
n AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, clean FROM l WHERE worded),
w AS (SELECT doc_id, k, clean || chr(10) || lead(clean) OVER o || chr(10) || lead(clean, 2) OVER o AS g FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
later AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS nth FROM w WHERE g IS NOT NULL) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest([k, k + 1, k + 2]) AS k FROM later),
gone_at AS (SELECT doc_id, pos FROM n JOIN gone USING (doc_id, k))
SELECT l.doc_id, count(*) FILTER (worded) AS n_lines, count(gone_at.pos) AS n_removed,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (gone_at.pos IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone_at USING (doc_id, pos) GROUP BY l.doc_id
"""


def _sketch(source: str, name: str) -> str:
    """CTEs for the sketch of column t of source (one row an id)."""
    k, s = fingerprints.K, fingerprints.S
    return rf"""
{name}_w AS (SELECT id, regexp_extract_all(t, '[^\x20\x09-\x0D]{{1,16}}') AS w FROM {source}),
{name}_s AS (SELECT id, i, {" || ' ' || ".join(f"w[i + {j}]" for j in range(k))} AS g, {", ".join(f"md5(w[i + {j}] || ' ' || w[i + {j + 1}]) AS s{j}" for j in range(k - s + 1))}
      FROM (SELECT id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM {name}_w WHERE len(w) >= {k})),
{name}_a AS (SELECT id, md5(g) AS h FROM {name}_s WHERE least(s0, s{k - s}) = least({", ".join(f"s{j}" for j in range(k - s + 1))})),
{name}_b AS (SELECT id, h FROM {name}_a UNION ALL SELECT id, md5(array_to_string(w, ' ')) FROM {name}_w WHERE len(w) > 0 AND id NOT IN (SELECT id FROM {name}_a)),
{name}_v AS (SELECT DISTINCT id, ('0x' || substr(h, 1, {fingerprints.HEX}))::BIGINT AS v FROM {name}_b),
{name} AS (SELECT x.id, coalesce(list_slice(list_sort(list(v) FILTER (v IS NOT NULL)), 1, {fingerprints.VALUES}), []) AS s FROM {source} x LEFT JOIN {name}_v USING (id) GROUP BY x.id)"""


def _near(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(list_slice(list_sort(list_distinct(list_concat({a}, {b}))), 1, {fingerprints.VALUES}), lambda x: list_contains({a}, x) AND list_contains({b}, x)))::DOUBLE / len(list_slice(list_sort(list_distinct(list_concat({a}, {b}))), 1, {fingerprints.VALUES})) END"


_HEXED = "array_to_string(list_transform({}, lambda x: format('{{:0" + str(fingerprints.HEX) + "x}}', x)), '')"
FINGERPRINTS = f"""
WITH o AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS id, doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT a.id, substr(a.t, 1, length(a.t) - length(a.t) // 4) || substr(b.t, 1, length(a.t) // 4) AS t
      FROM o a JOIN o b ON b.id = CASE WHEN a.id = (SELECT max(id) FROM o) THEN 1 ELSE a.id + 1 END),
{_sketch('o', 'sa')}, {_sketch('e', 'se')}
SELECT o.doc_id, length(o.t) AS n_chars, sha256(e.t) AS edited_sha256, {_HEXED.format('sa.s')} AS fingerprint, {_HEXED.format('se.s')} AS edited_fingerprint,
      {_near('sa.s', 'se.s')} AS near_edited, {_near('sa.s', 'sn.s')} AS near_next
FROM o JOIN e USING (id) JOIN sa USING (id) JOIN se USING (id) JOIN sa sn ON sn.id = CASE WHEN o.id = (SELECT max(id) FROM o) THEN 1 ELSE o.id + 1 END
"""


NGRAM_JOIN = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
      UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.b) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY ALL
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, 1 AS k, unnest(w) AS g FROM w
      UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w)
      UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM w)
      UNION ALL SELECT lang, 4, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FROM (SELECT lang, w, unnest(range(1, len(w) - 2)) AS i FROM w)),
f AS (SELECT lang, k, g, count(*) AS f, string_split(g, ' ') AS w FROM g GROUP BY lang, k, g HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, g, k, f, w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.g, c.k, c.f, c.cut, a.f AS l, b.f AS r, ((2000000::HUGEINT * c.f) // (a.f + b.f))::BIGINT AS score
      FROM c JOIN f a ON a.lang = c.lang AND a.g = array_to_string(c.w[1:c.cut], ' ') JOIN f b ON b.lang = c.lang AND b.g = array_to_string(c.w[c.cut + 1:c.k], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS nth FROM s) WHERE nth = 1),
sub AS (SELECT lang, array_to_string(w[1:k - 1], ' ') AS g, f FROM f WHERE k > 2 UNION ALL SELECT lang, array_to_string(w[2:k], ' ') AS g, f FROM f WHERE k > 2),
top AS (SELECT lang, g, max(f) AS f FROM sub GROUP BY lang, g),
kept AS (SELECT best.* FROM best LEFT JOIN top ON top.lang = best.lang AND top.g = best.g WHERE 100 * coalesce(top.f, 0) < 80 * best.f),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, g) AS rank FROM kept)
SELECT r.lang, r.rank, r.g AS phrase, r.f AS a, r.l, r.r, n.n, r.score FROM r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000
"""

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
o AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lc FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
have AS (SELECT o.lang, o.source, o.term, count(*) AS c FROM o JOIN kept ON kept.lang = o.lang AND kept.term = o.term GROUP BY o.lang, o.source, o.term),
groups AS (SELECT DISTINCT lang, source FROM d),
every AS (SELECT g.lang, g.source, k.term, coalesce(h.c, 0) AS c, k.lc FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN have h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
total AS (SELECT lang, source, sum(c) AS n, sum(lc) AS ln, count(*) AS v FROM every GROUP BY lang, source),
p AS (SELECT e.lang, e.source, e.term, e.c, (1 + (1000000000::HUGEINT * (e.c + 1)) // (t.n + t.v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (e.lc + 1)) // (t.ln + t.v))::BIGINT AS q
      FROM every e JOIN total t ON t.lang = e.lang AND t.source = e.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
