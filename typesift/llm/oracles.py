"""DuckDB SQL for the operator queries that SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_UPPER.lower()}')"


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower('text')}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_lower('text')}, '{_ALNUM}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS t
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
dw AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS t
  FROM d, sizes, unnest(range(1, greatest(len(w) - k + 2, 1))) AS r(i)),
hits AS (SELECT dw.doc_id, dw.i, dw.k, win.item_id FROM dw JOIN win ON dw.k = win.k AND dw.t = win.t),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + k)) AS r(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_lower('text')}, '{_WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS t
  FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

OP4 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
l AS (SELECT doc_id, [x for x in string_split(t, chr(10)) if regexp_matches(x, '{_WORD}')] AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') AS t
        FROM d, unnest(range(1, greatest(len(w) - 1, 1))) AS r(i)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM again, unnest(range(i, i + 3)) AS r(p) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    len(l) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS upper, len(regexp_extract_all(t, '[A-Za-z]')) AS letters,
    len(regexp_extract_all(t, '!')) AS exclaims, len([x for x in w if regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]')]) AS lettered,
    len([x for x in l if suffix(x, '...')]) AS dots
  FROM d JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 100 * upper > 40 * letters OR 10 * exclaims > n_words
       OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words
       OR 100 * lettered < 80 * n_words OR 100 * dots > 30 * n_lines) AS kept
FROM f
"""


def _found(kind: int, name: str, pattern: str, keep: str = "true", part: str = "m") -> str:
    """Spans of one kind: matches and the gaps between them give the places.

    keep: a condition on the match m; part: the end of m that is the span.
    """
    p = pattern.replace("'", "''")
    return f"""
SELECT doc_id, {kind} AS k, '{name}' AS kind, s + length(m) - length({part}) AS s, s + length(m) AS e FROM (
  SELECT doc_id, ms[i] AS m,
    list_sum([length(x) for x in list_slice(gs, 1, i)]) + coalesce(list_sum([length(x) for x in list_slice(ms, 1, i - 1)]), 0) AS s
  FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs FROM d WHERE regexp_matches(t, '{p}')),
    unnest(range(1, len(ms) + 1)) AS r(i)) WHERE {keep}"""


def _digest(base: list[tuple], more: list[tuple]) -> str:
    every = [_found(i, *rule) for i, rule in enumerate(base + more)]
    names = [rule[0] for rule in base]
    part = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (kind = '{n}') AS n_{n}" for n in names)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(every)}),
g AS (SELECT doc_id, {counts}, string_agg({part}, ',' ORDER BY s, k) FILTER (k < {len(names)}) AS base,
      string_agg({part}, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in names)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


_KEYWORD = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_ASSIGN = _KEYWORD + r"""["']?\x20*[:=]\x20*["']?"""
_IN_ASSIGN = _ASSIGN.replace("'", "''")

OP9 = _digest(
    [("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", f"length(regexp_extract(m, '^{_IN_ASSIGN}([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"),
     ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
     ("hex", "[0-9a-f]+", "length(m) >= 24")],
    [("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
     ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
     ("github", "gh[pousr]_[A-Za-z0-9]+", "length(m) >= 40"),
     ("slack", "xox[abprs]-[A-Za-z0-9-]+", "length(m) >= 15"),
     ("google", "AIza[A-Za-z0-9_-]+", "length(m) >= 39")])

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_BACKWARD = f"list_reverse([CAST(x AS INT) for x in string_split({_DIGITS}, '')])"
_LUHN = (f"list_sum([CASE WHEN i % 2 = 1 THEN {_BACKWARD}[i] ELSE 2 * {_BACKWARD}[i] - CASE WHEN {_BACKWARD}[i] > 4 THEN 9 ELSE 0 END END "
         f"for i in range(1, length({_DIGITS}) + 1)]) % 10 = 0")
_IBAN = "regexp_extract(m, '^(?:IBAN|iban|Iban)[:\\x20]*(.*)$', 1)"
_IBAN_DIGITS = (f"string_split(array_to_string([CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END "
                f"for c in string_split(substr({_IBAN}, 5) || substr({_IBAN}, 1, 4), '')], ''), '')")
_SSN = "regexp_extract(m, '[0-9]{3}-[0-9]{2}-[0-9]+$')"

OP10 = _digest(
    [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
     ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_bool_and([CAST(x AS HUGEINT) <= 255 for x in string_split(m, '.')])"),
     ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
     ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15")],
    [("link", r"(?:http|https|ftp)://[A-Za-z0-9._~%+-]+:[^\s@/]+@[A-Za-z0-9.-]+"),
     ("iban", r"(?:IBAN|iban|Iban)[:\x20]*[A-Z]{2}[0-9]{2}[A-Z0-9]+",
      f"length({_IBAN}) BETWEEN 15 AND 34 AND list_reduce([CAST(c AS INT) for c in {_IBAN_DIGITS}], lambda a, d: (a * 10 + d) % 97) = 1", _IBAN),
     ("ssn", r"(?:SSN|ssn)[:#\x20]*[0-9]{3}-[0-9]{2}-[0-9]+",
      f"regexp_matches({_SSN}, '-[0-9]{{4}}$') AND NOT regexp_matches({_SSN}, '^(000|666|9)|-00-|-0000$')", _SSN)])

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * g + 1}, 5) AS INTEGER) >> {shift}) & 31), 1)"
    for g in range(8) for shift in (15, 10, 5, 0))

OP2 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS rep FROM p GROUP BY h)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN rep IS NULL OR rep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN rep <> page_id OR page_id IS NULL THEN rep END AS refers_to
FROM p JOIN f USING (h)
"""

OP5 = f"""
WITH d AS (SELECT doc_id, text AS t, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, i, regexp_extract_all(l[i], '{_WORD}') AS w FROM d, unnest(range(1, len(l) + 1)) AS r(i)
          WHERE doc_id IS NOT NULL),
leaf AS (SELECT doc_id, i, len(w) || ':' || array_to_string([CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END for x in w[1:8]], ' ') AS k
         FROM lines WHERE len(w) >= 5),
rec AS (SELECT k, min(doc_id) AS first FROM leaf GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
out AS (SELECT DISTINCT doc_id, i FROM leaf JOIN rec USING (k) WHERE doc_id > first),
gone AS (SELECT doc_id, list(i) AS g FROM out GROUP BY doc_id),
new AS (SELECT d.doc_id, t, l, coalesce(len(g), 0) AS n,
  CASE WHEN g IS NULL THEN t ELSE array_to_string([l[i] for i in range(1, len(l) + 1) if NOT list_contains(g, i)], chr(10)) END AS r
  FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(n AS BIGINT) AS n_dropped, CAST(length(r) AS BIGINT) AS n_chars, sha256(r) AS text_sha256
FROM new
"""

_CRC32 = """4294967295 - list_reduce(list_concat([4294967295], [CAST(ascii(x) AS BIGINT) for x in string_split(CAST(conv_id AS VARCHAR), '')]),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, 3988292384 * (c & 1))))"""

OP12 = f"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, ({_CRC32}) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
n AS (SELECT conv_id AS base, count(*) AS n FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, t.i AS d, role, text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL
  SELECT c.conv_id, coalesce(least(h, n), 0) + t.i - h AS d, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h LEFT JOIN n USING (base)),
m AS (
  SELECT conv_id, 0 AS d, '' AS k, 0 AS b FROM c
  UNION ALL
  SELECT conv_id, d, string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY d), strlen(text) FROM r),
l AS (SELECT conv_id, max(d) AS l FROM m GROUP BY conv_id),
v AS (SELECT d, k, min(conv_id) AS v, count(*) AS n, max(b) AS b FROM m GROUP BY d, k),
mv AS (SELECT m.conv_id, m.d, v.v FROM m JOIN v USING (d, k)),
kids AS (SELECT p.v, p.d, count(*) AS n FROM v JOIN mv p ON p.conv_id = v.v AND p.d = v.d - 1 GROUP BY p.v, p.d),
w AS (SELECT v.v, v.d, v.n, (v.n - 1) * v.b AS saved, coalesce(kids.n, 0) AS n_children FROM v LEFT JOIN kids USING (v, d)),
sub AS (SELECT p.v, p.d, sum(CAST(n_children = 0 AS INT)) AS leaves, sum(saved) AS saved FROM w JOIN mv p ON p.conv_id = w.v AND p.d <= w.d GROUP BY p.v, p.d),
e AS (SELECT v, d, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS e FROM mv JOIN l USING (conv_id) WHERE d = l GROUP BY v, d)
SELECT w.v AS conv_id, CAST(w.d AS BIGINT) AS depth, p.v AS parent_conv_id, w.n AS n_convs, CAST(n_children AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM w JOIN sub USING (v, d) LEFT JOIN e USING (v, d) LEFT JOIN mv p ON p.conv_id = w.v AND p.d = w.d - 1
"""

_LETTERS = "ABCDE"
_ORDERS = " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS c" for i, c in enumerate(_LETTERS))

OP13 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
    + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(doc_id > first, false) AS INT) AS fails
  FROM d JOIN firsts USING (t) LEFT JOIN lab USING (doc_id)),
n AS (SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL),
l AS ({_ORDERS}),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS f,
        list_sum([1 << (ascii(x) - 65) for x in string_split(filter_order[1:step], '')]) AS after
      FROM o, unnest(range(1, 6)) AS r(step)),
r AS (
  SELECT part, filter_order, step, s.f, coalesce(sum(n) FILTER (fails & after = 0), 0) AS kept,
    coalesce(sum(n) FILTER (fails & after = s.f), 0) AS removed, coalesce(sum(n) FILTER (fails & s.f > 0 AND fails & (after - s.f) > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = s.f), 0) AS unique_fails, coalesce(sum(n) FILTER (good AND fails & after = s.f), 0) AS good_lost,
    coalesce(sum(n) FILTER (toxic AND fails & after = s.f), 0) AS toxic_lost
  FROM n, s GROUP BY part, filter_order, step, s.f)
SELECT part, filter_order, CAST(step AS INT) AS step, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""

ORACLES: dict[str, str] = {
    "op1_suffix_decontamination": OP1, "op2_salvage_warc": OP2, "op3_hamming_near_dedup": OP3, "op4_rule_cascade": OP4,
    "op5_line_template_tree": OP5, "op9_dfa_secrets": OP9, "op10_anchor_pii": OP10,
    "op12_euler_prefix_trie": OP12, "op13_survival_words": OP13}
