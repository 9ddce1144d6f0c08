"""SQL that gives the rows of the queries by other means. Rules, patterns and bounds are spelled out here once
more, so that the check does not share them with the code it checks."""

from __future__ import annotations


def _secret_kind(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
      SELECT {rank} AS rank, '{kind}' AS kind, doc_id, x, {least} AS least,
        list_transform(string_split_regex(x, '{pattern}'), lambda y: length(y)) AS gaps,
        list_transform(regexp_extract_all(x, '{pattern}', 0), lambda y: length(y)) AS sizes,
        list_transform(regexp_extract_all(x, '{pattern}', {group}), lambda y: length(y)) AS parts
      FROM texts WHERE regexp_matches(x, '{pattern}')"""


OP1 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
kinds AS ({" UNION ALL ".join([
    _secret_kind(0, "assign", r'''(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', 2, 6),
    _secret_kind(1, "access", "AKIA[A-Z0-9]+", 0, 20),
    _secret_kind(2, "hex", "[0-9a-f]+", 0, 24),
    _secret_kind(3, "pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    _secret_kind(4, "forge", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    _secret_kind(5, "chat", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    _secret_kind(6, "jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", 0, 1),
])}),
nth AS (SELECT *, unnest(generate_series(1, len(sizes))) AS i FROM kinds),
-- Running sums, not sums of growing slices: the text has many short runs of hex digits.
along AS (
  SELECT doc_id, rank, kind, i, parts[i] >= least AS counts, sizes[i] AS size,
    sum(gaps[i] + sizes[i]) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop
  FROM nth),
found AS (
  SELECT doc_id, rank, kind, (stop - size)::BIGINT AS start, kind || ':' || (stop - size)::BIGINT || ':' || stop::BIGINT AS span
  FROM along WHERE counts),
summed AS (
  SELECT doc_id,
    count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN summed USING (doc_id)
"""

OP3 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS x,
    list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS words,
    list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM texts WHERE len(words) >= 5),
times AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i+4]) AS n FROM windows),
repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM times, (SELECT unnest(generate_series(0, 4)) AS k)
  WHERE n > 1 GROUP BY doc_id),
counts AS (
  SELECT doc_id, len(words) AS n_words,
    coalesce(list_sum(list_transform(words, lambda y: length(y))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(x, '[#*$%&|<>]')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(words, lambda y: regexp_matches(y, '\p{Lu}.*\p{Lu}') AND NOT regexp_matches(y, '\p{Ll}'))) AS n_upper,
    len(list_filter(words, lambda y: regexp_matches(y, '\p{L}'))) AS n_alpha,
    len(list_filter(lines, lambda y: regexp_matches(y, '^\s*(?:[-*•]\s|[0-9]+[.)]\s)'))) AS n_bullets,
    len(list_filter(lines, lambda y: regexp_matches(y, '(?:\.\.\.|…)\s*$'))) AS n_ellipses,
    len(list_intersect(list_transform(words, lambda y: lower(y)), string_split(
      'the of and to in a is that it for was on are with as be by this from or an '
      || 'le la les de des et un une du en que qui est pour dans par sur pas au avec '
      || 'der die das und zu den von mit ist im für nicht ein eine als auch es sich '
      || 'el los las y se con no para su al lo del por', ' '))) AS stop_words
  FROM texts LEFT JOIN repeats USING (doc_id)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
    AND word_chars / n_words BETWEEN 2 AND 12
    AND n_symbols / word_chars <= 0.2
    AND n_upper / n_words <= 0.5
    AND n_alpha / n_words >= 0.6
    AND n_dup_lines / n_lines <= 0.4
    AND n_bullets / n_lines <= 0.9
    AND n_ellipses / n_lines <= 0.3
    AND stop_words >= 1 AS kept
FROM judged
"""

OP8 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
ordered AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11)::BIGINT AS formatted_chars,
  bool_and(CASE role
    WHEN 'system' THEN before IS NULL
    WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
    WHEN 'assistant' THEN before = 'user'
    ELSE false END) AND bool_and(after IS NOT NULL OR role = 'assistant') AS valid
FROM ordered GROUP BY conv_id
"""

def _checksum(text: str) -> str:
    """CRC-32 of a text of digits, as an unsigned number."""
    shifts = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda y: ascii(y)::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {shifts}))"


OP11 = rf"""
WITH numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, id) - 1 AS place, id, words
  FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT conv_id, {_checksum("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM numbered)),
rebuilt AS (
  SELECT c.conv_id, n.place, n.id, n.words FROM convs c
    JOIN numbered n ON n.conv_id = c.conv_id - c.conv_id % 20 AND n.place < c.h
  UNION ALL
  SELECT conv_id, place, id, words FROM convs JOIN numbered USING (conv_id) WHERE place >= h),
whole AS (
  SELECT conv_id, coalesce(list(id ORDER BY place) FILTER (id IS NOT NULL), []) AS ids, list(words ORDER BY place) AS words
  FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id),
begun AS (
  SELECT conv_id, d, array_to_string(ids[1:d], '') AS path, CASE WHEN d > 0 THEN array_to_string(ids[1:d - 1], '') END AS above,
    CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, d = len(ids) AS ends
  FROM (SELECT *, unnest(generate_series(0, len(ids))) AS d FROM whole)),
nodes AS (
  SELECT path, d, any_value(above) AS above, any_value(words) AS words, count(*) AS n, min(conv_id) AS conv_id,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM begun GROUP BY path, d),
children AS (SELECT above AS path, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
counted AS (SELECT *, coalesce(n_children, 0) AS kids FROM nodes LEFT JOIN children USING (path)),
sums AS (
  SELECT top.path, count(*) FILTER (sub.kids = 0) AS n_leaves, sum((sub.n - 1) * sub.words)::BIGINT AS saved_tokens
  FROM counted top JOIN counted sub ON starts_with(sub.path, top.path) GROUP BY top.path)
SELECT c.conv_id, c.d AS depth, p.conv_id AS parent_conv_id, c.n AS n_convs, c.kids AS n_children, n_leaves, saved_tokens,
  c.ends_sha256
FROM counted c JOIN sums USING (path) LEFT JOIN nodes p ON p.path = c.above
"""

# Documents of a source are walked in the order of their hash, one at a time.
OP12 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'none') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents),
sources AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1 AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source)),
-- Sources that reach their limit first come first: of all numbers of them the least that leaves no other one above.
steps AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS shares,
    coalesce(sum(3 * source_size) OVER before, 0) AS given, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k
  FROM sources WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT k, (total - given)::BIGINT AS rest, shares::BIGINT AS shares FROM steps
  WHERE (total - given) * weight / shares <= 3 * source_size ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN steps.k < level.k THEN (3 * source_size)::DOUBLE ELSE (rest * weight)::DOUBLE / level.shares END AS target,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
    floor(target - whole * source_size)::BIGINT AS budget
  FROM steps, level),
groups AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY hash) AS n
  FROM (SELECT source, hash, any_value(size) AS size, sum(size)::BIGINT AS words FROM docs WHERE size > 0 GROUP BY source, hash)),
walk AS (
  SELECT source, 0::BIGINT AS n, budget AS space, budget AS most, budget * 1000 <= target AS done, FALSE AS taken, target
  FROM targets
  UNION ALL
  SELECT w.source, g.n, CASE WHEN fits AND g.words <= space THEN space - g.words ELSE space END,
    CASE WHEN fits AND g.words > space THEN space ELSE most END,
    done OR (fits AND g.words > space AND space * 1000 <= target), fits AND g.words <= space, target
  FROM (SELECT * FROM walk) w JOIN (SELECT * FROM groups) g ON g.source IS NOT DISTINCT FROM w.source AND g.n = w.n + 1,
    LATERAL (SELECT NOT done AND g.size <= most AS fits)),
ends AS (SELECT source, arg_max(space, n) AS space, any_value(target) AS target FROM walk GROUP BY source),
extra AS (
  SELECT g.source, arg_min(g.n, (abs(g.words - e.space), g.hash)) AS n
  FROM ends e JOIN groups g ON g.source IS NOT DISTINCT FROM e.source JOIN walk w ON w.source IS NOT DISTINCT FROM g.source AND w.n = g.n
  WHERE e.space * 1000 > e.target AND NOT w.taken AND g.words < 2 * e.space GROUP BY g.source)
SELECT doc_id, d.size, source_size, t.target, (d.size * (whole + CASE WHEN w.taken OR x.n IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken
FROM docs d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source
LEFT JOIN groups g ON g.source IS NOT DISTINCT FROM d.source AND g.hash = d.hash
LEFT JOIN walk w ON w.source IS NOT DISTINCT FROM d.source AND w.n = g.n
LEFT JOIN extra x ON x.source IS NOT DISTINCT FROM d.source AND x.n = g.n
"""

OP13 = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS given, len(given) AS n,
    {_checksum("doc_id::VARCHAR")} AS h, h // 10 AS g, CASE WHEN n > 0 THEN g % n END AS a, 1 + (n - a) // (3 + g % 8) AS p
  FROM documents),
texts AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(generate_series(0, n - 1), lambda i: given[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END])
    ELSE given END AS words
  FROM docs),
windows AS (SELECT doc_id, i, words[i + 1:i + 6] AS six FROM (SELECT *, unnest(generate_series(0, n - 6)) AS i FROM texts WHERE n >= 12)),
again AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM windows x JOIN windows y ON x.doc_id = y.doc_id AND x.six = y.six AND x.i < y.i),
islands AS (
  SELECT doc_id, q, min(i) AS start, max(i) + 6 + q - min(i) AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM again) GROUP BY doc_id, q, island),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= 12 AND length >= 2 * q GROUP BY doc_id, start, length),
told AS (
  SELECT doc_id, count(*) AS n_runs,
    first({{'start': start, 'length': length, 'period': period}} ORDER BY length DESC, start, period) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(start + period, start + length - 1)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(words[i + 1], ' ' ORDER BY i) AS collapsed
  FROM (SELECT doc_id, words, unnest(generate_series(0, n - 1)) AS i FROM texts) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
  1000 * best.length // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM texts LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _base_personal(rank: int, kind: str, pattern: str, check: str) -> str:
    return f"""
      SELECT {rank} AS rank, '{kind}' AS kind, doc_id, x, string_split_regex(x, '{pattern}') AS gaps,
        list_transform(regexp_extract_all(x, '{pattern}', 0), lambda m: {{'size': length(m), 'counts': {check}}}) AS hits
      FROM texts WHERE regexp_matches(x, '{pattern}')"""


def _placed_personal(rank: int, kind: str, cue: str, found: str) -> str:
    """Every place of a text that has the cue is tried; `found` gives the offset and size of a span that begins near it."""
    return f"""
      SELECT doc_id, {rank} AS rank, '{kind}' AS kind, i - 1 + hit.skip AS start, hit.size AS size
      FROM (SELECT doc_id, i, {found} AS hit
        FROM (SELECT doc_id, x, unnest(generate_series(1, length(x))) AS i FROM texts WHERE regexp_matches(x, '{cue}')))
      WHERE hit.size > 0"""


_DIGITS = r"regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda d, k:
    CASE WHEN k % 2 = 1 THEN d::INT ELSE 2 * d::INT // 10 + 2 * d::INT % 10 END)) % 10 = 0"""
_FREE = r"NOT regexp_matches(substr(x, i - 1, 1), '[\pL\pN]') OR i = 1"
_SSN = r"""CASE WHEN regexp_matches(substr(x, i, 11), '^[0-9]{3}-[0-9]{2}-[0-9]{4}$')
    AND NOT regexp_matches(substr(x, i, 11), '^(000|666|9)|-00-|-0000$') AND NOT regexp_matches(substr(x, i + 11, 1), '[0-9-]')
    AND (i = 1 OR NOT regexp_matches(substr(x, i - 1, 1), '[\pL\pN_-]')) THEN {'skip': 0, 'size': 11} END"""
_IBAN_CODE = r"""regexp_extract(substr(x, i, 60),
    '^([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?:[^A-Za-z0-9]|$)', 1)"""
# The remainder of the turned code, letter by letter; a letter counts as two digits.
_IBAN = f"""CASE WHEN ({_FREE}) AND length(replace({_IBAN_CODE}, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_concat([0::BIGINT],
    list_transform(string_split(substr(replace({_IBAN_CODE}, ' ', ''), 5) || left({_IBAN_CODE}, 4), ''), lambda c: ascii(c)::BIGINT)),
    lambda r, c: CASE WHEN c >= 65 THEN r * 100 + c - 55 ELSE r * 10 + c - 48 END % 97) = 1
    THEN {{'skip': 0, 'size': length({_IBAN_CODE})}} END"""
_CUE = "(?:account|Account|ACCOUNT|acct|Acct|ACCT|konto|Konto|KONTO|compte|Compte|COMPTE|cuenta|Cuenta|CUENTA)"
_NUMBER = rf"^({_CUE}(?:\x20(?:number|no\.?|nr\.?))?\x20?[:#]?\x20?)([0-9]{{6,17}})(?:[^0-9]|$)"
_ACCOUNT = f"""CASE WHEN ({_FREE}) AND regexp_matches(substr(x, i, 50), '{_NUMBER}') THEN
    {{'skip': length(regexp_extract(substr(x, i, 50), '{_NUMBER}', 1)), 'size': length(regexp_extract(substr(x, i, 50), '{_NUMBER}', 2))}} END"""
_LOGIN = r"""CASE WHEN regexp_matches(substr(x, i), '^(https|http|ftp)://[A-Za-z0-9._%+-]+:[^\s\pZ\x1C-\x1F\x85/@:]+@[A-Za-z0-9.-]+') THEN
    {'skip': length(regexp_extract(substr(x, i), '^[a-z]+://')), 'size': length(regexp_extract(substr(x, i),
      '^[a-z]+://([A-Za-z0-9._%+-]+:[^\s\pZ\x1C-\x1F\x85/@:]+@[A-Za-z0-9.-]+)', 1))} END"""

OP7 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
kinds AS ({" UNION ALL ".join([
    _base_personal(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE"),
    _base_personal(1, "ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND right('00' || p, 3)::INT <= 255))"),
    _base_personal(2, "card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    _base_personal(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
])}),
nth AS (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM kinds),
along AS (
  SELECT doc_id, rank, kind, hits[i].counts AS counts, hits[i].size AS size,
    sum(length(gaps[i]) + hits[i].size) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop
  FROM nth),
found AS (
  SELECT doc_id, rank, kind, (stop - size)::BIGINT AS start, size FROM along WHERE counts
  {"".join(" UNION ALL " + _placed_personal(*k) for k in [
    (4, "iban", "[A-Z]{2}[0-9]{2}", _IBAN),
    (5, "ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", _SSN),
    (6, "account", _CUE, _ACCOUNT),
    (7, "login", "(http|https|ftp)://", _LOGIN),
])}),
named AS (SELECT *, kind || ':' || start || ':' || start + size AS span FROM found),
summed AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, k in enumerate(("email", "ip", "card", "phone")))},
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 4) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM named GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ("email", "ip", "card", "phone"))},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN summed USING (doc_id)
"""

# Bytes as pairs of hex digits.
OP9 = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, (length(x) // 2)::BIGINT AS n FROM documents),
strings AS (
  SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s
  FROM (SELECT doc_id, x, unnest(generate_series(0, n - 50)) AS i FROM texts WHERE n >= 50)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM strings) WHERE first < doc_id),
edges AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, TRUE) AS fresh FROM again),
runs AS (
  SELECT doc_id, min(i) AS start, max(i) + 50 AS stop
  FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges) GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM runs),
cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(stop - start)::BIGINT AS n_removed, max(stop) AS last,
    string_agg(substr(x, 2 * before + 1, 2 * (start - before)), '' ORDER BY start) AS kept
  FROM pieces JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""
