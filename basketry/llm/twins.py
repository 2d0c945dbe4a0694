"""DuckDB twins of the queries that SQL can express; each reads the whole tables."""

from __future__ import annotations

from .quality_rules import COMMON, PUNCTUATION, SYMBOLS

_SPACE = r"[\x20\x09-\x0D]"

_OP1 = rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}+', '', 'g')) AS h FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY h) AS n, first_value(doc_id) OVER (PARTITION BY h ORDER BY chars DESC, doc_id) AS k FROM d
)
SELECT doc_id, k AS keep_id, n AS group_size, doc_id = k AS kept, h AS text_sha256 FROM g
"""

# The schedule by counting: ranks come from a window here.
_OP3 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS place FROM documents
), ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][place % 3 + 1] AS weight, 2 * source_size AS most FROM ranked
), sums AS (
  SELECT *, 3 * sum(source_size) OVER () AS total, coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY most::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM weighed
), levels AS (
  SELECT *, (total - 2 * capped)::DOUBLE / 2 / open_weight AS level FROM sums
), targets AS (
  SELECT source, source_size, coalesce(least(max(CASE WHEN level * weight <= most THEN level END) OVER () * weight, most::DOUBLE), most::DOUBLE) AS target FROM levels
), sized AS (
  SELECT source, source_size, floor(target)::BIGINT // source_size AS full_passes, floor(target)::BIGINT % source_size AS rest, (source_size + 1023) // 1024 AS blocks FROM targets WHERE source_size > 0 AND target >= 1
), needs AS (
  SELECT *, full_passes * blocks + (rest + 1023) // 1024 AS need FROM sized
), shares AS (
  SELECT *, (sum(need) OVER (ORDER BY source NULLS LAST))::BIGINT AS hi, (sum(need) OVER (ORDER BY source NULLS LAST) - need)::BIGINT AS lo FROM needs
), grid AS (
  SELECT min(k) AS k FROM range(0, 60) AS r(k) WHERE (1::BIGINT << k) >= (SELECT coalesce(sum(need), 1) FROM needs)
), points AS (
  SELECT slot, coalesce(list_sum(list_transform(range(k), lambda j: ((slot >> j) & 1) << (k - 1 - j))), 0) AS point FROM (SELECT k, unnest(range(0, 1::BIGINT << k)) AS slot FROM grid)
), dealt AS (
  SELECT slot, s.*, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM points JOIN shares s ON point >= lo AND point < hi
), blocks AS (
  SELECT slot, source, rank % blocks AS block_no, least(1024, source_size - rank % blocks * 1024, CASE WHEN rank >= full_passes * blocks THEN rest - rank % blocks * 1024 ELSE 1024 END) AS words FROM dealt
), streams AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a, row_number() OVER () AS row FROM d WHERE size > 0
), segments AS (
  SELECT row, source, block_no, greatest(a, block_no * 1024) - block_no * 1024 AS a, least(a + size, (block_no + 1) * 1024) - block_no * 1024 AS b
  FROM (SELECT *, unnest(range(a // 1024, (a + size - 1) // 1024 + 1)) AS block_no FROM streams)
), parts AS (
  SELECT row, slot, greatest(0, least(b, words) - a) AS part FROM segments g JOIN blocks u ON g.source IS NOT DISTINCT FROM u.source AND g.block_no = u.block_no
), taken AS (
  SELECT row, sum(part)::BIGINT AS taken, min(slot) FILTER (WHERE part > 0) AS first_slot FROM parts GROUP BY row
), answers AS (
  SELECT doc_id, source, size, coalesce(t.taken, 0) AS taken, first_slot FROM streams s LEFT JOIN taken t ON t.row = s.row
  UNION ALL SELECT doc_id, source, size, 0, NULL FROM d WHERE size = 0
)
SELECT doc_id, size, source_size, target, taken, first_slot FROM answers a JOIN targets t ON a.source IS NOT DISTINCT FROM t.source
"""

# Links come from counting shared shingles, components from the closure of the links.
_OP4 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)
), two_way AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a, b FROM two_way UNION SELECT r.a, e.b FROM reach r JOIN two_way e ON r.b = e.a
), least_id AS (
  SELECT a, min(b) AS c FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_id ON a = d.doc_id
"""

_OP6 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), t AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))) AS formatted_chars,
    string_agg(role, '>' ORDER BY turn, role, text) AS roles
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars,
  regexp_full_match(roles, '(system>)?user>assistant(>user>assistant)*') AS valid
FROM t
"""

# Bytes as pairs of hex digits; blocks of 1000 windows keep the strings that are cut short.
_OP7 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
  SELECT doc_id, block, substr(h, 2000 * block + 1, 2398) AS part FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 + 999) // 1000)) AS block FROM d)
), windows AS (
  SELECT doc_id, 1000 * block + i AS pos, md5_number(substr(part, 2 * i + 1, 400)) AS w
  FROM (SELECT doc_id, block, part, unnest(range(0, greatest(0, length(part) // 2 - 199))) AS i FROM blocks)
), again AS (
  SELECT doc_id, pos FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)
), islands AS (
  SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS island
  FROM (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 200 THEN 0 ELSE 1 END AS fresh FROM again)
), spans AS (
  SELECT doc_id, min(pos) AS a, max(pos) + 200 AS b FROM islands GROUP BY doc_id, island
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS k, a AS until FROM spans
  UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id
), kept AS (
  SELECT g.doc_id, string_agg(CASE WHEN until IS NULL THEN substr(h, 2 * k + 1) ELSE substr(h, 2 * k + 1, 2 * (until - k)) END, '' ORDER BY k) AS left_over FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id
), sums AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def _distance(name: str, h: str, bins: int) -> str:
    """CTEs for the references of histogram ``h`` and each document's distance to that of its language."""
    return f"""
{name}_shares AS (
  SELECT doc_id, lang, chars, i, {h}[i] / list_sum({h}) AS p FROM c, range(1, {bins + 1}) AS r(i) WHERE list_sum({h}) > 0
), {name}_median AS (
  SELECT lang, i, coalesce(quantile_disc(p, 0.5) FILTER (WHERE chars >= 500), 0) AS q FROM {name}_shares GROUP BY lang, i
), {name}_reference AS (
  SELECT lang, i, q / sum(q) OVER (PARTITION BY lang) AS q FROM {name}_median QUALIFY sum(q) OVER (PARTITION BY lang) > 0
), {name}_distance AS (
  SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS {name}
  FROM {name}_shares s JOIN {name}_reference f ON f.lang IS NOT DISTINCT FROM s.lang AND f.i = s.i GROUP BY doc_id
)"""


def _without(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"length(t) - length(regexp_replace(t, '{quoted}', '', 'g'))"


_OP10 = rf"""
WITH common(lang, words) AS (
  VALUES {', '.join(f"('{lang}', {words})" for lang, words in COMMON.items())}
), d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), counted AS (
  SELECT doc_id, lang, w, words, len(w) AS n_words, length(t) AS chars, {_without(_SPACE)} AS spaces, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    {_without(chr(92) + 'p{Lu}')} AS capitals, {_without(chr(92) + 'p{Nd}')} AS digits, {_without(PUNCTUATION)} AS marks, {_without(SYMBOLS)} AS n_symbols
  FROM d LEFT JOIN common USING (lang)
), c AS (
  SELECT *, [chars - capitals - digits - spaces - marks - n_symbols, capitals, digits, spaces, marks, n_symbols] AS class_counts,
    CASE WHEN words IS NOT NULL THEN list_append(list_transform(words, lambda x: len(list_filter(w, lambda y: y = x))), len(list_filter(w, lambda y: NOT list_contains(words, y)))) END AS word_counts
  FROM counted
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times
  FROM (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM c WHERE len(w) >= 5))
), repeats AS (
  SELECT doc_id, sum(covered)::BIGINT AS n FROM (
    SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS covered FROM windows WHERE times > 1
  ) GROUP BY doc_id
), {_distance('class', 'class_counts', 6)}, {_distance('word', 'word_counts', 21)}, judged AS (
  SELECT c.doc_id, n_words, chars - spaces AS word_chars, n_symbols, n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    CASE WHEN n_words >= 20 THEN class END AS class_distance, CASE WHEN n_words >= 20 THEN word END AS word_distance
  FROM c LEFT JOIN repeats r ON r.doc_id = c.doc_id LEFT JOIN class_distance x ON x.doc_id = c.doc_id LEFT JOIN word_distance y ON y.doc_id = c.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT coalesce(class_distance > 0.07 + 1.5 / sqrt(n_words), false)
    AND NOT coalesce(word_distance > 0.06 + 2.2 / sqrt(n_words), false) AS kept,
  round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM judged
"""


def _crc32(text: str) -> str:
    """The checksum of an ASCII text, byte by byte and bit by bit."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b:
      list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE y END))))"""


# A pair of a document and a lag is looked at where three words of the lag's grid, and the words after them, agree.
_OP11 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS w, {_crc32('doc_id::VARCHAR')} AS h
  FROM documents
), planted AS (
  SELECT row, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS hit, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM d
), texts AS (
  SELECT row, doc_id, n, CASE WHEN hit THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) ELSE w END AS w FROM planted
), pos AS MATERIALIZED (
  SELECT row, unnest(range(n)) AS i, unnest(w) AS x FROM texts
), grid AS (
  SELECT row, q, q * unnest(range(0, n // q - 2)) AS i FROM (SELECT row, n, unnest(range(1, n // 4 + 1)) AS q FROM texts WHERE n >= 6)
), agree AS (
  SELECT g.row, g.q, g.i FROM grid g JOIN pos a ON a.row = g.row AND a.i = g.i JOIN pos b ON b.row = g.row AND b.i = g.i + q AND b.x = a.x JOIN pos c ON c.row = g.row AND c.i = g.i + 2 * q AND c.x = a.x
), lags AS (
  SELECT DISTINCT g.row, g.q FROM agree g JOIN pos a ON a.row = g.row AND a.i = g.i + 1 JOIN pos b ON b.row = g.row AND b.i = g.i + 1 + q AND b.x = a.x LEFT JOIN pos c ON c.row = g.row AND c.i = g.i + 1 + 2 * q
  WHERE q = 1 OR c.x = a.x
), same AS (
  SELECT g.row, g.q, a.i, a.i - row_number() OVER (PARTITION BY g.row, g.q ORDER BY a.i) AS island
  FROM lags g JOIN pos a ON a.row = g.row JOIN pos b ON b.row = g.row AND b.i = a.i + g.q AND b.x = a.x
), stretches AS (
  SELECT row, q, min(i) AS s, count(*) + q AS len FROM same GROUP BY row, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS MATERIALIZED (
  SELECT row, s, len, min(q) AS q FROM stretches GROUP BY row, s, len
), best AS (
  SELECT row, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines, arg_min([s, len, q], ROW(-(len::DOUBLE / q), s, q)) AS b FROM runs GROUP BY row
), gone AS (
  SELECT DISTINCT p.row, p.i FROM pos p JOIN runs r ON r.row = p.row AND p.i >= r.s + r.q AND p.i < r.s + r.len
), kept AS (
  SELECT p.row, string_agg(x, ' ' ORDER BY p.i) AS t FROM pos p LEFT JOIN gone g ON g.row = p.row AND g.i = p.i WHERE g.i IS NULL GROUP BY p.row
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b[1] AS start, b[2] AS length, b[3] AS period, 1000 * b[2] // b[3] AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM texts LEFT JOIN best ON best.row = texts.row LEFT JOIN kept ON kept.row = texts.row
"""

# From row to row: for each state the cheapest edits so far, the ASCII-least of them, and the text they give. ``steps``: the edits of one row with up to three insertions before it.
_OP13 = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS c FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN c = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM c WHERE c <> 0
), convs AS (
  SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)
), placed AS (
  SELECT k, turn, role, text, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial, right(regexp_replace(text, '{_SPACE}+$', ''), 1) AS mark
  FROM damaged JOIN convs ON damaged.conv_id IS NOT DISTINCT FROM convs.conv_id
), r AS MATERIALIZED (
  SELECT *, CASE WHEN mark = '' THEN 'b' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'd' WHEN mark NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    coalesce(lag(initial) OVER (PARTITION BY k ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM placed
), inserts(a, b, ins, added) AS (
  VALUES (0, 0, '', []), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
    (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])
), edits(b, initial, z, edit, price, said) AS (
  VALUES (0, 's', 1, 'K', 0, NULL), (0, 'u', 2, 'K', 0, NULL), (1, 'u', 2, 'K', 0, NULL), (2, 'a', 3, 'K', 0, NULL), (3, 'u', 2, 'K', 0, NULL), (0, '*', 2, 'R', 2, 'user'), (1, '*', 2, 'R', 2, 'user'),
    (2, '*', 3, 'R', 2, 'assistant'), (3, '*', 2, 'R', 2, 'user'), (0, '*', 0, 'D', 3, ''), (1, '*', 1, 'D', 3, ''), (2, '*', 2, 'D', 3, ''), (3, '*', 3, 'D', 3, '')
), steps AS MATERIALIZED (
  SELECT a, z, initial, edit, said, ins || edit AS letters, added, price + 2 * length(ins) AS price FROM inserts JOIN edits USING (b)
), best AS (
  SELECT k, 0::BIGINT AS i, 0 AS z, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM convs
  UNION ALL
  SELECT k, i, z, m[1], m[2], m[3] FROM (
    SELECT b.k, r.i, s.z, arg_min(ROW(b.cost + s.price + CASE WHEN fault = 't' AND edit <> 'D' THEN 1 ELSE 0 END, b.audit || s.letters, b.said || s.added || CASE WHEN edit = 'D' THEN [] ELSE [coalesce(s.said, role) || ':' || text] END),
      ROW(b.cost + s.price + CASE WHEN fault = 't' AND edit <> 'D' THEN 1 ELSE 0 END, b.audit || s.letters)) AS m
    FROM best b JOIN r ON r.k = b.k AND r.i = b.i + 1 JOIN steps s ON s.a = b.z AND (s.initial = '*' OR s.initial = r.initial) AND (edit = 'D' OR fault NOT IN ('b', 'd')) GROUP BY ALL
  )
), ends AS (
  SELECT k, arg_min(ROW(cost + 2 * length(ins), audit || ins, said || added), ROW(cost + 2 * length(ins), audit || ins)) AS m
  FROM best JOIN (SELECT k AS key, max(i) AS n FROM best GROUP BY k) ON k = key AND i = n JOIN inserts ON a = z AND b IN (0, 3) GROUP BY k
), sums AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM r GROUP BY k
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  m[1] AS cost, m[2] AS audit, sha256(array_to_string(m[3], chr(10))) AS repaired_sha256
FROM convs JOIN ends ON ends.k = convs.k LEFT JOIN sums ON sums.k = convs.k
"""

_NUMBERS = "sum(urls)::BIGINT AS urls, sum(labelled)::BIGINT AS labelled, sum(bad)::BIGINT AS bad"


def _far(hits: str, of: str) -> str:
    """Whether a chi-square test tells two groups apart, p and c."""
    a, n, b, m = (f"{s}.{f}::DOUBLE" for s, f in (("p", hits), ("p", of), ("c", hits), ("c", of)))
    return f"({n} + {m}) * ({a} * ({m} - {b}) - {b} * ({n} - {a})) * ({a} * ({m} - {b}) - {b} * ({n} - {a})) > 3.841 * {n} * {m} * ({a} + {b}) * ({n} + {m} - {a} - {b})"


def _level(d: int) -> str:
    """The literal branches of level ``d`` and the rows below them. Groups of branches grow one branch at a time."""
    return f"""
counts{d} AS MATERIALIZED (
  SELECT host, node, rest[1] AS seg, {_NUMBERS}, sum(CASE WHEN len(rest) = 1 THEN urls ELSE 0 END)::BIGINT AS ends FROM rows{d} WHERE len(rest) > 0 GROUP BY host, node, rest[1]
), ordered{d} AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY host, node ORDER BY (bad + 1) / (labelled + 2), seg) AS i
  FROM (SELECT *, sum(urls) OVER (PARTITION BY host, node) AS total FROM counts{d}) WHERE urls >= 20 AND urls >= 0.02 * total
), grown{d} AS (
  SELECT host, node, i, seg, 1 AS branch, {{'labelled': labelled, 'bad': bad, 'urls': urls, 'ends': ends}} AS p FROM ordered{d} WHERE i = 1
  UNION ALL
  SELECT c.host, c.node, c.i, c.seg, CASE WHEN {_far('bad', 'labelled')} OR {_far('ends', 'urls')} THEN branch + 1 ELSE branch END,
    CASE WHEN {_far('bad', 'labelled')} OR {_far('ends', 'urls')} THEN {{'labelled': c.labelled, 'bad': c.bad, 'urls': c.urls, 'ends': c.ends}}
      ELSE {{'labelled': p.labelled + c.labelled, 'bad': p.bad + c.bad, 'urls': p.urls + c.urls, 'ends': p.ends + c.ends}} END
  FROM grown{d} g JOIN ordered{d} c ON c.host = g.host AND c.node = g.node AND c.i = g.i + 1
), level{d} AS MATERIALIZED (
  SELECT host, node, seg, string_agg(replace(replace(replace(seg, '%', '%25'), '*', '%2A'), '|', '%7C'), '|') OVER (PARTITION BY host, node, branch ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS branch
  FROM grown{d}
), {_down("rows", d, f"host, {_NUMBERS}", "GROUP BY ALL")}, {_down("pages_at", d, "page_id, host, path", "")}"""


def _down(rows: str, d: int, cols: str, group: str) -> str:
    cols = cols.replace("host", "r.host")
    return f"""{rows}{d + 1} AS MATERIALIZED (
  SELECT {cols}, CASE WHEN len(rest) = 0 THEN r.node ELSE r.node || '/' || coalesce(branch, '*') END AS node, rest[2:] AS rest
  FROM {rows}{d} r LEFT JOIN level{d} l ON l.host = r.host AND l.node = r.node AND l.seg = r.rest[1] {group}
)"""


_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

_OP12 = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), split AS (
  SELECT *, string_split(path, '/')[2:] AS rest, try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:\.html)?/?$', 1) AS BIGINT) AS doc_id FROM p
), known AS (
  SELECT doc_id, bool_or(coalesce(toxic = 1, false) OR coalesce(quality = 0, false)) AS bad FROM labels WHERE toxic = 1 OR quality = 0 OR (toxic IS NOT NULL AND quality IS NOT NULL) GROUP BY doc_id
), rows1 AS (
  SELECT host, '' AS node, rest, count(*) AS urls, count(k.bad) AS labelled, count(*) FILTER (WHERE k.bad) AS bad FROM split s LEFT JOIN known k ON k.doc_id = s.doc_id GROUP BY ALL
), pages_at1 AS (
  SELECT page_id, host, path, '' AS node, rest FROM split
), {", ".join(map(_level, (1, 2, 3, 4)))}, leaves AS (
  SELECT host, CASE WHEN len(rest) > 0 THEN node || '/**' ELSE node END AS template, {_NUMBERS} FROM rows5 GROUP BY ALL
), base AS (
  SELECT coalesce((sum(labelled) - sum(bad)) / nullif(sum(labelled), 0), 1) AS base FROM leaves
), hosts AS (
  SELECT host, (sum(labelled) - sum(bad) + 10 * any_value(base)) / (sum(labelled) + 10) AS prior FROM leaves, base GROUP BY host
), templates AS (
  SELECT leaves.host, template, (labelled - bad + 10 * prior) / (labelled + 10) AS purity FROM leaves JOIN hosts ON hosts.host = leaves.host
), rules(rule_host, rule_path, says) AS (
  VALUES {", ".join(map(repr, _RULES))}
), ruled AS (
  SELECT host AS h, path AS q, arg_max(ROW(rule_host || rule_path, says), length(rule_host || rule_path)) AS r FROM (SELECT DISTINCT host, path FROM p)
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL
)
SELECT page_id, a.host, a.path, r[1] AS rule, template, round(purity, 9) AS purity, coalesce(r[2], CASE WHEN purity < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT *, CASE WHEN len(rest) > 0 THEN node || '/**' ELSE node END AS t FROM pages_at5) a JOIN templates ON templates.host = a.host AND template = t LEFT JOIN ruled ON h = a.host AND q = a.path
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": _OP1, "op3_mix_sources": _OP3, "op4_near_dedup": _OP4, "op6_chat_format": _OP6, "op7_suffix_dedup": _OP7, "op10_quality_rules": _OP10, "op11_periodic_runs": _OP11, "op12_url_filters": _OP12, "op13_conversation_repair": _OP13}
