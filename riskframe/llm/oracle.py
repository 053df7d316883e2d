"""SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .licences import MIN_SHARE, NOTICES, PHRASES, RARE_WORDS, SLACK
from .quality import STOP_WORDS

ORACLE: dict[str, str] = {}

_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

ORACLE["op6_quality_rules"] = f"""
WITH plain AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM plain),
windows AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
  FROM split WHERE len(w) >= 3),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
measured AS (
  SELECT s.doc_id, len(w) AS n_words,
         CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop,
         length(t) - length(replace(t, '!', '')) AS n_ex,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_cap,
         len(lines) AS n_lines
  FROM split s LEFT JOIN covered c USING (r)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND 1000 * word_chars BETWEEN 2500 * n_words AND 12000 * n_words
       AND 1000 * n_symbols <= 200 * n_words AND 1000 * n_ex <= 300 * n_words
       AND 1000 * n_stop >= 50 * n_words AND 1000 * n_cap <= 400 * word_chars
       AND 1000 * n_dup_lines <= 500 * n_lines AS kept
FROM judged"""


def _rows(rows) -> str:
    """Literal rows: texts quoted, numbers as they are."""
    cell = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def _place(text: str, phrase: str) -> int:
    words, k = text.split(), phrase.split()
    return next(i for i in range(len(words)) if words[i : i + len(k)] == k)


# phrases that must stand in order: the base ones (notice -1) and the keys of each notice
_PHRASE_WORDS = [(-1, p, j, w, len(p.split()), 0) for p, _ in PHRASES for j, w in enumerate(p.split())] + [
    (n, k, j, w, len(k.split()), _place(x.text, k))
    for n, x in enumerate(NOTICES)
    for k in x.keys
    for j, w in enumerate(k.split())
]
_JOINED = "coalesce(array_to_string(list_sort(list_distinct(list(label))), ','), '')"

ORACLE["op4_licence_scan"] = f"""
WITH plain AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
pos AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM plain),
notice_words AS (SELECT * FROM ({_rows((n, i, w) for n, x in enumerate(NOTICES) for i, w in enumerate(x.text.split()))}) v(n, i, w)),
phrase_words AS (SELECT * FROM ({_rows(_PHRASE_WORDS)}) v(n, phrase, j, w, size, place)),
frequency AS (SELECT w, count(DISTINCT r) AS c FROM pos WHERE w IN (SELECT w FROM notice_words) GROUP BY w),
weighed AS (
  SELECT n, m.w, m.i, ln(((SELECT count(*) FROM plain) + 1.0) / (coalesce(c, 0) + 1.0)) + 1e-6 AS idf
  FROM (SELECT n, w, min(i) AS i FROM notice_words GROUP BY n, w) m LEFT JOIN frequency f ON f.w = m.w),
rare AS (SELECT n, w, i, round(idf, 6) AS x FROM weighed QUALIFY row_number() OVER (PARTITION BY n ORDER BY idf DESC, w) <= {RARE_WORDS}),
starts AS (
  SELECT r, n, phrase, place, pos.i - j AS s FROM pos JOIN phrase_words p ON p.w = pos.w
  GROUP BY r, n, phrase, place, size, pos.i - j HAVING count(*) = size),
anchors AS (SELECT DISTINCT r, n, pos.i - rare.i AS o FROM pos JOIN rare ON rare.w = pos.w),
met AS (
  SELECT DISTINCT a.r, a.n, a.o, q.w, q.x FROM anchors a JOIN rare q ON q.n = a.n
  JOIN pos p ON p.r = a.r AND p.w = q.w AND abs(p.i - (a.o + q.i)) <= {SLACK}),
keyed AS (
  SELECT a.r, a.n, a.o FROM anchors a JOIN starts s ON s.r = a.r AND s.n = a.n AND abs(s.s - (a.o + s.place)) <= {SLACK}
  GROUP BY a.r, a.n, a.o HAVING count(DISTINCT phrase) = (SELECT count(DISTINCT phrase) FROM phrase_words p WHERE p.n = a.n)),
shares AS (
  SELECT r, n, max(share) AS share FROM (
    SELECT r, n, o, sum(x) / (SELECT sum(x) FROM rare q WHERE q.n = met.n) AS share FROM met JOIN keyed USING (r, n, o) GROUP BY r, n, o)
  GROUP BY r, n HAVING max(share) >= {MIN_SHARE}),
base AS (
  SELECT r, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, {_JOINED} AS base_labels
  FROM starts JOIN ({_rows(PHRASES)}) v(phrase, label) USING (phrase) WHERE n = -1 GROUP BY r),
found AS (
  SELECT r, label FROM shares JOIN ({_rows((n, x.label) for n, x in enumerate(NOTICES))}) v(n, label) USING (n)
  UNION SELECT r, label FROM starts JOIN ({_rows(PHRASES)}) v(phrase, label) USING (phrase) WHERE n = -1),
labelled AS (SELECT r, {_JOINED} AS labels FROM found GROUP BY r),
best AS (SELECT r, max(share) AS share FROM shares GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE round(least(coalesce(share, 0.0::DOUBLE), 1.0::DOUBLE), 6) END AS score
FROM plain LEFT JOIN base USING (r) LEFT JOIN labelled USING (r) LEFT JOIN best USING (r)"""


ORACLE["op11_phrase_collocations"] = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS p
  FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE k > 1 AND f >= 30),
inner_phrases AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a
  FROM candidates, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i)
  WHERE m < k AND i + m - 1 <= k),
covered AS (
  SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN inner_phrases i USING (lang, phrase) WHERE 100 * i.a >= 80 * c.a),
cuts AS (
  SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:k], ' ') AS tail
  FROM candidates ANTI JOIN covered USING (lang, phrase), (SELECT unnest([1, 2, 3]) AS j) WHERE j < k),
scored AS (
  SELECT c.lang, c.phrase, c.a, j, h.f AS l, t.f AS r,
         CAST((2000000 * CAST(c.a AS HUGEINT)) // (CAST(h.f AS HUGEINT) + t.f) AS BIGINT) AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""
