"""What SQL can state of the queries' results."""

from __future__ import annotations

import string

from driftpanel.llm import licenses, personal_data
from driftpanel.llm.quality import GRAM_SHARE, LEAST_WORDS, LINE_SHARE, WINDOW, WINDOW_PERCENT
from driftpanel.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def jaccard(n: int, percent: int) -> str:
    return rf"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all({LOWER}, '{SPACED}') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + {n - 1}), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS k FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM grams a JOIN grams b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * i >= {percent} * (s.n + t.n - i)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.other)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN reach r USING (doc_id) GROUP BY d.doc_id, s.n"""


WINNOWING = rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, size, k, array_to_string(list_slice(w, k, k + size - 1), ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM texts, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
hits AS (SELECT DISTINCT doc_id, p.size, k, g FROM places p SEMI JOIN windows v USING (g)),
words AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM hits) GROUP BY 1),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits JOIN windows USING (g)) GROUP BY 1)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(w.n, 0)::BIGINT AS n_hit, coalesce(f.n, 0)::BIGINT AS n_items,
  sha256(coalesce(f.list, '')) AS items_sha256, coalesce(w.n, 0) > 0 AS contaminated
FROM texts t LEFT JOIN words w USING (doc_id) LEFT JOIN found f USING (doc_id)"""


def repetition() -> str:
    def gram(n: int) -> str:
        return "concat_ws(' ', word, " + ", ".join(f"lead(word, {k}) OVER o" for k in range(1, n)) + ")"

    per_length = ",\n".join(rf"""
g{n} AS (
  SELECT doc_id, i, chars, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside
  FROM (SELECT doc_id, i, chars, (fits AND count(*) OVER (PARTITION BY doc_id, g, fits) > 1)::INT AS twice FROM (
    SELECT doc_id, i, chars, {gram(n)} AS g, n_words - i >= {n - 1} AS fits FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)))),
s{n} AS (SELECT doc_id, sum(chars * inside) AS chars, sum(inside) AS words FROM g{n} GROUP BY 1)""" for n in GRAM_SHARE)
    worst = " AND ".join(f"coalesce(s{n}.chars, 0) / greatest(word_chars, 1) / {limit} <= 1" for n, limit in GRAM_SHARE.items())
    joins = " ".join(f"LEFT JOIN s{n} USING (doc_id)" for n in GRAM_SHARE)
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
words AS (SELECT doc_id, n_words, i, word, length(word) AS chars FROM (
  SELECT doc_id, len(w) AS n_words, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts)),
{per_length},
rows AS (
  SELECT doc_id, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars, row_number() OVER (PARTITION BY doc_id, line) AS nth
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '{SPACED}')),
repeats AS (SELECT doc_id, count(*) FILTER (nth > 1) AS n, coalesce(sum(chars) FILTER (nth > 1), 0) AS chars FROM rows GROUP BY 1),
measured AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(r.n, 0)::BIGINT AS n_dup_lines,
    coalesce(s{WINDOW}.words, 0)::BIGINT AS n_repeat_words,
    (len(w) < {LEAST_WORDS} OR 100 * coalesce(s{WINDOW}.words, 0) > {WINDOW_PERCENT} * len(w)) AS base_failed,
    coalesce(r.chars, 0) / greatest(word_chars, 1) <= {LINE_SHARE} AND {worst} AS fine
  FROM (SELECT *, length(array_to_string(w, '')) AS word_chars FROM texts) t LEFT JOIN repeats r USING (doc_id) {joins})
SELECT * EXCLUDE (fine), NOT base_failed AND fine AS kept FROM measured"""


# The base kinds' patterns as plain ones: leftmost, greedy, not overlapping.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
TESTS = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INT), 0) <= 255))",
    "card": f"length({DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 "
            f"THEN substr({DIGITS}, -i, 1)::INT ELSE 2 * substr({DIGITS}, -i, 1)::INT - CASE WHEN substr({DIGITS}, -i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
    "phone": f"length({DIGITS}) BETWEEN 9 AND 15",
    "iban": "length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_transform(range(1, length(replace(m, ' ', '')) + 1), lambda i: "
            "ascii(substr(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), i, 1))), lambda a, v: CASE WHEN v < 58 "
            "THEN (a * 10 + v - 48) % 97 ELSE (a * 100 + v - 55) % 97 END, 0) = 1",
    "national_id": "substr(m, 1, 3) NOT IN ('000', '666')",
}


def private() -> str:
    parts = []
    for place, kind in enumerate(personal_data.KINDS):
        pattern = PLAIN.get(kind.name, kind.pattern)
        before = f"right(substr(text, 1, start::BIGINT), {personal_data.NEAR})"
        after = f"substr(text, start::BIGINT + length(m) + 1, {personal_data.NEAR})"
        near = rf"regexp_matches(lower({before} || chr(10) || {after}), '\b(?:{kind.context})')"
        parts.append(rf"""
SELECT doc_id, {place} AS place, '{kind.name}' AS kind, start, start + length(m) AS stop FROM (
  SELECT doc_id, text, ms[i] AS m, coalesce(list_sum(list_transform(gaps[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM texts)))
WHERE {TESTS[kind.name]} AND {kind.score} + CASE WHEN {near} THEN 0.3 ELSE 0 END >= {kind.least}""")
    count = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in personal_data.KINDS[: personal_data.BASE_KINDS])
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(parts)})
SELECT doc_id, {count},
  sha256(coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, place) FILTER (place < {personal_data.BASE_KINDS}), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, place), '') AS spans
FROM texts LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""


def license_texts() -> str:
    """Every place of every licence text, without an index."""

    def listed(words: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    phrases = ", ".join(f"('{label}', {listed(p.split())})" for p, label in licenses.PHRASES)
    texts = ",\n".join(f"('{label}', {licenses.needed(text)}, {listed(text.split())}, {listed(must)})" for label, text, must in licenses.TEXTS)
    near = licenses.NEAR
    return rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents),
phrases(label, p) AS (VALUES {phrases}),
licences(label, need, l, must) AS (VALUES {texts}),
base AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda k: w[k + 1 : k + len(p)] = p)) AS k FROM texts, phrases),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM texts),
places AS (SELECT label, need, len(l) AS size, must, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS p FROM licences),
begins AS (SELECT doc_id, label, need, size, must, i - p AS b, count(*) AS n FROM words JOIN places USING (word) GROUP BY ALL HAVING count(*) >= need),
found AS (
  SELECT doc_id, label, n / size AS share FROM begins JOIN texts USING (doc_id) WHERE list_bool_and(list_transform(must, lambda x:
    contains(' ' || array_to_string(w[greatest(b - {near}, 0) + 1 : b + size + {near}], ' ') || ' ', ' ' || x || ' ')))),
based AS (SELECT doc_id, count(*) AS n, min(k) AS first, max(k) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY 1),
labelled AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share
  FROM (SELECT doc_id, label, NULL AS share FROM base UNION ALL SELECT doc_id, label, share FROM found) GROUP BY 1)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.first::BIGINT AS first_word, b.last::BIGINT AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(l.share, 0.0::DOUBLE) END AS score
FROM texts t LEFT JOIN based b USING (doc_id) LEFT JOIN labelled l USING (doc_id)"""


EXACT = r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(x) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY x)"""


SOURCE_AUDIT = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
terms AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, lang, source, unnest(w) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM terms GROUP BY ALL HAVING sum(docs) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
used AS (SELECT lang, source, term, n FROM terms SEMI JOIN kept USING (lang, term)),
totals AS (SELECT lang, source, sum(n) AS total FROM used GROUP BY ALL),
groups AS (SELECT d.lang, d.source, coalesce(t.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN totals t USING (lang, source)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 5)) // (g.total + 5 * l.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v)::HUGEINT AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM found
QUALIFY part = 'pair' OR rank <= 50"""


def vector_codes(parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE, rounds: int = ROUNDS) -> str:
    """The same codebooks by comparing every part with every entry."""

    def assigned(books: str) -> str:
        gap = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - x[i]) * (v[i] - x[i])))"
        return (f"SELECT vec_id, part, min(d) AS d, arg_min(entry, (d, entry)) AS entry, any_value(v) AS v "
                f"FROM (SELECT vec_id, c.part, b.entry, v, {gap} AS d FROM cut c JOIN {books} b ON b.part = c.part) GROUP BY vec_id, part")

    def after(k: int) -> str:
        means = ("SELECT part, entry, list(m ORDER BY i) AS x FROM (SELECT part, entry, i, "
                 "(sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS m "
                 f"FROM (SELECT part, entry, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY ALL) GROUP BY part, entry")
        return f"""
a{k} AS MATERIALIZED ({assigned(f'b{k}')}),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN ({means}) m ON m.part = b.part AND m.entry = b.entry)"""

    return f"""
WITH fine AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
cut AS MATERIALIZED (
  SELECT vec_id, part, list_slice(v, part * (len(v) // {parts}) + 1, (part + 1) * (len(v) // {parts})) AS v
  FROM (SELECT vec_id, v, unnest(range({parts})) AS part FROM fine)),
b0 AS (
  SELECT part, entry, v AS x FROM cut JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM fine ORDER BY vec_id LIMIT {entries}) USING (vec_id)),
{",".join(after(k) for k in range(rounds))},
last AS MATERIALIZED ({assigned(f'b{rounds}')}),
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM last GROUP BY vec_id),
digest AS (
  SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, i)) AS s
  FROM (SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT s FROM digest) AS codebooks_sha256
FROM coded JOIN fine USING (vec_id)"""
