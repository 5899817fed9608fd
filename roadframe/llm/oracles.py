"""SQL of the contracts that SQL can express, for DuckDB over whole tables.

Byte windows (op6) take minutes there at sf0.01, and models and packing have no SQL: tests hold those against Python.
"""

from __future__ import annotations

from . import divergence, licenses, quality

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: All pairs that share a shingle, their similarity, and the smallest document each one reaches.
NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN [w[1]] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON b.g = a.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
c (id, root) USING KEY (id) AS (SELECT doc_id, doc_id FROM d UNION
  SELECT m.b, min(c.root) FROM c JOIN sym m ON m.a = c.id JOIN recurring.c r ON r.id = m.b WHERE c.root < r.root GROUP BY m.b)
SELECT c.id AS doc_id, coalesce(n.n, 0) AS n_shingles, root AS component_id, c.id = root AS kept FROM c LEFT JOIN n ON n.doc_id = c.id"""

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_ALNUM.format(_LOWER)} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ALNUM.format(_LOWER)} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d JOIN (SELECT DISTINCT k FROM iw) q ON len(w) >= k)),
hit AS (SELECT doc_id, k, p, item_id FROM dw JOIN iw USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT o) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS o FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""

SUBSTRINGS = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS at FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS first_doc FROM g) WHERE first_doc < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS at FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.at) AS t FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.at = word.at WHERE gone.at IS NULL GROUP BY word.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""

def _quality() -> str:
    value = {"mean_word": "word_chars / greatest(n_words, 1)", "symbol_share": "n_symbols / greatest(word_chars, 1)", "dup_share": "n_dup_lines / greatest(n_lines, 1)", "repeat_share": "n_repeat_words / greatest(n_words, 1)"}
    cells = "\nUNION ALL ".join(f"SELECT lang, source, '{f}' AS f, {r.base}e0 AS base_q, {r.high}e0 AS high_q, {r.spread}e0 AS spread, {r.two_sided} AS sym, CAST(floor(ln({value[f]} + {quality.SHIFT}) / ln({quality.GAMMA})) AS INT) AS b FROM good" for f, r in quality.FEATURES.items())
    parts, rule = [], "f, base_q, high_q, spread, sym"
    for level, keys in (("g", "lang, source, "), ("l", "lang, "), ("c", "")):
        cuts = ", ".join(f"min(CASE WHEN upto >= floor({q}_q * (total - 1)) + 1 THEN greatest(pow({quality.GAMMA}, b + 0.5) - {quality.SHIFT}, 0.0) END) AS {q}" for q in ("base", "high"))
        width = f"greatest(spread * (high - base), {quality.LEAST_WIDTH} + {quality.GAMMA - 1} * (high + {quality.SHIFT}))"
        parts.append(f"""{level}h AS (SELECT {keys}{rule}, b, count(*) AS n FROM cell GROUP BY {keys}{rule}, b),
{level}u AS (SELECT *, sum(n) OVER (PARTITION BY {keys}f ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {keys}f) AS total FROM {level}h),
{level} AS (SELECT {keys}f, n, CASE WHEN sym THEN base - {width} ELSE -1.0 END AS lo, high + {width} AS hi FROM (SELECT {keys}{rule}, max(total) AS n, {cuts} FROM {level}u GROUP BY {keys}{rule}))""")
    blend = ", ".join(f"g.n / (g.n + {quality.PRIOR}) * g.{x} + (1 - g.n / (g.n + {quality.PRIOR})) * (l.n / (l.n + {quality.PRIOR}) * l.{x} + (1 - l.n / (l.n + {quality.PRIOR})) * c.{x}) AS {x}" for x in ("lo", "hi"))
    checks = " OR ".join(f"(x.f = '{f}' AND NOT ({v} BETWEEN x.lo AND x.hi))" for f, v in value.items())
    return f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
line AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
run AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(w[p : p + 7], ' ')) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
again AS (SELECT doc_id, count(DISTINCT o) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS o FROM run WHERE n > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(again.n, 0) AS n_repeat_words
  FROM d LEFT JOIN line ON line.doc_id = d.doc_id LEFT JOIN again ON again.doc_id = d.doc_id),
j AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM m),
good AS (SELECT * FROM j WHERE NOT base_failed),
cell AS ({cells}),
{", ".join(parts)},
fence AS (SELECT g.lang, g.source, g.f, {blend} FROM g JOIN l ON l.lang IS NOT DISTINCT FROM g.lang AND l.f = g.f JOIN c ON c.f = g.f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM fence x WHERE x.lang IS NOT DISTINCT FROM j.lang AND x.source IS NOT DISTINCT FROM j.source AND ({checks})) AS kept FROM j"""


def _licenses() -> str:
    known = [*((t, label, True) for t, label in licenses.PHRASES.items()), *((t, label, False) for t, label in licenses.TEMPLATES.items())]
    values = ", ".join(f"({i}, '{t}', '{label}', {base})" for i, (t, label, base) in enumerate(known))
    k = licenses.K
    grams = "SELECT {0}, words, unnest(range(1, len(w) - %d)) AS p, w FROM {1} WHERE len(w) >= %d" % (k - 2, k)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM.format(_LOWER)} AS w FROM documents),
t AS (SELECT *, len(w) AS words FROM (SELECT id, label, base, string_split(t, ' ') AS w FROM (VALUES {values}) v(id, t, label, base))),
tg AS (SELECT id, label, base, words, p - 1 AS t, array_to_string(w[p : p + {k - 1}], ' ') AS g FROM ({grams.format("id, label, base", "t")})),
dg AS (SELECT r, p - 1 AS i, array_to_string(w[p : p + {k - 1}], ' ') AS g FROM ({grams.format("r", "(SELECT *, 0 AS words FROM d)")})),
hit AS (SELECT r, id, label, base, words, i - t AS diagonal, t FROM dg JOIN tg USING (g)),
gap AS (SELECT *, least({k}, coalesce(t - lag(t) OVER (PARTITION BY r, id, diagonal ORDER BY t), {k})) AS adds FROM hit),
diag AS (SELECT r, id, label, base, words, diagonal, diagonal + min(t) AS a, diagonal + max(t) + {k} AS b, sum(adds) / words AS alone FROM gap GROUP BY r, id, label, base, words, diagonal),
cut AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, id ORDER BY diagonal) > CASE WHEN base THEN 0 ELSE least({licenses.BAND}, words // 4) END, false) AS far FROM diag),
chain AS (SELECT *, sum(CAST(far AS INT)) OVER (PARTITION BY r, id ORDER BY diagonal) AS chain FROM cut),
held AS (SELECT DISTINCT r, id, chain, t FROM chain JOIN hit USING (r, id, diagonal)),
both_gap AS (SELECT *, least({k}, coalesce(t - lag(t) OVER (PARTITION BY r, id, chain ORDER BY t), {k})) AS adds FROM held),
together AS (SELECT r, id, chain, sum(adds) AS n FROM both_gap GROUP BY ALL),
span AS (SELECT r, id, label, base, words, chain, min(a) AS a, max(b) AS b, max(alone) AS alone FROM chain GROUP BY ALL),
found AS (SELECT r, label, base, words, a, greatest(alone, CASE WHEN b - a <= {licenses.LONGEST_SPAN} * words THEN n / words ELSE 0 END) AS share FROM span JOIN together USING (r, id, chain)),
kept AS (SELECT * FROM found WHERE share >= CASE WHEN base OR words < {licenses.WHOLE_BELOW} THEN 1 ELSE {licenses.LEAST_SHARE} END),
s AS (SELECT r, max(share) AS score FROM found GROUP BY r),
l AS (SELECT r, count(*) FILTER (base) AS n_base, min(a) FILTER (base) AS first_word, max(a) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM kept GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN l ON l.r = d.r LEFT JOIN s ON s.r = d.r"""


_SHARE = f"1 + (CAST({divergence.SCALE} AS HUGEINT) * ({{0}} + 2)) // ({{1}} + 2 * v)"
_APART = "(p - q) * (p - q) // (p + q)"

DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n, {_SHARE.format("coalesce(n.n, 0)", "coalesce(gn.total, 0)")} AS p, {_SHARE.format("kept.n", "l.total")} AS q
  FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum({_APART}) AS value FROM (SELECT lang, source, term, p FROM p) a JOIN (SELECT lang, source, term, p AS q FROM p) b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST({_APART} AS BIGINT) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}"""


SQL = {"op3_near_duplicates": NEAR_DUPLICATES, "op4_decontamination": DECONTAMINATION, "op5_substring_dedup": SUBSTRINGS, "op9_quality_rules": _quality(), "op11_license_scans": _licenses(), "op13_source_divergence": DIVERGENCE}
