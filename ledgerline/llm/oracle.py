"""Independent DuckDB SQL of the operators that SQL can express: all pairs
instead of signatures, counting windows instead of arrays."""

from __future__ import annotations

from . import quality_rules as Q

_SPLIT = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _components(edges: str) -> str:
    """CTEs reach(id, root): ``edges`` is a relation (a, b)."""
    return f"""
edge AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
walk(id, root) AS (SELECT a, a FROM edge UNION SELECT w.id, e.b FROM walk w JOIN edge e ON w.root = e.a),
reach AS (SELECT id, min(root) AS root FROM walk GROUP BY id)"""


def near_dedup_sql() -> str:
    """2-word shingle sets, all pairs that share a shingle."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_SPLIT}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id
          GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
{_components('links')}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id,
       d.doc_id = coalesce(r.root, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.id = d.doc_id"""


def line_dedup_sql() -> str:
    """Character 9-grams of the normalised lines, all pairs that share one."""
    size = 9
    return f"""
WITH RECURSIVE raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, pos, line, trim(lower(regexp_replace(line, '\\s+', ' ', 'g'))) AS form FROM raw),
forms AS (SELECT form, row_number() OVER (ORDER BY min(struct_pack(d := doc_id, p := pos))) AS id,
                 min(struct_pack(d := doc_id, p := pos)) AS first FROM lines WHERE form <> '' GROUP BY form),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(form) - {size - 1}, 1) + 1),
                                                lambda i: substring(form, i, {size}))) AS s FROM forms),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.id < y.id GROUP BY x.id, y.id),
links AS (SELECT a, b FROM pairs JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
{_components('links')},
stays AS (SELECT coalesce(r.root, f.id) AS root, min(f.first) AS first FROM forms f LEFT JOIN reach r ON r.id = f.id GROUP BY 1),
judged AS (SELECT l.doc_id, l.pos, l.line, l.form,
                  l.form = '' OR st.first = struct_pack(d := l.doc_id, p := l.pos) AS stay
           FROM lines l LEFT JOIN forms f ON f.form = l.form LEFT JOIN reach r ON r.id = f.id
           LEFT JOIN stays st ON st.root = coalesce(r.root, f.id))
SELECT doc_id, count(*) FILTER (WHERE form <> '') AS n_lines, count(*) FILTER (WHERE NOT stay) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stay), '') AS text
FROM judged GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL"""


def quality_sql() -> str:
    """Counts by unnesting words, windows and lines; binomial sums by log gamma."""
    window, rules = Q.WINDOW, list(Q.RULES.items())
    alpha = Q.ALPHA / len(rules)
    grid = ", ".join(f"('{rule}', {k}, CAST({cut!r} AS DOUBLE))" for rule, (_, cuts) in rules for k, cut in enumerate(cuts))
    signals = " UNION ALL ".join(
        f"SELECT doc_id, stratum, base_failed, '{rule}' AS rule, CAST({signal} AS DOUBLE) AS signal FROM m" for rule, (signal, _) in rules)
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), {_SPLIT}) AS w FROM documents),
spots AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM t),
texts AS (SELECT doc_id, p, count(*) OVER ahead AS many, string_agg(word, ' ') OVER ahead AS words FROM spots
          WINDOW ahead AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)),
windows AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, words) AS times FROM texts WHERE many = {window}),
covered AS (SELECT doc_id, count(DISTINCT spot) AS n FROM
            (SELECT doc_id, unnest(range(p, p + {window})) AS spot FROM windows WHERE times > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS d FROM l WHERE regexp_matches(line, {_SPLIT}) GROUP BY doc_id),
m0 AS (SELECT t.doc_id, t.stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
              CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
              coalesce(dup.n, 0) AS n_lines, coalesce(dup.d, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
       FROM t LEFT JOIN dup ON dup.doc_id = t.doc_id LEFT JOIN covered c ON c.doc_id = t.doc_id),
m AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m0),
sig AS ({signals}),
grid(rule, k, cut) AS (VALUES {grid}),
good AS (SELECT s.* FROM sig s JOIN labels b ON b.doc_id = s.doc_id WHERE b.quality = 1 AND NOT s.base_failed),
strata AS (SELECT stratum, rule, count(*) AS n FROM good GROUP BY stratum, rule),
level AS (SELECT CAST({Q.DELTA!r} AS DOUBLE) / (count(DISTINCT stratum) * {len(rules)}) AS level FROM strata),
tested AS (SELECT st.stratum, g.rule, g.k, g.cut, st.n, count(*) FILTER (WHERE x.signal >= g.cut) AS hit
           FROM strata st JOIN grid g ON g.rule = st.rule JOIN good x ON x.stratum = st.stratum AND x.rule = st.rule
           GROUP BY ALL),
passed AS (SELECT stratum, rule, max_by(cut, k) AS cut FROM tested, level
           WHERE list_sum(list_transform(range(0, hit + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
                 + i * ln({alpha!r}) + (n - i) * ln(1 - {alpha!r})))) <= level GROUP BY stratum, rule),
rejected AS (SELECT DISTINCT s.doc_id FROM sig s JOIN passed p ON p.stratum = s.stratum AND p.rule = s.rule WHERE s.signal >= p.cut)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND r.doc_id IS NULL AS kept, stratum
FROM m LEFT JOIN rejected r ON r.doc_id = m.doc_id"""


def fill_in_middle_sql() -> str:
    """Tokens by a regular expression, cut and joined as lists."""
    number = "('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), {}, 8))::UBIGINT::BIGINT"
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, {', '.join(f'{number.format(8 * i + 1)} AS h{i + 1}' for i in range(4))},
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w FROM documents),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
                  THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle,
             array_to_string(w[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def hard_negatives_sql() -> str:
    """All anchors against all rows."""
    return """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
