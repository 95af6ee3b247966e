"""DuckDB SQL for the operators' queries."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c
  FROM (SELECT rid, i, list_slice(w, i, i + 4) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5))
),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM win WHERE c > 1) GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid
),
f AS (
  SELECT d.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS n_lower
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR n_upper > n_lower) AS kept
FROM f
"""

ORACLES = {"op7_quality_rules": _OP7}

_OP4 = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.own <> c.own)
SELECT query_id, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) <= 20
"""

_OP8 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT rid, list_slice(w, i, i + 4) AS g FROM (SELECT rid, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, x.b FROM reach r JOIN both_ x ON x.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, coalesce(k.links, 0) AS n_links FROM d LEFT JOIN n USING (rid)
LEFT JOIN (SELECT a AS rid, count(*) AS links FROM both_ GROUP BY a) k USING (rid) JOIN (SELECT r.a AS rid, min(e.doc_id) AS component_id FROM reach r JOIN d e ON e.rid = r.b GROUP BY r.a) m USING (rid)
"""


def _op1() -> str:
    """Raking under the bound of 1, round by round as CTEs, over cells of source, language and topic."""
    from .mixing import LANGS, ROUNDS, Target

    t = Target()
    langs = ", ".join(f"'{x}'" for x in LANGS)
    out = f"""WITH r AS MATERIALIZED (SELECT doc_id, coalesce(source, '(none)') AS source, CASE WHEN lang IN ({langs}) THEN lang ELSE 'other' END AS lang, len({WORDS})::DOUBLE AS tokens, coalesce(text, '') AS text FROM documents),
f AS MATERIALIZED (SELECT *, CASE WHEN contains(text, '@') OR contains(text, '://') THEN 'contact' WHEN contains(text, 'License') THEN 'licence' WHEN tokens < 100 THEN 'short' ELSE 'prose' END AS topic FROM r),
c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS m FROM f GROUP BY ALL HAVING sum(tokens) > 0), tot AS (SELECT {t.share} * sum(m) AS asked FROM c)"""
    # A class's target is its power's share, or all it has; what it lacks goes to the others. As many rounds as classes may fill up.
    for name, col, power in (("s", "source", t.source_flatten), ("l", "lang", t.lang_flatten), ("t", "topic", t.topic_flatten)):
        out += f",\n{name}0 AS MATERIALIZED (SELECT {col}, sum(m) AS own, pow(sum(m), {power}) AS p, false AS whole FROM c GROUP BY {col})"
        for i in range(1, 9):
            out += f",\n{name}{i} AS MATERIALIZED (SELECT {col}, own, p, whole OR p * (asked - sum(CASE WHEN whole THEN own ELSE 0 END) OVER ()) / sum(CASE WHEN whole THEN 0 ELSE p END) OVER () > own AS whole FROM {name}{i - 1}, tot)"
        out += f",\n{name}w AS MATERIALIZED (SELECT {col}, own, CASE WHEN whole THEN own ELSE p * (asked - sum(CASE WHEN whole THEN own ELSE 0 END) OVER ()) / sum(CASE WHEN whole THEN 0 ELSE p END) OVER () END AS want FROM {name}8, tot)"
    out += ",\nb0 AS (SELECT lang, 1.0::DOUBLE AS b FROM lw), c0 AS (SELECT topic, 1.0::DOUBLE AS c FROM tw)"

    def factors(i: int) -> str:
        return f"""
q{i} AS MATERIALIZED (SELECT source, lang, topic, m, b, c, own, want, b * c AS q FROM c JOIN sw USING (source) JOIN b{i} USING (lang) JOIN c{i} USING (topic)),
a{i} AS MATERIALIZED (SELECT source, greatest(0, max(CASE WHEN slope > 0 THEN (want - own + free) / slope ELSE 0 END)) AS a FROM (SELECT source, own, want, sum(m) OVER w AS free, sum(m * q) OVER w AS slope FROM q{i} WINDOW w AS (PARTITION BY source ORDER BY q ROWS UNBOUNDED PRECEDING)) GROUP BY source)"""

    def moved(x: str) -> str:
        whole, free, at_bound = "sum(CASE WHEN over THEN m ELSE 0 END)", "sum(CASE WHEN over THEN 0 ELSE am END)", f"any_value({x})"
        return f"CASE WHEN {free} = 0 AND {whole} <= any_value(want) THEN {at_bound} WHEN {free} > 0 AND any_value(want) > {whole} THEN (any_value(want) - {whole}) / {free} ELSE {at_bound} / 2 END"

    for i in range(1, ROUNDS):
        out += f""",{factors(i - 1)},
x{i} AS MATERIALIZED (SELECT lang, topic, m, b, c, a * m AS am, a * q >= 1 AS over FROM q{i - 1} JOIN a{i - 1} USING (source)),
b{i} AS MATERIALIZED (SELECT lang, {moved('b')} AS b FROM (SELECT lang, m, b, am * c AS am, over FROM x{i}) JOIN lw USING (lang) GROUP BY lang),
c{i} AS MATERIALIZED (SELECT topic, {moved('c')} AS c FROM (SELECT topic, m, c, am * b{i}.b AS am, over FROM x{i} JOIN b{i} USING (lang)) JOIN tw USING (topic) GROUP BY topic)"""
    n = ROUNDS - 1
    draw = "('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || text), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"
    weight = "coalesce(a.a * z.b * z.c, 1)"
    return out + f""",{factors(n)}
SELECT doc_id, f.source, f.lang, f.topic, tokens, round({weight}, 6) AS weight, round(least(1, {weight}), 6) AS prob, round({draw}, 6) AS draw, {draw} < least(1, {weight}) AS sampled
FROM f LEFT JOIN a{n} a USING (source) LEFT JOIN (SELECT lang, topic, b, c FROM b{n}, c{n}) z USING (lang, topic)"""


ORACLES |= {"op1_mixing": _op1(), "op4_exact_topk": _OP4, "op8_ngram_jaccard_join": _OP8}

# The given conversations hold plain turns only, so turns that are JSON calls have no part here.
_OP6 = r"""
WITH RECURSIVE said AS (SELECT conv_id, turn, 'call_' || turn AS call_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations WHERE role = 'assistant'),
calls AS (SELECT *, CASE WHEN n % 5 = 0 THEN 'unknown' WHEN n % 2 = 0 THEN 'search' ELSE 'summarise' END AS name, CASE WHEN turn >= 3 THEN '"after":"call_' || (turn - 2) || '",' ELSE '' END AS after FROM said),
answers AS (SELECT conv_id, 'call_' || (turn - 1) AS call_id, min({'t': turn, 'c': coalesce(text, '')}) AS a, count(*) AS n_results FROM conversations WHERE role IN ('user', 'tool') GROUP BY ALL),
refs AS (SELECT DISTINCT c.conv_id, c.turn, p.turn AS up FROM calls c JOIN calls p ON p.conv_id = c.conv_id AND (p.turn = c.turn - 2 AND c.turn > 2 OR p.turn = c.turn - 4 AND c.turn > 4)),
paths AS (SELECT DISTINCT conv_id, turn, 0 AS steps FROM calls c WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.conv_id = c.conv_id AND r.turn = c.turn)
  UNION SELECT r.conv_id, r.turn, steps + 1 FROM paths p JOIN refs r ON r.conv_id = p.conv_id AND r.up = p.turn),
level AS (SELECT conv_id, turn, max(steps) AS level FROM paths GROUP BY ALL),
x AS (SELECT calls.*, level.level, a, n_results, count(*) OVER (PARTITION BY calls.conv_id, calls.call_id) > 1 AS id_repeated,
  CASE WHEN name = 'unknown' THEN 'unknown tool' WHEN name = 'search' AND n < 60 THEN 'limit: missing' ELSE '' END AS errors,
  CASE WHEN name = 'summarise' THEN '{' || after || '"text":' || to_json(text) || ',"words":' || len(regexp_extract_all(text, '\S+')) || '}' ELSE '{' || after || CASE WHEN n >= 60 THEN '"limit":' || (n % 50) || ',' ELSE '' END || '"query":' || to_json(text) || '}' END AS arguments
  FROM calls JOIN level USING (conv_id, turn) LEFT JOIN answers USING (conv_id, call_id))
SELECT conv_id, turn, call_id, name, level, CASE WHEN n_results IS NULL THEN 'no_result' ELSE 'linked' END AS status, errors = '' AS valid, errors, coalesce(n_results, 0) AS n_results, id_repeated,
  '{"arguments":' || arguments || ',"id":"' || call_id || '","name":"' || name || '","result":' || CASE WHEN n_results IS NULL THEN '{}' ELSE '{"content":' || to_json(a.c) || ',"turn":' || a.t || '}' END || '}' AS line FROM x
UNION ALL SELECT conv_id, a.t, call_id, NULL, NULL, 'orphan', false, 'no call', n_results, false, '{"id":"' || call_id || '","result":{"content":' || to_json(a.c) || ',"turn":' || a.t || '}}'
FROM answers WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = answers.conv_id AND c.call_id = answers.call_id)
UNION ALL SELECT conv_id, turn, NULL, NULL, NULL, 'context', true, '', 0, false, '{"content":' || to_json(coalesce(text, '')) || CASE WHEN role IS NULL THEN '' ELSE ',"role":' || to_json(role) END || '}'
FROM conversations WHERE role IS NULL OR role NOT IN ('assistant', 'user', 'tool')
"""

ORACLES |= {"op6_chat_formatting": _OP6}
