"""DuckDB SQL for the queries that SQL can express."""

U, L = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folded(table: str, key: str) -> str:
    text = f"translate(coalesce(text, ''), '{U}', '{L}')"
    return f"SELECT {key}, list_filter(string_split_regex({text}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM {table}"


DECONTAMINATION = f"""
WITH dw AS ({_folded("documents", "doc_id")}), iw AS ({_folded("benchmark", "item_id")}),
win AS (SELECT DISTINCT item_id::VARCHAR AS item_id, array_to_string(w[i:i+9], ' ') AS g, least(len(w), 10) AS k
        FROM iw, range(1, greatest(len(w) - 9, 1) + 1) t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
dg AS (SELECT doc_id, i AS s, k, array_to_string(w[i:i+k-1], ' ') AS g FROM dw, ks, range(1, len(w) - k + 2) t(i)),
hits AS (SELECT DISTINCT doc_id, s, k, item_id FROM dg JOIN win USING (g, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{U}', '{L}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, unnest(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r AS (SELECT doc_id, doc_id AS m FROM t UNION SELECT sym.b, r.m FROM r JOIN sym ON sym.a = r.doc_id WHERE r.m < sym.b)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, t.doc_id = c.m AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY 1) c USING (doc_id)
"""

CHAT_FORMATTING = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE role WHEN 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE role WHEN 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(12 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\\\*\\|')) + 10 + 1)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def quality_rules() -> str:
    """The measures, the log-bucket sketches by (lang, source), lang and all, the bounds read off them, and the verdicts."""
    rates = {"word_len": "word_chars / n_words", "symbol_rate": "n_symbols / n_words", "dup_line_rate": "n_dup_lines / n_lines", "punct_rate": "n_punct / word_chars", "capital_rate": "n_capitals / word_chars", "echo_rate": "n_echoes / n_words"}
    punct = "[!-/:-@\\[-`{-~]"
    only = lambda p: f"len(regexp_extract_all(packed, '{p}'))"
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS m, {m} AS v FROM x WHERE NOT base_failed" for m in rates)
    quantile = lambda q: f"min(CASE WHEN upto >= ceil(size * {q}) THEN v END)"

    def level(name: str, by: str, some: str = "TRUE") -> str:
        keys = f"{by}, " if by else ""
        return f"""{name} AS (SELECT {keys}m, first(size) AS size, {quantile(0.25)} AS q1, {quantile(0.5)} AS q2, {quantile(0.75)} AS q3 FROM (
  SELECT {keys}m, CASE WHEN b = -1073741824 THEN 0.0 ELSE 2 * pow(1.01 / 0.99, b) / (1.01 / 0.99 + 1) END AS v, sum(n) OVER (PARTITION BY {keys}m ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {keys}m) AS size
  FROM (SELECT {keys}m, b, sum(n) AS n FROM s WHERE {some} GROUP BY ALL)) GROUP BY {keys}m)"""

    def leaning(name: str, fine: str, lang: str, top: str) -> str:
        mean = lambda x, c, above: f"((coalesce({x}.size * {x}.{c}, 0.0::DOUBLE) + 200.0::DOUBLE * {above}) / (coalesce({x}.size, 0) + 200.0::DOUBLE))"
        picked = ", ".join(f"{mean('f', c, mean('l', c, f'a.{c}'))} AS {c}" for c in ("q1", "q2", "q3"))
        return f"""{name} AS (SELECT g.lang, g.source, g.m, {picked} FROM (SELECT DISTINCT lang, source, m FROM s) g LEFT JOIN {fine} f ON g.m = f.m AND g.lang IS NOT DISTINCT FROM f.lang AND g.source IS NOT DISTINCT FROM f.source
  LEFT JOIN {lang} l ON g.m = l.m AND g.lang IS NOT DISTINCT FROM l.lang LEFT JOIN {top} a ON g.m = a.m)"""

    some = "b <> -1073741824"
    side = lambda q: " ".join(f"WHEN abs({x}.{q} - {x}.q2) > 1e-6 THEN {x}.q2 + 14.0::DOUBLE * ({x}.{q} - {x}.q2)" for x in ("e", "o"))
    out = " + ".join(f"coalesce((x.{m} > (SELECT hi FROM bounds b WHERE b.m = '{m}' AND b.lang IS NOT DISTINCT FROM x.lang AND b.source IS NOT DISTINCT FROM x.source))::INT, 0)" for m in rates)
    low = "coalesce((x.word_len < (SELECT lo FROM bounds b WHERE b.m = 'word_len' AND b.lang IS NOT DISTINCT FROM x.lang AND b.source IS NOT DISTINCT FROM x.source))::INT, 0)"
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+4], ' ')) AS c FROM d, range(1, len(w) - 3) t(i)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g WHERE c > 1) GROUP BY 1),
p AS (SELECT *, array_to_string(w, '') AS packed, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
c AS (SELECT p.doc_id, lang, source, len(w) AS n_words, length(packed) AS word_chars, {only("[#*$%&|<>]")} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines,
  {only(punct)} AS n_punct, {only("[A-Z]")} AS n_capitals, len(list_filter(list_zip(w[1:len(w)-1], w[2:len(w)]), lambda z: z[1] = z[2])) AS n_echoes FROM p LEFT JOIN r USING (doc_id)),
x AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {", ".join(f"CASE WHEN {e.split('/')[1].strip()} > 0 THEN {e.replace('/', '::DOUBLE /')} ELSE 0.0 END AS {m}" for m, e in rates.items())} FROM c),
s AS (SELECT lang, source, m, CASE WHEN v <= 1e-9 THEN -1073741824 ELSE ceil(ln(v) / ln(1.01 / 0.99))::INT END AS b, count(*) AS n FROM ({long}) GROUP BY ALL),
{level("fine", "lang, source")}, {level("bylang", "lang")}, {level("top", "")}, {level("some_fine", "lang, source", some)}, {level("some_bylang", "lang", some)}, {level("some_top", "", some)},
{leaning("whole", "fine", "bylang", "top")}, {leaning("partial", "some_fine", "some_bylang", "some_top")},
bounds AS (SELECT e.lang, e.source, e.m, CASE {side("q1")} END AS lo, CASE {side("q3")} END AS hi FROM whole e JOIN partial o ON e.m = o.m AND e.lang IS NOT DISTINCT FROM o.lang AND e.source IS NOT DISTINCT FROM o.source),
v AS (SELECT *, {out} + {low} AS n_outlying FROM x)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, n_lines::BIGINT AS n_lines,
  n_punct::BIGINT AS n_punct, n_capitals::BIGINT AS n_capitals, n_echoes::BIGINT AS n_echoes, base_failed, n_outlying::BIGINT AS n_outlying, NOT base_failed AND n_outlying = 0 AS kept FROM v
"""


QUALITY_RULES = quality_rules()


#: Terms by RE2, counts and whole-number scores; every document against every item.
RANKED_SEARCH = rf"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{U}', '{L}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), asked AS (
  SELECT item_id, term, count(*) AS qtf
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{U}', '{L}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths),
held AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), corpus),
sizes AS (SELECT doc_id, 75 + (25 * n * docs) // words AS m FROM lengths, corpus),
scores AS (
  SELECT item_id, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""


def url_filter(rules: tuple[tuple[str, str, str], ...], link: str, unit: int, damping: int, rounds: int, block_percent: int) -> str:
    """Rules, host edges and the rounds of both masses, one table a round."""
    lower = f"'{U}', '{L}'"
    quoted = link.replace("'", "''")
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    loop = ",\n".join(
        f"""m{i + 1} AS MATERIALIZED (
  SELECT kind, host, CAST(sum(mass) AS BIGINT) AS mass FROM (
    SELECT e.kind, e.dst AS host, (m.mass // 100 * {damping}) // e.leaving * e.weight AS mass FROM m{i} m JOIN shares e ON e.kind = m.kind AND e.src = m.host
    UNION ALL SELECT kind, host, mass // 100 * {100 - damping} FROM m0
  ) GROUP BY kind, host HAVING sum(mass) > 0)"""
        for i in range(rounds)
    )
    return rf"""
WITH urls AS MATERIALIZED (
  SELECT row_number() OVER () AS row, page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {lower}), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), rules (rule_host, rule_path, rule_verdict) AS (VALUES {listed}),
fits AS (
  SELECT row, rule_host || rule_path AS rule, rule_verdict AS verdict FROM urls
  JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND prefix(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(rule_host || rule_path) DESC, rule_verdict = 'block' DESC, rule_host || rule_path) = 1
), judged AS MATERIALIZED (SELECT row, page_id, host, path, rule, verdict FROM urls LEFT JOIN fits USING (row)),
links AS (
  SELECT src, dst, count(*) AS weight
  FROM (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{quoted}', 1), lambda h: translate(h, {lower})))) AS dst FROM urls)
  WHERE src <> '' AND src <> dst GROUP BY src, dst
), names AS (SELECT host FROM urls WHERE host <> '' UNION SELECT src FROM links UNION SELECT dst FROM links WHERE dst <> ''),
labels AS (SELECT string_split(host, '.') AS parts FROM names),
ups AS (SELECT DISTINCT array_to_string(parts[i:], '.') AS low, array_to_string(parts[i + 1:], '.') AS up FROM (SELECT parts, unnest(range(1, len(parts))) AS i FROM labels)),
edges AS (
  SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM (
    SELECT * FROM links UNION ALL SELECT low, up, 1 FROM ups WHERE contains(up, '.') UNION ALL SELECT up, low, 1 FROM ups WHERE contains(up, '.')
  ) GROUP BY src, dst
), shares AS MATERIALIZED (
  SELECT kind, src, dst, weight, CAST(sum(weight) OVER (PARTITION BY kind, src) AS BIGINT) AS leaving
  FROM (SELECT 'trust' AS kind, src, dst, weight FROM edges UNION ALL SELECT 'distrust', dst, src, weight FROM edges)
), counts AS (
  SELECT CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM judged WHERE verdict IS NOT NULL AND host <> '' GROUP BY ALL
), m0 AS MATERIALIZED (SELECT kind, host, CAST({unit} // CAST(sum(n) OVER (PARTITION BY kind) AS BIGINT) * n AS BIGINT) AS mass FROM counts),
{loop},
reached AS (
  SELECT host, CAST(coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS BIGINT) AS trust, CAST(coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS BIGINT) AS distrust FROM m{rounds} GROUP BY host
)
SELECT page_id, host, path, rule, verdict IS NOT NULL AS by_rule, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust,
  coalesce(verdict, CASE WHEN distrust > 0 AND distrust // 100 * {100 - block_percent} >= trust // 100 * {block_percent} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN reached USING (host)
"""
