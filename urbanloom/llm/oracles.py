"""The same rows in DuckDB's SQL, for the operators that SQL can express."""

from __future__ import annotations

from urbanloom.llm import quality_rules, secret_scan, url_filter

#: Words of a text; the pattern is written out so that both engines agree on white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '{WORD}')"


def mix_sql(weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len({words("coalesce(text, '')")}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CAST(list_extract([{", ".join(map(str, weights))}], CAST(r % {len(weights)} AS INTEGER) + 1) AS DOUBLE) AS weight, {epochs}.0::DOUBLE * source_size AS most FROM s),
o AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT *, least(most, weight * (SELECT max(level) FROM o WHERE level * weight <= most)) AS target FROM o),
p AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place, CAST(floor(target) AS BIGINT) AS budget
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(size, greatest(0, budget - (budget // source_size) * source_size - place)) END AS BIGINT) AS taken FROM p"""


def quality_sql(policy: str = quality_rules.CURRENT_POLICY) -> str:
    bits = " + ".join(f"CASE WHEN {rule.fails} THEN {1 << rule.bit} ELSE 0 END" for rule in quality_rules.RULES)
    n = quality_rules.WINDOW
    return f"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT *, {words("text")} AS words FROM t),
g AS (SELECT row_id, unnest(range(1, len(words) - {n - 2})) AS pos, words FROM w WHERE len(words) >= {n}),
h AS (SELECT row_id, pos, count(*) OVER (PARTITION BY row_id, list_slice(words, pos, pos + {n - 1})) AS times FROM g),
c AS (SELECT row_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT row_id, unnest(range(pos, pos + {n})) AS p FROM h WHERE times > 1) GROUP BY row_id),
l AS (SELECT row_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY row_id),
u AS (SELECT row_id, count(*) FILTER (regexp_full_match(word, '[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*')) AS n_upper_words, count(*) FILTER (word = before) AS n_same_as_previous
  FROM (SELECT row_id, word, lag(word) OVER (PARTITION BY row_id ORDER BY k) AS before FROM (SELECT row_id, unnest(words) AS word, unnest(range(0, len(words))) AS k FROM w)) GROUP BY row_id),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_upper_words, 0) AS n_upper_words, coalesce(n_same_as_previous, 0) AS n_same_as_previous
  FROM w LEFT JOIN c USING (row_id) LEFT JOIN l USING (row_id) LEFT JOIN u USING (row_id)),
b AS (SELECT *, CAST({bits} AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & {quality_rules.BASE_MASK}) <> 0 AS base_failed, (failed_bits & {quality_rules.BASE_MASK | quality_rules.POLICIES[policy]}) = 0 AS kept, failed_bits FROM b"""


def secret_sql(max_owners: int = 2, max_docs: int = 8) -> str:
    quote = lambda pattern: pattern.replace("'", "''")
    kinds = " UNION ALL ".join(
        f"SELECT row_id, doc_id, source, '{kind}' AS kind, {rank} AS rank, string_split_regex(text, '{quote(pattern)}') AS pieces, regexp_extract_all(text, '{quote(pattern)}') AS found, "
        + (f"regexp_extract_all(text, '{quote(pattern)}', 2)" if kind == "assign" else f"regexp_extract_all(text, '{quote(pattern)}')")
        + f" AS held FROM t WHERE regexp_matches(text, '{quote(pattern)}')"
        for rank, (kind, pattern) in enumerate(secret_scan.KINDS)
    )
    base = ", ".join(f"'{k}'" for k in secret_scan.BASE_KINDS)
    listed = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank)"
    return f"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS text FROM documents), k AS ({kinds}),
e AS (SELECT row_id, doc_id, source, kind, rank, unnest(range(1, len(found) + 1)) AS i, pieces, found, held FROM k),
s AS (SELECT row_id, doc_id, source, kind, rank, list_extract(found, i) AS value, list_extract(held, i) AS secret,
  length(list_aggregate(list_slice(pieces, 1, i), 'string_agg', '')) + coalesce(length(list_aggregate(list_slice(found, 1, i - 1), 'string_agg', '')), 0) AS a FROM e),
f AS (SELECT *, a + length(value) AS b FROM s WHERE kind <> 'assign' OR length(secret) >= 6),
o AS (SELECT secret, count(DISTINCT coalesce(source, '') || (source IS NULL)) AS owners, count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INT)) AS docs FROM f GROUP BY secret),
j AS (SELECT f.*, owners = 1 OR (owners <= {max_owners} AND docs <= {max_docs}) AS live, kind IN ({base}) AS base FROM f JOIN o USING (secret)),
r AS (SELECT row_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce({listed} FILTER (base), '') AS base_list, coalesce({listed} FILTER (base OR live), '') AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM j GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_list, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM t LEFT JOIN r USING (row_id)"""


def collocation_sql(least: int = 100, longest: int = 5, top: int = 2000) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p),
t AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: list_slice(words, i, i + size - 1))) AS phrase FROM w, (SELECT unnest(range(1, {longest + 1})) AS size) WHERE len(words) >= size),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {least}),
x AS (SELECT DISTINCT lang, unnest([list_slice(phrase, 1, size - 1), list_slice(phrase, 2, size)]) AS phrase, f FROM f WHERE size > 2),
c AS (SELECT * FROM f WHERE size > 1 AND NOT EXISTS (SELECT 1 FROM x WHERE x.lang = f.lang AND x.phrase = f.phrase AND x.f >= f.f)),
k AS (SELECT lang, size, phrase, f AS a, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.*, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM k JOIN t USING (lang)
  JOIN f AS l ON l.lang = k.lang AND l.phrase = list_slice(k.phrase, 1, k.k) JOIN f AS r ON r.lang = k.lang AND r.phrase = list_slice(k.phrase, k.k + 1, k.size)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank, array_to_string(phrase, ' ') AS phrase, a, l, r, n, score FROM b)
SELECT * FROM o WHERE rank <= {top}"""


def url_sql() -> str:
    """Rules, templates, tree and purity as in url_verdicts() with its production parameters."""
    ordered = sorted(url_filter.CONTRACT_RULES, key=lambda r: (-len(r[1]), r[1]))
    fits = lambda rule: (lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')")(*url_filter.split_rule(rule))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ordered) + " END"
    said = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in ordered) + " END"
    body = "regexp_replace(s, '\\.[A-Za-z]{1,5}$', '')"
    shape = (
        f"(CASE WHEN regexp_full_match({body}, '[0-9]+') THEN '{{n}}' WHEN regexp_full_match({body}, '[0-9A-Fa-f]{{8,}}(-[0-9A-Fa-f]+)*') THEN '{{h}}' WHEN regexp_matches({body}, '[0-9]') "
        f"THEN regexp_replace({body}, '[0-9]+', '{{n}}', 'g') ELSE {body} END) || regexp_extract(s, '(\\.[A-Za-z]{{1,5}})$', 1)"
    )
    depth = url_filter.DEPTH
    levels = []
    for d in range(1, depth + 1):
        segment = f"list_extract(segments, {d})"
        levels.append(f"""f{d} AS (SELECT host, p{d - 1}, count(DISTINCT {segment}) AS fan FROM t{d - 1} GROUP BY ALL),
t{d} AS (SELECT t{d - 1}.*, coalesce(p{d - 1} || '/' || CASE WHEN fan > 32 AND NOT contains({segment}, '{{') THEN '{{s}}' ELSE {segment} END, p{d - 1}) AS p{d} FROM t{d - 1} JOIN f{d} USING (host, p{d - 1}))""")
    for d in range(1, depth + 1):
        above, here, before = f"p{d - 1}", f"p{d}", "h0" if d == 1 else f"h{d - 1}"
        levels.append(f"""k{d} AS (SELECT *, sum(n) OVER (PARTITION BY host, {above}, {here}) AS kn, sum(b) OVER (PARTITION BY host, {above}, {here}) AS kb, ub / greatest(un, 1) AS pooled FROM {before}),
z{d} AS (SELECT *, CASE WHEN pooled * (1 - pooled) > 0 THEN (kb / greatest(kn, 1) - pooled) / sqrt(pooled * (1 - pooled) / greatest(kn, 1)) ELSE 0 END AS z FROM k{d}),
s{d} AS (SELECT *, CASE WHEN kn = 0 THEN 'unlabelled ' || {here} WHEN abs(z) <= 1.96 THEN 'similar' WHEN z > 0 THEN 'above' ELSE 'below' END AS side FROM z{d}),
b{d} AS (SELECT *, sum(n) OVER (PARTITION BY host, {above}, side) AS bn, sum(b) OVER (PARTITION BY host, {above}, side) AS bb FROM s{d}),
h{d} AS (SELECT * EXCLUDE (purity, support, un, ub, kn, kb, pooled, z, side, bn, bb), kn AS un, kb AS ub, CASE WHEN bn > 0 AND {here} <> {above} THEN (bb + 2 * purity) / (bn + 2) ELSE purity END AS purity,
  CASE WHEN bn > 0 AND {here} <> {above} THEN bn ELSE support END AS support FROM b{d})""")
    return f"""
WITH u AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, {rule} AS rule, string_split(path, '/') AS parts FROM u),
v AS (SELECT *, {said} AS said, CASE WHEN len(parts) - 1 > {depth} THEN list_append(list_transform(list_slice(parts, 2, {depth}), lambda s: {shape}), '{{*}}') ELSE list_transform(list_slice(parts, 2, {depth + 1}), lambda s: {shape}) END AS segments FROM r),
w AS (SELECT *, CASE WHEN len(segments) > 0 THEN '/' || array_to_string(segments, '/') ELSE '' END AS template FROM v),
t0 AS (SELECT host, template, any_value(segments) AS segments, count(said) AS n, count(*) FILTER (said = 'block') AS b, '' AS p0 FROM w GROUP BY host, template),
{", ".join(levels[:depth])},
c AS (SELECT coalesce(sum(b) / greatest(sum(n), 1), 0) AS cs FROM t0),
h0 AS (SELECT *, (ub + 2 * cs) / (un + 2) AS purity, un AS support FROM (SELECT t{depth}.*, sum(n) OVER (PARTITION BY host) AS un, sum(b) OVER (PARTITION BY host) AS ub FROM t{depth}), c),
{", ".join(levels[depth:])},
j AS (SELECT host, template, support >= 5 AND purity >= 0.9 AS rejected FROM h{depth})
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, template, rejected AS template_rejected FROM w JOIN j USING (host, template)"""


ORACLES = {"op1_url_filter": url_sql(), "op3_source_mix": mix_sql(), "op4_quality_rules": quality_sql(), "op8_secret_scan": secret_sql(), "op12_collocations": collocation_sql()}
