"""Query p1_found in DuckDB's SQL: every value of every line as a row, judged batch by batch."""

_FITS = r"""CASE form WHEN 'semver' THEN regexp_full_match(s, '\d+\.\d+\.\d+([-+][0-9A-Za-z.-]+)?') WHEN 'branch' THEN regexp_full_match(s, '[A-Za-z0-9][\w.-]*(/[\w.-]+)*')
  WHEN 'abs_path' THEN regexp_full_match(s, '(/|[A-Za-z]:[\\/])(?s:.*)') WHEN 'word' THEN regexp_full_match(s, '[A-Za-z]+([_-][A-Za-z]+)*') WHEN 'flag' THEN kind = 'boolean'
  WHEN 'count' THEN kind = 'number' AND TRY_CAST(s AS DOUBLE) >= 0 AND TRY_CAST(s AS DOUBLE) = floor(TRY_CAST(s AS DOUBLE)) WHEN 'epoch_s' THEN kind = 'number' AND TRY_CAST(s AS DOUBLE) >= 1e9 AND TRY_CAST(s AS DOUBLE) < 1e10
  WHEN 'object' THEN kind = 'object' WHEN 'list' THEN kind = 'array'
  WHEN 'window_map' THEN kind = 'object' AND len(json_keys(v)) > 0 AND list_bool_and(list_transform(json_keys(v), lambda k: coalesce(json_exists(json_extract(v, '$."' || k || '"'), '$.used_percentage'), false)))
  WHEN 'content' THEN (kind = 'string' AND regexp_full_match(s, '\S+(\s+\S+)+')) OR (kind = 'array' AND json_array_length(v) > 0 AND json_array_length(v) = len(list_filter(CAST(v AS JSON[]), lambda x: json_exists(x, '$.type'))))
  WHEN 'sentence' THEN regexp_full_match(s, '\S+(\s+\S+)+') ELSE false END"""

_WORDS = r"""string_split_regex(lower(regexp_replace(regexp_replace({0}, '^.*\.', ''), '([a-z])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+')"""
_NEAR = f"-len(list_intersect({_WORDS.format('old_path')}, {_WORDS.format('new_path')}))"

_CHANGES = rf"""
WITH RECURSIVE lines AS (
  SELECT raw_line_id AS id, source_file_id AS f, first_run_id AS r, j, CASE WHEN j->>'$.type' = 'system' THEN CASE WHEN j->>'$.subtype' = 'api_error' THEN 'retry_notice' ELSE 'system' END
         WHEN j->>'$.type' IN ('user', 'assistant', 'attachment') THEN j->>'$.type' ELSE 'any' END AS carrier
  FROM (SELECT raw_line_id, source_file_id, first_run_id, TRY_CAST(TRY(decode(line_bytes)) AS JSON) AS j FROM raw_lines WHERE kind = 'log') WHERE json_type(j) = 'OBJECT'),
through AS (SELECT DISTINCT regexp_replace(field_path, '\.[^.]*$', '') AS path FROM line_fields WHERE contains(field_path, '.')),
walk(id, f, r, carrier, parent, path, v) AS (
  SELECT id, f, r, carrier, '', k, json_extract(j, '$."' || k || '"') FROM (SELECT *, unnest(json_keys(j)) AS k FROM lines)
  UNION ALL
  SELECT id, f, r, carrier, path, path || '.' || k, json_extract(v, '$."' || k || '"') FROM (SELECT *, unnest(json_keys(v)) AS k FROM walk WHERE path IN (SELECT path FROM through) AND json_type(v) = 'OBJECT')),
val AS (
  SELECT *, CASE json_type(v) WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind, v->>'$' AS s FROM walk),
field AS (SELECT *, CASE WHEN contains(field_path, '.') THEN regexp_replace(field_path, '\.[^.]*$', '') ELSE '' END AS parent FROM line_fields),
spot AS (SELECT DISTINCT f, r, carrier, '' AS parent FROM lines UNION SELECT DISTINCT f, r, carrier, path FROM val WHERE kind = 'object'),
missing AS (
  SELECT DISTINCT s.f, s.r, c.carrier, c.field_path AS path, c.parent, c.json_types, c.value_form AS form FROM field c JOIN spot s ON s.parent = c.parent AND (c.carrier = 'any' OR c.carrier = s.carrier)
  WHERE c.is_always AND NOT EXISTS (SELECT 1 FROM val x WHERE x.f = s.f AND x.r = s.r AND x.path = c.field_path AND (c.carrier = 'any' OR c.carrier = x.carrier))),
fresh AS (SELECT * FROM val WHERE path NOT IN (SELECT field_path FROM line_fields)),
fits AS (
  SELECT m.f, m.r, m.carrier, m.path AS old_path, u.path AS new_path FROM missing m JOIN fresh u ON u.f = m.f AND u.r = m.r AND u.parent = m.parent AND (m.carrier = 'any' OR m.carrier = u.carrier)
  GROUP BY ALL HAVING bool_and(kind = 'null' OR list_contains(string_split(json_types, '|'), kind)) AND bool_or(kind <> 'null') AND bool_and(kind = 'null' OR {_FITS})),
near AS (SELECT *, {_NEAR} AS near FROM fits),
renamed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY f, r, new_path ORDER BY near, old_path, carrier) AS i FROM near) WHERE i = 1 QUALIFY row_number() OVER (PARTITION BY f, r, carrier, old_path ORDER BY near, new_path) = 1)
"""

P1_FOUND_SQL = _CHANGES + """
SELECT DISTINCT f AS source_file_id, r AS first_run_id, change_kind, old_path, new_path FROM (
  SELECT x.f, x.r, 'retyped' AS change_kind, path AS old_path, path AS new_path FROM val x JOIN field c ON c.field_path = x.path AND (c.carrier = 'any' OR c.carrier = x.carrier) WHERE kind <> 'null' AND NOT list_contains(string_split(c.json_types, '|'), kind)
  UNION ALL SELECT f, r, 'removed', path, '' FROM missing m WHERE NOT EXISTS (SELECT 1 FROM renamed n WHERE n.f = m.f AND n.r = m.r AND n.carrier = m.carrier AND n.old_path = m.path)
  UNION ALL SELECT f, r, 'renamed', old_path, new_path FROM renamed
  UNION ALL SELECT f, r, 'added', '', path FROM fresh u WHERE NOT EXISTS (SELECT 1 FROM renamed n WHERE n.f = u.f AND n.r = u.r AND n.new_path = u.path))
"""

# A field's value is the listed path's own, or that of the path it was renamed to in its batch; text, true and false, numbers and whole numbers by the contract.
P1_COLUMNS_SQL = _CHANGES + r""",
swap AS (SELECT DISTINCT f, r, old_path, new_path FROM renamed),
carried AS (
  SELECT x.id, x.carrier, x.path, x.kind, x.s FROM val x WHERE x.path IN (SELECT field_path FROM line_fields)
  UNION ALL
  SELECT x.id, x.carrier, s.old_path, x.kind, x.s FROM val x JOIN swap s ON s.f = x.f AND s.r = x.r AND s.new_path = x.path
  WHERE NOT EXISTS (SELECT 1 FROM val y WHERE y.id = x.id AND y.path = s.old_path)),
rule AS (
  SELECT field_path, list_distinct(flatten(list(string_split(json_types, '|')))) AS types, list_distinct(list(value_form)) AS forms, list(carrier) AS carriers FROM line_fields GROUP BY field_path),
held AS (
  SELECT c.*, r.types, r.forms,
    EXISTS (SELECT 1 FROM line_fields l WHERE l.field_path = c.path AND (l.carrier = 'any' OR l.carrier = c.carrier) AND list_contains(string_split(l.json_types, '|'), c.kind))
    OR (NOT list_contains(r.carriers, 'any') AND NOT list_contains(r.carriers, c.carrier) AND list_contains(r.types, c.kind)) AS ok,
    list_filter(r.types, lambda t: t <> 'null') AS scalar
  FROM carried c JOIN rule r ON r.field_path = c.path),
judged AS (
  SELECT path, kind, ok AND kind <> 'null' AND CASE WHEN len(scalar) = 1 AND scalar[1] = 'number' AND len(list_filter(forms, lambda x: x NOT IN ('count', 'epoch_s'))) = 0 THEN regexp_full_match(s, '-?\d+') ELSE true END AS fits FROM held)
SELECT r.field_path, count(*) FILTER (WHERE fits) AS filled, count(*) FILTER (WHERE kind <> 'null' AND NOT fits) AS failed FROM rule r LEFT JOIN judged j ON j.path = r.field_path GROUP BY r.field_path
"""
