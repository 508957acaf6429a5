"""DuckDB SQL of the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

URLS = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
bare AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM cut),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), '{_UPPER}', '{_LOWER}') AS host,
         substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM bare),
rules (h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fit USING (page_id)
"""

# A turn is "<|turn|>role<|text|>text<|end|>": 8, 8 and 7 characters of marks.
_CONTROL = ["<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", "<|startoftext|>"]
_ESCAPED = "replace({}, '\\', '\\\\')"
for _mark in _CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_mark}', '{_mark[0]}\\{_mark[1:]}')"

CHAT = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(23 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM joined
"""

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), '" + _UPPER + "', '" + _LOWER + \
    "'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
windows AS (
  SELECT item_id, least(len(ws), 13) AS n, unnest(list_transform(range(greatest(len(ws) - 12, 1)),
         lambda i: array_to_string(ws[i + 1:i + 13], ' '))) AS w FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, unnest(range(len(ws) - n + 1)) AS i, unnest(list_transform(range(len(ws) - n + 1),
         lambda i: array_to_string(ws[i + 1:i + n], ' '))) AS w FROM d, sizes WHERE len(ws) >= n),
found AS (SELECT DISTINCT doc_id, item_id, p.n, i FROM places p JOIN windows USING (n, w)),
hits AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT u, w FROM links UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
least AS (SELECT u, min(w) AS w FROM reach GROUP BY u),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(w, vec_id)) AS component_id, vec_id <= coalesce(w, vec_id) AS kept
FROM embeddings LEFT JOIN least ON least.u = vec_id LEFT JOIN counts ON counts.u = vec_id
"""

_TERMS = "regexp_extract_all(translate(text, '" + _UPPER + "', '" + _LOWER + "'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SEARCH = f"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS w FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS w FROM benchmark),
counts AS (SELECT doc_id, w, count(*) AS tf FROM words WHERE w IN (SELECT w FROM asked) GROUP BY doc_id, w),
weights AS (
  SELECT w, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM counts, whole GROUP BY w),
norms AS (SELECT doc_id, 50 + (50 * n * docs) // total AS m FROM sizes, whole),
scores AS (
  SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN counts USING (w) JOIN weights USING (w) JOIN norms USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 50
"""


def sql() -> dict[str, str]:
    return {"op3_decontamination": DECONTAMINATION, "op5_url_rules": URLS, "op7_chat": CHAT, "op8_embeddings": EMBEDDINGS,
            "op13_lexical_search": SEARCH}
