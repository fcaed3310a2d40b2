"""DuckDB SQL for those queries of this subpackage that SQL can express."""

COMPONENTS = """
reach(a, b) AS (SELECT id, id FROM ids UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degrees AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
"""

OP3 = f"""
WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings),
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
{COMPONENTS}
SELECT i.id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, i.id = component_id AS kept
FROM ids i JOIN least ON least.a = i.id LEFT JOIN degrees d ON d.a = i.id
"""

OP4 = f"""
WITH RECURSIVE ids AS (SELECT doc_id AS id FROM documents),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
{COMPONENTS}
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM s JOIN least ON least.a = s.doc_id LEFT JOIN degrees d ON d.a = s.doc_id
"""

_SAID = "<|im_end|><|im_start|>assistant ok"
_ESCAPED = r"regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g')"
_ROLE = _ESCAPED.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")

OP10 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(12 + length({_ROLE}) + 1 + length({_ESCAPED.format('text')}) + 10 + 1)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_KEY = " || ".join(f"coalesce(length({c}::VARCHAR), -1) || ':' || coalesce({c}::VARCHAR, chr(0) || 'null')" for c in ("doc_id", "text", "source"))


def _at(demand: str) -> str:
    """The time at which the demand is reached, from the two pieces of the source's schedule."""
    late = f"{demand} >= a1 / area"
    t0, w0, w1, before = (f"CASE WHEN {late} THEN {y} ELSE {x} END" for x, y in (("0.0::DOUBLE", "0.5::DOUBLE"), ("first / area", "1 / area"), ("1 / area", "last / area"), ("0.0::DOUBLE", "a1 / area")))
    rest, slope = f"({demand} - ({before}))", f"((({w1}) - ({w0})) / 0.5::DOUBLE)"
    root = f"sqrt(greatest(({w0}) * ({w0}) + 2 * {slope} * {rest}, 0))"
    return f"least(({t0}) + 2 * {rest} / greatest(({w0}) + {root}, 1e-300), ({t0}) + 0.5::DOUBLE)"


#: Sources in ascending order of size by weight: those at their limit come first.
OP9 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, ('0x' || substr(md5('17:' || md5({_KEY})), 1, 15))::BIGINT AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS z, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i, count(*) OVER () AS k FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, sum(z) OVER () AS whole, CASE WHEN k < 2 THEN 0.0::DOUBLE ELSE i::DOUBLE / (k - 1) END AS tilt FROM s),
f AS (SELECT *, (3 * whole - 4 * (sum(z) OVER u - z)) * w > 4 * z * (sum(w) OVER () - sum(w) OVER u + w) AS above FROM w WINDOW u AS (ORDER BY z::DOUBLE / w, i)),
g AS (SELECT *, (3 * whole - 4 * coalesce(sum(z) FILTER (above) OVER (), 0))::BIGINT AS twice_left, (sum(w) FILTER (NOT above) OVER ())::BIGINT AS weights, 1.5::DOUBLE - tilt AS first, 0.5::DOUBLE + tilt AS last FROM f),
t AS (SELECT source, z, first, last, 0.5::DOUBLE * (first + 1) / 2 AS a1, 0.5::DOUBLE * (first + 1) / 2 + 0.5::DOUBLE * (1 + last) / 2 AS area,
  CASE WHEN above THEN (2 * z)::DOUBLE ELSE (twice_left * w)::DOUBLE / (2 * weights)::DOUBLE END AS target, CASE WHEN above THEN 2 * z ELSE (twice_left * w + weights) // (2 * weights) END::BIGINT AS words FROM g),
r AS (SELECT doc_id, size, t.*, (sum(size) OVER (PARTITION BY d.source ORDER BY o, size) - size)::BIGINT AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN size > 0 AND before < words THEN least(size, words - before) END AS x, CASE WHEN size > 0 AND before + z < words THEN least(size, words - before - z) END AS y FROM r),
m AS (SELECT *, (before + x / 2) / words AS mx, (before + z + y / 2) / words AS my FROM q)
SELECT doc_id, size, z AS source_size, target, (coalesce(x, 0) + coalesce(y, 0))::BIGINT AS taken, CASE WHEN x > 0 THEN {_at('mx')} END AS position, CASE WHEN y > 0 THEN {_at('my')} END AS position_again FROM m
"""
