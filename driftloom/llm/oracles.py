"""DuckDB SQL for those queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
hot AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id <> h.keeper AS gone
  FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

ORACLES["op3_source_mixing"] = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth
  FROM sizes GROUP BY source),
weighed AS (SELECT *, CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
levels AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(source_size) OVER before, 0) AS gone, coalesce(sum(weight) OVER before, 0) AS gone_weight
  FROM weighed
  WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
full_ AS (
  SELECT *, CAST(total - 3 * gone AS DOUBLE) / CAST(all_weight - gone_weight AS DOUBLE) * weight > CAST(3 * source_size AS DOUBLE) AS is_full
  FROM levels),
held AS (
  SELECT *, coalesce(sum(source_size) FILTER (is_full) OVER (), 0) AS held,
         coalesce(sum(weight) FILTER (is_full) OVER (), 0) AS held_weight
  FROM full_),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(total - 3 * held AS DOUBLE) / CAST(all_weight - held_weight AS DOUBLE) * weight END AS target
  FROM held),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5(coalesce(s.source, '') || 'mix'), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 AS shift,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS rank
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(floor(rate * rank + shift) - floor(rate * (rank - 1) + shift), 3) AS BIGINT) AS taken
FROM placed
"""

ORACLES["op2_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT o.a, o.b FROM shared o JOIN sizes x ON x.doc_id = o.a JOIN sizes y ON y.doc_id = o.b
  WHERE 100 * o.both_ >= 80 * (x.n + y.n - o.both_)),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id)
SELECT r.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""

ORACLES["op8_substring_dedup"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM starts),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, i FROM windows WHERE h IN (SELECT h FROM again)),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM hit, (SELECT unnest(range(0, 35)) AS k)),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words),
judged AS (
  SELECT p.doc_id, p.pos, p.word, g.pos IS NOT NULL AS is_gone
  FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.pos = p.pos)
SELECT d.doc_id, CAST(count(j.pos) AS BIGINT) AS n_words, CAST(count(*) FILTER (j.is_gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(j.word, ' ' ORDER BY j.pos) FILTER (NOT j.is_gone), '')) AS kept_sha256
FROM documents d LEFT JOIN judged j ON j.doc_id = d.doc_id GROUP BY d.doc_id
"""

ORACLES["op11_exact_top_k"] = r"""
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 1024) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
asked AS (SELECT vec_id AS query_id, min(x) AS q FROM fine WHERE vec_id % 100 = 0 GROUP BY vec_id),
scored AS (
  SELECT query_id, vec_id, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: q[i] * x[i])) AS BIGINT) AS score
  FROM asked JOIN fine ON vec_id <> query_id AND len(q) = len(x)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM placed WHERE rank <= 10
"""


def _more(best: str, cost: str, edit: str) -> str:
    """A way (nine digits of cost, then its audit) with one more edit; null stays null."""
    return f"(lpad(CAST(CAST(left({best}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({best}, 10) || '{edit}')"


ORACLES["op12_conversation_repair"] = rf"""
WITH RECURSIVE bytes_ AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS codes FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, codes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM base, bytes_),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM damaged),
told AS (
  SELECT *, left(role, 1) AS r, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') AS open_ FROM placed),
judged AS (
  SELECT *, blank OR again AS gone, NOT (blank OR again) AND open_ AS cut, CASE WHEN pos > 1 THEN lag(r) OVER (PARTITION BY conv_id ORDER BY pos) || r NOT IN ('su', 'ua', 'au') ELSE false END AS wrong FROM told),
ways(conv_id, pos, b0, b1, b2, b3) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '000000000', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM judged
  UNION ALL
  SELECT conv_id, pos, {_more("b0", "2", "D")},
    least({_more("b1", "2", "D")}, CASE WHEN NOT gone AND r = 's' THEN {_more("b0", "5 * cut", "K")} END),
    least({_more("u2", "2", "D")}, CASE WHEN NOT gone THEN {_more("least(b0, b1, a1)", "5 * cut + 1", "R")} END, CASE WHEN NOT gone AND r = 'u' THEN {_more("least(b0, b1, a1)", "5 * cut", "K")} END),
    least({_more("a1", "2", "D")}, CASE WHEN NOT gone THEN {_more("u2", "5 * cut + 1", "R")} END, CASE WHEN NOT gone AND r = 'a' THEN {_more("u2", "5 * cut", "K")} END)
  FROM (
    SELECT *, least(u1, {_more("a1", "5", "I")}) AS u2 FROM (
      SELECT *, least(b3, {_more("u1", "5", "I")}) AS a1 FROM (
        SELECT w.conv_id, j.pos, b0, b1, b3, j.r, j.gone, CAST(j.cut AS BIGINT) AS cut, least(b2, {_more("b0", "5", "I")}, {_more("b1", "5", "I")}, {_more("b3", "5", "I")}) AS u1
        FROM ways w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.pos + 1)))),
ends AS (
  SELECT conv_id, least(b0, b3, {_more("least(b2, " + _more("b1", "5", "I") + ")", "5", "I")}) AS best FROM ways
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
edits AS (SELECT conv_id, unnest(string_split(substr(best, 10), '')) AS e, unnest(range(1, length(best) - 8)) AS i FROM ends WHERE length(best) > 9),
matched AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS pos FROM edits),
emitted AS (
  SELECT m.conv_id, m.i, m.e, j.role, j.text, count(*) FILTER (NOT (m.e = 'K' AND j.r = 's')) OVER (PARTITION BY m.conv_id ORDER BY m.i) % 2 = 1 AS odd
  FROM matched m LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM m.conv_id AND j.pos = m.pos AND m.e <> 'I' WHERE m.e <> 'D'),
hashes AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role ELSE CASE WHEN odd THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS h FROM emitted GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (wrong) AS illegal FROM judged GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  coalesce(CAST(left(n.best, 9) AS BIGINT), 0) AS cost, coalesce(substr(n.best, 10), '') AS audit, coalesce(h.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
"""
