"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op1_ngram_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER.format('text'))} AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS items FROM d
),
x AS MATERIALIZED (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM s),
k AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x AS a JOIN x AS b ON a.item = b.item AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
r AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a)
SELECT s.doc_id, len(items)::BIGINT AS n_shingles, least(s.doc_id, min(r.b)) AS component_id
FROM s LEFT JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, items
"""

ORACLES["op3_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

# The template writes <s><|role|>..<|text|>..</s> a turn, [INST] and [/INST] with a blank around a user's turn.
MASKED = "replace(replace(replace(replace(replace(replace(replace({}, '\\', '\\\\'), '<s>', '<\\.s>'), '</s>', '<\\./s>'), '[INST]', '[\\.INST]'), '[/INST]', '[\\./INST]'), '<|role|>', '<\\.|role|>'), '<|text|>', '<\\.|text|>')"

ORACLES["op10_chat_formatting"] = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(23 + length({MASKED.format('role')}) + length({MASKED.format('text')}) + CASE WHEN role = 'user' THEN 15 ELSE 0 END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

ORACLES["op5_substring_dedup"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
x AS MATERIALIZED (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d)
),
b AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS f FROM x) WHERE f < doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM b),
t AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.p) AS kept, count(*) AS n FROM t ANTI JOIN g ON t.doc_id = g.doc_id AND t.p = g.p GROUP BY t.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

# CRC-32 of distinct n-grams only: a table of 256 remainders made by its rule, then one step a byte.
STEP = "(CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
FLOORED = "(({a} - ((({a}) % ({b})) + ({b})) % ({b})) // ({b}))"
FEATURES = f"""SELECT id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM (SELECT {{id}} AS id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {{table}})"""

ORACLES["op11_importance_resampling"] = f"""
WITH RECURSIVE bits AS (
  SELECT range AS i, range AS c, 0 AS k FROM range(256) UNION ALL SELECT i, {STEP}, k + 1 FROM bits WHERE k < 8
),
lookup AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS MATERIALIZED ({FEATURES.format(id="doc_id", table="documents")}),
q AS MATERIALIZED ({FEATURES.format(id="item_id", table="benchmark")}),
grams AS MATERIALIZED (SELECT DISTINCT g, hex(encode(g)) AS x FROM (SELECT g FROM d UNION ALL SELECT g FROM q)),
hashed AS MATERIALIZED (
  SELECT g, xor(4294967295, list_reduce(
      list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) % 10000 AS bucket
  FROM grams, lookup
),
ds AS (SELECT bucket, count(*) AS s FROM d JOIN hashed USING (g) GROUP BY bucket),
qs AS (SELECT bucket, count(*) AS t FROM q JOIN hashed USING (g) GROUP BY bucket),
k AS (SELECT (SELECT coalesce(sum(s), 0) FROM ds)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM qs)::DOUBLE AS tt),
gain AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS v
  FROM ds LEFT JOIN qs USING (bucket), k
),
w AS (
  SELECT id, {FLOORED.format(a="sum(v)", b="count(*)")}::BIGINT AS weight, count(*) AS n
  FROM d JOIN hashed USING (g) JOIN gain USING (bucket) GROUP BY id
),
z AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score,
         coalesce(n, 0) >= 39 AS fit
  FROM documents LEFT JOIN w ON w.id = doc_id
),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS total FROM z WHERE fit)
SELECT z.doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= 25 * total // 100 THEN place END AS rank
FROM z LEFT JOIN r USING (doc_id)
"""

# Two rounds written out: assign every piece to its nearest entry, then replace entries by floored means.
NEAREST = """
a{r} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT vec_id, x.p, e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM x JOIN b{r} AS b ON x.p = b.p
  ) GROUP BY vec_id, p
)"""
MEANS = f"""
m{{r}} AS MATERIALIZED (
  SELECT p, e, list({FLOORED.format(a="s", b="k")} ORDER BY j)::BIGINT[] AS v FROM (
    SELECT p, e, j, sum(y) AS s, count(*) AS k
    FROM (SELECT a.p, a.e, unnest(x.v) AS y, unnest(range(len(x.v))) AS j FROM a{{r}} AS a JOIN x ON a.vec_id = x.vec_id AND a.p = x.p)
    GROUP BY p, e, j
  ) GROUP BY p, e
),
b{{n}} AS MATERIALIZED (SELECT p, e, coalesce(m.v, b.v) AS v FROM b{{r}} AS b LEFT JOIN m{{r}} AS m USING (p, e))"""

ORACLES["op12_vector_codes"] = f"""
WITH u AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
),
x AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS v FROM (SELECT vec_id, v, unnest(range(16)) AS p FROM u)),
b0 AS MATERIALIZED (
  SELECT p, e, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM u QUALIFY e < 64) USING (vec_id)
),{NEAREST.format(r=0)},{MEANS.format(r=0, n=1)},{NEAREST.format(r=1)},{MEANS.format(r=1, n=2)},{NEAREST.format(r=2)},
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(y, ',' ORDER BY p, e)) FROM (SELECT p, e, array_to_string(v, ',') AS y FROM b2)) AS codebooks_sha256
FROM c JOIN u USING (vec_id)
"""
