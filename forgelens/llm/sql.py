"""What operators compute, as plain SQL over the same tables, where SQL can say it."""

WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = (
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER copies AS keep_id, count(*) OVER copies AS group_size,
  doc_id = max(doc_id) OVER copies AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW copies AS (PARTITION BY coalesce(text, ''))
"""

NGRAM_JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, {WORDS}) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
entries AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM entries a JOIN entries b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, r.component_id FROM sets s
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = s.doc_id
"""


def _z(a: str) -> str:
    return f"list_sum(list_transform(xs, lambda x: exp({a} * ln(x))))"


def _entropy(a: str) -> str:
    mean = f"list_sum(list_transform(xs, lambda x: exp({a} * ln(x)) * ln(x)))"
    return f"(ln({_z(a)}) - {a} * {mean} / {_z(a)})"


def _repeats(a: str) -> str:
    return f"(exp(({a} - 1) * ln(list_min(xs))) / {_z(a)})"


def _bisected(name: str, fine: str) -> str:
    return f"""{name} AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL SELECT i + 1, CASE WHEN ok THEN a ELSE lo END, CASE WHEN ok THEN hi ELSE a END
  FROM (SELECT i, lo, hi, a, {fine} AS ok
        FROM (SELECT i, lo, hi, (lo + hi) / 2 AS a, xs, goal FROM {name}, shares) WHERE i < 50))"""


#: A target entropy of 0.95 of the greatest, 4 readings at most, as many tokens as there
#: are, blocks of 65536.
TEMPERATURE_MIX = f"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS})) + 1 AS tokens FROM documents),
sources AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS st FROM tokens GROUP BY source),
total AS (SELECT CAST(sum(st) AS BIGINT) AS total, 0.95 * ln(count(*)) - 1e-12 AS goal FROM sources),
shares AS (SELECT list(st / total ORDER BY st) AS xs, any_value(goal) AS goal FROM sources, total),
{_bisected("by_entropy", _entropy("a") + " >= goal")},
{_bisected("by_repeats", _repeats("a") + " > 4")},
chosen AS (
  SELECT xs, round(greatest(
    CASE WHEN {_entropy("1")} >= goal THEN 1.0 ELSE (SELECT hi FROM by_entropy WHERE i = 50) END,
    CASE WHEN {_repeats("0")} <= 4 THEN 0.0 ELSE (SELECT hi FROM by_repeats WHERE i = 50) END), 6) AS a
  FROM shares),
plan AS (
  SELECT source, st, a AS exponent, weight, CAST(floor(weight * total + 0.5) AS BIGINT) AS quota,
    CAST(greatest(floor(weight * 65536 + 0.5), 1) AS BIGINT) AS per_block
  FROM (SELECT source, st, total, a, round(exp(a * ln(st / total)) / {_z("a")}, 9) AS weight
        FROM sources, total, chosen)),
readings AS (
  SELECT t.*, p.* EXCLUDE (source), unnest(range(0, (quota - 1) // st + 1)) AS epoch
  FROM tokens t JOIN plan p ON p.source = t.source),
placed AS (
  SELECT *, CAST(epoch * st + sum(tokens) OVER (PARTITION BY source, epoch
    ORDER BY md5('mix:' || epoch || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) - tokens AS BIGINT) AS start
  FROM readings)
SELECT doc_id, source, epoch, CAST(tokens AS BIGINT) AS tokens, start, block,
  row_number() OVER (PARTITION BY block ORDER BY md5('mix:=' || source || ':' || epoch || ':' || doc_id), doc_id, start) AS position,
  CAST(exponent AS DOUBLE) AS exponent, CAST(weight AS DOUBLE) AS weight
FROM (SELECT *, start // per_block AS block FROM placed WHERE start < quota)
"""


def _whole(scale: int) -> str:
    return f"list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"


_USABLE = (
    "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
)
_SQUARED = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_FLOOR = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"


def _assigned(i: int) -> str:
    gap = _SQUARED.format(a="k.v", b="c.v")
    return f"""a{i} AS MATERIALIZED (
  SELECT vec_id, v, CAST(nearest % 16 AS INTEGER) AS cluster, CAST(nearest // 16 AS BIGINT) AS distance
  FROM (SELECT k.vec_id, k.v, min({gap} * 16 + c.cluster) AS nearest
        FROM kept k, c{i} c GROUP BY k.row, k.vec_id, k.v))"""


def _moved(i: int) -> str:
    return f"""c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT cluster, list(mean ORDER BY place) AS v FROM (
      SELECT cluster, place, {_FLOOR} AS mean
      FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS place FROM a{i}) GROUP BY cluster, place)
    GROUP BY cluster) m ON m.cluster = c.cluster)"""


CLUSTERS = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, {_whole(64)} AS v FROM embeddings WHERE len(embedding) = 64 AND {_USABLE}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v
  FROM kept ORDER BY sha256('1:' || vec_id), v LIMIT 16),
{_assigned(0)}, {_moved(0)},
{_assigned(1)}, {_moved(1)},
{_assigned(2)}, {_moved(2)},
{_assigned(3)}
SELECT vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a3 a JOIN c3 c ON c.cluster = a.cluster
"""


def _coded(i: int) -> str:
    gap = _SQUARED.format(a="p.v", b="b.v")
    return f"""a{i} AS MATERIALIZED (
  SELECT row, part, v, nearest % 64 AS entry, nearest // 64 AS error
  FROM (SELECT p.row, p.part, p.v, min({gap} * 64 + b.entry) AS nearest
        FROM pieces p JOIN b{i} b ON b.part = p.part GROUP BY p.row, p.part, p.v))"""


def _fitted(i: int) -> str:
    return f"""b{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY place) AS v FROM (
      SELECT part, entry, place, {_FLOOR} AS mean
      FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS place FROM a{i})
      GROUP BY part, entry, place)
    GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry)"""


VECTOR_CODES = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, {_whole(256)}) - 1 AS row, vec_id, label, {_whole(256)} AS v
  FROM embeddings WHERE {_USABLE}),
pieces AS MATERIALIZED (
  SELECT row, part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] AS v
  FROM (SELECT row, v, unnest(range(16)) AS part FROM kept)),
b0 AS MATERIALIZED (SELECT part, row AS entry, v FROM pieces WHERE row < 64),
{_coded(0)}, {_fitted(0)},
{_coded(1)}, {_fitted(1)},
{_coded(2)},
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2),
codes AS (
  SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error
  FROM a2 GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes ON codes.row = kept.row, books
"""
