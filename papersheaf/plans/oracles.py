"""The same queries in SQL for DuckDB, written independently of the Spark code."""

from __future__ import annotations

from papersheaf.functions import lexicon
from papersheaf.plans import queries as q

SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"


def r6(expression: str) -> str:
    return f"(round({expression}, 6) + 0.0)"


def strip(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def clean(column: str) -> str:
    kept = (
        f"trim(regexp_replace(regexp_replace(coalesce({column}, ''), '{SPACE}+', ' ', 'g'), "
        r"'[^\p{L}\p{N}_ .,!?;:\-()]', ' ', 'g'))"
    )
    return f"CASE WHEN length({kept}) > 3 THEN regexp_replace({kept}, ' +', ' ', 'g') ELSE '' END"


def n_words(column: str) -> str:
    return f"CASE WHEN {column} = '' THEN 0 ELSE len(string_split({column}, ' ')) END::INT"


def values(rows: list[tuple]) -> str:
    def literal(value: object) -> str:
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)

    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


def word_list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def sanitize(expression: str) -> str:
    merged = (
        "trim(regexp_replace(translate(" + expression + ", '<>:\"/\\|?*', '_________'), '_+', '_', 'g'), '_')"
    )
    return f"CASE WHEN length({merged}) > 50 THEN left({merged}, 47) || '...' ELSE {merged} END"


TEXTS = f"""texts AS (
  SELECT doc_id, lang, source, n_chars, text, CAST(substr(source, 4) AS INT) AS cluster_id,
    source || '_' || lang || '_' || (doc_id % 50) || '.pdf' AS document_name, {clean('text')} AS full_text
  FROM documents)"""
PAGES = """pages_of AS (
  SELECT doc_id, unnest(generate_series(1, len(lines))) AS page_number, unnest(lines) AS raw_text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))"""
POINTS = """points AS (
  SELECT vec_id AS doc_id, embedding::DOUBLE[] AS x, label AS cluster_id FROM embeddings)"""
VALUES_OF_POINTS = """longs AS (
  SELECT doc_id, cluster_id, unnest(generate_series(1, len(x))) AS i, unnest(x) AS v FROM points)"""
MEANS = VALUES_OF_POINTS + """, centers AS (
  SELECT cluster_id, n, list(c ORDER BY i) AS center FROM (
    SELECT cluster_id, i, avg(v) AS c, count(*) AS n FROM longs GROUP BY ALL) GROUP BY ALL)"""
TO_MEANS = MEANS + """, distances AS (
  SELECT doc_id, cluster_id, list_distance(x, center) AS distance FROM points JOIN centers USING (cluster_id))"""
LONG = f"{POINTS}, {VALUES_OF_POINTS}"
CENTERS = f"{POINTS}, {MEANS}"
DISTANCES = f"{POINTS}, {TO_MEANS}"
COPIES = POINTS + """, twice AS (
  SELECT doc_id, x FROM points UNION ALL SELECT doc_id + 1000000, x FROM points)"""
PAIRS = POINTS + """, pairs AS (
  SELECT a.doc_id AS id_a, b.doc_id AS id_b, a.cluster_id AS ca, b.cluster_id AS cb,
    list_dot_product(a.x, b.x) AS dot, list_distance(a.x, b.x) AS distance,
    1 - list_cosine_similarity(a.x, b.x) AS cosine
  FROM points a JOIN points b ON a.doc_id <> b.doc_id)"""


def components(n: int) -> str:
    """The first ``n`` principal components: the covariance squared again and again leaves one direction, which is then taken out."""
    parts = [
        LONG,
        "overall AS (SELECT i, avg(v) AS m FROM longs GROUP BY i)",
        "centred AS (SELECT doc_id, cluster_id, i, v - m AS v FROM longs JOIN overall USING (i))",
        """cov_1 AS MATERIALIZED (
  SELECT p.i, q.i AS j, sum(p.v * q.v) / ((SELECT count(*) FROM points) - 1) AS v
  FROM centred p JOIN centred q USING (doc_id) GROUP BY ALL)""",
    ]
    for c in range(1, n + 1):
        parts += [
            f"""power_{c}(step, i, j, v) AS (
  SELECT 0, i, j, v FROM cov_{c} UNION ALL
  SELECT step + 1, i, j, v / max(abs(v)) OVER () FROM (
    SELECT p.step, p.i, q.j, sum(p.v * q.v) AS v FROM power_{c} p JOIN power_{c} q ON p.j = q.i WHERE p.step < 15 GROUP BY ALL))""",
            f"""column_{c} AS (SELECT i, v FROM power_{c} WHERE step = 15 AND j = (
  SELECT arg_max(i, v) FROM power_{c} WHERE step = 15 AND i = j))""",
            f"""vector_{c} AS MATERIALIZED (
  SELECT i, v / sqrt((SELECT sum(v * v) FROM column_{c})) * sign((SELECT arg_max(v, abs(v)) FROM column_{c})) AS w FROM column_{c})""",
            f"""value_{c} AS (
  SELECT sum(p.w * v * q.w) AS e FROM cov_1 c JOIN vector_{c} p ON p.i = c.i JOIN vector_{c} q ON q.i = c.j)""",
            f"""cov_{c + 1} AS MATERIALIZED (SELECT c.i, c.j, v - (SELECT e FROM value_{c}) * p.w * q.w AS v
  FROM cov_{c} c JOIN vector_{c} p ON p.i = c.i JOIN vector_{c} q ON q.i = c.j)""",
        ]
    return ", ".join(parts)


MERGE_DISTANCES = {"ward": "list_distance(p.x, q.x) ** 2", "average": "1 - list_cosine_similarity(p.x, q.x)", "single": "list_distance(p.x, q.x)"}
MERGE_UPDATES = {
    "ward": "((na + no) * da + (nb + no) * db - no * dab) / (na + nb + no)",
    "average": "(na * da + nb * db) / (na + nb)",
    "single": "least(da, db)",
}


def tree(linkage: str) -> str:
    """Step by step, the nearest two of all clusters merge and their distances to the others are made anew from the old ones."""
    return (
        POINTS
        + f""", steps(t, a, b, d, na, nb, merged) AS (
  SELECT 0, p.doc_id, q.doc_id, {MERGE_DISTANCES[linkage]}, 1.0::DOUBLE, 1.0::DOUBLE, false
  FROM points p JOIN points q ON p.doc_id < q.doc_id
  UNION ALL (
  WITH now AS (SELECT * FROM steps WHERE NOT merged),
  best AS (SELECT * FROM now ORDER BY d, a, b LIMIT 1),
  touched AS (
    SELECT c.a IN (best.a, best.b) AS left_one, CASE WHEN left_one THEN c.a ELSE c.b END = best.a AS of_a,
      CASE WHEN left_one THEN c.b ELSE c.a END AS o, CASE WHEN left_one THEN c.nb ELSE c.na END AS no, c.d
    FROM now c, best WHERE (c.a IN (best.a, best.b)) <> (c.b IN (best.a, best.b))),
  sides AS (SELECT o, any_value(no) AS no, max(d) FILTER (of_a) AS da, max(d) FILTER (NOT of_a) AS db FROM touched GROUP BY o),
  anew AS (
    SELECT t, a, o, no, na + nb AS size, {MERGE_UPDATES[linkage]} AS d FROM sides, (SELECT t, a, na, nb, d AS dab FROM best))
  SELECT best.t + 1, c.a, c.b, c.d, c.na, c.nb, false FROM now c, best
    WHERE c.a NOT IN (best.a, best.b) AND c.b NOT IN (best.a, best.b)
  UNION ALL SELECT t + 1, least(a, o), greatest(a, o), d,
    CASE WHEN o < a THEN no ELSE size END, CASE WHEN o < a THEN size ELSE no END, false FROM anew
  UNION ALL SELECT t + 1, a, b, d, na, nb, true FROM best)),
merges AS (SELECT t, a, b, d FROM steps WHERE merged)"""
    )


def tree_cut(linkage: str, k: int) -> str:
    return f"""WITH RECURSIVE {tree(linkage)},
parents AS (SELECT a, b FROM merges WHERE t <= (SELECT count(*) FROM points) - {k}),
up(doc_id, root) AS (SELECT doc_id, doc_id FROM points UNION ALL SELECT doc_id, a FROM up JOIN parents ON b = root),
roots AS (SELECT doc_id, min(root) AS root FROM up GROUP BY doc_id),
numbers AS (SELECT root, (row_number() OVER (ORDER BY count(*) DESC, root) - 1)::INT AS cluster_id FROM roots GROUP BY root)
SELECT doc_id, cluster_id FROM roots JOIN numbers USING (root)"""


def silhouettes(distance: str) -> str:
    return (
        PAIRS
        + f""", toward AS (
  SELECT id_a, ca, cb, avg({distance}) AS d FROM pairs GROUP BY ALL),
samples AS (
  SELECT id_a AS doc_id, ca AS cluster_id, coalesce(
    (min(CASE WHEN ca <> cb THEN d END) - min(CASE WHEN ca = cb THEN d END)) / nullif(greatest(
    min(CASE WHEN ca <> cb THEN d END), min(CASE WHEN ca = cb THEN d END)), 0), 0) AS s
  FROM toward GROUP BY ALL)"""
    )


CALINSKI = """
  (SELECT (ssb / (k - 1)) / (ssw / (n - k)) FROM (
    SELECT (SELECT count(*) FROM points) AS n, (SELECT count(*) FROM centers) AS k,
      (SELECT sum(distance * distance) FROM distances) AS ssw,
      (SELECT sum(c.n * list_distance(c.center, g.center) ** 2) FROM centers c,
        (SELECT list(m ORDER BY i) AS center FROM (SELECT i, avg(v) AS m FROM longs GROUP BY i)) g) AS ssb))"""
POOL_MEAN = "(SELECT avg(cosine) FROM pairs WHERE ca = cb AND id_a < id_b)"
POOL_STD = "(SELECT stddev_pop(cosine) FROM pairs WHERE ca = cb AND id_a < id_b)"
SIZES = """sizes AS (
  SELECT cluster_id, count(*) AS size, count(*) * 100.0 / (SELECT count(*) FROM points) AS percentage
  FROM points GROUP BY cluster_id)"""
NAMES = """names AS (
  SELECT cluster_id, 'Topic (a: b) ' || min(source) AS name FROM texts WHERE lang = 'de' GROUP BY cluster_id)"""
FILES = """files AS (
  SELECT CASE WHEN lang = 'de' THEN '/in/sub/' ELSE '/in/' END || document_name AS path,
    sum(n_chars)::BIGINT * 1024 AS length
  FROM texts WHERE lang <> 'fr' GROUP BY 1)"""
FOLDERS = f"""folders AS (
  SELECT cluster_id, 'clusters/' || {sanitize("'cluster_' || cluster_id || coalesce('_' || name, '')")} AS cluster_dir
  FROM (SELECT DISTINCT cluster_id FROM texts) LEFT JOIN names USING (cluster_id))"""
RESOLVED = """resolved AS (
  SELECT t.doc_id, t.document_name, t.cluster_id, coalesce(e.path, b.path) AS source_path,
    coalesce(e.length, b.length) AS length
  FROM texts t LEFT JOIN files e ON e.path = '/in/' || t.document_name
  LEFT JOIN (SELECT regexp_extract(path, '[^/]*$') AS base, min(path) AS path, arg_min(length, path) AS length
             FROM files GROUP BY 1) b ON b.base = t.document_name)"""
# no name in this table is the stem of another, so suffixes are plain ranks
MANIFEST = f"""{TEXTS}, {NAMES}, {FILES}, {FOLDERS}, {RESOLVED}, manifest AS (
  SELECT doc_id, document_name, cluster_id, source_path IS NOT NULL AS success,
    CASE WHEN source_path IS NOT NULL THEN 'copied' END AS operation, source_path,
    CASE WHEN source_path IS NOT NULL THEN cluster_dir || '/' || CASE WHEN r = 1 THEN document_name
      ELSE replace(document_name, '.pdf', '_' || (r - 1) || '.pdf') END END AS destination_path,
    round(length / 1048576.0, 2) AS file_size_mb,
    CASE WHEN source_path IS NULL THEN 'Source file not found: ' || document_name END AS error
  FROM (SELECT *, row_number() OVER (
          PARTITION BY cluster_id, document_name, source_path IS NULL ORDER BY doc_id) AS r FROM resolved)
  JOIN folders USING (cluster_id))"""
STATISTICS = """statistics AS (
  SELECT cluster_id, count(*) AS file_count, count(*) * 100.0 / (SELECT count(*) FROM texts) AS percentage,
    coalesce(any_value(name), 'Cluster ' || cluster_id) AS name
  FROM texts LEFT JOIN names USING (cluster_id) GROUP BY cluster_id)"""
INVENTORY = """inventory AS (
  SELECT doc_id, lang, source, text, '/in/' || source || '/' || doc_id ||
    CASE lang WHEN 'de' THEN '.PDF' WHEN 'es' THEN '.txt' ELSE '.pdf' END AS path,
    CASE WHEN source <> 'src3' THEN n_chars * 1024 END AS length FROM documents)"""


def assembled() -> str:
    """Documents from their lines."""
    good = f"""
  SELECT doc_id, {clean("string_agg(raw_text, chr(10) ORDER BY page_number) FILTER (valid)")} AS full_text,
    count(*) FILTER (valid)::INT AS page_count, count(*)::INT AS total_pages
  FROM (SELECT *, length({strip('raw_text')}) >= {q.PAGE_LENGTH} AS valid FROM pages_of) GROUP BY doc_id"""
    return f"""{PAGES}, gathered AS ({good}), assembled AS (
  SELECT doc_id, full_text, page_count, total_pages, {n_words('full_text')} AS word_count,
    length(full_text)::INT AS char_count, true AS success, NULL::VARCHAR AS error FROM gathered)"""


RECORDS = f"""{TEXTS}, {assembled()}, records AS (
  SELECT doc_id, document_name AS filename, CASE WHEN source = 'src5' THEN '' ELSE a.full_text END AS full_text,
    CASE WHEN source = 'src5' THEN 0 ELSE page_count END AS page_count,
    CASE WHEN source = 'src5' THEN 0 ELSE word_count END AS word_count,
    CASE WHEN source = 'src5' THEN 0 ELSE char_count END AS char_count, source <> 'src5' AS success,
    CASE WHEN source = 'src5' THEN 'Invalid file' END AS error
  FROM texts JOIN assembled a USING (doc_id))"""
LETTER_VECTORS = "[" + ", ".join(
    f"(length(body) - length(replace(body, '{letter}', '')))::DOUBLE" for letter in q.LETTERS
) + "]"


UNIT = (
    "CASE WHEN list_dot_product(v, v) = 0 THEN v "
    "ELSE list_transform(v, lambda e: (e / sqrt(list_dot_product(v, v)))::FLOAT::DOUBLE) END"
)


def letters(body: str) -> str:
    return f"""WITH {TEXTS}, counted AS (
  SELECT doc_id, v, sqrt(list_dot_product(v, v)) AS n FROM (
    SELECT doc_id, {LETTER_VECTORS} AS v FROM (SELECT doc_id, {body} AS body FROM texts)))
SELECT doc_id, (unnest(generate_series(1, 8)) - 1)::INT AS position,
  {r6("(unnest(CASE WHEN n = 0 THEN v ELSE list_transform(v, lambda e: e / n) END))::FLOAT::DOUBLE")} AS value
FROM counted"""


# all copies of a key sit in one list of words; the position counts kept and dropped words alike
WORDS = rf"""{TEXTS}, tokens AS (
  SELECT cluster_id, doc_id, unnest(generate_series(1, len(w))) AS position, unnest(w) AS word
  FROM (SELECT cluster_id, doc_id, list_filter(regexp_extract_all(lower(full_text), '[\p{{L}}\p{{N}}_]+'),
          lambda t: regexp_full_match(t, '[a-z]{{4,}}')) AS w FROM texts)),
counts AS (
  SELECT cluster_id, word, count(*) AS n, min(doc_id * 1000000 + position) AS seen FROM tokens
  WHERE word NOT IN ({word_list(lexicon.STOP_WORDS)}) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, seen)::INT AS rank FROM counts)"""


def domains(rows: list[tuple]) -> str:
    return f"""domains AS (SELECT * FROM (VALUES {values(rows)}) AS d(domain_rank, domain, word)),
scores AS (
  SELECT cluster_id, domain_rank, domain, sum(n)::BIGINT AS score FROM counts JOIN domains USING (word) GROUP BY ALL)"""


def content(rows: list[tuple]) -> str:
    return f"""WITH {WORDS}, {domains(rows)}, best AS (
  SELECT cluster_id, domain FROM scores
  QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, domain_rank) = 1),
top AS (
  SELECT cluster_id, string_agg(upper(word[1]) || word[2:], '_' ORDER BY rank) AS words
  FROM (SELECT *, count(*) OVER (PARTITION BY cluster_id ORDER BY rank) AS kept
        FROM ranked WHERE rank <= 3 AND n >= 2) WHERE kept <= 2 GROUP BY cluster_id)
SELECT cluster_id, coalesce(domain, words, 'Topic_' || cluster_id) || '_(' || count(*) || 'docs)' AS name
FROM texts LEFT JOIN best USING (cluster_id) LEFT JOIN top USING (cluster_id) GROUP BY cluster_id, domain, words"""


FILE_WORDS = f"""{TEXTS}, parts AS (
  SELECT cluster_id, doc_id, unnest(generate_series(1, len(w))) AS position, unnest(w) AS part
  FROM (SELECT cluster_id, doc_id, string_split(translate(regexp_replace(document_name, '\\.[^.]+$', ''), '_-', '  '),
          ' ') AS w FROM texts)),
ranked AS (
  SELECT cluster_id, lower(part) AS word, count(*) AS n,
    row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(doc_id * 1000 + position))::INT AS rank
  FROM parts WHERE length(part) > 2 AND NOT regexp_full_match(part, '[0-9]+')
    AND lower(part) NOT IN ({word_list(lexicon.FILENAME_STOP_WORDS)}) GROUP BY cluster_id, lower(part))"""
THEME_WORDS = f"""{TEXTS}, tokens AS (
  SELECT cluster_id, doc_id, unnest(generate_series(1, len(w))) AS position, unnest(w) AS word
  FROM (SELECT cluster_id, doc_id, string_split(lower(full_text), ' ') AS w FROM texts)),
ranked AS (
  SELECT cluster_id, word, count(*) AS n,
    row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(doc_id * 1000000 + position)) AS rank
  FROM tokens WHERE length(word) > 4 AND word NOT IN ({word_list(lexicon.THEME_STOP_WORDS)})
  GROUP BY cluster_id, word),
top AS (SELECT cluster_id, list(word ORDER BY rank) AS w FROM ranked WHERE rank <= 3 AND n > 1 GROUP BY cluster_id)"""
SCORES = POINTS + """, scores AS (
  SELECT cluster_id + 2 AS k, sum(x[1] * x[1]) AS inertia, avg(x[2]) AS silhouette,
    stddev_pop(x[3]) AS davies_bouldin, sum(abs(x[4])) AS calinski_harabasz
  FROM points GROUP BY cluster_id)"""
NORMALIZED = SCORES + """, normalized AS (
  SELECT *, (silhouette - min(silhouette) OVER ()) / (max(silhouette) OVER () - min(silhouette) OVER ()) AS s,
    1 - (davies_bouldin - min(davies_bouldin) OVER ()) / (max(davies_bouldin) OVER () - min(davies_bouldin) OVER ()) AS d,
    (calinski_harabasz - min(calinski_harabasz) OVER ())
      / (max(calinski_harabasz) OVER () - min(calinski_harabasz) OVER ()) AS c,
    (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ()) AS px,
    (inertia - min(inertia) OVER ()) / (max(inertia) OVER () - min(inertia) OVER ()) AS py
  FROM scores),
chord AS (
  SELECT *, greatest(0, least(1, (px + (py - y0) * (y1 - y0)) / (1 + (y1 - y0) ** 2))) AS t
  FROM (SELECT *, (SELECT arg_min(py, k) FROM normalized) AS y0, (SELECT arg_max(py, k) FROM normalized) AS y1
        FROM normalized)),
elbow AS (
  SELECT *, sqrt((px - t) ** 2 + (py - y0 - t * (y1 - y0)) ** 2) AS distance FROM chord),
composite AS (
  SELECT *, 0.35 * s + 0.30 * d + 0.25 * c + 0.10 * CASE WHEN k =
    (SELECT arg_max(k, distance) FROM elbow) THEN 1.0 ELSE 0.5 END AS composite_score FROM elbow)"""
REPORT = f"""WITH {MANIFEST}, {STATISTICS}, totals AS (
  SELECT count(*) AS n, count(*) FILTER (success) AS good, count(*) FILTER (NOT success) AS bad FROM manifest),
head AS (SELECT unnest([
    'Report on the sorted documents', repeat('=', 50), 'Written: now', 'Folder: /out', 'Placed by: Copy',
    'All files', repeat('-', 25), 'Files: ' || n, 'Placed: ' || good,
    'Not placed: ' || bad, 'Share placed: ' || printf('%.1f', good * 100.0 / n) || '%', 'Clusters',
    repeat('-', 25)]) AS line, unnest(generate_series(0, 12)) AS part FROM totals),
first AS (
  SELECT cluster_id, document_name, row_number() OVER (PARTITION BY cluster_id ORDER BY document_name, doc_id) AS r
  FROM texts)
SELECT 0 AS section, 0 AS cluster_id, part::INT AS part, '' AS item, line FROM head
UNION ALL SELECT 1, cluster_id, 0, '', name FROM statistics
UNION ALL SELECT 1, cluster_id, 1, '', '   Size: ' || file_count || ' (' || printf('%.1f', percentage) || '%)'
  FROM statistics
UNION ALL SELECT 1, cluster_id, 2, '', '   Members:' FROM statistics
UNION ALL SELECT 1, cluster_id, (2 + r)::INT, '', '     - ' || document_name FROM first WHERE r <= 10
UNION ALL SELECT 1, cluster_id, 13, '', '     and ' || (file_count - 10) || ' others' FROM statistics
  WHERE file_count > 10
UNION ALL SELECT 2, 0, 0, '', 'Files not placed (' || bad || ')' FROM totals WHERE bad > 0
UNION ALL SELECT 2, 0, 1, '', repeat('-', 25) FROM totals WHERE bad > 0
UNION ALL SELECT 2, 0, 2, document_name || ' ' || doc_id, '   - ' || document_name || ': ' || error
  FROM manifest WHERE NOT success"""
# names are file, file_1, file_2_1 and file_<source>; the parent of file_j is file, that of file_2_1 is file_2
CONFLICTS = f"""WITH {TEXTS}, placed AS (
  SELECT doc_id, 'clusters/c' || (cluster_id % 4) AS d, 'file' || CASE lang WHEN 'en' THEN '' WHEN 'de' THEN '_1'
    WHEN 'fr' THEN '_2_1' ELSE '_' || cluster_id END AS s FROM texts),
g AS (SELECT d, s, count(*) AS n FROM placed GROUP BY ALL),
one AS (
  SELECT g.*, CASE WHEN p.n - 1 >= try_cast(substr(g.s, 6) AS INT) AND g.s NOT LIKE '%\\_0' ESCAPE '\\' THEN 1 ELSE 0 END
    AS taken FROM g LEFT JOIN g p ON p.d = g.d AND p.s = 'file' AND regexp_full_match(g.s, 'file_[0-9]+')),
two AS (
  SELECT one.d, one.s, one.n, CASE WHEN p.n - 1 + p.taken >= 1 THEN 1 ELSE one.taken END AS taken
  FROM one LEFT JOIN one p ON p.d = one.d AND p.s = 'file_2' AND one.s = 'file_2_1')
SELECT doc_id, d || '/' || s || CASE WHEN r + taken = 0 THEN '' ELSE '_' || (r + taken) END || '.pdf' AS destination_path
FROM (SELECT *, row_number() OVER (PARTITION BY d, s ORDER BY doc_id) - 1 AS r FROM placed) JOIN two USING (d, s)"""

NEAREST = f"""WITH {POINTS}, scored AS (
  SELECT q.doc_id AS query_id, p.doc_id, list_dot_product(q.x, p.x) AS s FROM points q, points p WHERE q.doc_id % 50 = 0)
SELECT query_id, doc_id, {r6('s')} AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id)::INT AS rank FROM scored) WHERE rank <= 5"""
ORACLES = {
    "validate_files": f"""WITH {INVENTORY} SELECT doc_id, reason IS NULL AS valid, reason AS reject_reason FROM (
  SELECT doc_id, CASE WHEN length IS NULL THEN 'File not found' WHEN lang = 'es' THEN 'Not a PDF file'
    WHEN length > 2 * 1048576 THEN 'File too large' END AS reason FROM inventory)""",
    "extract_pages": f"""WITH {PAGES} SELECT doc_id, page_number::INT AS page_number, raw_text
FROM pages_of JOIN documents USING (doc_id) WHERE length(text) >= 100""",
    "extract_errors": """SELECT doc_id, CASE WHEN length(text) < 100 THEN 0 ELSE len(string_split(text, chr(10))) END::INT
  AS total_pages, CASE WHEN length(text) < 100 THEN 'too short' END AS error FROM documents""",
    "extract_documents": f"""WITH {INVENTORY}, {assembled()}, read AS (
  SELECT path AS file_path, regexp_extract(path, '[^/]*$') AS filename, a.*, coalesce(length, 0) AS size,
    lang <> 'es' AND coalesce(length, 0) <= 2 * 1048576 AS usable, length(text) >= 100 AS fine
  FROM inventory JOIN assembled a USING (doc_id))
SELECT file_path, filename, CASE WHEN usable AND fine THEN full_text ELSE '' END AS full_text,
  CASE WHEN usable AND fine THEN page_count ELSE 0 END AS page_count,
  CASE WHEN usable AND fine THEN total_pages ELSE 0 END AS total_pages,
  CASE WHEN usable AND fine THEN word_count ELSE 0 END AS word_count,
  CASE WHEN usable AND fine THEN char_count ELSE 0 END AS char_count,
  CASE WHEN usable AND fine THEN round(size / 1048576.0, 2) END AS file_size_mb, usable AND fine AS success,
  CASE WHEN NOT usable THEN 'Invalid file' WHEN NOT fine THEN 'too short' END AS error FROM read""",
    "document_metadata": f"""WITH {INVENTORY} SELECT doc_id, CASE WHEN lang <> 'fr' THEN source ELSE '' END AS title,
  '' AS author, '' AS subject, '' AS creator, '' AS producer, '' AS creation_date,
  CASE WHEN lang <> 'fr' THEN lang ELSE '' END AS modification_date,
  round(coalesce(length, 0) / 1048576.0, 2) AS file_size_mb,
  lower(regexp_extract(path, '\\.[^.]+$')) AS file_extension FROM inventory""",
    "embedding_cache": f"""WITH {TEXTS} SELECT doc_id, md5('letters_' || full_text) AS cache_key,
  full_text IN (SELECT full_text FROM texts WHERE lang = 'en') AS cached FROM texts""",
    "write_reports": f"""WITH {TEXTS}, {NAMES}, {STATISTICS}
SELECT cluster_id, file_count, {r6('percentage')} AS percentage, name FROM statistics""",
    "write_clustered": f"""WITH {TEXTS}, {NAMES}, {FOLDERS} SELECT substr(cluster_dir, 10) AS cluster_dir,
  count(*) AS documents, sum(length(text))::BIGINT AS characters FROM texts JOIN folders USING (cluster_id) GROUP BY 1""",
    "write_plan": f"""WITH {TEXTS}, {NAMES} SELECT cluster_id, document_name,
  count(*) OVER (PARTITION BY cluster_id) AS count, name AS theme,
  'cluster_' || cluster_id || coalesce('_' || name, '') AS folder_name FROM texts LEFT JOIN names USING (cluster_id)""",
    "clean_text": f"WITH {TEXTS} SELECT doc_id, full_text FROM texts",
    "valid_pages": f"""WITH {PAGES} SELECT doc_id, page_number::INT AS page_number, raw_text FROM pages_of
WHERE length({strip('raw_text')}) >= {q.PAGE_LENGTH}""",
    "assemble_document": f"WITH {assembled()} SELECT * FROM assembled",
    "cleaned_pages": f"""WITH {PAGES} SELECT doc_id, page_number::INT AS page_number, {clean('raw_text')} AS text
FROM pages_of WHERE length({strip('raw_text')}) >= {q.PAGE_LENGTH}""",
    "count_words": f"WITH {TEXTS} SELECT doc_id, {n_words('full_text')} AS word_count FROM texts",
    "count_chars": f"WITH {TEXTS} SELECT doc_id, length(full_text)::INT AS char_count FROM texts",
    "failed_records": f"WITH {RECORDS} SELECT doc_id, filename, page_count, char_count, success, error FROM records",
    "extraction_summary": f"""WITH {RECORDS} SELECT count(*) AS total_files,
  count(*) FILTER (success) AS successful FROM records""",
    "extraction_details": f"""WITH {RECORDS} SELECT filename, word_count, char_count,
  CASE WHEN success THEN 'Success' ELSE 'Failed' END AS status FROM records""",
    "embeddable_documents": f"""WITH {RECORDS} SELECT doc_id, char_count FROM records
WHERE success AND trim(full_text) <> ''""",
    "first_n_words": f"""WITH {TEXTS} SELECT doc_id,
  array_to_string(string_split(full_text, ' ')[1:512], ' ') AS first_words FROM texts""",
    "text_characteristics": f"""WITH {TEXTS} SELECT doc_id, length(full_text)::INT AS length,
  {n_words('full_text')} AS words, length(regexp_replace(full_text, '[^.!?]', '', 'g'))::INT AS sentences,
  {r6("CASE WHEN full_text <> '' THEN list_avg(list_transform(string_split(full_text, ' '), lambda w: length(w))) END")}
    AS avg_word_length,
  CASE WHEN full_text = '' THEN 0 ELSE len(list_distinct(string_split(lower(full_text), ' '))) END::INT AS unique_words
FROM texts""",
    "corpus_statistics": f"""WITH {TEXTS}, c AS (SELECT {n_words('full_text')} AS words, length(full_text) AS length,
    len(list_distinct(string_split(lower(full_text), ' '))) AS u FROM texts)
SELECT {r6('avg(words)')} AS avg_words, {r6('avg(length)')} AS avg_characters,
  {r6('avg(CASE WHEN words > 0 THEN u / words END)')} AS avg_vocabulary_diversity FROM c""",
    "sanitize_name": f"SELECT page_id, {sanitize('url')} AS name FROM pages",
    "embed_with_model": letters("full_text"),
    "l2_normalize": f"""WITH {POINTS}, scaled AS (
  SELECT doc_id, list_transform(x, lambda e: e * (cluster_id + 2)) AS x FROM points),
normed AS (SELECT doc_id, x, sqrt(list_dot_product(x, x)) AS n FROM scaled)
SELECT doc_id, (unnest(generate_series(1, len(x))) - 1)::INT AS position,
  {r6('(unnest(list_transform(x, lambda e: e / n)))::FLOAT::DOUBLE')} AS value FROM normed""",
    "incremental_embed": letters("full_text"),
    "pairwise_similarity": f"""WITH {PAIRS} SELECT id_a, id_b, {r6('dot')} AS similarity FROM pairs
WHERE id_a < id_b AND dot >= 0.25 UNION ALL SELECT doc_id, doc_id, 1.0 FROM points""",
    "pairwise_similarity_copies": f"""WITH {COPIES} SELECT a.doc_id AS id_a, b.doc_id AS id_b, {r6('list_dot_product(a.x, b.x)')} AS similarity
FROM twice a JOIN twice b ON a.doc_id < b.doc_id WHERE list_dot_product(a.x, b.x) >= 0.25""",
    "similarity_network_copies": f"""WITH {COPIES} SELECT a.doc_id AS id_a, b.doc_id AS id_b, {r6('list_dot_product(a.x, b.x)')} AS similarity
FROM twice a JOIN twice b ON a.doc_id < b.doc_id WHERE list_dot_product(a.x, b.x) > 0.3""",
    "pairwise_correlation_copies": f"""WITH {COPIES}, centred AS (
  SELECT doc_id, list_transform(x, lambda e: e - m) AS x FROM (SELECT doc_id, x, list_avg(x) AS m FROM twice))
SELECT a.doc_id AS id_a, b.doc_id AS id_b, {r6('list_cosine_similarity(a.x, b.x)')} AS correlation
FROM centred a JOIN centred b ON a.doc_id < b.doc_id WHERE list_cosine_similarity(a.x, b.x) >= 0.25""",
    "find_most_similar": NEAREST,
    "search_index": NEAREST,
    "similarity_network": f"""WITH {PAIRS} SELECT id_a, id_b, {r6('dot')} AS similarity FROM pairs
WHERE id_a < id_b AND dot > 0.3""",
    "pairwise_correlation": f"""WITH {POINTS}, centred AS (
  SELECT doc_id, list_transform(x, lambda e: e - m) AS x FROM (SELECT doc_id, x, list_avg(x) AS m FROM points)),
c AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, list_cosine_similarity(a.x, b.x) AS r
  FROM centred a JOIN centred b ON a.doc_id < b.doc_id)
SELECT id_a, id_b, {r6('r')} AS correlation FROM c WHERE r >= 0.25
UNION ALL SELECT doc_id, doc_id, 1.0 FROM points""",
    "search_text": f"""WITH {TEXTS}, asked AS (
  SELECT item_id AS query_id, {clean('text')} AS body FROM benchmark),
q AS (SELECT query_id, {LETTER_VECTORS} AS v FROM asked),
d AS (SELECT doc_id, {LETTER_VECTORS} AS v FROM (SELECT doc_id, full_text AS body FROM texts)),
qn AS (SELECT query_id, {UNIT} AS x FROM q), dn AS (SELECT doc_id, {UNIT} AS x FROM d),
ranked AS (
  SELECT query_id, list_dot_product(qn.x, dn.x) AS s,
    row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(qn.x, dn.x) DESC, doc_id) AS rank FROM qn, dn)
SELECT query_id, {r6('max(s)')} AS best, {r6('min(s)')} AS fifth FROM ranked WHERE rank <= 5 GROUP BY query_id""",
    "embedder_places_texts": f"""WITH {TEXTS} SELECT count(*) AS n, count(*) AS n_same,
  count(*) FILTER (regexp_matches(full_text, '[\\p{{L}}\\p{{N}}]')) AS n_unit, count(*) AS n_whole
FROM texts WHERE full_text <> ''""",
    "join_embeddings": f"""SELECT doc_id, lang, {r6('embedding[1]::DOUBLE')} AS first
FROM documents JOIN embeddings ON vec_id = doc_id""",
    "best_per_metric": f"""WITH {SCORES} SELECT arg_max(k, silhouette) AS best_silhouette_k,
  arg_max(k, calinski_harabasz) AS best_calinski_harabasz_k FROM scores""",
    "embedding_statistics": f"""WITH {LONG} SELECT count(DISTINCT doc_id) AS n_documents, max(i)::INT AS dimension,
  {r6('min(v)')} AS min_value, {r6('max(v)')} AS max_value, {r6('avg(v)')} AS mean_value,
  {r6('stddev_pop(v)')} AS std_value FROM longs""",
    "embedding_histogram": f"""WITH {LONG}, l AS (SELECT min(v) AS low, max(v) AS high FROM longs)
SELECT least(floor(50 * (v - low) / (high - low)), 49)::INT AS bin, count(*) AS n FROM longs, l GROUP BY 1""",
    "leading_dimensions": f"""WITH {LONG} SELECT doc_id, (i - 1)::INT AS dimension, {r6('v')} AS value FROM longs
WHERE i <= 50""",
    "kmeans_assign": f"""WITH {CENTERS} SELECT doc_id, arg_min(c.cluster_id, list_distance(x, center))::INT AS cluster_id,
  {r6('min(list_distance(x, center))')} AS distance FROM points, centers c GROUP BY doc_id""",
    "kmeans_step": f"""WITH {CENTERS}, nearest AS (
  SELECT doc_id, arg_min(c.cluster_id, list_distance(x, center)) AS cluster_id FROM points, centers c GROUP BY doc_id)
SELECT n.cluster_id, count(*) AS n, (i - 1)::INT AS position, {r6('avg(v)')} AS value
FROM nearest n JOIN longs USING (doc_id) GROUP BY n.cluster_id, i""",
    "dbscan": f"""WITH RECURSIVE {PAIRS}, near AS (SELECT id_a, id_b FROM pairs WHERE distance <= {q.EPS}),
cores AS (SELECT id_a AS id FROM near GROUP BY id_a HAVING count(*) + 1 >= 5),
links AS (SELECT id_a, id_b FROM near WHERE id_a IN (FROM cores) AND id_b IN (FROM cores)),
reach(root, id) AS (
  SELECT id, id FROM cores UNION SELECT r.root, l.id_b FROM reach r JOIN links l ON l.id_a = r.id),
labelled AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
numbered AS (SELECT id, (dense_rank() OVER (ORDER BY root) - 1)::INT AS cluster_id FROM labelled),
border AS (SELECT id_a AS id, min(cluster_id) AS cluster_id FROM near JOIN numbered n ON n.id = id_b
  WHERE id_a NOT IN (FROM cores) GROUP BY id_a)
SELECT doc_id, coalesce(n.cluster_id, b.cluster_id, -1)::INT AS cluster_id, n.id IS NOT NULL AS is_core
FROM points LEFT JOIN numbered n ON n.id = doc_id LEFT JOIN border b ON b.id = doc_id""",
    "pca_project": f"""WITH RECURSIVE {components(2)} SELECT doc_id, {r6('sum(v * a.w)')} AS x, {r6('sum(v * b.w)')} AS y
FROM centred JOIN vector_1 a USING (i) JOIN vector_2 b USING (i) GROUP BY doc_id""",
    "project_centers": f"""WITH RECURSIVE {components(2)}, middle AS (
  SELECT cluster_id, i, avg(v) AS v FROM centred GROUP BY ALL)
SELECT cluster_id, {r6('sum(v * a.w)')} AS x, {r6('sum(v * b.w)')} AS y
FROM middle JOIN vector_1 a USING (i) JOIN vector_2 b USING (i) GROUP BY cluster_id""",
    "explained_variance": f"""WITH RECURSIVE {components(10)}, shares AS (
  SELECT c::INT AS component, e / (SELECT sum(v) FROM cov_1 WHERE i = j) AS share FROM ({' UNION ALL '.join(
      f'SELECT {c} AS c, e FROM value_{c}' for c in range(1, 11))}))
SELECT component, {r6('share')} AS explained_variance_ratio, {r6('sum(share) OVER (ORDER BY component)')} AS cumulative FROM shares""",
    "agglomerative": tree_cut("ward", 5),
    "agglomerative_features": tree_cut("ward", 5),
    "cluster_features": f"""WITH {LONG}, whole AS (
  SELECT count(DISTINCT doc_id) AS n_rows, sum(v * v) AS squares FROM longs)
SELECT (i - 1)::INT AS position, {r6('sum(v)')} AS total, any_value(n_rows) AS n_rows, {r6('any_value(squares)')} AS squares,
  any_value(n_rows) AS n_members, any_value(n_rows) AS n_distinct FROM longs, whole GROUP BY i""",
    "agglomerative_average": tree_cut("average", 5),
    "agglomerative_single": tree_cut("single", 5),
    "fit_predict_agglomerative": tree_cut("ward", 8),
    "evaluate_agglomerative": f"""WITH RECURSIVE {tree('ward')},
parents AS (SELECT k, a, b FROM merges, (VALUES (2), (3), (5), (9)) ks(k) WHERE t <= (SELECT count(*) FROM points) - k),
up(k, doc_id, root) AS (
  SELECT k, doc_id, doc_id FROM points, (VALUES (2), (3), (5), (9)) ks(k)
  UNION ALL SELECT up.k, doc_id, a FROM up JOIN parents p ON p.k = up.k AND b = root),
labels AS (SELECT k, doc_id, min(root) AS c FROM up GROUP BY ALL),
apart AS (SELECT p.doc_id AS i, q.doc_id AS j, list_distance(p.x, q.x) AS d FROM points p JOIN points q ON p.doc_id <> q.doc_id),
toward AS (
  SELECT l.k, i, l.c, m.c AS other, avg(d) AS d FROM apart JOIN labels l ON l.doc_id = i JOIN labels m ON m.doc_id = j AND m.k = l.k
  GROUP BY ALL),
samples AS (
  SELECT k, i, coalesce((b - a) / nullif(greatest(a, b), 0), 0) AS s FROM (
    SELECT k, i, min(d) FILTER (other = c) AS a, min(d) FILTER (other <> c) AS b FROM toward GROUP BY k, i)),
longs_of AS (SELECT k, c, doc_id, unnest(generate_series(1, len(x))) AS i, unnest(x) AS v FROM points JOIN labels USING (doc_id)),
middle AS (SELECT k, c, i, avg(v) AS m, count(*) AS n FROM longs_of GROUP BY ALL),
overall AS (SELECT k, i, avg(v) AS m FROM longs_of GROUP BY ALL),
within AS (SELECT k, sum((v - m) ** 2) AS w FROM longs_of JOIN middle USING (k, c, i) GROUP BY k),
between_ AS (SELECT k, sum(n * (middle.m - overall.m) ** 2) AS b FROM middle JOIN overall USING (k, i) GROUP BY k)
SELECT k, (SELECT {r6('avg(s)')} FROM samples WHERE samples.k = within.k) AS silhouette_score,
  {r6('(b / (k - 1)) / (w / ((SELECT count(*) FROM points) - k))')} AS calinski_harabasz_score, k::BIGINT AS n_clusters_found
FROM within JOIN between_ USING (k)""",
    "agglomerative_merges": f"""WITH RECURSIVE {tree('ward')}
SELECT b AS dead, a AS survivor, {r6('sqrt(d)')} AS height FROM merges""",
    "normalize_scores": f"""WITH {NORMALIZED} SELECT k, {r6('s')} AS silhouette_norm, {r6('d')} AS davies_bouldin_norm
FROM normalized""",
    "elbow_point": f"WITH {NORMALIZED} SELECT arg_max(k, distance) AS elbow_k FROM elbow",
    "elbow_distances": f"WITH {NORMALIZED} SELECT k, {r6('distance')} AS distance FROM elbow",
    "composite_score": f"WITH {NORMALIZED} SELECT k, {r6('composite_score')} AS composite_score FROM composite",
    "best_k": f"""WITH {NORMALIZED} SELECT arg_max(k, distance) AS elbow_k, arg_max(k, silhouette) AS silhouette_k,
  arg_min(k, davies_bouldin) AS davies_bouldin_k, arg_max(k, calinski_harabasz) AS calinski_harabasz_k,
  arg_max(k, composite_score) AS composite_k FROM composite""",
    "validate_separation": f"""WITH {SCORES}, p AS (SELECT max(k) AS k, arg_max(silhouette, k) AS s FROM scores)
SELECT coalesce((SELECT arg_max(c.k, c.silhouette) FROM scores c, p WHERE c.k <= greatest(2, p.k - 2)
  AND c.k > greatest(1, p.k - 5) AND c.silhouette > p.s AND p.s < 0.25), p.k) AS final_k FROM p""",
    "silhouette_euclidean": f"WITH {silhouettes('distance')} SELECT {r6('avg(s)')} AS silhouette_euclidean FROM samples",
    "silhouette_sampled": f"""WITH {POINTS}, strata AS (
  SELECT cluster_id, count(*) AS n, least(count(*), greatest(2, {q.SAMPLED} * count(*) // (SELECT count(*) FROM points)))::BIGINT AS taken
  FROM points GROUP BY cluster_id),
chosen AS (
  SELECT doc_id, x, cluster_id FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY md5('0:' || doc_id), doc_id) AS rank FROM points)
  JOIN strata USING (cluster_id) WHERE rank <= taken),
toward AS (
  SELECT c.doc_id, c.cluster_id, p.cluster_id AS other, avg(list_distance(c.x, p.x)) AS d
  FROM chosen c JOIN points p ON p.doc_id <> c.doc_id GROUP BY ALL),
samples AS (
  SELECT doc_id, cluster_id, coalesce((b - a) / nullif(greatest(a, b), 0), 0) AS s FROM (
    SELECT doc_id, cluster_id, min(d) FILTER (other = cluster_id) AS a, min(d) FILTER (other <> cluster_id) AS b
    FROM toward GROUP BY ALL)),
means AS (SELECT cluster_id, avg(s) AS mean, coalesce(var_samp(s), 0) AS spread FROM samples GROUP BY cluster_id)
SELECT sum(taken)::BIGINT AS n_sampled, {r6('sum(n * mean) / sum(n)')} AS silhouette_euclidean,
  {r6('sqrt(sum(n * n * (1 - taken / n) * spread / taken)) / sum(n)')} AS standard_error FROM means JOIN strata USING (cluster_id)""",
    "silhouette_cosine": f"WITH {silhouettes('cosine')} SELECT {r6('avg(s)')} AS silhouette_cosine FROM samples",
    "silhouette_samples": f"WITH {silhouettes('distance')} SELECT doc_id, cluster_id, {r6('s')} AS silhouette FROM samples",
    "cosine_samples": f"WITH {silhouettes('cosine')} SELECT doc_id, cluster_id, {r6('s')} AS silhouette FROM samples",
    "calinski_harabasz": f"WITH {DISTANCES} SELECT {r6(CALINSKI)} AS calinski_harabasz",
    "davies_bouldin": f"""WITH {DISTANCES}, spread AS (
  SELECT cluster_id, center, avg(distance) AS s FROM distances JOIN centers USING (cluster_id) GROUP BY ALL)
SELECT {r6('avg(worst)')} AS davies_bouldin FROM (
  SELECT a.cluster_id, max((a.s + b.s) / list_distance(a.center, b.center)) AS worst
  FROM spread a JOIN spread b ON a.cluster_id <> b.cluster_id GROUP BY a.cluster_id)""",
    "inertia": f"WITH {DISTANCES} SELECT {r6('sum(distance * distance)')} AS inertia FROM distances",
    "avg_distance_to_center": f"""WITH {DISTANCES} SELECT cluster_id, {r6('avg(distance)')} AS avg_distance_to_center
FROM distances GROUP BY cluster_id""",
    "intra_cluster_similarity": f"""WITH {PAIRS} SELECT ca AS cluster_id, {r6('avg(dot)')} AS intra_cluster_similarity
FROM pairs WHERE ca = cb AND id_a < id_b GROUP BY ca""",
    "intra_cluster_distance_pool": f"""WITH {PAIRS} SELECT {r6(POOL_MEAN)} AS avg_intra_cluster_distance,
  {r6(POOL_STD)} AS std_intra_cluster_distance""",
    "cluster_compactness": f"""WITH {PAIRS} SELECT cluster_id, {r6('coalesce(avg(distance), 0)')} AS avg_pairwise_distance
FROM points LEFT JOIN pairs ON ca = cluster_id AND cb = cluster_id AND id_a = doc_id AND id_a < id_b
GROUP BY cluster_id""",
    "distance_to_center_histogram": f"""WITH {DISTANCES}, l AS (
  SELECT min(distance) AS low, max(distance) AS high FROM distances)
SELECT least(floor(20 * (distance - low) / (high - low)), 19)::INT AS bin, count(*) AS n
FROM distances, l GROUP BY 1""",
    "quality_band": f"""WITH {silhouettes('cosine')} SELECT doc_id, CASE WHEN s > 0.5 THEN 'Excellent'
  WHEN s > 0.3 THEN 'Good' WHEN s > 0.1 THEN 'Fair' ELSE 'Poor' END AS quality FROM samples""",
    "cluster_sizes": f"WITH {POINTS}, {SIZES} SELECT cluster_id, size, {r6('percentage')} AS percentage FROM sizes",
    "cluster_summary": f"""WITH {DISTANCES}, {SIZES}, inner_pairs AS (
  SELECT a.cluster_id, avg(list_dot_product(a.x, b.x)) AS s FROM points a JOIN points b
  ON a.cluster_id = b.cluster_id AND a.doc_id < b.doc_id GROUP BY 1),
d AS (SELECT cluster_id, avg(distance) AS d FROM distances GROUP BY 1)
SELECT 'doc' || doc_id AS document_name, cluster_id, size, {r6('percentage')} AS percentage,
  {r6('d')} AS avg_distance_to_center, {r6('s')} AS intra_cluster_similarity, doc_id
FROM points JOIN sizes USING (cluster_id) JOIN d USING (cluster_id) JOIN inner_pairs USING (cluster_id)""",
    "cluster_info": f"""WITH {silhouettes('distance')}, {TO_MEANS}, {SIZES}
SELECT 'kmeans' AS algorithm, (SELECT count(*) FROM sizes) AS n_clusters, (SELECT count(*) FROM points) AS n_documents,
  {r6('(SELECT avg(s) FROM samples)')} AS silhouette_score, {r6(CALINSKI)} AS calinski_harabasz_score,
  cluster_id, size FROM sizes""",
    "clustering_evaluation": f"""WITH {silhouettes('distance')}, {TO_MEANS},
cosines AS (SELECT id_a, ca, cb, avg(cosine) AS d FROM pairs GROUP BY ALL),
cosine_samples AS (
  SELECT id_a, min(CASE WHEN ca = cb THEN d END) AS a, min(CASE WHEN ca <> cb THEN d END) AS b FROM cosines GROUP BY id_a)
SELECT (SELECT count(*) FROM centers) AS n_clusters, (SELECT count(*) FROM points) AS n_documents,
  {r6('(SELECT avg(s) FROM samples)')} AS silhouette_score,
  {r6('(SELECT avg((b - a) / greatest(a, b)) FROM cosine_samples)')} AS silhouette_cosine,
  {r6(CALINSKI)} AS calinski_harabasz_score, {r6(POOL_MEAN)} AS avg_intra_cluster_distance,
  {r6(POOL_STD)} AS std_intra_cluster_distance""",
    "cluster_ellipses": f"""WITH {POINTS}, m AS (
  SELECT cluster_id, count(*) AS n, avg(x[1]) AS center_x, avg(x[2]) AS center_y, var_samp(x[1]) AS a,
    var_samp(x[2]) AS c, covar_samp(x[1], x[2]) AS b FROM points GROUP BY cluster_id HAVING count(*) > 1),
e AS (SELECT *, (a + c) / 2 AS h, sqrt((a - c) ** 2 / 4 + b ** 2) AS r FROM m)
SELECT cluster_id, n, {r6('center_x')} AS center_x, {r6('center_y')} AS center_y, {r6('2 * sqrt(h + r)')} AS width,
  {r6('2 * sqrt(greatest(h - r, 0))')} AS height, {r6('degrees(atan2(2 * b, a - c) / 2)')} AS angle FROM e""",
    "content_names": content(lexicon.domain_rows(q.SAMPLE_LEXICON)),
    "content_names_default": content(lexicon.domain_rows()),
    "cluster_top_words": f"WITH {WORDS} SELECT cluster_id, rank, word, n FROM ranked WHERE rank <= 5",
    "domain_scores": f"""WITH {WORDS}, {domains(lexicon.domain_rows(q.SAMPLE_LEXICON))}
SELECT cluster_id, domain, score FROM scores""",
    "filename_keywords": f"WITH {FILE_WORDS} SELECT cluster_id, rank, word, n FROM ranked WHERE rank <= 3 AND n > 1",
    "filename_names": f"""WITH {FILE_WORDS} SELECT cluster_id, coalesce(word, 'group_' || cluster_id) || '_' || size ||
  'files' AS name FROM (SELECT cluster_id, count(*) AS size FROM texts GROUP BY 1)
LEFT JOIN (SELECT cluster_id, word FROM ranked WHERE rank = 1 AND n > 1) USING (cluster_id)""",
    "theme_names": f"""WITH {THEME_WORDS} SELECT cluster_id, CASE """
    + " ".join(f"WHEN list_has_any(w, [{word_list(words)}]) THEN '{name}'" for name, words in lexicon.THEMES)
    + """ ELSE coalesce(upper(w[1][1]) || w[1][2:], 'Mixed_Documents_' || cluster_id) END AS name
FROM (SELECT DISTINCT cluster_id FROM texts) LEFT JOIN top USING (cluster_id)""",
    "cluster_directories": f"WITH {TEXTS}, {NAMES}, {FOLDERS} SELECT cluster_id, cluster_dir FROM folders",
    "resolve_sources": f"WITH {TEXTS}, {FILES}, {RESOLVED} SELECT doc_id, source_path, length FROM resolved",
    "resolve_conflicts": CONFLICTS,
    "placement_manifest": f"WITH {MANIFEST} SELECT * FROM manifest",
    "organize_summary": f"""WITH {MANIFEST} SELECT count(*) AS total_files_processed,
  count(*) FILTER (success) AS successful_operations, count(*) FILTER (NOT success) AS failed_operations,
  {r6('count(*) FILTER (success) * 100.0 / count(*)')} AS success_rate FROM manifest""",
    "cluster_statistics": f"""WITH {TEXTS}, {NAMES}, {STATISTICS}
SELECT cluster_id, file_count, {r6('percentage')} AS percentage, name FROM statistics""",
    "cluster_files": f"""WITH {TEXTS}, {NAMES}, {STATISTICS} SELECT cluster_id, document_name, file_count,
  {r6('percentage')} AS percentage, name FROM texts JOIN statistics USING (cluster_id)""",
    "readable_report": REPORT,
    "breakdown_table": f"""WITH {TEXTS}, {NAMES}, {STATISTICS} SELECT cluster_id,
  name || ': ' || file_count || ' files (' || printf('%.1f', percentage) || '%)' AS line FROM statistics""",
    "document_table": f"""WITH {RECORDS}, {NAMES}
SELECT filename AS document, CASE WHEN success THEN coalesce(name, 'Cluster_' || cluster_id) END AS cluster,
  page_count AS pages, r.word_count AS words, CASE WHEN success THEN 'Success' ELSE 'Failed' END AS status
FROM records r JOIN texts USING (doc_id) LEFT JOIN names USING (cluster_id)""",
    "cluster_listing": f"""WITH {TEXTS}, {NAMES} SELECT cluster_id, coalesce(name, 'Cluster_' || cluster_id) AS cluster,
  document_name FROM texts LEFT JOIN names USING (cluster_id)""",
    "listing_summary": f"""WITH {TEXTS}, {NAMES}, head AS (SELECT unnest([repeat('=', 60),
    'Documents by cluster', repeat('=', 60), 'Documents: ' || count(*),
    'Clusters: ' || count(DISTINCT cluster_id), repeat('=', 60), 'Listing', repeat('=', 60)]) AS line,
  unnest(generate_series(0, 7)) AS part FROM texts),
c AS (SELECT DISTINCT cluster_id FROM texts)
SELECT 0 AS section, 0 AS cluster_id, part::INT AS part, '' AS item, line FROM head
UNION ALL SELECT 1, cluster_id, 0, '', coalesce(name, 'Cluster ' || cluster_id) FROM c LEFT JOIN names USING (cluster_id)
UNION ALL SELECT 1, cluster_id, 1, '', repeat('-', 40) FROM c
UNION ALL SELECT 1, cluster_id, 2, document_name || ' ' || doc_id, '  • ' || document_name FROM texts""",
    "archive_path": f"""WITH {TEXTS}, {NAMES} SELECT doc_id, replace(replace(replace(coalesce(name,
  'Cluster_' || cluster_id), '(', ''), ')', ''), ' ', '_') || '/' || document_name AS archive_path
FROM texts LEFT JOIN names USING (cluster_id)""",
}

ORACLES["scanned_rows"] = " UNION ALL ".join(f"SELECT '{name}.parquet' AS filename, count(*) AS n_rows FROM {name}" for name in q.SCANNED)
ORACLES["default_run"] = f"""WITH {TEXTS} SELECT count(*) AS total_files_processed,
  count(*) FILTER (lang <> 'fr') AS successful_operations, count(*) FILTER (lang = 'fr') AS failed_operations,
  {r6("count(*) FILTER (lang <> 'fr') * 100.0 / count(*)")} AS success_rate,
  true AS clusters_in_range, true AS every_cluster_named, true AS every_file_reported
FROM texts JOIN embeddings ON vec_id = doc_id"""
ORACLES["report_totals"] = ORACLES["organize_summary"]
ORACLES["report_listing"] = ORACLES["cluster_listing"]
ORACLES["report_placements"] = ORACLES["placement_manifest"]
ORACLES["report_text"] = f"SELECT line FROM ({REPORT}) WHERE line NOT LIKE 'Written: %' AND line NOT LIKE 'Folder: %'"
ORACLES["report_breakdown"] = f"WITH {TEXTS} SELECT doc_id, document_name, cluster_id FROM texts"
ORACLES["plan_quality"] = f"""WITH {SCORES} SELECT k, {r6('inertia')} AS inertia, {r6('silhouette')} AS silhouette,
  {r6('davies_bouldin')} AS davies_bouldin, {r6('calinski_harabasz')} AS calinski_harabasz FROM scores"""
ORACLES["fit_predict_dbscan"] = f"SELECT doc_id, cluster_id FROM ({ORACLES['dbscan']})"
ORACLES["kmeans_invariants"] = f"""WITH {POINTS} SELECT count(*) AS n, count(*) AS n_nearest, 8::BIGINT AS n_clusters,
  8::BIGINT AS n_means, true AS sizes_descend FROM points"""
