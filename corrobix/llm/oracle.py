"""DuckDB SQL for the operators that SQL can express, over the same tables."""

# Lower-cased words, 4-word shingles as text, all pairs that share one, and everything reachable over links.
OP2_NGRAM_JACCARD = r"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, list_filter(string_split_regex(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), grams AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM split
), sets AS (SELECT g, min(doc_id) AS rep FROM grams WHERE len(g) > 0 AND doc_id IS NOT NULL GROUP BY g
), member AS (SELECT r, doc_id, CAST(len(g) AS BIGINT) AS n, rep FROM grams LEFT JOIN sets USING (g)
), tokens AS (SELECT rep, CAST(len(g) AS BIGINT) AS n, unnest(g) AS t FROM sets
), pairs AS (
  SELECT x.rep AS a, y.rep AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.rep < y.rep
  GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT doc_id, rep FROM member WHERE n > 0 UNION SELECT rep, doc_id FROM member WHERE n > 0
), reach AS (SELECT DISTINCT a AS doc_id, a AS root FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.root = links.a
), low AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT m.doc_id, m.n AS n_shingles, CASE WHEN m.n = 0 THEN m.doc_id ELSE low.component_id END AS component_id FROM member m LEFT JOIN low ON m.doc_id = low.doc_id
"""

# All pairs of vectors by cosine, and everything reachable.
OP4_EMBEDDING_DEDUP = r"""
WITH RECURSIVE raw AS (
  SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), good AS (
  SELECT r, vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM raw
  WHERE vec_id IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT x.r AS a, y.r AS b FROM good x JOIN good y ON x.r <> y.r AND len(x.v) = len(y.v) WHERE list_sum(list_transform(list_zip(x.v, y.v), lambda p: p[1] * p[2])) / x.norm / y.norm >= 0.95
), reach AS (SELECT r, r AS root FROM good UNION SELECT reach.r, pairs.b FROM reach JOIN pairs ON reach.root = pairs.a
), low AS (SELECT reach.r, min(raw.vec_id) AS component_id FROM reach JOIN raw ON raw.r = reach.root GROUP BY reach.r
), counts AS (SELECT a AS r, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(vec_id = coalesce(component_id, vec_id), false) AS kept
FROM raw LEFT JOIN low USING (r) LEFT JOIN counts USING (r)
"""

# Windows of 13 words as text, the smallest document of each, and the words that no repeated window covers.
OP7_SUBSTRING_DEDUP = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i : i + 12], ' '))) AS s FROM split WHERE len(w) >= 13 AND doc_id IS NOT NULL
), first AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s
), bad AS (SELECT r, i FROM windows JOIN first USING (s) WHERE first < doc_id
), gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS k FROM bad
), words AS (SELECT r, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM split
), kept AS (SELECT words.r, count(*) AS n_kept, string_agg(word, ' ' ORDER BY words.k) AS text FROM words LEFT JOIN gone ON words.r = gone.r AND words.k = gone.k WHERE gone.r IS NULL GROUP BY words.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (r)
"""

# Lines as text, the documents that hold each key, and the lines that stay.
OP11_LINE_DEDUP = r"""
WITH docs AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), lines AS (SELECT r, doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM docs
), keyed AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines
), common AS (SELECT key, max(doc_id) AS stays FROM keyed WHERE length(key) >= 20 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (SELECT r, i, line, coalesce(doc_id <> stays, false) AS gone FROM keyed LEFT JOIN common USING (key)
), joined AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM judged GROUP BY r)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs JOIN joined USING (r)
"""

# Terms by language and source, every kept term with every source, shares and differences in wide integers.
OP12_SOURCE_DIVERGENCE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), words AS (SELECT r, lang, source, unnest(w) AS term FROM docs
), kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), sources AS (SELECT DISTINCT lang, source FROM docs
), counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL
), every AS (SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n FROM sources s JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), share AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM every JOIN v USING (lang)
), whole AS (SELECT lang, term, sum(n) AS n FROM every GROUP BY lang, term
), base AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM whole JOIN v USING (lang)
), far AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM share x JOIN share y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM share JOIN base USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def _op13_centroids(rounds: int = 10) -> str:
    """Every round as two named tables: the nearest centroid of each vector, and where the centroids move."""
    near = "SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, k.c, list_sum(list_transform(list_zip(v.x, k.x), lambda p: CAST(p[1] - p[2] AS HUGEINT) * (p[1] - p[2]))) AS d FROM vectors v, {k} k) GROUP BY r"
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(k=f'k{i}')})")
        steps.append(f"m{i} AS (SELECT c, list(m ORDER BY i) AS x FROM (SELECT c, i, CAST(floor_div(sum(e), count(*)) AS BIGINT) AS m FROM (SELECT a.c, unnest(range(1, 65)) AS i, unnest(v.x) AS e FROM a{i} a JOIN vectors v USING (r)) GROUP BY c, i) GROUP BY c)".replace("floor_div(sum(e), count(*))", "((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*))"))
        steps.append(f"k{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, k.x) AS x FROM k{i} k LEFT JOIN m{i} m USING (c))")
    return (
        "WITH vectors AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0), "
        "k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), array_to_string(x, ',')) - 1 AS c, x FROM vectors WHERE vec_id IS NOT NULL QUALIFY c < 8), "
        + ", ".join(steps)
        + f", last AS MATERIALIZED ({near.format(k=f'k{rounds}')}) SELECT v.vec_id, CAST(l.c AS INTEGER) AS cluster, CAST(l.d AS BIGINT) AS distance, CAST(sum(l.d) OVER (PARTITION BY l.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(l.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256 FROM vectors v JOIN last l USING (r) JOIN k{rounds} k ON k.c = l.c"
    )


ORACLE_SQL = {
    "op2_ngram_jaccard": OP2_NGRAM_JACCARD,
    "op4_embedding_dedup": OP4_EMBEDDING_DEDUP,
    "op7_substring_dedup": OP7_SUBSTRING_DEDUP,
    "op11_line_dedup": OP11_LINE_DEDUP,
    "op12_source_divergence": OP12_SOURCE_DIVERGENCE,
    "op13_centroid_clusters": _op13_centroids(),
}
