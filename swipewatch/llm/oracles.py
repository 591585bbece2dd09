"""DuckDB SQL for the rows of the queries that SQL can express."""

ORACLES = {}

ORACLES["op5_exact_dedup"] = r"""
WITH plain AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), grouped AS (
    SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM plain GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM plain JOIN grouped USING (t)
"""

ORACLES["op3_decontaminate"] = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
    FROM documents
), items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item, n, list_aggregate(w[s : s + n - 1], 'string_agg', ' ') AS t
    FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s
          FROM items WHERE len(w) > 0)
), found AS (
    SELECT doc_id, s, p.n, item
    FROM (SELECT doc_id, n, s, list_aggregate(w[s : s + n - 1], 'string_agg', ' ') AS t
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
                FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)) p
    JOIN windows v ON p.t = v.t AND p.n = v.n
), places AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM found) GROUP BY doc_id
), ids AS (
    SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids
    FROM found GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN places USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

# payloads as DuckDB sees them; URL keys and the order of histories are tested by themselves
ORACLES["op6_warc"] = r"""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h,
           max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
    FROM pages
)
SELECT page_id, strlen(body) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
           (CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) % 32
           AS BIGINT), 1) for k in range(32)], '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM p
"""

ORACLES["op11_hard_negatives"] = r"""
WITH taken AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), scored AS (
    SELECT a.id AS anchor_id, r.id AS id, a.label = r.label AS same,
           CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda k: a.q[k] * r.q[k])) AS BIGINT) AS score
    FROM taken a CROSS JOIN taken r
    WHERE a.id % 100 = 0
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same AND id <> anchor_id
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

ORACLES["op12_substrings"] = r"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents
), windows AS (
    SELECT doc_id, s, md5(list_aggregate(w[s : s + 49], 'string_agg', ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM split WHERE len(w) >= 50)
), repeated AS (
    SELECT doc_id, s FROM windows JOIN (SELECT h, min(doc_id) AS low FROM windows GROUP BY h) USING (h) WHERE low < doc_id
), gone AS (
    SELECT DISTINCT doc_id, s + k AS place FROM (SELECT doc_id, s, unnest(range(50)) AS k FROM repeated)
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS t
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM split)
    ANTI JOIN gone USING (doc_id, place)
    GROUP BY doc_id
), removed AS (
    SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
