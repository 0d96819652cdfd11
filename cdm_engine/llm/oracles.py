"""SQL (DuckDB) for the queries that SQL can express, by definition: all windows, grouped and compared as strings."""

OP2_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), ordered AS (
    SELECT *, row_number() OVER w AS n, lag(role, 1, '') OVER w AS before,
        CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 END AS marks
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), judged AS (
    SELECT *, CASE WHEN (before = '' AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user')
        OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user') THEN NULL ELSE n - 1 END AS wrong
    FROM ordered
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(marks + length(text) + escapes) AS BIGINT) AS formatted_chars,
    min(wrong) IS NULL AND arg_max(role, n) = 'assistant' AS valid,
    coalesce(min(wrong), CASE WHEN arg_max(role, n) <> 'assistant' THEN count(*) ELSE -1 END) AS first_violation
FROM (SELECT *, len(regexp_extract_all(text, '\[\\*/?(INST|SYS|ROLE)\]|\[\\*/TURN\]|<\\*/?s>')) AS escapes FROM judged)
GROUP BY conv_id
"""

OP8_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS id,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT r, id, k, array_to_string(words[k : k + 49], ' ') AS w FROM (SELECT r, id, words, unnest(range(1, len(words) - 48)) AS k FROM docs)
), gone AS (
    SELECT DISTINCT r, unnest(range(k, k + 50)) AS k FROM (SELECT r, id, k, min(id) OVER (PARTITION BY w) AS first FROM windows) WHERE first < id
), placed AS (
    SELECT r, words[k] AS word, k FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS k FROM docs)
), kept AS (
    SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM placed ANTI JOIN gone USING (r, k) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

OP9_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
    SELECT r, k, substr(h, 2 * k + 1, 400) AS w FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS k FROM docs)
), again AS (
    SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY w) AS n FROM windows) WHERE n > 1
), runs AS (
    SELECT r, min(k) AS lo, max(k) + 200 AS hi FROM (SELECT r, k, sum(new) OVER (PARTITION BY r ORDER BY k) AS g
        FROM (SELECT r, k, CASE WHEN k - lag(k) OVER (PARTITION BY r ORDER BY k) <= 200 THEN 0 ELSE 1 END AS new FROM again)) GROUP BY r, g
), kept AS (
    SELECT r, h, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before, lead(lo) OVER (PARTITION BY r ORDER BY lo) IS NULL AS last FROM docs JOIN runs USING (r)
), left_over AS (
    SELECT r, count(*) AS n_spans, sum(hi - lo) AS n_removed,
        string_agg(substr(h, 2 * before + 1, 2 * (lo - before)) || CASE WHEN last THEN substr(h, 2 * hi + 1) ELSE '' END, '' ORDER BY lo) AS h FROM kept GROUP BY r
)
SELECT doc_id, CAST(length(docs.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(left_over.h, docs.h))) AS kept_sha256
FROM docs LEFT JOIN left_over USING (r)
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP10_SQL = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents
), items AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS words FROM benchmark
), windows AS (
    SELECT DISTINCT item, w FROM (SELECT item, words[k : k + least(len(words), 10) - 1] AS w FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS k FROM items WHERE len(words) > 0))
), phrases AS (
    SELECT row_number() OVER () AS p, w, len(w) AS size FROM (SELECT DISTINCT w FROM windows)
), found AS (
    SELECT r, k, p, size FROM (
        SELECT r, k, size AS s, array_to_string(words[k : k + size - 1], ' ') AS t FROM docs, (SELECT DISTINCT size FROM phrases), unnest(range(1, greatest(len(words) - size + 2, 1))) AS u(k)
    ) JOIN phrases ON size = s AND array_to_string(w, ' ') = t
), hit AS (
    SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(k, k + size)) AS j FROM found) GROUP BY r
), named AS (
    SELECT r, list_sort(list(DISTINCT item)) AS ids FROM found JOIN phrases USING (p) JOIN windows ON windows.w = phrases.w GROUP BY r
), placed AS (
    SELECT r, words[k] AS word, k FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS k FROM docs)
), terms AS (
    SELECT p, size, w[o] AS word, o FROM (SELECT p, size, w, unnest(range(1, size + 1)) AS o FROM phrases)
), seeds AS (
    SELECT p, size, word, o FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY coalesce(n, 0), o) AS c FROM terms LEFT JOIN (SELECT word, count(*) AS n FROM placed GROUP BY word) USING (word)) WHERE c = 1
), starts AS (
    SELECT p, size, r, k - o + shift AS s FROM seeds JOIN placed USING (word), (VALUES (-1), (0), (1)) AS v(shift)
), close AS (
    SELECT DISTINCT p, r FROM (
        SELECT starts.p, starts.r, s FROM starts JOIN terms ON terms.p = starts.p JOIN placed ON placed.r = starts.r AND placed.word = terms.word AND abs(placed.k - (s + terms.o)) <= 1
        GROUP BY starts.p, starts.r, s, starts.size HAVING count(DISTINCT terms.o) = starts.size)
), near AS (
    SELECT r, count(DISTINCT item) AS n FROM close JOIN phrases USING (p) JOIN windows ON windows.w = phrases.w GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
    sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, coalesce(near.n, 0) AS n_near
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r) LEFT JOIN near USING (r)
"""

#: floor(s / n) of whole numbers, also negative ones.
_FLOOR = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def op11_sql(k: int = 8, rounds: int = 10) -> str:
    """Every round spelled out: all distances to all centroids, then the means by component."""
    nearest = lambda i: (
        f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, cluster := cluster)) AS m FROM (SELECT r, cluster, "
        f"list_sum([(kept.v[j] - c{i}.v[j]) * (kept.v[j] - c{i}.v[j]) for j in range(1, 65)]) AS d FROM kept, c{i}) GROUP BY r)"
    )
    steps = []
    for i in range(rounds):
        steps += [
            nearest(i),
            f"s{i} AS (SELECT cluster, j, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT m.cluster AS cluster, unnest(v) AS x, unnest(range(64)) AS j FROM a{i} JOIN kept USING (r)) GROUP BY cluster, j)",
            f"c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT cluster, list({_FLOOR} ORDER BY j) AS v FROM s{i} GROUP BY cluster) AS m USING (cluster))",
        ]
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
    WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(CAST(x AS DOUBLE))]) = 64
), c0 AS MATERIALIZED (
    SELECT CAST(place - 1 AS INTEGER) AS cluster, v FROM (SELECT v, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) AS place FROM kept) WHERE place <= {k}
), {", ".join(steps)}, {nearest(rounds)}, per AS (
    SELECT m.cluster AS cluster, CAST(sum(m.d) AS BIGINT) AS cluster_inertia, count(*) AS cluster_size FROM a{rounds} GROUP BY 1
)
SELECT vec_id, cluster, CAST(m.d AS BIGINT) AS distance, cluster_inertia, CAST((SELECT sum(cluster_inertia) FROM per) AS BIGINT) AS inertia,
    sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256, cluster_size
FROM a{rounds} JOIN kept USING (r) JOIN per ON per.cluster = m.cluster JOIN c{rounds} USING (cluster)
"""


def op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round spelled out: all distances of a part to all entries of its codebook, then the means by component."""
    nearest = lambda i: (
        f"a{i} AS MATERIALIZED (SELECT r, p, min(struct_pack(d := d, e := e)) AS m FROM (SELECT r, p, e, "
        f"list_sum([(w[j] - c[j]) * (w[j] - c[j]) for j in range(1, len(w) + 1)]) AS d FROM cut JOIN c{i} USING (p)) GROUP BY r, p)"
    )
    steps = []
    for i in range(rounds):
        steps += [
            nearest(i),
            f"s{i} AS (SELECT p, e, j, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT p, m.e AS e, unnest(w) AS x, unnest(range(len(w))) AS j FROM a{i} JOIN cut USING (r, p)) GROUP BY p, e, j)",
            f"c{i + 1} AS MATERIALIZED (SELECT c{i}.p, c{i}.e, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT p, e, list({_FLOOR} ORDER BY j) AS c FROM s{i} GROUP BY p, e) AS m USING (p, e))",
        ]
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
    WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NOT NULL AND isfinite(CAST(x AS DOUBLE))]) = len(embedding)
), cut AS MATERIALIZED (
    SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS w FROM (SELECT r, v, unnest(range({parts})) AS p FROM kept)
), c0 AS MATERIALIZED (
    SELECT p, place - 1 AS e, w AS c FROM cut JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS place FROM kept) USING (r) WHERE place <= {entries}
), {", ".join(steps)}, {nearest(rounds)}, coded AS (
    SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256, label
FROM coded JOIN kept USING (r)
"""
