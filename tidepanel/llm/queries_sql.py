"""DuckDB SQL of the training-data queries that SQL can express."""

# Component x becomes floor(256 x); doubles hold the sums exactly.
OP6_SEARCH = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

# The checksum is worked out byte by byte with the 256 remainders that eight shift steps give.
OP2_SHARDS = """
WITH RECURSIVE steps(i, step, c) AS (
    SELECT i::BIGINT, 0, i::BIGINT FROM range(256) t(i)
    UNION ALL
    SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE step < 8
), remainders AS (
    SELECT list(c ORDER BY i) AS r FROM steps WHERE step = 8
), rows AS (
    SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS g,
        (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size
    FROM documents
), bytes AS (
    SELECT g, list_transform(regexp_extract_all(hex(encode(any_value(text))), '..'), lambda x: ('0x' || x)::BIGINT) AS b
    FROM rows GROUP BY g
), sums AS (
    SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(r[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS text_crc32
    FROM bytes, remainders
), placed AS (
    SELECT doc_id, g, size,
        (coalesce(sum(size) OVER (ORDER BY g, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before,
        row_number() OVER (ORDER BY g, doc_id) - 1 AS n
    FROM rows
), total AS (
    SELECT sum(size)::BIGINT AS total FROM rows
), groups AS (
    SELECT g, min(before) AS low, max(before + size) AS high FROM placed GROUP BY g
), targets AS (
    SELECT k, (total * k) // 8 AS t, total FROM total, range(1, 8) r(k)
), cuts AS (
    SELECT k, coalesce(max(CASE WHEN t - low <= high - t THEN low ELSE high END), any_value(t)) AS cut
    FROM targets LEFT JOIN groups ON low < t AND t < high AND (high - low) * 512 <= total
    GROUP BY k
), sharded AS (
    SELECT p.*, (SELECT count(*) FROM cuts WHERE 2 * p.before + p.size > 2 * cut)::INTEGER AS shard FROM placed p
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, n - min(n) OVER (PARTITION BY shard) AS slot,
    NULL::INTEGER AS grown_shard
FROM sharded JOIN sums USING (g)
"""

# Checksums as above, once per distinct feature; a feature is a word or two neighbouring ones.
OP11_RESAMPLING = """
WITH RECURSIVE steps(i, step, c) AS (
    SELECT i::BIGINT, 0, i::BIGINT FROM range(256) t(i)
    UNION ALL
    SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE step < 8
), remainders AS (
    SELECT list(c ORDER BY i) AS r FROM steps WHERE step = 8
), texts AS (
    SELECT row_number() OVER () AS n, 'd' AS side, doc_id, text FROM documents
    UNION ALL
    SELECT row_number() OVER (), 'b', NULL, text FROM benchmark
), words AS (
    SELECT n, side, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM texts
), features AS (
    SELECT n, side, unnest(w) AS f FROM words
    UNION ALL
    SELECT n, side, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
), grouped AS (
    SELECT n, side, f, count(*) AS times FROM features GROUP BY ALL
), bytes AS (
    SELECT f, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::BIGINT) AS b
    FROM (SELECT DISTINCT f FROM grouped)
), buckets AS (
    SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(r[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 10000 AS bucket
    FROM bytes, remainders
), placed AS (
    SELECT n, side, bucket, sum(times)::BIGINT AS times FROM grouped JOIN buckets USING (f) GROUP BY ALL
), counted AS (
    SELECT bucket, coalesce(sum(times) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s, coalesce(sum(times) FILTER (WHERE side = 'b'), 0)::DOUBLE AS t
    FROM placed GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counted) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counted) + 10000)))) AS gain
    FROM counted
), weights AS (
    SELECT n, sum(times)::BIGINT AS n_features, floor(sum(times * gain) / sum(times))::BIGINT AS weight
    FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY n
), scored AS (
    SELECT n, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
    FROM words LEFT JOIN weights USING (n) WHERE side = 'd'
), ranked AS (
    SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS eligible FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * eligible // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (n)
"""


def vector_codes_sql(rounds: int = 4) -> str:
    """Rounds of assignments over all pairs of part and entry; integers in doubles, which are exact here."""
    nearest = """
    SELECT id, p, min_by(k, struct_pack(d := d, k := k)) AS k, min(d) AS d
    FROM (
        SELECT id, parts.p AS p, k, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d
        FROM parts JOIN {book} book ON parts.p = book.p
    ) GROUP BY id, p"""
    steps = []
    for r in range(rounds):
        steps.append(f"near{r} AS MATERIALIZED ({nearest.format(book=f'book{r}')})")
        steps.append(f"""book{r + 1} AS MATERIALIZED (
    SELECT p, k, coalesce(moved.c, book{r}.c) AS c
    FROM book{r} LEFT JOIN (
        SELECT p, k, list(m ORDER BY i) AS c
        FROM (SELECT p, k, i, floor(sum(x[i]) / count(*)) AS m FROM near{r} JOIN parts USING (id, p), range(1, 1 + (SELECT max(len(x)) FROM parts)) r(i) GROUP BY p, k, i)
        GROUP BY p, k
    ) moved USING (p, k))""")
    return f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), parts AS MATERIALIZED (
    SELECT id, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, range(4) r(p)
), book0 AS MATERIALIZED (
    SELECT p, id - 1 AS k, x AS c FROM parts WHERE id <= 256
), {", ".join(steps)}, final AS MATERIALIZED ({nearest.format(book=f"book{rounds}")}
), coded AS (
    SELECT vec_id, label, code, error
    FROM kept JOIN (SELECT id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM final GROUP BY id) USING (id)
), digest AS (
    SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, k)) AS codebooks_sha256
    FROM book{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded, digest
"""


ORACLES = {
    "op2_shards": OP2_SHARDS,
    "op6_search": OP6_SEARCH,
    "op11_resampling": OP11_RESAMPLING,
    "op13_vector_codes": vector_codes_sql(),
}
