"""DuckDB SQL for the queries that SQL can express."""

#: CRC-32 of a text's bytes, unsigned; the table is built from the polynomial.
CRC = """list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
            lambda crc, b: xor(crc >> 8, crc_table[1 + (xor(crc, b) & 255)]))"""

ORACLES = {
    "op4_sharding": f"""
        WITH RECURSIVE bits AS (
            SELECT i, i AS c, 0 AS k FROM range(256) t(i)
            UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS crc_table FROM bits WHERE k = 8),
        sized AS (
            SELECT doc_id, strlen(body) + 8 AS size, xor({CRC}, 4294967295) AS text_crc32
            FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents), crc),
        summed AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM sized),
        cut AS (SELECT *, CAST(least((2 * upto - size) * 24 // (2 * total), 23) AS INTEGER) AS shard FROM summed)
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM cut
    """,
    # quantiles are exact here; a sketch equals them on tables of this size
    "op8_quality": r"""
        WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS body FROM documents),
        words AS (
            SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos
            FROM (SELECT doc_id, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w FROM texts)),
        counted AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY doc_id),
        windows AS (
            SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS times
            FROM (SELECT *, lead(word) OVER same AS w2, lead(word, 2) OVER same AS w3 FROM words WINDOW same AS (PARTITION BY doc_id ORDER BY pos))
            WHERE w3 IS NOT NULL),
        repeated AS (
            SELECT doc_id, count(DISTINCT place) AS n_repeat_words
            FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS place FROM windows WHERE times > 1) GROUP BY doc_id),
        lines AS (
            SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
            FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        base AS (
            SELECT doc_id, lang, source, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
                   length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
                   coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM texts LEFT JOIN counted USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
        failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
        ratios AS (
            SELECT doc_id, lang, source, rule, ln((c + more) / of) AS x, CASE WHEN c > 0 THEN ln(c / of) END AS own, reach, low
            FROM (SELECT doc_id, lang, source, unnest([
                {'rule': 'length', 'c': word_chars, 'of': n_words, 'more': 0.0, 'reach': 12.0, 'low': true},
                {'rule': 'symbols', 'c': n_symbols, 'of': n_words, 'more': 0.5, 'reach': 10.0, 'low': false},
                {'rule': 'lines', 'c': n_dup_lines, 'of': greatest(n_lines, 1), 'more': 0.5, 'reach': 3.0, 'low': false},
                {'rule': 'words', 'c': n_repeat_words, 'of': n_words, 'more': 0.5, 'reach': 8.0, 'low': false}], recursive := true)
                FROM failed WHERE NOT base_failed)),
        g AS (SELECT lang, source, rule, count(*) AS n, quantile_disc(x, 0.25) AS lo, quantile_disc(x, 0.5) AS mid FROM ratios GROUP BY ALL),
        l AS (SELECT lang, rule, count(*) AS n, quantile_disc(x, 0.25) AS lo, quantile_disc(x, 0.5) AS mid FROM ratios GROUP BY ALL),
        a AS (SELECT rule, count(*) AS n, quantile_disc(x, 0.25) AS lo, quantile_disc(x, 0.5) AS mid FROM ratios GROUP BY ALL),
        placed AS (
            SELECT r.*, CASE WHEN g.n >= 100 THEN g.lo WHEN l.n >= 100 THEN l.lo WHEN a.n >= 100 THEN a.lo END AS lo,
                   CASE WHEN g.n >= 100 THEN g.mid WHEN l.n >= 100 THEN l.mid WHEN a.n >= 100 THEN a.mid END AS mid
            FROM ratios r JOIN g ON g.rule = r.rule AND g.lang IS NOT DISTINCT FROM r.lang AND g.source IS NOT DISTINCT FROM r.source
                 JOIN l ON l.rule = r.rule AND l.lang IS NOT DISTINCT FROM r.lang JOIN a ON a.rule = r.rule),
        verdict AS (
            SELECT doc_id, bool_and(coalesce(own <= mid + greatest(mid - lo, 0.005) * reach, true)
                                    AND (NOT low OR coalesce(own >= mid - greatest(mid - lo, 0.005) * reach, true))) AS inside
            FROM placed GROUP BY doc_id)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND coalesce(inside, true) AS kept, n_lines, lang, source
        FROM failed LEFT JOIN verdict USING (doc_id)
    """,
    "op3_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op5_chat_format": """
        WITH starts AS (SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY conv_id),
        heads AS (SELECT conv_id, min(coalesce(text, '')) AS head FROM conversations JOIN starts USING (conv_id, turn) GROUP BY conv_id),
        placed AS (SELECT conv_id, row_number() OVER (ORDER BY head, conv_id) - 1 AS pos FROM heads),
        pairs AS (
            SELECT pos // 2 AS pair_id, max(conv_id) FILTER (pos % 2 = 0) AS chosen_id, max(conv_id) FILTER (pos % 2 = 1) AS rejected_id
            FROM placed GROUP BY pos // 2),
        sides AS (
            SELECT pair_id, chosen_id AS conv_id, 'chosen' AS side FROM pairs
            UNION ALL SELECT pair_id, rejected_id, 'rejected' FROM pairs),
        met AS (SELECT pair_id, side, turn, list(coalesce(role, '') || chr(0) || coalesce(text, '') ORDER BY role, text) AS says
                FROM conversations JOIN sides USING (conv_id) GROUP BY ALL),
        ends AS (
            SELECT pair_id, min(turn) AS until
            FROM (SELECT * FROM met WHERE side = 'chosen') c FULL JOIN (SELECT * FROM met WHERE side = 'rejected') r USING (pair_id, turn)
            WHERE c.says IS DISTINCT FROM r.says GROUP BY pair_id)
        SELECT s.pair_id, CASE WHEN turn < coalesce(until, 9223372036854775807) THEN 'prompt' ELSE side END AS part,
               conv_id, turn, coalesce(role, '') AS role,
               '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered,
               turn >= coalesce(until, 9223372036854775807) AND role = 'assistant' AS learn
        FROM conversations JOIN sides s USING (conv_id) LEFT JOIN ends e ON e.pair_id = s.pair_id
        WHERE side = 'chosen' OR turn >= coalesce(until, 9223372036854775807)
    """,
    "op7_warc_audit": """
        WITH made AS (
            SELECT page_id, 'WARC/1.0' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e
                   || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'Content-Type: application/http; msgtype=response' || e
                   || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') || e || e AS record
            FROM pages, (SELECT chr(13) || chr(10) AS e)),
        cut AS (SELECT *, page_id % 101 = 100 AS corrupted, sum(strlen(record)) OVER (ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS upto FROM made)
        SELECT page_id, CAST(upto - strlen(record) AS BIGINT) AS start_byte, CAST(upto AS BIGINT) AS end_byte,
               sha256(record) AS record_sha256,
               CASE WHEN corrupted THEN sha256(left(record, length(record) - 1) || '!') ELSE sha256(record) END AS replica_sha256,
               corrupted
        FROM cut
    """,
}
