"""DuckDB SQL for the queries of this package that SQL can express.

Mixing orders by a hash, personal data and licences add what their methods find, packing needs a
tokenizer, the two fingerprint queries hash shingles and byte windows, and language model and
conversations need a CRC: those are tested against brute-force versions.
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op4_warc": """
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id, sha1(payload) AS hex FROM payloads),
        bits AS (
            SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr(
                '0000000100100011010001010110011110001001101010111100110111101111',
                (strpos('0123456789abcdef', substr(hex, i, 1)) - 1) * 4 + 1, 4)), '') AS b
            FROM firsts
        )
        SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                16 * CAST(substr(b, 5 * k + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * k + 2, 1) AS INT)
                + 4 * CAST(substr(b, 5 * k + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * k + 4, 1) AS INT)
                + CAST(substr(b, 5 * k + 5, 1) AS INT) + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM bits
    """,
    "op5_quality_rules": rf"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
        ),
        windows AS (
            SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
        ),
        repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
            SELECT doc_id, unnest(range(i, i + 8)) AS p FROM repeated) GROUP BY doc_id),
        lines AS (
            SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
            WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id
        ),
        m AS (
            SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
                length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words,
                len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS n_letter_words,
                coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word
            FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
        ),
        bits AS (
            SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
                + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END
                + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
                + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
                + CASE WHEN 2 * n_letter_words < n_words THEN 64 ELSE 0 END
                + CASE WHEN longest_word > 1000 THEN 128 ELSE 0 END AS failure_bits
            FROM m
        )
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
            CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
            CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failure_bits & 3 <> 0 AS base_failed,
            failure_bits & 127 = 0 AS kept, CAST(failure_bits AS BIGINT) AS failure_bits
        FROM bits
    """,
    "op8_url_filters": r"""
        WITH rows AS (
            SELECT page_id, DATE '2024-01-01' + CAST((page_id * 7) % 366 AS INT) AS fetched_on,
                coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host
            FROM pages
        ),
        hosts AS (SELECT host, ('0x' || substr(md5(host), 1, 6))::BIGINT AS h FROM (SELECT DISTINCT host FROM rows WHERE host <> '')),
        named AS (
            SELECT h, ['spam', 'adult', 'allow'][h % 3 + 1] AS list,
                CASE WHEN h % 4 = 0 AND host LIKE '%.%.%' THEN substr(host, strpos(host, '.') + 1) ELSE host END AS domain
            FROM hosts
        ),
        entries AS (
            SELECT list, domain, h % 150 AS d, TRUE AS added FROM named
            UNION ALL SELECT list, domain, h % 150 + 30 + h % 101, FALSE FROM named
            UNION ALL SELECT list, domain, h % 150 + 170 + h % 67, h % 2 = 0 FROM named
        ),
        daily AS (
            SELECT list, domain, DATE '2024-01-01' + CAST(d AS INT) AS day, bool_and(added) AS added
            FROM entries GROUP BY list, domain, d
        ),
        held AS (
            SELECT list, domain, day AS since, added,
                coalesce(lead(day) OVER (PARTITION BY list, domain ORDER BY day), DATE '9999-12-31') AS until
            FROM daily
        ),
        met AS (
            SELECT page_id, domain, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, bool_or(list = 'allow') AS allowed
            FROM rows JOIN held ON added AND fetched_on >= since AND fetched_on < until
                AND (host = domain OR ends_with(host, '.' || domain))
            GROUP BY page_id, domain
        ),
        best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC) = 1)
        SELECT page_id, fetched_on, host, coalesce(NOT allowed, FALSE) AS blocked, domain, lists
        FROM rows LEFT JOIN best USING (page_id)
    """,
    "op9_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
        windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM starts),
        later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
        covered AS (
            SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later) GROUP BY doc_id
        ),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        marked AS (
            SELECT words.doc_id, word, p, c.p IS NOT NULL AS gone
            FROM words LEFT JOIN (SELECT doc_id, unnest(gone) AS p FROM covered) c USING (doc_id, p)
        ),
        kept AS (
            SELECT doc_id, count_if(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept
            FROM marked GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
            sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op12_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ),
        w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
        totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
        starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        grams AS (SELECT lang, w[i:i + k - 1] AS g FROM starts, range(1, 6) AS sizes(k) WHERE i + k - 1 <= len(w)),
        f AS (SELECT lang, g, CAST(count(*) AS HUGEINT) AS c FROM grams GROUP BY lang, g HAVING count(*) >= 100),
        phrases AS (SELECT * FROM f WHERE len(g) > 1),
        inside AS (
            SELECT DISTINCT lang, g[i:i + k - 1] AS g, c
            FROM (SELECT lang, g, c, unnest(range(1, len(g))) AS i FROM phrases WHERE len(g) > 2), range(2, 5) AS sizes(k)
            WHERE k < len(g) AND i + k - 1 <= len(g)
        ),
        kept AS (
            SELECT * FROM phrases AS p
            WHERE NOT EXISTS (SELECT 1 FROM inside AS o WHERE o.lang = p.lang AND o.g = p.g AND 100 * o.c >= 100 * p.c)
        ),
        cuts AS (SELECT lang, g, c, unnest(range(1, len(g))) AS k FROM kept),
        scored AS (
            SELECT cuts.lang, cuts.g, cuts.c AS a, k, x.c AS l, y.c AS r, n, (1000 * cuts.c * n) // (x.c * y.c) AS score
            FROM cuts JOIN totals ON totals.lang = cuts.lang
            JOIN f AS x ON x.lang = cuts.lang AND x.g = cuts.g[1:k]
            JOIN f AS y ON y.lang = cuts.lang AND y.g = cuts.g[k + 1:len(cuts.g)]
        ),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        ranked AS (
            SELECT *, array_to_string(g, ' ') AS phrase,
                row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
            FROM lowest
        )
        SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
            CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM ranked WHERE rank <= 2000
    """,
}
