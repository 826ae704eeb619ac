"""The queries' SQL, where SQL can express them."""

ORACLES = {
    "op5_url_filters": """
        WITH cut AS (
            SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), parts AS (
            SELECT page_id, coalesce(url, '') AS url,
                   translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ), rules(rule, rule_host, rule_path, rule_verdict) AS (
            VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                   ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
        ), won AS (
            SELECT page_id, host, path, url, (
                SELECT max_by(struct_pack(r := rule, v := rule_verdict), length(rule)) FROM rules
                WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            ) AS best
            FROM parts
        )
        SELECT page_id, host, path, best.r AS rule, coalesce(best.v, CASE
            WHEN regexp_matches(url, '(?i)://[^/?#]*\\b(casino|pills|adult|(poker|roulette)-?online)\\b')
              OR regexp_matches(url, '(?i)\\.(exe|msi|apk)([?#]|$)') THEN 'block' ELSE 'allow' END) AS verdict
        FROM won
    """,
    "op10_decontamination": """
        WITH doc_words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM documents
        ), item_words AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n,
                   array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS words
            FROM item_words, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(k) WHERE len(w) > 0
        ), sizes AS (SELECT DISTINCT n FROM windows),
        doc_windows AS (
            SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS words
            FROM doc_words, sizes, unnest(range(1, len(w) - n + 2)) AS t(k) WHERE len(w) >= n
        ), found AS (
            SELECT d.doc_id, d.k, d.n, i.item_id FROM doc_windows d JOIN windows i ON d.n = i.n AND d.words = i.words
        ), hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(k, k + n)) AS t(p) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op4_near_vectors": """
        WITH RECURSIVE usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
            ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
        ), reached AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
        ), roots AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
        degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings LEFT JOIN degrees d ON vec_id = d.a LEFT JOIN roots r ON vec_id = r.a
    """,
    "op6_warc": """
        WITH parts AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha,
                   CASE WHEN url IS NULL THEN '' ELSE array_to_string(list_reverse(string_split(translate(
                       regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '.')), ',') || ')' || lower(regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1)) END AS url_key,
                   (page_id % 315360000 + 315360000) % 315360000 AS stamp
            FROM pages
        ), payloads AS (
            SELECT page_id, payload_bytes, sha,
                   row_number() OVER (ORDER BY url_key, stamp, page_id, sha) - 1 AS place,
                   lag(page_id) OVER (PARTITION BY url_key ORDER BY stamp, page_id, sha) AS previous
            FROM parts
        ), firsts AS (SELECT sha, min(page_id) AS first_page FROM payloads GROUP BY sha)
        SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda k:
                   array_to_string(list_transform(range(4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       ((('0x' || substr(sha, 5 * k + 1, 5))::BIGINT >> (15 - 5 * j)) & 31)::BIGINT + 1, 1)), '')), '') AS payload_digest,
               CASE WHEN page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first_page THEN first_page END AS refers_to, place, previous
        FROM payloads JOIN firsts USING (sha)
    """,
    "op8_jaccard": """
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, hash(array_to_string(w[k : k + least(len(w), 4) - 1], ' ')) AS s
            FROM words, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS t(k) WHERE len(w) > 0
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
            FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
            WHERE 100 * shared >= 85 * (p.n + q.n - shared)
        ), reached AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
        ), roots AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN roots ON doc_id = a
    """,
    "op12_lexical": """
        WITH doc_terms AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
            FROM documents
        ), item_terms AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
            FROM benchmark
        ), totals AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM doc_terms WHERE len(w) > 0),
        held AS (
            SELECT doc_id, m, term, count(*) AS tf FROM (
                SELECT doc_id, 50 + (50 * len(w) * docs) // terms AS m, unnest(w) AS term FROM doc_terms, totals
            ) SEMI JOIN item_terms USING (term) GROUP BY ALL
        ), weights AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, totals GROUP BY term, docs
        ), scores AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
            FROM held JOIN weights USING (term) JOIN item_terms USING (term) GROUP BY ALL
        )
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
        FROM scores WHERE score > 0 QUALIFY rank <= 50
    """,
    "op13_spelling": """
        WITH RECURSIVE powers AS (
            -- CRC-32 of each byte: eight steps of the reversed polynomial.
            SELECT b::BIGINT AS c, b, 0 AS k FROM range(256) AS t(b)
            UNION ALL
            SELECT CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b, k + 1 FROM powers WHERE k < 8
        ), crc AS (SELECT list(c ORDER BY b) AS bytes FROM powers WHERE k = 8),
        runs AS (
            SELECT doc_id, run, count(*) AS times FROM (
                SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
            ) GROUP BY ALL
        ), hashed AS (
            SELECT run, times, xor(4294967295, list_reduce(
                       list_prepend(4294967295, list_transform(range(strlen(key)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                       lambda c, b: xor(c >> 8, bytes[(xor(c, b) & 255) + 1]))) AS h
            FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS key, hex(encode(key)) AS h FROM runs), crc
        ), spoiled AS (
            SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
                   ELSE run END AS word, times FROM hashed
        ), words AS (
            SELECT word, sum(times)::BIGINT AS n FROM spoiled WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
        ), cut AS (
            SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS t(p)
        ), near AS (
            SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.rest = y.rest AND x.p = y.p AND x.word <> y.word
            UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
            UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word
        ), best AS (
            SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS b, max(n) AS b_n FROM near JOIN words ON b = word GROUP BY a
        ), formed AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN b_n >= 2 * n THEN b END AS form,
                   CASE WHEN b_n >= 2 * n THEN b_n END AS form_n
            FROM words LEFT JOIN best USING (word)
        ), led AS (
            SELECT word, word AS root FROM words
            UNION SELECT l.word, f.form FROM led l JOIN formed f ON l.root = f.word WHERE f.form IS NOT NULL
        )
        SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM formed f JOIN led l ON f.word = l.word
        WHERE l.root IN (SELECT word FROM formed WHERE form IS NULL)
    """,
}
