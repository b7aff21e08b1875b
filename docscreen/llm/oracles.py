"""DuckDB SQL for the digest queries that SQL can express."""

from __future__ import annotations

from . import licenses

#: Base32 of a hexadecimal SHA-1: eight groups of five digits make four letters each.
_BASE32 = """list_reduce(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(sha, 1 + 5 * CAST(i // 4 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)),
    lambda a, b: a || b)"""

#: Words of the word rule, as a list.
_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    # Bytes as hexadecimal digits, two each.
    "op1_suffix_dedup": """
        WITH b AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             w AS (SELECT r, k, md5(substr(h, 2 * k + 1, 400)) AS m FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS k FROM b WHERE length(h) >= 400)),
             hit AS (SELECT r, k, lag(k) OVER (PARTITION BY r ORDER BY k) AS last FROM (SELECT r, k, count(*) OVER (PARTITION BY m) AS n FROM w) WHERE n > 1),
             run AS (SELECT r, k, sum(CASE WHEN last IS NULL OR k > last + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY k) AS g FROM hit),
             span AS (SELECT r, min(k) AS s, max(k) + 200 AS e FROM run GROUP BY r, g),
             gap AS (SELECT r, s, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s) AS a FROM span),
             cut AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (s - a)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS kept, sum(e - s) AS n_removed, count(*) AS n_spans FROM gap JOIN b USING (r) GROUP BY r)
        SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM b LEFT JOIN cut USING (r)""",
    "op6_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format(text="text")} AS ws FROM documents),
             v AS (SELECT doc_id, k, array_to_string(ws[k:k + 49], ' ') AS said FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS k FROM w WHERE len(ws) >= 50)),
             hit AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY said) AS least FROM v) WHERE least < doc_id),
             gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS i FROM hit),
             word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
             kept AS (SELECT doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE g.i IS NULL) AS text FROM word LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op7_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=f"translate(text, '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
             met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
             link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
             edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
             reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
             least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, coalesce(m, doc_id) >= doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)""",
    "op8_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS sha FROM p),
             m AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS last FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM m""",
    "op11_pivot_index": """
        WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
             g AS (SELECT * FROM e WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
             link AS (SELECT a.r, a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
             edge AS (SELECT DISTINCT a, b FROM link),
             reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
             least AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY 1),
             n AS (SELECT r, count(*) AS n FROM link GROUP BY 1)
        SELECT vec_id, coalesce(n, 0) AS n_links, CAST(least(vec_id, coalesce(m, vec_id)) AS BIGINT) AS component_id, coalesce(m, vec_id) >= vec_id AS kept FROM e LEFT JOIN n USING (r) LEFT JOIN least USING (vec_id)""",
    # Every pair with every kept term, zeros written out.
    "op12_source_divergence": f"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
             w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
             k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
             l AS (SELECT lang, count(term) AS v, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
             g AS (SELECT DISTINCT lang, source FROM d),
             c AS (SELECT lang, source, term, count(*) AS c FROM w GROUP BY ALL),
             z AS (SELECT g.lang, g.source, k.term, k.c AS total, coalesce(c.c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
             s AS (SELECT lang, source, sum(c) AS n FROM z GROUP BY ALL),
             p AS (SELECT z.*, 1 + CAST(1000000000 AS HUGEINT) * (z.c + 2) // (s.n + 2 * l.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (z.total + 2) // (l.n + 2 * l.v) AS q FROM z JOIN s USING (lang, source) JOIN l USING (lang)),
             pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
             ranked AS (
                 SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
                 UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM ranked QUALIFY part = 'pair' OR rank <= 10""",
    "op13_collocations": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
             p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d),
             n AS (SELECT lang, sum(len(ws)) AS n FROM p GROUP BY 1),
             f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
                   FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k)) GROUP BY ALL HAVING count(*) >= 100),
             c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
             cut AS (SELECT c.*, i, array_to_string(w[:i], ' ') AS lp, array_to_string(w[i + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c),
             s AS (SELECT cut.lang, cut.phrase, cut.k, cut.f AS a, l.f AS l, r.f AS r, n.n, CAST(1000 AS HUGEINT) * cut.f * n.n // (CAST(l.f AS HUGEINT) * r.f) AS score, i
                   FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = lp JOIN f r ON r.lang = cut.lang AND r.phrase = rp JOIN n ON n.lang = cut.lang
                   QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, i) = 1),
             inside AS (SELECT DISTINCT lang, array_to_string(w[j:j + m - 1], ' ') AS phrase, f FROM (SELECT *, unnest(range(1, k - m + 2)) AS j FROM (SELECT *, unnest(range(2, k)) AS m FROM c)))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM s WHERE NOT EXISTS (SELECT 1 FROM inside WHERE inside.lang = s.lang AND inside.phrase = s.phrase AND 100 * inside.f >= 100 * s.a)
        QUALIFY rank <= 2000""",
    "op9_licenses": licenses.sql("documents", "concat_ws('/', '', source, lang, CAST(doc_id AS VARCHAR))"),
}
