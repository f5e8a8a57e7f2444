"""DuckDB SQL of the queries that SQL can express."""

_OP2 = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS p
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), grams AS (
  SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS p
  FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), hits AS (
  SELECT g.r, g.i, g.k, x.item_id FROM grams g JOIN windows x USING (k, p)
), words AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS j FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r
), found AS (
  SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hits GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""

_OP9 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS p FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM docs WHERE len(w) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, p) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS j FROM twice) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT x) AS d FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM docs) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines, CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper, CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS BIGINT) AS n_letters
  FROM docs LEFT JOIN repeats USING (r) LEFT JOIN lines USING (r)
), f AS (
  SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
    + CASE WHEN n_letters >= 20 AND 100 * n_upper > 50 * n_letters THEN 64 ELSE 0 END AS BIGINT) AS failures
  FROM m
)
SELECT *, failures & 3 <> 0 AS base_failed, failures & 127 = 0 AS kept FROM f
"""

_OP8 = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

_RULES = ("few_words", "repeated_windows", "symbols", "duplicate_lines", "long_words", "short_words", "upper_case")
_ABLATIONS = _OP9.rsplit("SELECT *", 1)[0] + "SELECT rule, CAST(count(*) FILTER (failures & bit <> 0) AS BIGINT) AS failed, CAST(count(*) FILTER (failures = bit) AS BIGINT) AS sole, CAST(count(*) FILTER (failures = 0) AS BIGINT) AS kept FROM f, (VALUES " + ", ".join(f"('{r}', {1 << i})" for i, r in enumerate(_RULES)) + ") r(rule, bit) GROUP BY rule"

_OP11 = """
WITH own AS (
  SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS v
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
), h AS (
  SELECT c, v, c - c % 100 AS b, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda a, x: list_reduce([xor(a, x), 1, 2, 3, 4, 5, 6, 7, 8], lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END)), 4294967295::UBIGINT) % 6 AS h
  FROM own
), re AS (
  SELECT h.c, list_concat(coalesce(o.v[1:h.h], []), h.v[h.h + 1:]) AS v FROM h LEFT JOIN own o ON o.c = h.b
), node AS (
  SELECT v[1:d] AS p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(v) = d), '')) AS ends_sha256
  FROM (SELECT c, v, unnest(range(0, len(v) + 1)) AS d FROM re) GROUP BY 1, 2
), kids AS (
  SELECT p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1
), sub AS (
  SELECT n.p[1:a] AS p, count(*) FILTER (k.n IS NULL) AS leaves, sum(CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.p[n.d].t) END) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM node) n LEFT JOIN kids k USING (p) GROUP BY 1
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN sub s USING (p) LEFT JOIN kids k USING (p) LEFT JOIN node u ON n.d > 0 AND u.p = n.p[1:n.d - 1] AND u.d = n.d - 1
"""

# The given pages name their article in one way, so SQL can cut it out.
_OP12 = """
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(p|br|h1)>', ' ', 'g'), '</?b>', '', 'g') AS t FROM pages
), d AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS text FROM a
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""

_OP13 = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[ \\t]+'), lambda x: x <> '') AS w FROM documents
), spans AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, w[i:i + k - 1] AS p, k, count(*) AS a FROM spans GROUP BY ALL HAVING count(*) >= 100
), n AS (
  SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY 1
), longer AS (
  SELECT DISTINCT lang, unnest([p[1:k - 1], p[2:k]]) AS p, a FROM f WHERE k > 2
), kept AS (
  SELECT * FROM f WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM longer g WHERE g.lang = f.lang AND g.p = f.p AND 100 * g.a >= 100 * f.a)
), cuts AS (
  SELECT c.*, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS c FROM kept) c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:c.c] JOIN f r ON r.lang = c.lang AND r.p = c.p[c.c + 1:c.k] JOIN n ON n.lang = c.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1
), ranked AS (
  SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM best
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op13_collocations": _OP13, "op12_html_text": _OP12, "op11_trie": _OP11, "op2_decontam": _OP2, "op8_warc": _OP8, "op9_ledger": _OP9, "ledger_ablations": _ABLATIONS}
