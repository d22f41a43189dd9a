"""DuckDB twins of the corpus queries, where SQL can express them."""

WORD = r"[^\x20\x09-\x0D]+"

OP2 = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (
    SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w AS place
    FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""

OP4 = rf"""
WITH RECURSIVE w AS MATERIALIZED (
    SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{WORD}'),
        lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, shingle FROM (
        SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
            ELSE [array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)] END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
link AS MATERIALIZED (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.least, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS least FROM reach GROUP BY x) r ON r.x = w.doc_id
"""

OP5 = rf"""
WITH d AS (
    SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, 'null') || ':mix') AS key, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size
    FROM documents),
s AS (
    SELECT source, source_size, r, w, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS fills FROM (
        SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r,
            [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
        FROM d GROUP BY source)),
l AS (
    SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fills, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY fills, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
o AS (SELECT arg_min(level, r) AS level, min(fills) AS fills FROM (SELECT * FROM l WHERE fills > level ORDER BY fills, r LIMIT 1)),
t AS (
    SELECT l.source, l.source_size, CASE WHEN o.level IS NULL OR l.fills <= o.level THEN l.cap ELSE o.level * l.w END AS target FROM l, o),
q AS (
    SELECT doc_id, size, source_size, target,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size AS upto
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
    SELECT doc_id, size, (e.e * source_size + upto)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) e(e) WHERE size > 0),
g AS (SELECT finish, sum(size) AS size FROM c GROUP BY finish),
cut AS (
    SELECT max(finish) AS cut FROM (SELECT finish, sum(size) OVER (ORDER BY finish) AS total FROM g) WHERE total <= (SELECT sum(target) FROM t))
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
    CASE WHEN size = 0 THEN 0 ELSE size * ((upto::DOUBLE / target <= cut)::INT + ((source_size + upto)::DOUBLE / target <= cut)::INT) END AS taken
FROM q, cut
"""

MEASURED = rf"""
d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
g AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM (
        SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, unnest([array_to_string(words[k:k + 4], ' ') for k in range(1, len(words) - 3)]) AS gram
        FROM d WHERE len(words) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g WHERE times > 1) GROUP BY doc_id),
m AS (
    SELECT d.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))
            - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))) AS n_dup_lines,
        len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}'))) AS n_lines,
        coalesce(r.n, 0) AS n_repeat_words
    FROM d LEFT JOIN r USING (doc_id)),
f AS (
    SELECT *, n_words < 10 AS few_words, 100 * n_repeat_words > 20 * n_words AS repeated_words, n_symbols > n_words AS symbols,
        100 * n_dup_lines > 30 * n_lines AS duplicate_lines, word_chars > 25 * n_words AS long_words, word_chars < 2 * n_words AS short_words FROM m)
"""

OP8 = f"""
WITH {MEASURED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeated_words AS base_failed,
    NOT (few_words OR repeated_words OR symbols OR duplicate_lines OR long_words OR short_words) AS kept FROM f
"""

ABLATION = f"""
WITH {MEASURED},
b AS (
    SELECT [few_words, repeated_words, symbols, duplicate_lines, long_words, short_words] AS fails,
        ['few_words', 'repeated_words', 'symbols', 'duplicate_lines', 'long_words', 'short_words'] AS rules FROM f),
u AS (SELECT unnest(rules) AS rule, unnest(fails) AS failed, len(list_filter(fails, lambda x: x)) AS n FROM b)
SELECT rule, count_if(failed) AS n_failed, count_if(failed AND n = 1) AS n_only, count_if(n - failed::INT = 0) AS n_kept_without FROM u GROUP BY rule
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
g AS (
    SELECT doc_id, unnest(range(1, len(words) - 48)) AS i, unnest([sha256(array_to_string(words[k:k + 49], ' ')) for k in range(1, len(words) - 48)]) AS gram
    FROM d WHERE len(words) >= 50),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first FROM g),
r AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM f WHERE first < doc_id) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
    sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN words ELSE [words[k] for k in range(1, len(words) + 1) if NOT list_contains(gone, k)] END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

# A turn's place in its path is the digest of its role and text, so that one path starts with another exactly where the
# conversations do. crc32 bit by bit.
OP12 = r"""
WITH RECURSIVE t AS MATERIALIZED (
    SELECT conv_id, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos FROM t),
c AS MATERIALIZED (
    SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM t)),
b AS (
    SELECT c.conv_id, 0 AS part, o.pos, o.digest, o.words FROM c JOIN o ON o.conv_id = c.base WHERE o.pos < c.h
    UNION ALL SELECT c.conv_id, 1, o.pos, o.digest, o.words FROM c JOIN o ON o.conv_id = c.conv_id WHERE o.pos >= c.h),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM b),
r AS MATERIALIZED (
    SELECT conv_id AS conv, 0 AS depth, '' AS path, 0 AS words FROM c
    UNION ALL SELECT conv_id, depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth), words FROM s),
m AS (SELECT conv, max(depth) AS depth FROM r GROUP BY conv),
e AS (
    SELECT path, sha256(string_agg(conv::VARCHAR, ',' ORDER BY conv)) AS ends_sha256 FROM r JOIN m USING (conv, depth) GROUP BY path),
n AS MATERIALIZED (SELECT path, depth, any_value(words) AS words, min(conv) AS conv_id, count(*) AS n_convs FROM r GROUP BY path, depth),
k AS MATERIALIZED (
    SELECT n.*, p.conv_id AS parent_conv_id, left(n.path, 64 * (n.depth - 1)) AS parent FROM n LEFT JOIN n p
        ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = left(n.path, 64 * (n.depth - 1))),
f AS MATERIALIZED (
    SELECT k.*, coalesce(x.n, 0) AS n_children FROM k LEFT JOIN (SELECT parent, count(*) AS n FROM k WHERE depth > 0 GROUP BY parent) x ON x.parent = k.path),
u AS (
    SELECT r.path, sum((f.n_convs - 1) * f.words) AS saved, count(*) FILTER (f.n_children = 0) AS leaves
    FROM f JOIN r ON r.conv = f.conv_id AND r.depth <= f.depth GROUP BY r.path)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, u.leaves AS n_leaves, u.saved::BIGINT AS saved_tokens,
    coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM f JOIN u USING (path) LEFT JOIN e USING (path)
"""

ALNUM = r"""[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"""
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS words FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER}, '{ALNUM}') AS words FROM benchmark),
w AS MATERIALIZED (
    SELECT DISTINCT item_id, least(len(words), 10) AS k, unnest([array_to_string(words[p:p + least(len(words), 10) - 1], ' ')
        for p in range(1, len(words) - least(len(words), 10) + 2)]) AS gram FROM i WHERE len(words) > 0),
g AS (
    SELECT doc_id, k, unnest(range(1, len(words) - k + 2)) AS p,
        unnest([array_to_string(words[q:q + k - 1], ' ') for q in range(1, len(words) - k + 2)]) AS gram
    FROM d, (SELECT DISTINCT k FROM w) WHERE len(words) >= k),
o AS MATERIALIZED (SELECT doc_id, p, k, item_id FROM g JOIN w USING (k, gram)),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS hit FROM o) GROUP BY doc_id),
x AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)
"""

ORACLES = {
    "op2_exact_dedup": OP2, "op4_jaccard_join": OP4, "op5_mixing": OP5, "op8_quality_rules": OP8, "rule_ablation": ABLATION,
    "op9_substring_dedup": OP9, "op12_trie": OP12, "op13_decontaminate": OP13,
}
