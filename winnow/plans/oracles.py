"""The same queries as DuckDB SQL, written from the rules and not from the Spark plans."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def _strip(c):
    return rf"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _norm(c):
    return rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def _slug(c):
    low = f"replace(lower({_strip(c)}), ' ', '-')"
    return f"regexp_replace(regexp_replace(regexp_replace({low}, '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


def _safe(c):
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;"), ("[", "&#91;"), ("]", "&#93;")):
        c = f"replace({c}, '{raw}', '{safe}')"
    return c


def _stamp(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# The words left out, as in the library.
_STOP = ("a an the of for with and or to in on at by from via as is are was were be been its it this that these "
         "those new after over into out up down about amid than").split()
STOP = "[" + ",".join(f"'{w}'" for w in _STOP) + "]"


def _words(c):
    return f"list_filter(list_distinct(string_split({_norm(c)}, ' ')), lambda w: length(w) > 2 and not list_contains({STOP}, w))"


def _tokens(title, source):
    return f"list_filter({_words(title)}, lambda w: not list_contains({_words(source)}, w))"


ITEMS = r"""items AS (SELECT doc_id AS item_id, source || '/' || lang AS feed_id,
  CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) * 1000 + ascii(substr(lang, 2, 1)) AS feed_ord,
  doc_id AS entry_ord, doc_id AS item_ord, source, source AS publisher,
  trim(regexp_extract(text, '^[^.\n|]*', 0)) AS title,
  'https://www.' || source || '.example.com/a/' || substr(md5(text), 1, 12) AS link, text AS description,
  CASE WHEN doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-30 00:00:00' - to_hours(CAST(doc_id * 37 % 720 AS INT)) END AS published,
  CASE WHEN lang = 'en' THEN 'About ' || source END AS topic_context, lang FROM documents)"""

SEEN = f"""seen AS (SELECT link, max({AS_OF} - to_days(CAST(item_id % 30 AS INT))) AS seen_at FROM items
  WHERE item_id IN (SELECT doc_id FROM labels) GROUP BY link)"""

CATEGORY = "CASE WHEN quality IS NULL THEN 'mention' WHEN toxic = 1 THEN 'exclude' WHEN quality = 1 THEN 'key' ELSE 'notable' END"
SCORED = f"""scored AS (SELECT i.*, description AS summary, {CATEGORY} AS category, lang AS domain
  FROM items i LEFT JOIN labels l ON l.doc_id = i.item_id)"""

DIGESTS = """digests AS (SELECT * FROM (VALUES
  (0, 'English Desk', ['key','notable'], []::VARCHAR[], false, 'en', ['en@example.com'], {'s': 'key', 'l': 'Key Stories'}),
  (1, 'French Desk', ['key','notable'], []::VARCHAR[], false, 'fr', ['fr@example.com','fr2@example.com'], NULL),
  (2, 'German Desk', ['key','notable'], []::VARCHAR[], false, 'de', []::VARCHAR[], NULL),
  (3, 'Everything / All', ['mention','key'], []::VARCHAR[], false, NULL, ['all@example.com'], {'s': 'mention', 'l': 'Also [new]'}),
  (4, 'Derived Nothing', ['key','mention'], []::VARCHAR[], true, NULL, ['none@example.com'], NULL),
  (5, 'Three Sources', ['notable','thought_leadership'], ['src1','src2','src3'], false, NULL, []::VARCHAR[], NULL))
  AS d(digest_ord, title, sections, sources, derived, domain, rcpt, label))"""

_TAKES_FEED = "(CASE WHEN len(d.sources) > 0 THEN list_contains(d.sources, {feed}) ELSE NOT d.derived END)"
ROUTED = f"""routed AS (SELECT s.*, d.digest_ord, d.title AS digest_title, {_slug('d.title')} AS digest_slug
  FROM scored s JOIN digests d ON list_contains(d.sections, s.category)
  AND {_TAKES_FEED.format(feed='s.source')} AND (d.domain IS NULL OR d.domain = s.domain))"""

FEEDS = """feeds AS (SELECT DISTINCT feed_id, feed_ord, source AS name,
  CASE feed_ord % 4 WHEN 0 THEN ['English Desk','Ghost Desk'] WHEN 1 THEN ['French Desk','Three Sources']
  WHEN 2 THEN []::VARCHAR[] END AS digests FROM items)"""

USERS = """base_users AS (SELECT CAST(c_custkey AS INT) AS user_ord, ' ' || c_name AS name,
  CASE WHEN c_nationkey = 7 THEN replace(lower(c_name), '#', '.') || ' at example'
  ELSE replace(lower(c_name), '#', '.') || '@example.com' END AS email, c_mktsegment FROM customer),
users AS (SELECT user_ord, name, email FROM base_users UNION ALL
  SELECT user_ord + 100000000, name, upper(email) FROM base_users WHERE c_mktsegment = 'MACHINERY')"""
CLEAN_USERS = r"""clean_users AS (SELECT * FROM (SELECT user_ord, trim(name) AS name, trim(email) AS email,
  row_number() OVER (PARTITION BY lower(trim(email)) ORDER BY user_ord) AS rn FROM users
  WHERE regexp_matches(trim(email), '^[^@\s]+@[^@\s]+\.[^@\s]+$')) WHERE rn = 1)"""
TOPICS = """topics AS (SELECT CAST(p_partkey AS INT) AS topic_ord, p_name || ' ' || p_partkey AS name,
  [p_name, p_brand || ' & ' || p_type] AS queries, 'About ' || p_type AS context,
  CASE WHEN p_partkey % 3 = 0 THEN 'sv' ELSE 'en' END AS lang, CASE WHEN p_partkey % 3 = 0 THEN 'SE' ELSE 'US' END AS country,
  CASE WHEN p_partkey % 7 = 0 THEN ['bing'] ELSE ['google', 'bing'] END AS engines,
  CASE WHEN p_partkey % 50 = 0 THEN 'ALL' WHEN p_partkey % 97 = 0 THEN 'nobody@example.com' WHEN p_partkey % 41 = 0 THEN ''
  ELSE 'Customer.' || lpad(CAST(p_partkey % 1500 AS VARCHAR), 9, '0') || '@example.com' END AS recipient FROM part)"""

USAGE = """calls AS (SELECT event_id, CAST(ts AS DATE) AS day,
  CASE event_type WHEN 'view' THEN 'alpha' WHEN 'purchase' THEN 'alpha' WHEN 'signup' THEN 'alpha' WHEN 'click' THEN 'beta' ELSE 'delta' END AS provider,
  CASE event_type WHEN 'view' THEN 'm-1' WHEN 'purchase' THEN 'm-1-20240101' WHEN 'signup' THEN 'm-1-4-20240202' WHEN 'click' THEN 'n-small-beta' ELSE 'z-1' END AS model,
  CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens FROM events),
prices AS (SELECT * FROM (VALUES ('alpha','m-1',1.0::DOUBLE,5.0::DOUBLE), ('alpha','m-1-4',3.0,15.0), ('beta','n-small',0.15,0.6),
  ('beta','n-small-latest',0.5,1.5), ('gamma','q-9',0.03,0.13)) AS p(provider, id, pi, po)),
priced AS (SELECT * FROM (SELECT c.provider, c.model, p.pi, p.po,
  row_number() OVER (PARTITION BY c.provider, c.model ORDER BY length(p.id) DESC) AS rn
  FROM (SELECT DISTINCT provider, model FROM calls) c JOIN prices p ON p.provider = c.provider AND (c.model = p.id
  OR (starts_with(c.model, p.id) AND regexp_matches(substr(c.model, length(p.id) + 1), '^-[0-9]')))) WHERE rn = 1),
usage AS (SELECT c.*, round(CAST(input_tokens AS DOUBLE) / 1000000 * pi + CAST(output_tokens AS DOUBLE) / 1000000 * po, 6) AS cost_usd
  FROM calls c LEFT JOIN priced p ON p.provider = c.provider AND p.model = c.model)"""
DAILY = f"""daily AS (SELECT day, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, count(*) AS calls,
  round(sum(coalesce(cost_usd, 0)), 4) AS cost_usd, bool_or(cost_usd IS NULL) AS cost_is_partial,
  array_to_string(list_sort(list(DISTINCT provider || '/' || model)), ',') AS models
  FROM usage WHERE day >= CAST({AS_OF} AS DATE) - 29 GROUP BY day)"""

HISTORY = f"""history AS (SELECT o_orderkey AS id, o_orderdate AS sent_at, 'Digest ' || o_orderpriority AS digest_title,
  {_slug("'Digest ' || o_orderpriority")} AS digest_slug, 'Order ' || o_orderkey AS title, o_orderstatus AS source FROM orders)"""

SUPPLIER = """base AS (SELECT s_name AS name, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey NOT IN (3, 8, 13, 18, 23)),
edited AS (SELECT s_name AS name, s_nationkey, CASE WHEN s_nationkey BETWEEN 5 AND 14 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal
  FROM supplier WHERE s_acctbal >= 500),
stamp AS (SELECT s_name AS name FROM supplier WHERE s_nationkey <= 12)"""

SETTINGS = """base AS (SELECT s_name AS name, CAST(floor(s_acctbal) AS BIGINT) + CASE WHEN s_nationkey BETWEEN 10 AND 20 THEN 7 ELSE 0 END AS value
  FROM supplier WHERE s_nationkey NOT IN (3, 8, 13, 18, 23)),
edited AS (SELECT s_name AS name, CAST(floor(s_acctbal) AS BIGINT) + CASE WHEN s_nationkey BETWEEN 5 AND 14 THEN 1 ELSE 0 END AS value
  FROM supplier WHERE s_acctbal >= 500),
stamp AS (SELECT s_name AS name, CAST(floor(s_acctbal) AS BIGINT) AS value FROM supplier WHERE s_nationkey <= 12)"""

WEB = r"""web AS (SELECT page_id, html, regexp_extract(html, '<title>([^<]*)', 1) AS title,
  CASE WHEN page_id % 3 = 0 THEN 'http://www.bing.com/news/apiclick.aspx?ref=x&url=' || url_encode(url) || '&c=1' ELSE url END AS link,
  url FROM pages)"""


def _host(c):
    host = rf"regexp_replace(string_split(lower(regexp_extract({c}, '^[A-Za-z]+://([^/?#]*)', 1)), ':')[1], '^www\.', '')"
    return rf"(CASE WHEN regexp_matches({host}, '(^|\.)(news\.google\.com|bing\.com)$') THEN '' ELSE {host} END)"


NUMBERED = """batched AS (SELECT *, (row_number() OVER (ORDER BY item_ord) - 1) // 8 AS batch_id,
  CAST((row_number() OVER (ORDER BY item_ord) - 1) % 8 AS INT) AS pos FROM items)"""


def _item_text(first):
    topic = """(CASE WHEN coalesce(topic_context, '') <> '' THEN 'TOPIC: ' || source || chr(10) || 'TOPIC CONTEXT: ' || topic_context || chr(10) ELSE '' END)"""
    return (f"{first} || chr(10) || {topic} || 'TITLE: ' || title || chr(10) || 'SOURCE: ' || publisher || chr(10) || 'DESCRIPTION:' || chr(10) || "
            f"'<item_description>' || chr(10) || CASE WHEN description = '' THEN '(no description)' ELSE description END || chr(10) || "
            f"'</item_description>' || chr(10)")


# the recorded answers, element by element
ANSWERS = """answers AS (SELECT b.item_id, b.batch_id, b.pos, b.title, b.description, s.category AS said, s.domain AS said_domain,
  (b.batch_id % 13 = 12) AS garbage, (b.batch_id % 4 = 2 AND b.pos = 1) AS scalar, (b.batch_id % 4 = 3 AND b.pos = 7) AS absent,
  (b.batch_id % 4 = 3 AND b.pos = 0) AS odd FROM batched b JOIN scored s ON s.item_id = b.item_id)"""

STORY_ITEMS = r"""sbase AS (SELECT item_id, item_ord, source, title, published FROM items),
sitems AS (SELECT * FROM sbase UNION ALL SELECT item_id + 1000000000, item_ord + 1000000000, source,
  'zeta' || item_id || ' omega' || item_id || ' ' || regexp_replace(title, '^([^ ]* ){0,3}', ''), published - to_hours(1) FROM sbase)"""
STORY = f"""placed AS (SELECT *, {_norm('title')} AS norm, row_number() OVER (ORDER BY published DESC NULLS LAST, item_ord) AS ord,
  {_tokens('title', 'source')} AS toks FROM sitems),
big AS (SELECT * FROM placed WHERE len(toks) >= 5),
retold AS (SELECT DISTINCT a.item_id FROM big a JOIN big b ON a.source = b.source AND b.ord < a.ord
  WHERE len(list_intersect(a.toks, b.toks)) >= 3
  AND len(list_intersect(a.toks, b.toks)) / least(len(a.toks), len(b.toks)) >= 0.6
  AND least(len(a.toks), len(b.toks)) - len(list_intersect(a.toks, b.toks)) >= 2),
survivors AS (SELECT * FROM placed WHERE item_id NOT IN (SELECT item_id FROM retold))"""

CLUSTERED = f"""idx AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY item_ord) - 1 AS i FROM items),
claimed AS (SELECT *, CASE WHEN i IN (0, 2) THEN 0 WHEN i = 1 THEN 1 WHEN i = 5 THEN 2 END AS c FROM idx),
story AS (SELECT *, coalesce(c, 1099511627776 + i) AS story_ord FROM claimed),
linkpos AS (SELECT source, story_ord, publisher, link, min(i) AS i FROM story GROUP BY ALL),
links AS (SELECT source, story_ord, array_to_string(list(publisher || '=' || link ORDER BY i), ' ') AS links FROM linkpos GROUP BY ALL),
merged AS (SELECT source, story_ord, min(c) AS c, count(*) AS n_members, arg_min(item_id, i) AS item_id, arg_min(title, i) AS title,
  arg_min(link, i) AS link, arg_min(description, i) AS description, max(published) AS published FROM story GROUP BY ALL)"""

BLOCK = ("CASE WHEN safe_href <> '' THEN '### [' || {t} || '](' || safe_href || ')' ELSE '### ' || {t} END || chr(10) || "
         "'*' || {p} || '*' || chr(10) || chr(10) || {s} || chr(10)").format(
    t=_safe("CASE WHEN title = '' THEN 'Untitled' ELSE title END"), p=_safe("publisher"), s=_safe("summary"))
RENDERED = f"""rows_ AS (SELECT r.*, d.sections, d.label, list_position(d.sections, r.category) AS rk, r.link AS safe_href
  FROM routed r JOIN digests d ON d.digest_ord = r.digest_ord),
secs AS (SELECT digest_ord, digest_title, digest_slug, rk, '## ' || any_value(CASE WHEN label.s = category THEN label.l
  ELSE upper(substr(category, 1, 1)) || substr(category, 2) END) || chr(10) || chr(10)
  || string_agg({BLOCK}, chr(10) ORDER BY item_ord) || chr(10) AS body FROM rows_ GROUP BY digest_ord, digest_title, digest_slug, rk),
rendered AS (SELECT digest_ord, digest_title, digest_slug, 0::BIGINT AS page,
  regexp_replace('# ' || digest_title || chr(10) || chr(10) || '*2024-01-31*' || chr(10) || chr(10) || string_agg(body, chr(10) ORDER BY rk), '{WS}+$', '') AS markdown
  FROM secs GROUP BY digest_ord, digest_title, digest_slug)"""

BLOCKS = f"""texts AS (SELECT digest_ord, digest_slug, 0 AS rank, 0 AS step, 0 AS place, '# ' || any_value(digest_title) || chr(10) || chr(10) || '*2024-01-31*' || chr(10) AS text
  FROM rows_ GROUP BY digest_ord, digest_slug
UNION ALL SELECT digest_ord, digest_slug, rk, 0, 0, '## ' || any_value(CASE WHEN label.s = category THEN label.l
  ELSE upper(substr(category, 1, 1)) || substr(category, 2) END) || chr(10) FROM rows_ GROUP BY digest_ord, digest_slug, rk
UNION ALL SELECT digest_ord, digest_slug, rk, 1, item_ord, {BLOCK} FROM rows_
UNION ALL SELECT DISTINCT digest_ord, digest_slug, rk, 2, 0, '' FROM rows_),
placed AS (SELECT *, row_number() OVER (PARTITION BY digest_ord ORDER BY rank, step, place) - 1 AS n, count(*) OVER (PARTITION BY digest_ord) AS k FROM texts)"""


def _with(*parts, select):
    return "WITH " + ",\n".join(parts) + "\n" + select


FAIR = ("fair AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY coalesce(published, " + AS_OF
        + ") DESC, entry_ord) AS rnk FROM {src}) ORDER BY rnk, feed_ord LIMIT 150)")

LANDED = rf"""places AS (SELECT *, item_id // 500 AS doc_ord, row_number() OVER (PARTITION BY feed_id, item_id // 500 ORDER BY item_id) - 1 AS place,
  source || '.example.com' AS host FROM items),
landed AS (SELECT feed_ord::BIGINT * 4398046511104 + doc_ord * 1048576 + place AS item_id, feed_id, feed_ord, doc_ord * 1048576 + place AS entry_ord, source,
  CASE WHEN lang <> 'fr' AND item_id % 10 = 0 THEN 'The Outlet' WHEN lang = 'es' THEN host ELSE source END AS publisher,
  CASE WHEN lang <> 'es' THEN title WHEN item_id % 10 = 0 THEN {_strip("title || ' - ' || upper(source) || '.example.com'")} ELSE title END AS title, link,
  substr(CASE WHEN lang = 'es' THEN trim(regexp_replace(description, '{WS}+', ' ', 'g')) ELSE description END, 1, 1000) AS description, published FROM places)"""

# The ratio of matched characters: the longest run that two titles share (the leftmost of equals), then the same to its
# left and right. In a title of 200 characters and more, characters above a hundredth of it begin no run but prolong one.
# Pairs sharing too few characters for the ratio are left out first. Then titles in order, each against those kept.
TITLES = f"""named AS MATERIALIZED (
  SELECT item_id, title, {_norm('title')} AS norm, row_number() OVER (ORDER BY published DESC NULLS LAST, item_ord) AS ord FROM items),
titles AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY min(ord)) AS tid, norm, length(norm) AS n, string_split(norm, '') AS c FROM named WHERE norm <> '' GROUP BY norm),
chars AS MATERIALIZED (SELECT tid, n, unnest(range(1, n + 1)) AS i, unnest(c) AS ch FROM titles),
nth AS MATERIALIZED (SELECT tid, n, ch, row_number() OVER (PARTITION BY tid, ch ORDER BY i) AS k FROM chars),
common AS MATERIALIZED (
  SELECT a.tid AS a, b.tid AS b FROM nth a JOIN nth b ON a.ch = b.ch AND a.k = b.k AND a.tid > b.tid
    AND 2 * least(a.n, b.n) >= 0.85 * (a.n + b.n) GROUP BY ALL HAVING 2 * count(*) >= 0.85 * (min(a.n) + min(b.n)) - 1e-6),
tri AS MATERIALIZED (
  SELECT tid, n, gram, row_number() OVER (PARTITION BY tid, gram) AS k
  FROM (SELECT tid, n, unnest([norm[i:i + 2] for i in range(1, n - 1)]) AS gram FROM titles)),
near AS MATERIALIZED (
  SELECT c.a, c.b FROM common c JOIN titles x ON x.tid = c.a JOIN titles y ON y.tid = c.b LEFT JOIN (
    SELECT p.a, p.b, count(*) AS shared FROM common p JOIN tri g ON g.tid = p.a JOIN tri h ON h.tid = p.b AND h.gram = g.gram AND h.k = g.k GROUP BY ALL) s
    ON s.a = c.a AND s.b = c.b WHERE coalesce(shared, 0) >= (x.n + y.n) * 0.125 - 2 - 1e-6),
seeds AS MATERIALIZED (
  SELECT * FROM chars QUALIFY n < 200 OR count(*) OVER (PARTITION BY tid, ch) <= n // 100 + 1),
parts AS (
  SELECT a, b, 1 AS alo, x.n + 1 AS ahi, 1 AS blo, y.n + 1 AS bhi, 0 AS size FROM near JOIN titles x ON x.tid = a JOIN titles y ON y.tid = b
  UNION ALL (
    WITH open AS (SELECT *, row_number() OVER () AS id FROM parts WHERE alo < ahi AND blo < bhi),
    hits AS (
      SELECT o.id, p.i, q.i AS j, p.i - row_number() OVER (PARTITION BY o.id, p.i - q.i ORDER BY p.i) AS run
      FROM open o JOIN chars p ON p.tid = o.a AND p.i >= o.alo AND p.i < o.ahi JOIN seeds q ON q.tid = o.b AND q.ch = p.ch AND q.i >= o.blo AND q.i < o.bhi),
    runs AS (SELECT id, min(i) AS i, min(j) AS j, count(*) AS k FROM hits GROUP BY id, i - j, run),
    best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC, i, j) = 1),
    found AS (
      SELECT o.*, coalesce(f.i, o.alo) AS i, coalesce(f.j, o.blo) AS j, coalesce(f.k, 0) AS k, x.c AS ac, y.c AS bc
      FROM open o LEFT JOIN best f USING (id) JOIN titles x ON x.tid = o.a JOIN titles y ON y.tid = o.b),
    longer AS (
      SELECT *, coalesce(list_position([ac[i - s] <> bc[j - s] for s in range(1, least(i - alo, j - blo) + 1)], true) - 1, least(i - alo, j - blo)) AS l,
        coalesce(list_position([ac[i + k + s] <> bc[j + k + s] for s in range(0, least(ahi - i - k, bhi - j - k))], true) - 1,
          least(ahi - i - k, bhi - j - k)) AS r FROM found),
    block AS (SELECT a, b, alo, ahi, blo, bhi, i - l AS i, j - l AS j, k + l + r AS k FROM longer)
    SELECT a, b, alo, i, blo, j, 0 FROM block WHERE k > 0
    UNION ALL SELECT a, b, i + k, ahi, j + k, bhi, 0 FROM block WHERE k > 0
    UNION ALL SELECT a, b, 0, 0, 0, 0, k FROM block WHERE k > 0)),
pairs AS MATERIALIZED (
  SELECT a, list(b) AS earlier FROM (
    SELECT a, b FROM parts JOIN titles x ON x.tid = a JOIN titles y ON y.tid = b GROUP BY a, b, x.n, y.n HAVING 2.0 * sum(size) / (x.n + y.n) >= 0.85)
  GROUP BY a),
steps AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a) AS step, a, earlier FROM pairs),
walk AS (
  SELECT 0 AS step, []::BIGINT[] AS gone
  UNION ALL SELECT s.step, CASE WHEN len(list_filter(s.earlier, lambda e: NOT list_contains(w.gone, e))) > 0 THEN list_append(w.gone, s.a) ELSE w.gone END
  FROM walk w JOIN steps s ON s.step = w.step + 1)"""

ORACLES = {
    "digest_run": _with(
        ITEMS, SEEN, SCORED, DIGESTS,
        f"young AS (SELECT * FROM items WHERE published IS NULL OR published >= {AS_OF} - INTERVAL 30 DAY)",
        FAIR.format(src="young"),
        f"new_items AS (SELECT * FROM fair WHERE link <> '' AND link NOT IN (SELECT link FROM seen WHERE seen_at > {AS_OF} - INTERVAL 14 DAY))",
        ROUTED,
        select="SELECT digest_title, category, count(*) AS n FROM routed WHERE item_id IN (SELECT item_id FROM new_items) GROUP BY ALL"),
    "fair_trim": _with(ITEMS, FAIR.format(src="items"), select=f"SELECT item_id, feed_id, {_stamp('published')} AS published FROM fair"),
    "feed_cap": _with(ITEMS, select="SELECT item_id, feed_id, title FROM items QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY entry_ord) <= 20"),
    "newest_topk": _with(ITEMS, select=f"SELECT item_id, feed_id, {_stamp('published')} AS published FROM items ORDER BY coalesce(items.published, {AS_OF}) DESC, feed_ord, entry_ord LIMIT 150"),
    "stale_filter": _with(ITEMS, select=f"SELECT item_id, {_stamp('published')} AS published FROM items i WHERE i.published IS NULL OR i.published >= {AS_OF} - INTERVAL 14 DAY"),
    "seen_new": _with(ITEMS, SEEN, select=f"SELECT item_id, link FROM items WHERE link NOT IN (SELECT link FROM seen WHERE seen_at > {AS_OF} - INTERVAL 14 DAY)"),
    "settled": _with(ITEMS, SCORED, DIGESTS, ROUTED, select="SELECT item_id, link FROM items WHERE link IN (SELECT link FROM routed UNION ALL SELECT link FROM scored WHERE category = 'exclude')"),
    "seen_upsert": _with(ITEMS, SEEN, SCORED, DIGESTS, ROUTED, select=f"""SELECT link, {_stamp('max(seen_at)')} AS seen_at FROM (
        SELECT link, seen_at FROM seen WHERE seen_at > {AS_OF} - INTERVAL 14 DAY UNION ALL
        SELECT link, {AS_OF} FROM routed UNION ALL SELECT link, {AS_OF} FROM scored WHERE category = 'exclude') GROUP BY link"""),
    "story_dedup": _with(ITEMS, STORY_ITEMS, STORY, select="SELECT item_id, source, title FROM survivors"),
    "title_dedup": "WITH RECURSIVE " + ITEMS + ", " + TITLES + """ SELECT m.item_id, m.title FROM named m LEFT JOIN titles t USING (norm)
        WHERE m.norm = '' OR NOT list_contains((SELECT gone FROM walk ORDER BY step DESC LIMIT 1), t.tid)
        QUALIFY m.norm = '' OR row_number() OVER (PARTITION BY m.norm ORDER BY m.ord) = 1""",
    "title_dedup_exact": _with(ITEMS, STORY_ITEMS, STORY, select="SELECT item_id, title FROM survivors QUALIFY norm = '' OR row_number() OVER (PARTITION BY norm ORDER BY ord) = 1"),
    "route": _with(ITEMS, SCORED, DIGESTS, ROUTED, select="SELECT item_id, digest_title, digest_slug, category FROM routed"),
    "unrouted": _with(ITEMS, SCORED, DIGESTS, ROUTED, select="""SELECT source, coalesce(nullif(domain, ''), '-') AS domain, category, count(*) AS n FROM scored
        WHERE category <> 'exclude' AND item_id NOT IN (SELECT item_id FROM routed) GROUP BY ALL"""),
    "run_counts": _with(ITEMS, SCORED, DIGESTS, ROUTED, select="SELECT (SELECT count(*) FROM scored WHERE category = 'exclude') AS excluded, (SELECT count(*) FROM routed) AS delivered"),
    "route_grid": _with(ITEMS, FEEDS, DIGESTS, "cols AS (SELECT unnest(['key','mention','notable']) AS col)", select=f"""
        SELECT f.feed_id, f.name AS feed, c.col, coalesce(string_agg(d.title, '|' ORDER BY d.digest_ord), '') AS digests FROM feeds f CROSS JOIN cols c
        LEFT JOIN digests d ON list_contains(d.sections, c.col) AND d.domain IS NULL AND {_TAKES_FEED.format(feed='f.name')} GROUP BY ALL"""),
    "route_grid_domains": _with(ITEMS, FEEDS, DIGESTS, "cols AS (SELECT unnest(['de','en','es','fr']) AS col)", select=f"""
        SELECT f.feed_id, f.name AS feed, c.col, coalesce(string_agg(DISTINCT d.title, '|' ORDER BY d.title), '') AS digests FROM feeds f CROSS JOIN cols c
        LEFT JOIN digests d ON (d.domain IS NULL OR d.domain = c.col) AND {_TAKES_FEED.format(feed='f.name')} GROUP BY ALL"""),
    "route_gaps": _with(ITEMS, FEEDS, DIGESTS, "cols AS (SELECT unnest(['key','mention','notable']) AS col)",
        f"""grid AS (SELECT f.feed_id, f.name AS feed, c.col, count(d.title) AS k FROM feeds f CROSS JOIN cols c
        LEFT JOIN digests d ON len(d.sources) > 0 AND list_contains(d.sections, c.col) AND d.domain IS NULL AND list_contains(d.sources, f.name) GROUP BY ALL)""",
        "orphans AS (SELECT feed FROM (SELECT feed_id, feed, max(k) AS m FROM grid GROUP BY ALL) WHERE m = 0)",
        select="SELECT feed, col, count(*) AS n, feed IN (SELECT feed FROM orphans) AS orphan FROM grid WHERE k = 0 GROUP BY ALL"),
    "feed_digests": _with(ITEMS, FEEDS, DIGESTS, "named AS (SELECT DISTINCT trim(name) AS feed, trim(t) AS t FROM (SELECT name, unnest(digests) AS t FROM feeds))",
        select="""SELECT d.digest_ord, d.title, CASE WHEN len(d.sources) > 0 THEN array_to_string(d.sources, ',')
        ELSE coalesce((SELECT string_agg(feed, ',' ORDER BY feed) FROM named n WHERE n.t = d.title), '') END AS sources,
        len(d.sources) = 0 AS sources_derived FROM digests d"""),
    "feed_reach": _with(ITEMS, FEEDS, DIGESTS, select=f"""SELECT f.feed_id, f.name AS feed, coalesce(string_agg(d.title, '|' ORDER BY d.digest_ord), '') AS digests
        FROM feeds f LEFT JOIN digests d ON {_TAKES_FEED.format(feed='f.name')} GROUP BY ALL"""),
    "reader_users": _with(USERS, CLEAN_USERS, select="SELECT user_ord, name, email FROM clean_users"),
    "reader_digests": _with(USERS, CLEAN_USERS, TOPICS, select="""SELECT u.user_ord AS digest_ord, u.name || '''s Digest' AS title, 'key,notable,mention' AS sections,
        string_agg(trim(t.name), '|' ORDER BY t.topic_ord) AS sources, u.email AS "to" FROM clean_users u JOIN topics t
        ON lower(t.recipient) IN ('all', '') OR lower(t.recipient) = lower(u.email) GROUP BY u.user_ord, u.name, u.email"""),
    "wiring_lints": _with(ITEMS, FEEDS, DIGESTS, USERS, CLEAN_USERS, TOPICS,
        "named AS (SELECT DISTINCT name AS feed, t FROM (SELECT name, unnest(digests) AS t FROM feeds))",
        select="""SELECT 'unknown_source' AS rule, title AS subject, s AS object FROM (SELECT title, unnest(sources) AS s FROM digests) WHERE s NOT IN (SELECT name FROM feeds)
        UNION ALL SELECT 'unrouted_source', f.name, '' FROM (SELECT DISTINCT name FROM feeds) f WHERE
          NOT EXISTS (SELECT 1 FROM digests d WHERE len(d.sources) = 0 AND d.title NOT IN (SELECT t FROM named))
          AND f.name NOT IN (SELECT unnest(sources) FROM digests) AND f.name NOT IN (SELECT feed FROM named JOIN digests d ON d.title = t AND len(d.sources) = 0)
        UNION ALL SELECT 'unknown_recipient', name, recipient FROM topics WHERE lower(recipient) NOT IN ('all', '') AND lower(recipient) NOT IN (SELECT lower(email) FROM clean_users)
        UNION ALL SELECT 'unknown_digest', feed, t FROM named WHERE t NOT IN (SELECT title FROM digests)
        UNION ALL SELECT 'double_wired', title, '' FROM digests WHERE len(sources) > 0 AND title IN (SELECT t FROM named)
        UNION ALL SELECT 'silent_feed', name, '' FROM feeds WHERE digests IS NULL"""),
    "orphan_topics": _with(USERS, TOPICS, select="SELECT topic_ord, name, recipient FROM topics WHERE lower(coalesce(nullif(recipient, ''), 'all')) <> 'all' AND lower(recipient) NOT IN (SELECT lower(trim(email)) FROM users)"),
    "topic_clean": """SELECT topic_ord, name, queries FROM (SELECT CAST(p_partkey AS INT) AS topic_ord, p_name AS name, p_name || '|' || p_brand || ' & ' || p_type AS queries,
        row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1""",
    "search_feeds": _with(TOPICS, "q AS (SELECT *, generate_subscripts(queries, 1) - 1 AS query_ord, unnest(queries) AS query FROM topics)",
        "e AS (SELECT *, unnest(engines) AS engine FROM q)", select="""SELECT topic_ord, CAST(query_ord AS INT) AS query_ord, engine, name, context AS topic_context,
        CASE WHEN engine = 'google' THEN 'https://news.google.com/rss/search?q=' || replace(url_encode(query || ' when:2d'), '%20', '+') || '&hl=' || lang || '&gl=' || country || '&ceid=' || country || ':' || lang
        ELSE 'https://www.bing.com/news/search?q=' || replace(url_encode(query), '%20', '+') || '&format=RSS&setmkt=' || lang || '-' || country || '&sortbydate=1' END AS url FROM e"""),
    "available_digests": _with(HISTORY, select="SELECT DISTINCT digest_title AS title, digest_slug AS slug FROM history"),
    "clean_links": "SELECT page_id, url AS link FROM pages",
    "publishers": _with(WEB, select=f"""SELECT page_id, {_host('url')} AS host, {_host('link')} AS raw_host,
        coalesce(CASE WHEN page_id % 5 = 0 THEN nullif(trim(regexp_extract(title, '^[^ ]*', 0)), '') END,
        CASE WHEN page_id % 2 = 0 THEN nullif({_host('url')}, '') END, 'The Feed') AS publisher FROM web"""),
    "title_suffixes": _with(ITEMS, select=f"SELECT item_id, CASE WHEN item_id % 3 = 0 THEN regexp_replace(title, '{WS}+$', '') ELSE title || ' - and why it matters' END AS title FROM items"),
    "strip_html": rf"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
        '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '{WS}+', ' ', 'g')) AS plain FROM pages""",
    "truncate_text": "SELECT doc_id AS item_id, substr(text, 1, 1000) AS description FROM documents",
    "slugs": f"SELECT doc_id AS item_id, {_slug('text')} AS slug FROM documents",
    "norm_titles": f"SELECT doc_id AS item_id, {_norm('text')} AS norm FROM documents",
    "title_tokens": f"SELECT doc_id AS item_id, array_to_string(list_sort({_tokens('text', 'source')}), ' ') AS tokens FROM documents",
    "safe_text": _with(WEB, select=f"SELECT page_id, {_safe('html')} AS safe, CASE WHEN page_id % 4 = 0 THEN '' ELSE link END AS href FROM web"),
    "delimiters": _with(ITEMS, select="SELECT item_id, title || description AS text FROM items"),
    "email_check": _with(USERS, select=r"SELECT user_ord, email, regexp_matches(trim(email), '^[^@\s]+@[^@\s]+\.[^@\s]+$') AS ok FROM users"),
    "prompts": _with(ITEMS, NUMBERED, select="SELECT batch_id, count(*) AS n_items, 'Sum up ' || string_agg(" + _item_text("'Item ' || (pos + 1) || ':'") + ", chr(10) ORDER BY pos) || ' as {\"items\": []}' AS prompt FROM batched GROUP BY batch_id"),
    "topic_prompts": _with(ITEMS, "n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY item_ord) - 1 AS k FROM items)",
        select="SELECT source, k // 50 AS chunk, count(*) AS n_items, string_agg(" + _item_text("'INDEX: ' || (k % 50)") + ", chr(10) ORDER BY k) AS prompt FROM n GROUP BY ALL"),
    "batch_join": _with(ITEMS, SCORED, NUMBERED, ANSWERS, select="""SELECT item_id, batch_id, pos,
        CASE WHEN garbage OR scalar OR absent THEN substr(description, 1, 300) ELSE 'S' || item_id END AS summary,
        CASE WHEN garbage OR scalar OR absent OR odd THEN 'mention' ELSE said END AS category,
        CASE WHEN garbage OR scalar OR absent THEN 'de' ELSE said_domain END AS domain FROM answers"""),
    "response_audit": _with(ITEMS, SCORED, NUMBERED, ANSWERS, select="""SELECT batch_id, count(*) AS n_items, bool_or(garbage) AS unparseable,
        count(*) FILTER (garbage OR scalar OR absent) AS n_missing, count(*) FILTER (odd AND NOT garbage) AS n_unknown_category FROM answers GROUP BY batch_id"""),
    "single_join": _with(ITEMS, SCORED, select="""SELECT item_id, CASE WHEN item_id % 9 < 2 THEN substr(description, 1, 300) ELSE 'S' || item_id END AS summary,
        CASE WHEN item_id % 9 < 2 OR category = 'notable' THEN 'mention' ELSE category END AS category FROM scored"""),
    "cluster_stories": _with(ITEMS, CLUSTERED, select=f"""SELECT m.item_id, m.source, m.story_ord, m.n_members,
        CASE m.c WHEN 0 THEN 'Pair' WHEN 2 THEN 'Late' ELSE m.title END AS title, m.link, {_stamp('m.published')} AS published,
        CASE m.c WHEN 0 THEN 'both' WHEN 1 THEN 'one' ELSE substr(m.description, 1, 300) END AS summary,
        CASE m.c WHEN 0 THEN 'key' WHEN 2 THEN 'notable' ELSE 'mention' END AS category,
        CASE m.c WHEN 0 THEN 'en' WHEN 2 THEN 'fr' ELSE 'de' END AS domain, l.links
        FROM merged m JOIN links l ON l.source = m.source AND l.story_ord = m.story_ord"""),
    "model_calls": _with(ITEMS, NUMBERED, "p AS (SELECT batch_id, count(*) AS n_items, length(string_agg(" + _item_text("'Item ' || (pos + 1) || ':'") + ", chr(10) ORDER BY pos)) AS n FROM batched GROUP BY batch_id)",
        select="SELECT batch_id, n_items, n AS input_tokens, n_items AS output_tokens FROM p"),
    "usage_extract": _with(USAGE, select="SELECT event_id, input_tokens, CASE WHEN event_id % 4 = 2 THEN 0 ELSE output_tokens END AS output_tokens FROM calls WHERE event_id % 4 <> 3"),
    "usage_cost": _with(USAGE, select="SELECT event_id, provider, model, cost_usd FROM usage"),
    "usage_daily": _with(USAGE, DAILY, select="SELECT strftime(d.day, '%Y-%m-%d') AS day, input_tokens, output_tokens, total_tokens, calls, cost_usd, cost_is_partial, models FROM daily d"),
    "usage_rollup": _with(USAGE, DAILY, select="""SELECT coalesce(strftime(d.day, '%Y-%m-%d'), 'total') AS day, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
        CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(cost_usd), 4) AS cost_usd,
        bool_or(cost_is_partial) AS cost_is_partial, count(*) AS n_days FROM daily d GROUP BY ROLLUP (d.day)"""),
    "history_page": _with(HISTORY, select=f"SELECT id, {_stamp('sent_at')} AS sent_at, digest_title, title FROM history WHERE digest_slug = 'digest-1-urgent' ORDER BY id DESC LIMIT 200 OFFSET 400"),
    "history_deep": _with(HISTORY, select="SELECT id, digest_slug, title FROM history WHERE id < 7000 ORDER BY id DESC LIMIT 200"),
    "history_trim": _with(HISTORY, select="SELECT id, digest_slug FROM history ORDER BY id DESC LIMIT 10000"),
    "history_counts": _with(HISTORY, select="SELECT '' AS digest_slug, count(*) AS total FROM history UNION ALL SELECT digest_slug, count(*) FROM history GROUP BY digest_slug"),
    "history_append": _with(ITEMS, SCORED, DIGESTS, ROUTED, select="SELECT 1000 + row_number() OVER (ORDER BY digest_ord, item_ord) AS id, digest_slug, title, link, source, summary, category FROM routed"),
    "vocabularies": """WITH v AS (SELECT p_partkey % 20 AS instance, CASE WHEN p_partkey % 20 <> 0 THEN CASE WHEN p_partkey % 7 = 0 THEN ''
            WHEN p_partkey % 20 < 4 AND p_partkey % 11 = 0 THEN 'other' ELSE p_brand END END AS c,
          CASE WHEN p_partkey % 20 < 15 THEN split_part(p_type, ' ', 1) END AS d FROM part),
        labels AS (SELECT instance, c FROM v WHERE c <> '' UNION SELECT 0, unnest(['news', 'thought_leadership', 'ai', 'ai_general', 'other', 'exclude'])),
        c AS (SELECT instance, string_agg(c, ',' ORDER BY c) AS categories, coalesce(max(c) FILTER (c = 'other'), max(c) FILTER (c <> 'exclude')) AS best FROM labels GROUP BY 1),
        d AS (SELECT instance, coalesce(string_agg(DISTINCT d, ',' ORDER BY d), '') AS domains, min(d) AS least, bool_or(d = 'PROMO') AS promo FROM v GROUP BY 1)
        SELECT instance, categories, CASE WHEN instance % 5 = 0 THEN 'chosen' ELSE best END AS fallback_category, domains,
          CASE WHEN instance % 3 = 0 AND promo THEN 'PROMO' ELSE least END AS fallback_domain FROM c JOIN d USING (instance)""",
    "run_latest": """SELECT instance, run_id, status, items_processed, previous_delivered, error FROM (SELECT o_custkey AS instance, o_orderkey AS run_id,
        CASE o_orderstatus WHEN 'F' THEN 'failure' ELSE 'success' END AS status, CAST(floor(o_totalprice) AS BIGINT) AS items_processed, o_orderstatus = 'P' AS previous_delivered,
        CASE WHEN o_orderstatus = 'F' THEN 'boom' END AS error, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
    "merge_rows": _with(SUPPLIER, select="""SELECT b.name, coalesce(e.s_nationkey, b.s_nationkey) AS s_nationkey, coalesce(e.s_acctbal, b.s_acctbal) AS s_acctbal FROM base b LEFT JOIN edited e ON e.name = b.name
        UNION ALL SELECT name, s_nationkey, s_acctbal FROM edited WHERE name NOT IN (SELECT name FROM base) AND name NOT IN (SELECT name FROM stamp)"""),
    "merge_changes": _with(SUPPLIER, select="""SELECT e.name, CASE WHEN b.name IS NOT NULL THEN 'updated' WHEN e.name IN (SELECT name FROM stamp) THEN 'removed' ELSE 'added' END AS action
        FROM edited e LEFT JOIN base b ON b.name = e.name WHERE b.name IS NULL OR b.s_acctbal <> e.s_acctbal"""),
    "merge_values": _with(SETTINGS, "allk AS (SELECT name FROM base UNION SELECT name FROM edited)",
        """j AS (SELECT k.name, b.value AS b, e.value AS e, s.value AS s FROM allk k LEFT JOIN base b ON b.name = k.name LEFT JOIN edited e ON e.name = k.name LEFT JOIN stamp s ON s.name = k.name)""",
        select="""SELECT name, CASE WHEN e IS NULL THEN b WHEN s = e THEN b ELSE e END AS value,
        CASE WHEN e IS NULL THEN 'same' WHEN s = e AND b IS NULL THEN 'removed' WHEN s = e AND b <> e THEN 'kept' WHEN s = e THEN 'same'
        WHEN b IS DISTINCT FROM e THEN 'set' ELSE 'same' END AS action FROM j"""),
    "render_digests": _with(ITEMS, SCORED, DIGESTS, ROUTED, RENDERED, select="SELECT digest_slug, page, markdown FROM rendered"),
    "digest_blocks": _with(ITEMS, SCORED, DIGESTS, ROUTED, RENDERED, BLOCKS, select=f"""SELECT digest_slug, rank, n,
        CASE WHEN n = k - 2 THEN regexp_replace(text, '{WS}+$', '') ELSE text END AS text FROM placed WHERE n < k - 1"""),
    "outbox": _with(ITEMS, SCORED, DIGESTS, ROUTED, RENDERED, select="""SELECT r.digest_slug, coalesce(x.a, '') AS recipient, r.digest_title || ' — 2024-01-31' AS subject, length(r.markdown) AS body_chars,
        CASE WHEN x.a IS NULL THEN 'no recipient configured' ELSE '' END AS error FROM rendered r JOIN digests d ON d.digest_ord = r.digest_ord
        LEFT JOIN (SELECT digest_ord, unnest(rcpt) AS a FROM digests) x ON x.digest_ord = r.digest_ord"""),
    "previous_digests": _with(HISTORY, select=f"SELECT digest_slug, id, {_stamp('sent_at')} AS rendered_at FROM history QUALIFY sent_at = max(sent_at) OVER (PARTITION BY digest_slug)"),
    "feed_scan": _with(ITEMS, LANDED, select=f"SELECT item_id, feed_id, source, publisher, title, link, description, {_stamp('published')} AS published FROM landed"),
    "landed_trim": _with(ITEMS, LANDED,
        "capped AS (SELECT * FROM landed QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY entry_ord) <= 20)",
        f"young AS (SELECT * FROM capped WHERE published IS NULL OR published >= {AS_OF} - INTERVAL 21 DAY)", FAIR.format(src="young"),
        select=f"SELECT item_id, feed_id, {_stamp('published')} AS published FROM fair"),
    "summarise_batches": _with(ITEMS, NUMBERED, select="SELECT item_id, 'place ' || pos AS summary, 'key' AS category, 'en' AS domain FROM batched"),
    "summarise_topics": _with(ITEMS, NUMBERED, select="SELECT source, 'key' AS category, 'place ' || pos AS summary, count(*) AS n FROM batched GROUP BY ALL"),
    "topic_stories": _with(ITEMS,
        "lettered AS (SELECT *, substr(title, 1, 1) AS letter, min(item_ord) OVER (PARTITION BY source) AS topic FROM items)",
        """stories AS (SELECT source, letter, topic, count(*) AS n, min(item_ord) AS first, arg_min(item_id, item_ord) AS item_id, arg_min(title, item_ord) AS title,
          arg_min(description, item_ord) AS description, max(published) AS published, count(DISTINCT link) AS n_links FROM lettered GROUP BY ALL)""",
        select=f"""SELECT row_number() OVER (ORDER BY topic, n = 1, first) - 1 AS item_ord, item_id, source, CASE WHEN n > 1 THEN 'All of ' || letter ELSE title END AS title,
        CASE WHEN n > 1 THEN 'about ' || letter ELSE substr(description, 1, 300) END AS summary, CASE WHEN n > 1 THEN 'key' ELSE 'mention' END AS category,
        {_stamp('published')} AS published, CAST(n_links AS INT) AS n_links FROM stories"""),
    "stream_seen": _with(ITEMS, "f AS (SELECT link, min(item_id % 4) AS d FROM items GROUP BY link)",
        select="SELECT item_id, items.link FROM items JOIN f ON f.link = items.link WHERE item_id % 4 = d"),
}
_YOUNG = f"young AS (SELECT * FROM landed WHERE landed.published IS NULL OR landed.published >= {AS_OF} - INTERVAL 21 DAY)"
# the stand-in labels items by their place in batches of eight
_LABELLED = """numbered AS (SELECT *, item_id AS item_ord, CAST((row_number() OVER (ORDER BY item_id) - 1) % 8 AS INT) AS pos FROM {src}),
scored AS (SELECT *, 'place ' || pos AS summary, ['exclude','key','mention','notable'][pos % 4 + 1] AS category, ['de','en','es','fr'][pos // 2 % 4 + 1] AS domain FROM numbered)"""
# a run derives the sources of digests without any from the feeds that name them
_WIRED = [FEEDS, DIGESTS.replace("digests AS", "declared AS", 1), "named AS (SELECT DISTINCT trim(name) AS feed, trim(t) AS t FROM (SELECT name, unnest(digests) AS t FROM feeds))",
          """digests AS (SELECT digest_ord, title, sections, CASE WHEN len(sources) > 0 THEN sources ELSE coalesce((SELECT list(feed) FROM named n WHERE n.t = declared.title), []) END AS sources,
          len(sources) = 0 AS derived, domain, rcpt, label FROM declared)"""]
ORACLES["full_run"] = _with(ITEMS, LANDED, _YOUNG, _LABELLED.format(src="young"), *_WIRED, ROUTED,
    select=f"""SELECT 'history' AS kind, digest_slug AS name, row_number() OVER (ORDER BY digest_ord, item_ord) AS number, title || ' ' || link || ' ' || summary || ' ' || category AS text FROM routed
    UNION ALL SELECT 'outbox', {_slug('d.title')}, 0, coalesce(a, '-') || ' ' || d.title || ' — 2024-01-31' FROM digests d
      LEFT JOIN (SELECT digest_ord, unnest(rcpt) AS a FROM digests) x ON x.digest_ord = d.digest_ord WHERE d.digest_ord IN (SELECT digest_ord FROM routed)
    UNION ALL SELECT 'unrouted', source, count(*), coalesce(nullif(domain, ''), '-') || ' ' || category FROM scored
      WHERE category <> 'exclude' AND item_id NOT IN (SELECT item_id FROM routed) GROUP BY source, domain, category
    UNION ALL SELECT 'usage', 'alpha', count(*), 'm-1' FROM scored
    UNION ALL SELECT DISTINCT 'seen', link, 0, '' FROM (SELECT link FROM routed UNION ALL SELECT link FROM scored WHERE category = 'exclude')
    UNION ALL SELECT 'run', 'success', count(*), '' FROM routed""")
ORACLES["run_metrics"] = _with(ITEMS, LANDED,
    "capped AS (SELECT * FROM landed QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY entry_ord) <= 20)",
    f"young AS (SELECT * FROM capped WHERE published IS NULL OR published >= {AS_OF} - INTERVAL 21 DAY)", FAIR.format(src="young"),
    _LABELLED.format(src="fair"), *_WIRED, ROUTED,
    select="""SELECT * FROM (SELECT unnest(['trim', 'dedup', 'seen', 'summarise', 'route']) AS stage,
      unnest([(SELECT count(*) FROM landed), n, n, n, n]) AS rows_in, unnest([n, n, n, n, (SELECT count(*) FROM routed)]) AS rows_out FROM (SELECT count(*) AS n FROM fair))""")
ORACLES["bad_feeds"] = _with(ITEMS, LANDED, f"young AS (SELECT * FROM landed WHERE feed_ord % 5 > 2 AND (landed.published IS NULL OR landed.published >= {AS_OF} - INTERVAL 21 DAY))",
    select="""SELECT feed_id, -1 AS doc_ord, 'items ' || count(*) AS reason FROM young GROUP BY feed_id
    UNION ALL SELECT DISTINCT CASE feed_ord % 5 WHEN 2 THEN 'stray-' || feed_id ELSE feed_id END, CAST(item_id // 500 AS INT),
      CASE feed_ord % 5 WHEN 0 THEN 'malformed' WHEN 1 THEN 'oversized' ELSE 'unknown_feed' END FROM items WHERE feed_ord % 5 <= 2""")
ORACLES["digest_files"] = _with(ITEMS, SCORED, DIGESTS, ROUTED, RENDERED, BLOCKS, select=f"""SELECT digest_slug, line, count(*) AS n FROM (
    SELECT digest_slug, unnest(string_split(CASE WHEN n = k - 2 THEN regexp_replace(text, '{WS}+$', '') ELSE text END, chr(10))) AS line FROM placed WHERE n < k - 1) GROUP BY ALL""")
_DROPS = [f"""p{k} AS (SELECT a.* FROM arrived a LEFT JOIN m{k - 1} m USING (link) WHERE a.item_id % 4 = {drop} AND (m.t IS NULL OR a.t >= m.t + INTERVAL 5 DAY)),
m{k} AS (SELECT link, max(t) AS t FROM (SELECT link, t FROM m{k - 1} UNION ALL SELECT link, t FROM p{k}) GROUP BY link)""" for k, drop in ((1, 2), (2, 0), (3, 3), (4, 1))]
ORACLES["stream_keyed"] = _with(ITEMS, f"arrived AS (SELECT item_id, link, coalesce(published, {AS_OF}) AS t FROM items WHERE link <> '')",
    "m0 AS (SELECT link, t FROM arrived WHERE false)", *_DROPS, select="SELECT item_id, link FROM p1 " + " ".join(f"UNION ALL SELECT item_id, link FROM p{k}" for k in (2, 3, 4)))
ORACLES["topic_reach"] = _with(ITEMS, DIGESTS, TOPICS, "open AS (SELECT string_agg(title, '|' ORDER BY digest_ord) AS titles FROM digests WHERE len(sources) = 0 AND NOT derived)",
    select="""SELECT topic_ord, name AS topic, titles || CASE WHEN contains(context, 'M') THEN '|' || regexp_extract(queries[2], '^(Brand#[0-9]+)', 1) ELSE '' END AS digests FROM topics, open""")
ORACLES["state_retention"] = _with(ITEMS, HISTORY, USAGE, select=f"""SELECT DISTINCT 'live' AS kept, link FROM items WHERE item_id % 3 > 0
    UNION ALL SELECT DISTINCT 'without_1', link FROM items WHERE item_id % 3 = 2
    UNION ALL SELECT 'marks', (item_id % 3) || '=' || count(DISTINCT link) FROM items WHERE item_id % 3 > 0 GROUP BY item_id % 3
    UNION ALL SELECT 'history', id::VARCHAR FROM (SELECT id FROM history ORDER BY id DESC LIMIT 1000)
    UNION ALL SELECT 'usage', strftime(day, '%Y-%m-%d') || '=' || count(*) FROM usage WHERE day >= CAST({AS_OF} AS DATE) - 14 GROUP BY day""")
ORACLES["stream_daily"] = ORACLES["usage_daily"].replace(f"WHERE day >= CAST({AS_OF} AS DATE) - 29 ", "")
_LINTS = ORACLES["wiring_lints"]
_GAPS = _with(
    "cols AS (SELECT unnest(['key','mention','notable']) AS col)",
    "src AS (SELECT d.title, d.sections, d.domain, CASE WHEN len(d.sources) > 0 THEN d.sources ELSE (SELECT list(feed) FROM named n WHERE n.t = d.title) END AS s FROM digests d)",
    """grid AS (SELECT f.feed_id, c.col, count(x.title) AS k FROM feeds f CROSS JOIN cols c
    LEFT JOIN src x ON x.domain IS NULL AND list_contains(x.sections, c.col) AND list_contains(x.s, f.name) GROUP BY ALL)""",
    select="").removeprefix("WITH ").rstrip()
ORACLES["health"] = (
    _LINTS[:_LINTS.rindex("SELECT 'unknown_source'")].rstrip() + ",\n" + _GAPS
    + ",\nfound AS (" + _LINTS[_LINTS.rindex("SELECT 'unknown_source'"):] + "),\n"
    + SCORED + ",\n" + NUMBERED + ",\n" + ANSWERS + """
    SELECT rule, count(*) AS n FROM found GROUP BY rule
    UNION ALL SELECT 'unroutable', count(*) FROM grid WHERE k = 0 HAVING count(*) > 0
    UNION ALL SELECT 'orphan_feed', count(*) FROM (SELECT feed_id FROM grid GROUP BY feed_id HAVING max(k) = 0) HAVING count(*) > 0
    UNION ALL SELECT 'orphan_topic', count(*) FROM topics WHERE lower(coalesce(nullif(recipient, ''), 'all')) <> 'all'
      AND lower(recipient) NOT IN (SELECT lower(email) FROM clean_users)
    UNION ALL SELECT 'response', (SELECT count(DISTINCT batch_id) FROM answers WHERE garbage)
      + (SELECT count(*) FROM answers WHERE garbage OR scalar OR absent) + (SELECT count(*) FROM answers WHERE odd AND NOT garbage)""")
