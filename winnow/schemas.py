"""Table layouts of the item stream and its configuration tables."""

LINK = "array<struct<publisher:string,link:string>>"

ITEM = (
    "item_id bigint, feed_id string, feed_ord int, entry_ord bigint, item_ord bigint, "
    "source string, publisher string, title string, link string, description string, "
    "published timestamp, topic_context string"
)
SCORED = ITEM + f", summary string, category string, domain string, links {LINK}"
FEEDS = (
    "feed_id string, feed_ord int, name string, url string, is_search boolean, "
    "topic_context string, digests array<string>"
)
TOPICS = (
    "topic_ord int, name string, queries array<string>, context string, lang string, "
    "country string, `window` string, engines array<string>, recipient string"
)
USERS = "user_ord int, name string, email string"
DIGESTS = (
    "digest_ord int, title string, sections array<string>, sources array<string>, "
    "sources_derived boolean, domain string, `to` array<string>, labels map<string,string>"
)
SEEN = "link string, seen_at timestamp"
HISTORY = (
    "id bigint, sent_at timestamp, digest_title string, digest_slug string, title string, "
    "link string, source string, summary string, category string"
)
USAGE = (
    "at timestamp, day date, provider string, model string, kind string, "
    "input_tokens bigint, output_tokens bigint, cost_usd double"
)
PRICES = "provider string, id string, input_usd_per_mtok double, output_usd_per_mtok double"
RUN_LOG = (
    "at timestamp, status string, items_processed bigint, previous_delivered boolean, error string"
)
