"""Same story, different newsroom: items of one source sharing their distinctive words.

An item goes when any earlier item, kept or not, tells the same story. So for every set of
words it is enough to know the earliest item of a matching set: a minimum, not a pair list.

Items with one word set never match each other (each side needs words of its own), so the
work runs on distinct (source, word set) rows, however often one headline is repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import significant_tokens
from ..session import broadcast_if_small, written

MIN_SHARED = 3
MIN_OWN = 2
# A word in more sets of its source than this is no key by itself; pairs of words are.
HOT_WORD = 200
# A pair of words in more sets than this is joined in salted pieces of about so many.
HOT_KEY = 2000


def newest_first(published: Column, item_ord: Column) -> Column:
    """Sortable order key: newest first, undated last, then item order."""
    age = F.coalesce(-F.unix_micros(published), F.lit((1 << 63) - 1))
    return F.struct(age.alias("age"), item_ord.alias("item_ord"))


def word_sets(items: DataFrame) -> DataFrame:
    """items with `_set` (its words as one sorted text) and `_n`, where a match is possible."""
    words = F.sort_array(significant_tokens(F.col("title"), F.col("source")))
    return (
        items.where(F.coalesce("source", F.lit("")) != "")
        .withColumn("_words", words)
        .withColumn("_n", F.size("_words"))
        .where(F.col("_n") >= MIN_SHARED + MIN_OWN)
        .withColumn("_set", F.array_join("_words", " "))
    )


def _ordered_by_rarity(sets: DataFrame) -> DataFrame:
    """Each set with `ranked`, those of its words that another set of its source has too, rarest in the source first, as (c, id) of
    count and number; `words`, their numbers; and `own`, how many words it has alone, which come before those.

    Numbers stand for words from here on: they are of one source, and a row that is sent once a key holds no text."""
    words = sets.select("_no", "source", F.explode("words").alias("w"))
    shared = words.groupBy("source", "w").agg(F.count("*").alias("c")).where("c > 1")
    numbered = written(shared.withColumn("id", F.monotonically_increasing_id()), "words")
    ranked = (
        words.join(broadcast_if_small(numbered), ["source", "w"])
        .groupBy("_no")
        .agg(F.sort_array(F.collect_list(F.struct("c", "id"))).alias("ranked"))
    )
    return sets.select("_no", "sid", "n", "first").join(ranked, "_no").select(
        "sid", "n", "first", "ranked", F.transform("ranked", lambda r: r["id"]).alias("words"), (F.col("n") - F.size("ranked")).alias("own"))


def _keys(ranked: Column, prefix: Column, hot_word: int) -> Column:
    """Join keys from a prefix of the ranked words: a rare word alone, a frequent one with
    each word after it. Two sets sharing a word within both prefixes, and a further word
    within one more, always share such a key."""
    heads = F.slice(ranked, F.lit(1), F.greatest(prefix, F.lit(0)))
    key = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    alone = F.transform(F.filter(heads, lambda r: r["c"] <= hot_word), lambda r: key(r["id"], F.lit(-1).cast("long")))
    paired = F.flatten(F.transform(heads, lambda r, i: F.when(
        r["c"] > hot_word,
        F.transform(F.slice(ranked, i + 2, F.greatest(prefix - i, F.lit(0))), lambda s: key(r["id"], s["id"])),
    ).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))))
    return F.concat(alone, paired)


def same_story(a: Column, b: Column, n_a: Column, n_b: Column, threshold: float) -> Column:
    """Whether two sets of `n_a` and `n_b` words, `a` and `b` those of them that others have too, tell one story."""
    shared = F.size(F.array_intersect(a, b))
    smaller = F.least(n_a, n_b)
    return (shared >= MIN_SHARED) & (shared / smaller >= threshold) & (smaller - shared >= MIN_OWN)


def _salted(df: DataFrame, crowd: DataFrame, hot_key: int, copies: bool) -> DataFrame:
    """Spread the rows of a crowded key; the other side is copied to every salt, of which a key has as many as its size asks for."""
    pieces = F.coalesce(F.ceil(F.col("size") / hot_key).cast("int"), F.lit(1))
    salt = F.explode(F.sequence(F.lit(0), pieces - 1)) if copies else F.pmod(F.xxhash64("sid"), pieces).cast("int")
    return df.join(broadcast_if_small(crowd.select("a", "b", "size")), ["a", "b"], "left").withColumn("salt", salt).drop("size")


def earliest_match(sets: DataFrame, threshold: float, hot_word: int = HOT_WORD, hot_key: int = HOT_KEY) -> DataFrame:
    """(sid, first_match): order key of the earliest set telling the same story.

    In a matching pair the smaller set x shares at least need(x) = max(3, threshold * |x|)
    words, so the rarest |x| - need(x) + 1 words of x and the rarest |y| - 2 of the other
    meet (prefix filter), each prefix one longer for a pair of words."""
    numbered = written(sets.where(F.col("sid").isNotNull()).withColumn("_no", F.monotonically_increasing_id()), "sets")
    ranked = written(_ordered_by_rarity(numbered), "ranked")
    n = F.col("n")
    need = F.greatest(F.lit(MIN_SHARED), F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int"))
    small, large = (ranked.select("sid", "words", "n", "first", F.explode(_keys(F.col("ranked"), prefix - F.col("own"), hot_word)).alias("key")).select(
        "key.a", "key.b", "sid", "words", "n", "first") for prefix in (n - need + 1, n - (MIN_SHARED - 1)))

    # the earliest set of a crowded key meets every other set once: one row in, one row out
    crowd = large.groupBy("a", "b").agg(F.count("*").alias("size"), F.min_by(
        F.struct("first", "words", "n"), F.col("first")).alias("lead")).where(F.col("size") > hot_key)
    crowd = written(crowd, "crowd")
    crowded = broadcast_if_small(crowd)
    led = (
        large.join(crowded, ["a", "b"])
        .where((F.col("lead.first") < F.col("first")) & same_story(F.col("words"), F.col("lead.words"), n, F.col("lead.n"), threshold))
        .groupBy("sid").agg(F.min("lead.first").alias("first_match"))
    )
    settled = None
    if not crowd.isEmpty():
        led = written(led, "led")
        settled = led.select("sid", F.lit(True).alias("settled"))

    def mark(df):
        if settled is None:
            return df.withColumn("settled", F.lit(False))
        return df.join(settled, "sid", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))

    def salted(df, copies: bool):
        return df.withColumn("salt", F.lit(0)) if settled is None else _salted(df, crowd, hot_key, copies)

    def side(df, prefix):
        return df.select("a", "b", "salt", *[F.col(c).alias(prefix + c) for c in ("sid", "words", "n", "first", "settled")])

    # pairs of two settled sets are no longer needed; everything else is compared
    x, y = mark(small), mark(large)
    joined = None
    for left, right in ((x.where(~F.col("settled")), y), (x.where("settled"), y.where(~F.col("settled")))):
        part = side(salted(left, False), "x_").join(side(salted(right, True), "y_"), ["a", "b", "salt"]).where(
            (F.col("x_n") <= F.col("y_n")) & (F.col("x_sid") != F.col("y_sid"))
            & same_story(F.col("x_words"), F.col("y_words"), F.col("x_n"), F.col("y_n"), threshold))
        joined = part if joined is None else joined.unionAll(part)
        if settled is None:
            break
    # the minimum is taken where the pairs arise; no pair list is shuffled
    met = joined.select(F.explode(F.array(
        F.struct(F.col("x_sid").alias("sid"), F.col("y_first").alias("first_match")),
        F.struct(F.col("y_sid").alias("sid"), F.col("x_first").alias("first_match")),
    )).alias("m")).select("m.*")
    return met.unionByName(led).groupBy("sid").agg(F.min("first_match").alias("first_match"))


def drop_retold(items: DataFrame, threshold: float = 0.6, hot_word: int = HOT_WORD, hot_key: int = HOT_KEY) -> DataFrame:
    """Items no earlier item of their source tells."""
    order = newest_first(F.col("published"), F.col("item_ord"))
    # the words are taken out of the titles once; what is kept of a row is narrow
    placed = written(word_sets(items).select("item_id", "source", "_set", order.alias("_first")), "placed")
    sets = written(placed.groupBy("source", "_set").agg(F.min("_first").alias("first"), F.min_by("item_id", "_first").alias("sid")), "sets")
    words = F.split("_set", " ")
    match = earliest_match(sets.select("sid", "source", "first", words.alias("words"), F.size(words).alias("n")), threshold, hot_word, hot_key)
    found = written(sets.select("source", "_set", "sid").join(match, "sid").drop("sid"), "found")
    gone = written(
        placed.select("item_id", "source", "_set", "_first").join(broadcast_if_small(found), ["source", "_set"])
        .where(F.col("first_match") < F.col("_first")).select("item_id"), "gone")
    return items.join(gone, "item_id", "left_anti").select(items.columns)
