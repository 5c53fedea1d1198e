"""Benchmark passages in documents, found by spaced seeds; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which of neighbouring words a seed looks at; it ignores the others, so they may be substituted.
#: All look at the first two, which sorts out most places of a document by one look-up. Whatever words
#: of 6 to WINDOW are substituted, if AGREE still holds one of the masks fits somewhere between.
MASKS = ("1111", "11011", "110011", "11101", "110101")
#: The same for items of fewer words, by their number.
SHORT = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("111",), 5: ("111", "11011")}
#: Words compared around a hit, and the share of them that must agree.
WINDOW, AGREE = 20, 0.8
#: Seeds are broadcast up to this many rows (about 60 MB), and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000

_GAPS = r"[\s\p{Punct}]+"


def word_hashes(text: Column) -> Column:
    """A hash per word, in order: A-Z and other letters in lower case, punctuation left out."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _GAPS), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _placed(rows: DataFrame, words: str, at: str) -> DataFrame:
    """A row for each place `at` of an array of words. The outer form, as Spark would put a filter on
    the array's size below the other and so make the words twice."""
    return rows.select("*", F.posexplode_outer(words).alias(at, "_w")).where(F.col(at).isNotNull()).drop("_w")


def _seeds(words: Column, at: Column, masks: tuple[str, ...]) -> Column:
    """One hash per mask for the word position `at`; null where the mask leaves the text."""
    found = []
    for mask in masks:
        seen = [F.get(words, at + i) for i, bit in enumerate(mask) if bit == "1"]
        found.append(F.when(at + len(mask) <= F.size(words), F.xxhash64(F.lit(mask), *seen)))
    return F.array(*found)


def seeds(items: DataFrame) -> DataFrame:
    """(seed, item_id, item_at) of every word of every item, by the masks for its length."""
    item, at = F.col("item"), F.col("item_at")
    own = _seeds(item, at, MASKS)
    for n, masks in SHORT.items():
        own = F.when(F.size(item) == n, _seeds(item, at, masks)).otherwise(own)
    return (
        _placed(items.select("item_id", word_hashes(F.col("text")).alias("item")), "item", "item_at")
        .select("item_id", "item_at", F.explode(own).alias("seed"))
        .where("seed is not null")
    )


def _pair(words: Column, at: Column) -> Column:
    return F.xxhash64(F.get(words, at), F.get(words, at + 1))


def _best_window(words: Column, item: Column, shift: Column) -> Column:
    """Most words that agree in WINDOW neighbours of the item (all of a shorter one), at this shift."""
    width = F.least(F.size(item), F.lit(WINDOW))

    def same(j: Column) -> Column:
        there = F.when((j >= 0) & (j + shift >= 0), F.get(words, j + shift) == F.get(item, j))
        return F.coalesce(there.cast("int"), F.lit(0))

    def slide(state: Column, j: Column) -> Column:
        now = state["now"] + same(j) - same(j - width)
        return F.struct(now.alias("now"), F.greatest(state["best"], now).alias("best"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    return F.aggregate(F.sequence(F.lit(0), F.size(item) - 1), start, slide, lambda s: s["best"])


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, agreeing, compared, doc_word) of each document with a passage of an item.

    A seed hashes the words that a mask looks at; equal seeds in item and document put the item
    beside the document at one shift. There the words around the hit are compared one by one: of
    WINDOW neighbouring item words (all of a shorter item) the share AGREE must be the same, so
    substituted words are tolerated. doc_word is where the item would begin; of several shifts the
    best is returned, one row per doc_id and item_id. Rows that repeat a doc_id count as one
    document. Null and empty texts hold no passage; items of a few words are searched by all of
    them. No items give no rows.

    Documents are read once and their seeds are never shuffled while the item seeds are few
    enough to broadcast, which is counted first. Beyond that they are joined by shuffle. A hit takes
    along the words beside the item only, never its document, and equal hits are made one before
    their words are compared.
    """
    items = items.select("item_id", "text").where("text is not null")
    found = seeds(items)
    small = found.count() <= BROADCAST_ROWS
    known = items.select("item_id", word_hashes(F.col("text")).alias("item"))
    lengths = {r.n for r in known.select(F.size("item").alias("n")).where(F.col("n") <= max(SHORT)).distinct().collect()}
    masks = tuple(dict.fromkeys([*MASKS, *(m for n in sorted(lengths & SHORT.keys()) for m in SHORT[n])]))
    # The longest text of an item_id, which may be repeated.
    found = found.join(known.groupBy("item_id").agg(F.max(F.size("item")).alias("n")), "item_id")
    words = docs.select("doc_id", word_hashes(F.col("text")).alias("words"))
    seed = F.explode(_seeds(F.col("words"), F.col("at"), masks)).alias("seed")
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    if small:
        placed = _placed(words, "words", "at")
        if 1 not in lengths:  # an item of one word has no pair
            pairs = _placed(known, "item", "at").select(_pair(F.col("item"), F.col("at")).alias("pair")).distinct()
            placed = placed.withColumn("pair", _pair(F.col("words"), F.col("at")))
            placed = placed.join(F.broadcast(pairs), "pair", "left_semi")
        hits = placed.select("doc_id", "words", "at", seed).join(F.broadcast(found), "seed")
        hits = hits.select("doc_id", "item_id", "n", "words", shift)
    else:
        # doc_id may be null or repeated.
        words = words.withColumn("row", F.xxhash64("doc_id", "words"))
        met = _placed(words, "words", "at").select("row", "at", seed).where("seed is not null").join(found, "seed")
        hits = met.select("row", "item_id", "n", shift).distinct().join(words, "row")
    before = F.greatest(-F.col("shift"), F.lit(0))  # words of the item in front of the document
    beside = F.slice("words", F.greatest(F.col("shift"), F.lit(0)) + 1, F.greatest(F.col("n") - before, F.lit(0)))
    # A passage is hit by every mask at every word of it, and compared once.
    hits = hits.select("doc_id", "item_id", "shift", beside.alias("beside")).distinct()
    hits = hits.join(F.broadcast(known) if small else known, "item_id")
    compared = F.least(F.size("item"), F.lit(WINDOW)).alias("compared")
    # One number with the order of (agreeing, -shift, compared); neither share count passes 2 ** 6.
    back = F.lit(1 << 31) - F.col("shift").cast("long")
    rank = F.shiftleft(F.col("agreeing").cast("long"), 40) + F.shiftleft(back, 6) + F.col("compared").cast("long")
    best = F.col("best")
    return (
        hits.select("doc_id", "item_id", "shift", compared, "beside", "item")
        .withColumn("agreeing", _best_window(F.col("beside"), F.col("item"), F.least("shift", F.lit(0))))
        .where(F.col("agreeing") >= AGREE * F.col("compared"))
        .groupBy("doc_id", "item_id")
        .agg(F.max(rank).alias("best"))
        .select(
            "doc_id",
            "item_id",
            F.shiftright(best, 40).cast("int").alias("agreeing"),
            best.bitwiseAND(63).cast("int").alias("compared"),
            (F.lit(1 << 31) - F.shiftright(best, 6).bitwiseAND((1 << 34) - 1)).cast("int").alias("doc_word"),
        )
    )
