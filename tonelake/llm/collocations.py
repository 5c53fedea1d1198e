"""Phrases whose words stand together more often than apart, counted over a prefix-free parse.

The words of a text, with a mark where a piece ends, are cut where the next few of them hash to a
multiple of PERIOD. Neighbouring chunks share those words, so every phrase lies whole in a chunk, and it
belongs to the one in which it begins before the shared words. Equal passages give equal chunks, however
they are surrounded; the distinct chunks and how often each occurs are the dictionary, and phrases are
counted in it only, each as often as its chunk.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonelake.llm.common import Codes, gram_codes, raw, small_batches, word_codes
from tonelake.llm.scratch import written

MAX_WORDS, LEAST, SHARE, TOP = 3, 10, 50, 2_000
#: Words between two cuts, on average.
PERIOD = 32
#: Bits of the map of frequent phrases that tasks hold (16 MB at any input size). It spares counting
#: longer phrases that cannot be frequent; one that it lets through in error is counted and dropped.
MAP_BITS = 1 << 27
#: floor(10^6 a^2 / (l r)), for counts of up to 15 digits: 10^6 times the square of one has 36 of 38.
_A, _L, _R = (f"cast({c} as decimal(15,0))" for c in "alr")
SCORE = f"(cast(1000000 as decimal(7,0)) * ({_A} * {_A})) div ({_L} * {_R})"
#: Text bytes that a task parses at once, and chunk bytes it counts at once.
PARSED, COUNTED = 4 << 20, 8 << 20
#: Marks between pieces and between texts; both separate pieces, so no word holds them.
PIECE, TEXT = b".", b"!"
_PLAIN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + PIECE * 10
)


def _tokens(texts: list[bytes]) -> list[bytes]:
    """Words and marks of the texts, each text followed by TEXT; marks of pieces stand between words."""
    plain = (t.translate(_PLAIN).replace(PIECE, b" . ") for t in texts)
    return (b" ! ".join(plain) + b" !").split()


def chunks(texts: list[bytes], codes: Codes, overlap: int) -> Iterator[tuple[bytes, bool]]:
    """(chunk, closed) over the texts; the last chunk of a text is closed and has no shared words."""
    tokens = _tokens(texts)
    kind = np.fromiter((1 if t == PIECE else 2 if t == TEXT else 0 for t in tokens), np.int8, len(tokens))
    # Marks that follow a mark say nothing, nor does one at the start of a text.
    keep = (kind != 1) | (np.append(2, kind[:-1]) == 0)
    tokens = [t for t, k in zip(tokens, keep.tolist()) if k]
    kind = kind[keep]
    ends = np.flatnonzero(kind == 2)
    cut = np.zeros(len(tokens) + 1, bool)
    window = gram_codes(word_codes(tokens, codes), overlap)
    hit = np.flatnonzero(window % np.uint64(PERIOD) == 0)
    # A window that reaches a text's end is its last one; there is nothing to cut after it.
    cut[hit[ends[np.searchsorted(ends, hit)] >= hit + overlap]] = True
    starts = np.append(0, ends[:-1] + 1)
    cut[starts] = True
    at = np.flatnonzero(cut[: len(tokens)])
    stop = ends[np.searchsorted(ends, at)]
    after = np.append(at[1:], len(tokens))
    closed = after > stop
    last = np.where(closed, stop, after + overlap)
    for a, b, c in zip(at.tolist(), last.tolist(), closed.tolist()):
        if a < b:
            yield b" ".join(tokens[a:b]), c


def dictionary(docs: DataFrame, overlap: int) -> DataFrame:
    """(lang, closed, chunk, n): the distinct chunks of all texts of a language and their number."""

    def parse(batches):
        codes = Codes()
        for batch in small_batches(batches, "text", PARSED):
            langs, texts = batch.column("lang").to_pylist(), raw(batch.column("text"))
            found: Counter = Counter()
            for lang in dict.fromkeys(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                found.update((lang, closed, chunk) for chunk, closed in chunks(own, codes, overlap))
            if found:
                lang, closed, chunk = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang), pa.array(closed), pa.array(chunk, pa.binary()), pa.array(found.values(), pa.int64())],
                    names=["lang", "closed", "chunk", "n"],
                )

    rows = docs.where("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    parsed = rows.mapInArrow(parse, "lang string, closed boolean, chunk binary, n long")
    return parsed.groupBy("lang", "closed", "chunk").agg(F.sum("n").alias("n"))


def _buffers(batches) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= COUNTED:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _maybe_frequent(phrases: pa.Array, lang: str, bits: np.ndarray) -> np.ndarray:
    """Whether the map has each phrase, by Spark's xxhash64(lang, phrase)."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    digest = xxhash.xxh64_intdigest
    place = np.fromiter((digest(p, seed) for p in phrases.to_pylist()), np.uint64, len(phrases))
    place &= np.uint64(MAP_BITS - 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def phrase_counts(parsed: DataFrame, sizes: list[int], overlap: int, bits: np.ndarray | None = None) -> DataFrame:
    """(lang, words, phrase, n): all phrases of `sizes` words in the texts of a dictionary.

    With `bits`, only those whose two phrases of one word less the map has. Size 0 stands for the
    number of all words, with an empty phrase. Tasks add up what they read at once in exact keys.
    """

    def grams(table: pa.Table, lang: str):
        texts = raw(table.column("chunk"))
        times = table.column("n").to_numpy()
        tokens = b" ! ".join([PIECE, *texts, b""]).split()
        encoded = pa.array(tokens, pa.binary()).dictionary_encode()
        names = encoded.dictionary
        ids = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # The first two tokens are the marks, so they are the first two names.
        ids, at_end = ids[2:], np.flatnonzero(ids[2:] == 1)
        row = np.repeat(np.arange(len(texts)), np.diff(np.append(-1, at_end)))
        closed = table.column("closed").to_numpy(zero_copy_only=False).astype(bool)
        owned = closed[row] | (np.arange(len(ids)) < at_end[row] - overlap)
        weight = times[row]
        at = np.flatnonzero(ids >= 2)
        # ids of the phrases that start at `at`, and the phrases in order of their ids
        key, made = ids, names
        if 0 in sizes:
            total = int(weight[at[owned[at]]].sum())
            yield 0, pa.array([b""], pa.binary()), np.array([total])
        for words in range(1, max(sizes) + 1):
            if words > 1:
                at = at[(at + words - 1 < len(ids))]
                at = at[ids[at + words - 1] >= 2]
                if bits is not None and words == max(sizes):
                    frequent = np.zeros(len(made), bool)
                    frequent[key[at]] = True
                    frequent[key[at + 1]] = True
                    some = np.flatnonzero(frequent)
                    frequent[some] = _maybe_frequent(made.take(pa.array(some)), lang, bits)
                    at = at[frequent[key[at]] & frequent[key[at + 1]]]
                if not len(at):
                    return
                both = key[at] * len(names) + ids[at + words - 1]
                _, first, inner = np.unique(both, return_index=True, return_inverse=True)
                ahead, last = made.take(pa.array(key[at[first]])), names.take(pa.array(ids[at[first] + words - 1]))
                made = pc.binary_join_element_wise(ahead, last, pa.scalar(b" "))
                key = np.zeros(len(ids), np.int64)
                key[at] = inner
            if words in sizes:
                mine = at[owned[at]]
                n = np.zeros(len(made), np.int64)
                np.add.at(n, key[mine], weight[mine])
                some = np.flatnonzero(n)
                yield words, made.take(pa.array(some)), n[some]

    def count(batches):
        for table in _buffers(batches):
            for lang in pc.unique(table.column("lang")).to_pylist():
                for words, phrase, n in grams(table.filter(pc.equal(table.column("lang"), lang)), lang):
                    for a in range(0, len(n), 20_000):
                        size = len(n[a : a + 20_000])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([lang] * size),
                                pa.array(np.full(size, words, np.int32)),
                                phrase.slice(a, size).cast(pa.string()),
                                pa.array(n[a : a + 20_000]),
                            ],
                            names=["lang", "words", "phrase", "n"],
                        )

    found = parsed.mapInArrow(count, "lang string, words int, phrase string, n long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def frequent_map(phrases: DataFrame) -> np.ndarray:
    """MAP_BITS bits with one set for each (lang, phrase); its size does not depend on their number."""
    place = F.xxhash64("lang", "phrase").bitwiseAND(F.lit(MAP_BITS - 1).cast("long"))
    placed = phrases.select(place.alias("place"))
    one = F.expr("shiftleft(1L, cast(place % 64 as int))")
    rows = placed.groupBy(F.expr("place div 64").alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    bits = np.zeros(MAP_BITS // 64, np.uint64)
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return bits


def frequent_phrases(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, n) of every phrase of up to `max_words` words that occurs `least` times in a
    language, and, as words 0, the number of all words. Null texts are empty; a null lang is `und`."""
    overlap = max(1, max_words - 1)
    parsed = written(dictionary(docs, overlap), "chunks")

    def kept(counts: DataFrame) -> DataFrame:
        return written(counts.where((F.col("n") >= least) | (F.col("words") == 0)), "phrases")

    parts = [kept(phrase_counts(parsed, [0, 1, 2][: max_words + 1], overlap))]
    for words in range(3, max_words + 1):
        bits = frequent_map(parts[-1].where(F.col("words") == words - 1))
        parts.append(kept(phrase_counts(parsed, [words], overlap, bits)))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found


def _slices(phrase: str, least: int, most: str) -> str:
    """SQL for the contiguous parts of `least` up to (not with) `most` words of a phrase."""
    return f"""flatten(transform(sequence({least}, {most} - 1), size -> transform(
        sequence(1, {most} - size + 1), at -> array_join(slice(split({phrase}, ' '), at, size), ' '))))"""


def collocations(
    docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, share: int = SHARE, top: int = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the `top` phrases of each language.

    Texts are lower-cased (A-Z) and cut at `.,;:!?` and line ends into pieces, those at spaces and tabs
    into words. A phrase of 2 to `max_words` words that occurs `least` times (a) has the score of its
    worst cut into two parts that occur l and r times, floor(10^6 a^2 / (l r)) in whole numbers,
    ties to the first cut. One that lies in a longer phrase with `share` percent of its occurrences is left
    out. n is the number of words of the language. Ties in score fall to the larger a, then to the phrase
    in the order of its bytes. Tables without a frequent phrase give no rows.
    """
    found = frequent_phrases(docs.select("lang", "text"), max_words, least)
    counts = found.where("words > 0").select("lang", "words", "phrase", F.col("n").alias("a"))
    many = counts.where("words >= 2")
    cuts = many.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.expr("array_join(slice(split(phrase, ' '), 1, k), ' ')").alias("head"),
        F.expr("array_join(slice(split(phrase, ' '), k + 1, words - k), ' ')").alias("tail"),
    )
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    best = (
        cuts.join(heads, ["lang", "head"])
        .join(tails, ["lang", "tail"])
        .withColumn("score", F.expr(SCORE))
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    around = (
        many.where("words >= 3")
        .select("lang", "a", F.explode(F.expr(_slices("phrase", 2, "words"))).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    left = best.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)
    )
    rows = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # First within a part of a language's phrases, so that no task ranks all of them.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(32))
    rows = rows.withColumn("_part", part).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    rows = rows.where(F.col("_rank") <= top).withColumn("rank", rank).where(F.col("rank") <= top)
    totals = found.where("words = 0").select("lang", "n")
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
