"""Recurring lines, found as templates of a fixed-depth tree over their words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import Codes, bit_map, in_bit_map, raw, small_batches
from tonelake.llm.scratch import written

#: Leading words that, with the number of words, choose a leaf.
DEPTH = 3
#: Different documents a template must occur in to be recurring.
MIN_DOCS = 5
#: The same for a template with that many fixed words.
LONG_DOCS, LONG = 2, 20
#: Share of a template's places that must be fixed words or fields with digits; one is a word at least.
FIXED = 0.6
WILD = b"<*>"
#: The code of a variable field.
WILD_CODE = int(np.uint64(xxhash.xxh3_64_intdigest(WILD)).view(np.int64))
#: Places, as a power of two, of the bit map of leaves that enough texts reach (4 MB).
LEAF_BITS = 25
_DIGITS = b"0123456789"


def _words(line: bytes) -> list[bytes] | None:
    """Words of a line; one that holds a digit is a variable field. None if no word is without one."""
    words = line.split()
    if not words:
        return None
    if len(line.translate(None, _DIGITS)) == len(line):
        return words
    words = [w if len(w.translate(None, _DIGITS)) == len(w) else None for w in words]
    if words.count(None) == len(words):
        return None
    return [WILD if w is None else w for w in words]


def _leaf(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b"%d %b" % (len(words), b" ".join(words[:DEPTH])))


def _signed(codes: list[int]) -> pa.Array:
    return pa.array(np.array(codes, np.uint64).view(np.int64))


def leaf_texts(docs: DataFrame) -> DataFrame:
    """(leaf, doc, long): each leaf that a text's lines reach, once; doc is a hash of the text, and
    long tells that the leaf's lines have LONG words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4_000_000):
            leaf, doc, long = [], [], []
            for text in raw(batch.column("text")):
                found = {_leaf(w): len(w) >= LONG for w in map(_words, text.split(b"\n")) if w}
                leaf += found.keys()
                long += found.values()
                doc += [xxhash.xxh3_64_intdigest(text)] * len(found)
            yield pa.RecordBatch.from_arrays(
                [_signed(leaf), _signed(doc), pa.array(long, pa.bool_())], names=["leaf", "doc", "long"]
            )

    return docs.where("text is not null").select("text").mapInArrow(run, "leaf long, doc long, long boolean")


def line_rows(docs: DataFrame, leaves: np.ndarray) -> DataFrame:
    """(doc_id, doc, at, leaf, line, words) of each line whose leaf is in the bit map `leaves`.

    doc is a hash of the text, line one of the words, and words their codes.
    """
    held = docs.sparkSession.sparkContext.broadcast(leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, codes = held.value, Codes()
        for batch in small_batches(batches, "text", 4_000_000):
            rows, leaf, words = [], [], []
            for i, text in enumerate(raw(batch.column("text"))):
                for at, line in enumerate(text.split(b"\n")):
                    if w := _words(line):
                        rows.append((i, at))
                        leaf.append(_leaf(w))
                        words.append(w)
            near = np.flatnonzero(in_bit_map(seen, np.array(leaf, np.uint64)))
            if not len(near):
                continue
            leaf, words = [leaf[k] for k in near], [words[k] for k in near]
            of, at = np.array(rows, np.int32)[near].T
            texts = raw(batch.column("text"))
            digest = {i: hashlib.md5(texts[i]).hexdigest() for i in set(of.tolist())}
            sizes = np.cumsum([0, *map(len, words)]).astype(np.int32)
            flat = _signed([codes[x] for w in words for x in w])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(of)),
                    pa.array([digest[i] for i in of.tolist()]),
                    pa.array(at),
                    _signed(leaf),
                    _signed([xxhash.xxh3_64_intdigest(b" ".join(w)) for w in words]),
                    pa.ListArray.from_arrays(pa.array(sizes), flat),
                ],
                names=["doc_id", "doc", "at", "leaf", "line", "words"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, doc string, at int, leaf long, line long, words array<long>"
    return docs.where("text is not null").select("doc_id", "text").mapInArrow(run, schema)


def _template(least: Column) -> Column:
    """(template, words): hash and number of the `least` most frequent words of `fixed` with their
    places, and of all that are as frequent as one of them."""
    rarest = F.get("fixed", least - 1)["seen"]
    left = F.filter("fixed", lambda w: w["seen"] >= rarest)
    left = F.array_sort(F.transform(left, lambda w: F.struct(w["place"], w["word"])))
    return F.struct(F.xxhash64("leaf", left).alias("template"), F.size(left).alias("words"))


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, doc, at): the lines whose template occurs in `min_docs` different texts, or in
    LONG_DOCS if it has LONG fixed words, without those of the first text (smallest doc_id) that has it.

    The tree has a fixed depth: number of words, then DEPTH leading words. Below a leaf, a word that
    at its place occurs in fewer texts than a template must is a variable field and becomes `<*>`, as
    are words with digits. Of the others the rarest of a line become fields too, for as long as they
    and the fields with digits fill the share FIXED of its places; what is left is the line's
    template. Names that a large corpus repeats are thus fields as in a small one: a template's own
    words occur more often than they. Every line that shares a longer template shares this one as
    well, so none is lost by it; a line with LONG fixed words has a second template, which keeps as
    many, as that one needs fewer texts. Leaves that too few texts reach are dropped by a count first, so only lines that
    can recur are spread to words. All counts are partial sums; no leaf is gathered in one task.
    """
    wanted = F.when(F.size("words") >= LONG, min(min_docs, LONG_DOCS)).otherwise(min_docs)
    leaves = (
        leaf_texts(docs)
        .distinct()
        .groupBy("leaf")
        .agg(F.count("*").alias("texts"), F.first("long").alias("long"))
        .where(F.col("texts") >= F.when(F.col("long"), min(min_docs, LONG_DOCS)).otherwise(min_docs))
    )
    near = written(line_rows(docs, bit_map(leaves, "leaf", LEAF_BITS)), "lines")
    lines = near.select("leaf", "line", "doc", "words")
    texts = lines.groupBy("leaf", "line").agg(
        F.countDistinct("doc").alias("texts"), F.first("words").alias("words")
    )
    digits = F.size(F.filter("words", lambda w: w == WILD_CODE))
    least = F.greatest(F.ceil(FIXED * F.size("words")) - digits, F.lit(1)).cast("int")
    texts = written(texts.withColumn("least", least), "line_texts")
    # Distinct lines carry their counts, so a line in many texts is spread to words once.
    places = texts.select("leaf", "line", "texts", wanted.alias("wanted"), F.posexplode("words").alias("place", "word"))
    common = (
        places.where(F.col("word") != WILD_CODE)
        .groupBy("leaf", "place", "word")
        .agg(F.sum("texts").alias("seen"), F.min("wanted").alias("wanted"))
        .where("seen >= wanted")
        .drop("wanted")
    )
    kept = (
        places.select("leaf", "line", "place", "word")
        .join(common, ["leaf", "place", "word"])
        .groupBy("leaf", "line")
        .agg(F.sort_array(F.collect_list(F.struct("seen", "place", "word")), asc=False).alias("fixed"))
    )
    longer = (F.col("least") < LONG) & (F.size("fixed") >= LONG)
    one, two = _template(F.col("least")), _template(F.lit(LONG))
    templates = (
        texts.select("leaf", "line", "least")
        .join(kept, ["leaf", "line"])
        .where(F.size("fixed") >= F.col("least"))
        .withColumn("found", F.when(longer, F.array_distinct(F.array(one, two))).otherwise(F.array(one)))
        .select("leaf", "line", F.inline("found"))
    )
    templates = written(templates, "line_templates")
    placed = near.select("doc_id", "doc", "at", "leaf", "line").join(templates, ["leaf", "line"])
    found = (
        placed.groupBy("template")
        .agg(
            F.countDistinct("doc").alias("texts"),
            F.min(F.struct("doc_id", "doc")).alias("first"),
            F.min("words").alias("words"),
        )
        .where(F.col("texts") >= F.when(F.col("words") >= LONG, min(min_docs, LONG_DOCS)).otherwise(min_docs))
        .select("template", "first")
    )
    return (
        placed.join(found, "template")
        .where(~F.col("doc").eqNullSafe(F.col("first.doc")))
        .select("doc_id", "doc", "at")
        .distinct()
    )


def without_recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Every row with its text freed from recurring lines, and n_lines and n_dropped.

    The other columns stay; lines keep their order. Null texts stay null, with no lines. Copies of
    one text are one text: they count once, and all of them keep or lose the same lines.
    """
    drops = (
        recurring(docs, min_docs)
        .select(F.col("doc").alias("_doc"), "at")
        .distinct()
        .groupBy("_doc")
        .agg(F.collect_set("at").alias("_at"))
    )
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda x, i: ~F.array_contains(F.col("_at"), i))
    return (
        docs.select(*keep, F.md5("text").alias("_doc"))
        .join(drops, "_doc", "left")
        .withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("_at"), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("_at").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
        .select(*keep, "n_lines", "n_dropped")
    )
