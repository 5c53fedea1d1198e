"""Near-duplicate groups by a similarity join over PartEnum signatures of shingle sets."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonelake.llm.common import Codes, gram_codes, lower_words, mix, raw, small_batches, word_codes
from tonelake.llm.components import components
from tonelake.llm.scratch import written

#: Sets a task remembers to have signed, so that copies in one partition are signed once.
SEEN_HELD = 500_000
#: Elements of a largest set for each 64 bits of its bit map.
MAP_RATE = 48


class Bands:
    """Size bands: two sets as similar as `percent` lie in one band or in neighbouring ones.

    Instance i of the join serves bands i - 1 and i, so a set takes part in two instances. limit(i)
    is the largest number of differing elements of a linked pair in instance i.
    """

    def __init__(self, percent: int):
        self.percent, self.start = percent, [1]

    def _add(self) -> None:
        self.start.append(100 * self.start[-1] // self.percent + 1)

    def of(self, n: int) -> int:
        while self.start[-1] <= n:
            self._add()
        return bisect_right(self.start, n) - 1

    def largest(self, instance: int) -> int:
        while len(self.start) <= instance + 1:
            self._add()
        return self.start[instance + 1] - 1

    def limit(self, instance: int) -> int:
        return (100 - self.percent) * 2 * self.largest(instance) // (100 + self.percent)


def shingles(text: bytes, codes: Codes, size: int) -> np.ndarray:
    """The distinct shingle codes in order; one for the whole sequence if it is shorter."""
    ids = word_codes(lower_words(text), codes)
    if not len(ids):
        return ids
    return np.unique(gram_codes(ids, min(size, len(ids))))


def set_code(elements: np.ndarray) -> int:
    """The class of a set, signed for Spark; equal sets are one class."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(elements.tobytes()) ^ len(elements))))


def signatures(elements: np.ndarray, instance: int, limit: int, ignored: int, parts: int, seed: int) -> np.ndarray:
    """PartEnum: hashes of the set's projections; linked sets share at least one.

    The domain is dealt to n1 blocks of `parts` parts. With at most `limit` differing elements, one
    block has at most `ignored` differing parts when n1 * (ignored + 1) > limit; each choice of
    parts - ignored parts of a block is one signature. With one part a block, some blocks are
    added beyond need: as many as may be empty in a set without it having to sign for them, since
    then a pair shares a block that is not empty.
    """
    n1 = limit // (ignored + 1) + 1
    spare = 1 + limit // 8 if parts == 1 else 0
    n1 += spare
    spread = mix(elements * np.uint64(2 * seed + 1) + np.uint64(instance))
    part = ((spread >> np.uint64(32)) % np.uint64(n1 * parts)).astype(np.int64)
    total = np.zeros(n1 * parts, np.uint64)
    np.add.at(total, part, mix(spread ^ np.uint64(0x9E3779B97F4A7C15)))
    total = total.reshape(n1, parts)
    block = np.arange(n1, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(instance * 65_537 + seed)
    if parts == 1:
        out = mix(total[:, 0] + block)
        full = np.bincount(part, minlength=n1) > 0
        return out[full] if n1 - int(full.sum()) <= spare else out
    found = []
    for c, chosen in enumerate(combinations(range(parts), parts - ignored)):
        code = block + np.uint64(c + 1)
        for j in chosen:
            code = mix(code + total[:, j])
        found.append(code)
    return np.concatenate(found)


def parity(elements: np.ndarray, words: int) -> np.ndarray:
    """A bit map in which each element flips one bit: two maps never differ in more bits than the
    sets in elements, so maps far apart rule a link out."""
    bit = mix(elements + np.uint64(77)) % np.uint64(64 * words)
    odd = (np.bincount(bit.astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def described(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """Each row's doc_id, n (set size), cls (class of its set), maps (instance, bits) of it, and sigs: its
    signatures of single blocks for both instances; a task signs equal sets once. Sets are made once for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, bands, seen = Codes(), Bands(percent), set()
        for batch in small_batches(batches, "text", 1_000_000):
            n, cls, first, maps, sigs, ends = [], [], [], [], [], [0]
            for text in raw(batch.column("text")):
                s = shingles(text, codes, size)
                n.append(len(s))
                cls.append(set_code(s) if len(s) else None)
                at = bands.of(len(s)) if len(s) else 0
                first.append(at)
                maps.append([parity(s, -(-bands.largest(i) // MAP_RATE)) for i in (at, at + 1)] if len(s) else [])
                fresh = len(s) and cls[-1] not in seen
                if fresh:
                    if len(seen) >= SEEN_HELD:
                        seen.clear()
                    seen.add(cls[-1])
                for i in (at, at + 1):
                    limit = bands.limit(i) if fresh else 0
                    if limit:
                        sigs.append(signatures(s, i, limit, 0, 1, 1).view(np.int64))
                    ends.append(ends[-1] + (len(sigs[-1]) if limit else 0))
            flat = pa.array(np.concatenate(sigs) if sigs else np.empty(0, np.int64))
            inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(cls, pa.int64()),
                    pa.array(first, pa.int32()),
                    pa.array(maps, pa.list_(pa.list_(pa.int64()))),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(ends), 2), pa.int32()), inner),
                ],
                names=["doc_id", "n", "cls", "band", "maps", "sigs"],
            )

    schema = "doc_id long, n long, cls long, band int, maps array<array<long>>, sigs array<array<long>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def signed(docs: DataFrame, percent: int, size: int, ignored: int, parts: int, seed: int) -> DataFrame:
    """(sig, cls, instance) of every set; a task signs equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, bands, seen = Codes(), Bands(percent), set()
        for batch in small_batches(batches, "text", 1_000_000):
            sigs, cls, inst = [], [], []
            for text in raw(batch.column("text")):
                s = shingles(text, codes, size)
                c = set_code(s) if len(s) else None
                if c is None or c in seen:
                    continue
                if len(seen) >= SEEN_HELD:
                    seen.clear()
                seen.add(c)
                at = bands.of(len(s))
                for i in (at, at + 1):
                    limit = bands.limit(i)
                    if limit:
                        found = signatures(s, i, limit, ignored, parts, seed).view(np.int64)
                        sigs.append(found)
                        cls.append(np.full(len(found), c))
                        inst.append(np.full(len(found), i, np.int32))
            if sigs:
                cols = [pa.array(np.concatenate(x)) for x in (sigs, cls, inst)]
                yield pa.RecordBatch.from_arrays(cols, names=["sig", "cls", "instance"])

    return docs.select("text").mapInArrow(run, "sig long, cls long, instance int")


def _far(a: str, b: str) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
    )


def _near(percent: int) -> Column:
    total = F.col("n_a") + F.col("n_b")
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (
        (100 + percent) * _far("bits_a", "bits_b") <= (100 - percent) * total
    )


def possible(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, instance) that sizes and bit maps do not rule out, once each."""
    left = maps.selectExpr("cls as a", "instance", "n as n_a", "bits as bits_a")
    right = maps.selectExpr("cls as b", "instance", "n as n_b", "bits as bits_b")
    return (
        pairs.join(left, ["a", "instance"])
        .join(right, ["b", "instance"])
        .where(_near(percent))
        .select("a", "b")
        .distinct()
    )


def linked(pairs: DataFrame, docs: DataFrame, owner: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs whose sets really are similar enough; sets are made anew for the classes asked for.

    owner: (cls, doc_id), one document per class. One class in many pairs is a skewed join key,
    which AQE splits; every row carries two sets and no task holds a group.
    """
    asked = pairs.selectExpr("a as cls").unionByName(pairs.selectExpr("b as cls")).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(asked.join(owner, "cls"), "doc_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in small_batches(batches, "text", 2_000_000):
            sets = [shingles(t, codes, size) for t in raw(batch.column("text"))]
            same = [set_code(s) == c for s, c in zip(sets, batch.column("cls").to_pylist())]
            bits = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("cls"), bits, pa.array(same)], names=["cls", "elements", "same"]
            )

    # A document id may be given to several texts; only the one of the class is taken.
    sets = texts.select("cls", "text").mapInArrow(make, "cls long, elements binary, same boolean")
    sets = written(sets.where("same").select("cls", "elements").dropDuplicates(["cls"]), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return (
        pairs.join(sets.selectExpr("cls as a", "elements as x"), "a")
        .join(sets.selectExpr("cls as b", "elements as y"), "b")
        .mapInArrow(compare, "a long, b long")
    )


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 4) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row.

    Two documents link when their sets of `size`-word shingles have 100 * intersection >= percent *
    union. Equal sets are one class from the start, so copies cost one row each. Signatures of
    single blocks bring classes together; each member of a bucket is compared with the
    bucket's smallest class, which joins groups of near copies without their pairs. What is then
    still in a bucket with another component is signed again, with more selective signatures over
    an own partition of the domain. There each bucket is compared with a member of its own choice,
    which joins loose groups from many sides, and at last all pairs of components still apart: so
    no link is lost, and a passage that many documents share does not bring them all together.

    Null or wordless texts are linked with nothing: component_id is their doc_id. A row with a null
    doc_id is in the group of its class; a group of such rows alone has a null component_id.
    """
    rows = written(described(docs, percent, size), "described")
    classes = rows.where("n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("band").alias("band"),
        F.min("maps").alias("maps"),
    )
    classes = written(classes, "classes")
    maps = classes.select(
        "cls", "n", "band", F.posexplode("maps").alias("k", "bits")
    ).selectExpr("cls", "n", "band + k as instance", "bits")
    owner = classes.where("doc_id is not null").select("cls", "doc_id")

    def buckets(signed_rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("sig")
        return (
            signed_rows.withColumn("first", F.min("cls").over(w))
            .withColumn("last", F.max("cls").over(w))
            .where("first <> last")
            .drop("last")
        )

    blocks = rows.select("cls", "band", F.posexplode("sigs").alias("k", "sigs")).select(
        F.explode("sigs").alias("sig"), "cls", F.expr("band + k").alias("instance")
    )
    shared = written(buckets(blocks), "buckets")
    stars = shared.where("cls <> first").selectExpr("first as a", "cls as b", "instance").distinct()
    stars = written(possible(stars, maps, percent), "pairs")
    links = written(linked(stars, docs, owner, percent, size), "links")
    group = written(components(links), "groups")
    w = Window.partitionBy("sig")

    def grouped(frame: DataFrame, group: DataFrame) -> DataFrame:
        return frame.join(group.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
            "root", F.coalesce("root", "cls")
        )

    def joined(group: DataFrame, links: DataFrame) -> DataFrame:
        """The groups after more links; each known one is a star already, which settles quickly."""
        edges = links.unionByName(group.selectExpr("node as a", "root as b"))
        return written(components(written(edges, "links")), "groups")

    def divided(frame: DataFrame, group: DataFrame) -> DataFrame:
        """The rows of buckets that hold classes of several components."""
        return (
            grouped(frame, group)
            .withColumn("low", F.min("root").over(w))
            .withColumn("high", F.max("root").over(w))
            .where("low <> high")
            .select("sig", "cls", "instance", "root")
        )

    open_ = divided(shared, group).select("cls").distinct()
    again = docs.select(F.col("doc_id").cast("long"), "text").join(
        open_.join(owner, "cls").select("doc_id"), "doc_id", "left_semi"
    )
    finer = written(buckets(signed(again, percent, size, 2, 4, 2)).distinct(), "finer")
    # Each finer bucket has a middle of its own, so a loose group gets links from many sides.
    left = written(divided(finer, group), "divided")
    middle = left.groupBy("sig").agg(
        F.min_by(F.struct("cls", "root"), F.xxhash64("sig", "cls")).alias("middle")
    )
    stars = (
        left.join(middle, "sig")
        .where("root <> middle.root")
        .selectExpr("least(middle.cls, cls) as a", "greatest(middle.cls, cls) as b", "instance")
        .distinct()
    )
    stars = written(possible(stars, maps, percent), "pairs")
    group = joined(group, linked(stars, docs, owner, percent, size))
    mixed = divided(finer, group).join(maps.select("cls", "instance", "n", "bits"), ["cls", "instance"])
    mixed = written(mixed, "mixed")
    # Sizes and bit maps are tested inside the join, so pairs that cannot link are never rows.
    cross = (
        mixed.selectExpr("sig", "cls as a", "root as root_a", "n as n_a", "bits as bits_a")
        .join(mixed.selectExpr("sig", "cls as b", "root as root_b", "n as n_b", "bits as bits_b"), "sig")
        .where("a < b and root_a <> root_b")
        .where(_near(percent))
        .select("a", "b")
        .distinct()
    )
    cross = written(cross, "pairs")
    group = joined(group, linked(cross, docs, owner, percent, size))

    placed = grouped(rows.select("doc_id", "n", "cls"), group)
    least = placed.where("cls is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "root", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    )
