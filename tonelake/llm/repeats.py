"""Long repeated byte strings, from merged Burrows-Wheeler transforms of shards over phrases.

Bytes are first cut into phrases at content-chosen anchors: a place is an anchor if its GRAM bytes
hash to the minimum of some REACH neighbouring places. Whether a place is an anchor depends on the
bytes around it alone, so equal strings have equal anchors inside. A string of LENGTH bytes has at least
DEPTH + 1 anchors that lie REACH or more from its ends, hence DEPTH common phrases. The transforms are
those of phrase sequences, a small fraction of the bytes, and refining their interleave DEPTH
times finds every place where a repeated string may start. Bytes are then compared by hashes.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonelake.llm.common import mix, raw
from tonelake.llm.scratch import shared_path, written

LENGTH, GRAM, REACH = 400, 16, 64
#: Phrases that two equal strings share at least: anchors in the middle, less one.
DEPTH = (LENGTH - GRAM + 1 - 2 * REACH) // REACH - 1
#: Bytes of a shard, and shards of a bucket of the stored texts.
SHARD_BYTES, SHARDS_A_BUCKET = 4 << 20, 4


def _slide(x: np.ndarray, pick, width: int) -> np.ndarray:
    """pick over `width` neighbours from each place on, by doubling; shorter at the end."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = pick(out[:-step], out[step:])
        have += step
    return out


def anchors(text: np.ndarray) -> np.ndarray:
    """Places of anchors in the bytes, in order."""
    n = len(text) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.int64)
    found = []
    block = 1 << 19
    for a in range(0, n, block):
        # Neighbours on both sides decide, so blocks overlap by REACH and a gram.
        low, high = max(0, a - REACH), min(n, a + block + REACH)
        part = np.ascontiguousarray(text[low : high + GRAM - 1])
        words = np.lib.stride_tricks.as_strided(part, (len(part) - 7, 8), (1, 1)).copy().view("<u8").ravel()
        m = high - low
        h = words[:m] * np.uint64(0x9E3779B97F4A7C15) + words[8 : 8 + m] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h = (h >> np.uint64(32)).astype(np.uint32)
        least = _slide(h, np.minimum, REACH)
        # A place is chosen if it is the least of a window that starts up to REACH - 1 before it.
        most = _slide(least[::-1], np.maximum, REACH)[::-1]
        at = np.flatnonzero(h == most) + low
        found.append(at[(at >= a) & (at < a + block)])
    return np.concatenate(found)


class Shard:
    """The texts of a shard, their anchors, and the transform of their phrase sequence."""

    def __init__(self, number: int, rows: pa.Table):
        keys = rows.column("key").to_pylist()
        texts = raw(rows.column("text"))
        order = sorted({k: i for i, k in reversed(list(enumerate(keys)))}.items())
        self.keys = [k for k, _ in order]
        self.texts = [texts[i] for _, i in order]
        self.data = b"".join(self.texts)
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        at = anchors(np.frombuffer(self.data, np.uint8))
        doc = np.searchsorted(self.ends, at, "right")
        inside = (at + GRAM <= self.ends[np.minimum(doc, len(sizes) - 1)]) if len(at) else np.empty(0, bool)
        self.at, self.doc = at[inside], doc[inside]
        n = len(self.at)
        after = np.append(self.at[1:] + GRAM, 0)
        last = np.append(self.doc[1:] != self.doc[:-1], True) if n else np.empty(0, bool)
        digest, data = xxhash.xxh3_64_intdigest, self.data
        self.phrase = np.fromiter(
            (digest(data[a:b]) for a, b in zip(self.at.tolist(), after.tolist())), np.uint64, n
        )
        # The last phrase of a text has no end; it equals nothing else.
        unique = mix((np.uint64(number) << np.uint64(32)) + np.arange(n, dtype=np.uint64))
        self.phrase[last] = unique[last]
        self.last = last

    def transform(self) -> None:
        """Sort suffixes by DEPTH phrases; symbol before each, and where that suffix is sorted to."""
        n = len(self.phrase)
        nexts = [self.phrase]
        for _ in range(DEPTH - 1):
            nexts.append(np.append(nexts[-1][1:], np.uint64(0)))
        self.sa = np.lexsort(nexts[::-1]) if n else np.empty(0, np.int64)
        self.first = self.phrase[self.sa]
        before = self.sa - 1
        self.bwt = self.phrase[before]
        rank = np.empty(n, np.int64)
        rank[self.sa] = np.arange(n)
        self.lf = rank[before] if n else rank
        # Nothing stands before a shard's first suffix, and no phrase crosses from text to text.
        self.open = (before >= 0) & ~self.last[before] if n else np.empty(0, bool)

    def first_blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, low, n): runs of sorted suffixes with the same first phrase."""
        live = ~self.last[self.sa]
        start = np.flatnonzero(np.append(True, self.first[1:] != self.first[:-1])) if len(self.sa) else np.empty(0, int)
        n = np.diff(np.append(start, len(self.sa)))
        ok = live[start]
        return self.first[start][ok], start[ok], n[ok]

    def rows_of(self, low: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))

    def extended(self, key: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The blocks of one phrase more: each block split by the phrase before, through the LF map."""
        rows, of = self.rows_of(low, n), np.repeat(key, n)
        ok = self.open[rows]
        rows, of = rows[ok], of[ok]
        if not len(rows):
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        new = mix(mix(self.bwt[rows]) + of)
        at = self.lf[rows]
        by = np.argsort(at)
        new, at = new[by], at[by]
        start = np.flatnonzero(np.append(True, (new[1:] != new[:-1]) | (at[1:] != at[:-1] + 1)))
        return new[start], at[start], np.diff(np.append(start, len(at)))

    def units(self, key: np.ndarray, low: np.ndarray, n: np.ndarray):
        """For each anchor in the blocks: the code of its core, first and last start of its strings.

        A string is looked after by its first anchor that is REACH or more from its start. The
        strings of one anchor start after those of the anchor before, so all of them hold the core: the
        bytes from REACH before the anchor to where the earliest possible string ends. Anchors are
        in the order of the sorted suffixes.
        """
        by = np.argsort(low)
        i = self.sa[self.rows_of(low[by], n[by])]
        doc, at = self.doc[i], self.at[i]
        before = np.where((i > 0) & (self.doc[i - 1] == doc), self.at[i - 1] - REACH + 1, -1)
        a = np.maximum(before, self.starts[doc])
        b = np.minimum(at - REACH, self.ends[doc] - LENGTH)
        ok = a <= b
        core, data, digest = at[ok] - REACH, self.data, xxhash.xxh3_64_intdigest
        code = [digest(data[x : x + LENGTH - REACH + 1]) for x in core.tolist()]
        return np.array(code, np.uint64), a[ok], b[ok]

    def unit_codes(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of all bytes of each anchor's strings."""
        data, digest = self.data, xxhash.xxh3_128_digest
        flat = b"".join(digest(data[x : y + LENGTH]) for x, y in zip(a.tolist(), b.tolist()))
        both = np.frombuffer(flat, "<i8").reshape(-1, 2)
        return both[:, 0], both[:, 1]


_BLOCK = "key long, shard int, low int, n int"


def _blocks(number: int, found) -> pa.Table:
    key, low, n = found
    return pa.table(
        {
            "key": pa.array(np.asarray(key, np.uint64).view(np.int64)),
            "shard": pa.array(np.full(len(key), number, np.int32)),
            "low": pa.array(np.asarray(low, np.int32)),
            "n": pa.array(np.asarray(n, np.int32)),
        }
    )


def _number(*tables: pa.Table) -> int:
    return next(t.column("shard")[0].as_py() for t in tables if t.num_rows)


def _arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (
        rows.column("key").to_numpy().view(np.uint64),
        rows.column("low").to_numpy().astype(np.int64),
        rows.column("n").to_numpy().astype(np.int64),
    )


def repeated(blocks: DataFrame) -> DataFrame:
    """Blocks whose interval in the merged order holds two suffixes or more. A key has one row per
    shard at most, however often it occurs."""
    total = F.sum("n").over(Window.partitionBy("key"))
    return blocks.withColumn("total", total).where("total >= 2").drop("total")


def stored(docs: DataFrame) -> DataFrame:
    """(shard, key, text) of each different text of LENGTH bytes or more, bucketed by shard.

    Tasks drop copies they have seen before they shuffle, so a text with very many copies is sent
    once per task. Bucketing keeps later passes over the texts from shuffling them again.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    buckets = max(1, -(-shards // SHARDS_A_BUCKET))

    def once(batches):
        seen: set[str] = set()
        for batch in batches:
            keys = batch.column("key").to_pylist()
            fresh = []
            for k in keys:
                fresh.append(k not in seen)
                seen.add(k)
            if len(seen) > 1_000_000:
                seen.clear()
            yield batch.filter(pa.array(fresh, pa.bool_()))

    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
    long = docs.where(F.octet_length("text") >= LENGTH).withColumn("key", F.md5("text"))
    long = long.select(shard, "key", "text")
    name = f"texts_{uuid.uuid4().hex}"
    (
        long.mapInArrow(once, "shard int, key string, text string")
        .repartition(buckets, "shard")
        .write.format("parquet")
        .bucketBy(buckets, "shard")
        .option("path", shared_path(spark, "texts"))
        .saveAsTable(name)
    )
    return spark.table(name)


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    Every byte covered by a LENGTH-byte string that also starts anywhere else is removed; strings
    are judged on the input. Copies of a text are handled as one text with a count: if there are
    two, each string of it starts elsewhere. Null and short texts keep all their bytes.
    """
    texts = stored(docs.select("text").where("text is not null"))
    by_shard = texts.groupBy("shard")

    def start(rows: pa.Table) -> pa.Table:
        number = _number(rows)
        s = Shard(number, rows)
        s.transform()
        return _blocks(number, s.first_blocks())

    def further(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        number = _number(rows, blocks)
        if not blocks.num_rows:
            return _blocks(number, ([], [], []))
        s = Shard(number, rows)
        s.transform()
        return _blocks(number, s.extended(*_arrays(blocks)))

    blocks = written(repeated(by_shard.applyInArrow(start, _BLOCK)), "blocks")
    for _ in range(DEPTH - 1):
        wider = by_shard.cogroup(blocks.groupBy("shard")).applyInArrow(further, _BLOCK)
        blocks = written(repeated(wider), "blocks")

    def placed(rows: pa.Table, blocks: pa.Table):
        number = _number(rows, blocks)
        s = Shard(number, rows)
        s.transform()
        key, a, b = s.units(*_arrays(blocks))
        return number, s, key, a, b, s.unit_codes(a, b)

    def count(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("key", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("shard", pa.int32()), ("n", pa.int32()))})
        number, s, key, a, b, (u, v) = placed(rows, blocks)
        _, one, n = np.unique(np.stack([u, v], axis=1), axis=0, return_index=True, return_counts=True)
        return pa.table(
            {
                "key": pa.array(key[one].view(np.int64)),
                "u": pa.array(u[one]),
                "v": pa.array(v[one]),
                "shard": pa.array(np.full(len(one), number, np.int32)),
                "n": pa.array(n.astype(np.int32)),
            }
        )

    units = by_shard.cogroup(blocks.groupBy("shard")).applyInArrow(
        count, "key long, u long, v long, shard int, n int"
    )
    w = Window.partitionBy("u", "v")
    units = written(
        units.withColumn("total", F.sum("n").over(w)).withColumn("one", F.min("shard").over(w)).drop("n"), "units"
    )
    # Where a core is repeated but some unit with it is not, single strings are compared; of equal
    # units one is enough.
    partial = (
        units.where("shard = one")
        .groupBy("key")
        .agg(F.sum("total").alias("all"), F.min("total").alias("least"))
        .where("all >= 2 and least = 1")
        .select("key")
    )
    asked = units.where("shard = one").join(partial, "key", "left_semi").select("shard", "u", "v", "total")
    mark = F.lit(None).cast("long")
    block_rows = blocks.select("shard", "key", "low", "n", mark.alias("u"), mark.alias("v"), mark.alias("total"))

    def with_blocks(rows: DataFrame) -> DataFrame:
        null = F.lit(None).cast("int")
        return block_rows.unionByName(
            rows.select("shard", mark.alias("key"), null.alias("low"), null.alias("n"), "u", "v", "total")
        )

    def halves(more: pa.Table) -> tuple[pa.Table, pa.Table]:
        low = more.column("low").is_null().to_numpy()
        return more.filter(pa.array(~low)), more.filter(pa.array(low))

    def single(rows: pa.Table, more: pa.Table) -> pa.Table:
        blocks, wanted = halves(more)
        out: dict[str, list] = {"key": [], "w": [], "shard": [], "unit": [], "k": [], "total": []}
        if wanted.num_rows:
            number, s, key, a, b, (u, v) = placed(rows, blocks)
            left = {
                (x, y): t
                for x, y, t in zip(*(wanted.column(c).to_pylist() for c in ("u", "v", "total")))
            }
            digest, data = xxhash.xxh3_64_intdigest, s.data
            for i, (x, y) in enumerate(zip(u.tolist(), v.tolist())):
                total = left.pop((x, y), None)
                if total is None:
                    continue
                size = int(b[i] - a[i]) + 1
                out["w"] += [digest(data[p : p + LENGTH]) for p in range(int(a[i]), int(b[i]) + 1)]
                out["k"] += range(size)
                for name, value in (("key", int(key[i].view(np.int64))), ("shard", number), ("unit", i), ("total", total)):
                    out[name] += [value] * size
        return pa.table(
            {
                "key": pa.array(out["key"], pa.int64()),
                "w": pa.array(np.array(out["w"], np.uint64).view(np.int64), pa.int64()),
                "shard": pa.array(out["shard"], pa.int32()),
                "unit": pa.array(out["unit"], pa.int32()),
                "k": pa.array(out["k"], pa.int32()),
                "total": pa.array(out["total"], pa.int64()),
            }
        )

    strings = by_shard.cogroup(with_blocks(asked).groupBy("shard")).applyInArrow(
        single, "key long, w long, shard int, unit int, k int, total long"
    )
    met = strings.withColumn("all", F.sum("total").over(Window.partitionBy("key", "w")))
    # A unit that occurs once is in one shard, where its place among the anchors names it.
    some = (
        met.where("all >= 2 and total = 1")
        .groupBy("shard", "unit")
        .agg(F.collect_list("k").alias("ks"))
        .select("shard", F.col("unit").cast("long").alias("u"), mark.alias("v"), "ks")
    )
    whole = units.where("total >= 2").select("shard", "u", "v", F.lit(None).cast("array<int>").alias("ks"))
    verdict = whole.unionByName(some)
    final_rows = block_rows.drop("total").withColumn("ks", F.lit(None).cast("array<int>")).unionByName(
        verdict.select(
            "shard", mark.alias("key"), F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("n"), "u", "v", "ks"
        )
    )

    def cut(rows: pa.Table, more: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"key": pa.array([], pa.string()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        blocks, told = halves(more)
        told = list(zip(*(told.column(c).to_pylist() for c in ("u", "v", "ks"))))
        whole_units = {(x, y) for x, y, ks in told if ks is None}
        if told:
            _, s, _, a, b, (u, v) = placed(rows, blocks)
        else:
            s = Shard(_number(rows), rows)
        change = np.zeros(len(s.data) + 1, np.int32)
        if told:
            hit = [i for i, x in enumerate(zip(u.tolist(), v.tolist())) if x in whole_units]
            np.add.at(change, a[hit], 1)
            np.add.at(change, b[hit] + LENGTH, -1)
            for unit, _, ks in told:
                for k in ks or ():
                    change[a[unit] + k] += 1
                    change[a[unit] + k + LENGTH] -= 1
        gone = np.cumsum(change[:-1]) > 0
        out = []
        whole = np.frombuffer(s.data, np.uint8)
        for key, x, y in zip(s.keys, s.starts.tolist(), s.ends.tolist()):
            g = gone[x:y]
            n = int(g.sum())
            runs = int((g[1:] & ~g[:-1]).sum() + g[0]) if n else 0
            kept = whole[x:y][~g].tobytes() if n else s.data[x:y]
            out.append((key, n, runs, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out))
        return pa.table(
            {
                "key": pa.array(cols[0]),
                "n_removed": pa.array(cols[1], pa.int64()),
                "n_spans": pa.array(cols[2], pa.int64()),
                "kept": pa.array(cols[3]),
            }
        )

    found = by_shard.cogroup(final_rows.groupBy("shard")).applyInArrow(
        cut, "key string, n_removed long, n_spans long, kept string"
    )
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long").alias("n_bytes")
    rows = docs.select("doc_id", size, F.md5(text).alias("key"), F.sha2(text, 256).alias("own"))
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"))
    all_ = (F.col("copies") >= 2) & (F.col("n_bytes") >= LENGTH)
    none = F.sha2(F.lit(""), 256)
    return (
        rows.join(copies.join(found, "key", "left"), "key")
        .select(
            "doc_id",
            "n_bytes",
            F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(all_, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(all_, none).otherwise(F.coalesce("kept", "own")).alias("kept_sha256"),
        )
    )
