"""Class-based bigrams: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import CODES_HELD, bit_map, in_bit_map, lower_words, raw, small_batches
from tonelake.llm.scratch import written

#: Frequent words exchanged over the classes, the classes, and the classes of endings that rare and
#: unseen words belong to.
CLUSTERED, CLASSES, ENDINGS = 2_048, 64, 32
#: Times a word must occur in training to be put into a class by its neighbours.
SEEN = 3
#: Frequent words whose counts and classes every task holds (6 MB); those of the others are joined.
HELD_WORDS = 262_144
#: Places, as a power of two, of the bit map that tells words seen SEEN times from rarer ones (4 MB).
SEEN_BITS = 25
#: Words whose gains are computed at once.
WORDS_AT_ONCE = 256
#: The end of a text: a token of its own, in a class of its own, and what stands before the first word.
END_CODE = np.uint64(xxhash.xxh3_64_intdigest(b"\n") & ~31)
END_CLASS = CLASSES + ENDINGS
ALL_CLASSES = END_CLASS + 1
ROUNDS = 8


class WordCodes(dict):
    """64-bit codes of words whose low five bits tell the class of the ending."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CODES_HELD:
            self.clear()
        ending = xxhash.xxh3_64_intdigest(word[-3:]) & (ENDINGS - 1)
        code = self[word] = (xxhash.xxh3_64_intdigest(word) & ~31) | ending
        return code


def tokens(texts: list[bytes], codes: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts one after the other, each with its end, and where each text stops."""
    words = [lower_words(t) for t in texts]
    stops = np.cumsum([len(w) + 1 for w in words])
    flat = np.full(int(stops[-1]) if len(stops) else 0, END_CODE, np.uint64)
    inner = np.ones(len(flat), bool)
    inner[stops - 1] = False
    flat[inner] = np.fromiter((c for w in words for c in map(codes.__getitem__, w)), np.uint64)
    return flat, stops


def encoded(docs: DataFrame) -> DataFrame:
    """Every row, with codes in place of its text: the text's tokens, its end included."""
    keep = [c for c in docs.columns if c != "text"]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in small_batches(batches, "text", 2_000_000):
            flat, stops = tokens(raw(batch.column("text")), codes)
            offsets = pa.array(np.concatenate([[0], stops]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], names=[*keep, "codes"])

    return docs.select(*keep, "text").mapInArrow(run, f"{fields}codes array<long>")


def _slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` codes, at least one row each."""
    for batch in batches:
        stops = np.cumsum(np.diff(_bounds(batch.column("codes"))))
        start = 0
        while start < len(stops):
            had = stops[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(stops, had + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _decoded(batches: Iterator[pa.RecordBatch], limit: int = 600_000) -> Iterator[np.ndarray]:
    """All codes of some texts one after the other, about `limit` at a time."""
    for batch in _slices(batches, limit):
        yield batch.column("codes").flatten().to_numpy().view(np.uint64)


def token_counts(texts: DataFrame) -> DataFrame:
    """(code, n) of every token of encoded texts. Tasks add up before they shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def added() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], names=["code", "n"])

        for code in _decoded(batches):
            held.append(code)
            size += len(code)
            if size > 1_500_000:
                yield added()
                held, size = [], 0
        if held:
            yield added()

    return texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _places(flat: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each code is in the sorted codes, or -1."""
    if not len(known):
        return np.full(len(flat), -1)
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    return np.where(known[at] == flat, at, -1)


def _held_places(code: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Where each code is among the sorted held words, their number for the end, -1 for another word."""
    at = _places(code, held)
    at[code == END_CODE] = len(held)
    return at


def _ending(code: np.ndarray) -> np.ndarray:
    """The class of a word's ending."""
    return CLASSES + (code & np.uint64(ENDINGS - 1)).astype(np.int64)


def symbol_pairs(texts: DataFrame, clustered: np.ndarray, held_words: np.ndarray) -> DataFrame:
    """(a, b, n): how often symbol b follows a in encoded texts. Symbols are the clustered words, then
    the classes of endings, then the end; there are a fixed number of them."""
    held = texts.sparkSession.sparkContext.broadcast((clustered, held_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, frequent = held.value
        base, width = len(known), len(known) + ENDINGS + 1
        place = _places(frequent, known)
        symbol = np.append(np.where(place >= 0, place, base - CLASSES + _ending(frequent)), width - 1)
        parts, size = [], 0

        def added() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            total = np.bincount(n, np.concatenate([c for _, c in parts])).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array((pair // width).astype(np.int32)), pa.array((pair % width).astype(np.int32)), pa.array(total)],
                names=["a", "b", "n"],
            )

        for code in _decoded(batches):
            at = _held_places(code, frequent)
            own = np.where(at >= 0, symbol[at], base - CLASSES + _ending(code))
            before = np.concatenate([[width - 1], own[:-1]])
            parts.append(np.unique(before * width + own, return_counts=True))
            size += len(parts[-1][0])
            if size > 1_500_000:
                yield added()
                parts, size = [], 0
        if parts:
            yield added()

    return texts.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def seen_map(counts: DataFrame, bits: int = SEEN_BITS) -> np.ndarray:
    """A bit map, of one size for any number of words, that has the places of all words seen SEEN times or more.

    A word that is not in it is rarer, so its class is that of its ending. One that is in it is looked
    up; with far more words than places nearly all are, with the same result.
    """
    words = counts.where(F.col("n") >= SEEN)
    return bit_map(words.select(F.shiftrightunsigned("code", 5).alias("slot")), "slot", bits)


def _perhaps(seen: np.ndarray, code: np.ndarray) -> np.ndarray:
    return in_bit_map(seen, code >> np.uint64(5))


def _kinds(at: np.ndarray, code: np.ndarray, own: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Class of each token, -1 if it must be looked up. own: classes of the held words, then the end's."""
    kind = np.where(at >= 0, own[at], _ending(code))
    other = np.flatnonzero(at < 0)
    kind[other[_perhaps(seen, code[other])]] = -1
    return kind


def surroundings(
    texts: DataFrame, clustered: np.ndarray, of: np.ndarray, held_words: np.ndarray, seen: np.ndarray
) -> DataFrame:
    """(code, n, around) of every word that is not clustered and in `seen`: its count, and how often it
    stands between which classes, those of clustered words and of endings (ALL_CLASSES * left + right, times)."""
    held = texts.sparkSession.sparkContext.broadcast((clustered, of, held_words, seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own_class, frequent, seen = held.value
        place = _places(frequent, known)
        core = np.append(place >= 0, True)
        kinds = _ending(frequent)
        kinds[place >= 0] = own_class[place[place >= 0]]
        kinds = np.append(kinds, END_CLASS)
        for code in _decoded(batches):
            at = _held_places(code, frequent)
            kind = np.where(at >= 0, kinds[at], _ending(code))
            around = np.concatenate([[END_CLASS], kind[:-1]]) * ALL_CLASSES + np.append(kind[1:], END_CLASS)
            mine = np.flatnonzero((at < 0) | ~core[at])
            mine = mine[_perhaps(seen, code[mine])]
            # One number per word and surroundings: held words by their place, others numbered after them.
            number, around = at[mine], around[mine]
            other = number < 0
            more, place_of = np.unique(code[mine[other]], return_inverse=True)
            number[other] = len(frequent) + place_of
            key, n = np.unique(number * ALL_CLASSES**2 + around, return_counts=True)
            word = np.concatenate([frequent, more])[key // ALL_CLASSES**2].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word), pa.array((key % ALL_CLASSES**2).astype(np.int32)), pa.array(n)],
                names=["code", "around", "n"],
            )

    # Dealt by word first, so that the counts and the lists need no second shuffle.
    counted = texts.mapInArrow(run, "code long, around int, n long").repartition("code")
    counted = counted.groupBy("code", "around").agg(F.sum("n").alias("n"))
    return counted.groupBy("code").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("around", "n")).alias("around")
    )


def exchange(pairs: np.ndarray, words: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each symbol after exchange clustering of the first `words` symbols.

    pairs[a, b] counts b after a. The other symbols keep a class of their own each. Words start in
    classes by rank in turn. Each round takes every word out of its class and puts it where the
    sum of N(c, d) log N(c, d) - N(c) log N(c) - N(d) log N(d) over classes becomes largest; ties go to
    the lowest class. It ends when no word moves.
    """
    n = len(pairs)
    total = classes + n - words
    of = np.concatenate([np.arange(words) % classes, classes + np.arange(n - words)])
    pick = np.zeros((n, total))
    pick[np.arange(n), of] = 1
    right, left = pairs @ pick, pairs.T @ pick
    joint = pick.T @ right
    freq = np.maximum(pairs.sum(axis=1), pairs.sum(axis=0))
    mass = pick.T @ freq

    def part(x):
        return x * np.log(np.maximum(x, 1e-12))

    for _ in range(rounds):
        moved = 0
        for w in np.argsort(-freq[:words], kind="stable"):
            old = of[w]
            own = pairs[w, w]
            joint[old] -= right[w]
            joint[:, old] -= left[w]
            joint[old, old] += own
            # Neighbours of w other than itself, by class.
            r, l = right[w].copy(), left[w].copy()
            r[old] -= own
            l[old] -= own
            mass[old] -= freq[w]
            rows, cols = joint[:classes], joint[:, :classes].T
            gain = (part(rows + r) - part(rows)).sum(axis=1) + (part(cols + l) - part(cols)).sum(axis=1)
            k = np.arange(classes)
            # The class's own cell was counted in both sums.
            cell = joint[k, k]
            gain -= (part(cell + r[k]) - part(cell)) + (part(cell + l[k]) - part(cell))
            gain += part(cell + r[k] + l[k] + own) - part(cell)
            gain -= 2 * (part(mass[:classes] + freq[w]) - part(mass[:classes]))
            new = int(np.argmax(gain))
            joint[new] += r
            joint[:, new] += l
            joint[new, new] += own
            mass[new] += freq[w]
            if new != old:
                moved += 1
                of[w] = new
                for table, line in ((right, pairs[:, w]), (left, pairs[w])):
                    table[:, old] -= line
                    table[:, new] += line
        if not moved:
            break
    return of


def _part(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def gains(word: np.ndarray, around: np.ndarray, n: np.ndarray, words: int, steps: np.ndarray) -> np.ndarray:
    """What the criterion of `exchange` gains by each class (column) for each of `words` words (row),
    given the transitions `steps` between classes as they are.

    word, around, n: which word stands how often between which classes.
    """
    side = np.concatenate([around // ALL_CLASSES, ALL_CLASSES + around % ALL_CLASSES])
    cell, at = np.unique(np.tile(word, 2) * (2 * ALL_CLASSES) + side, return_inverse=True)
    times = np.bincount(at, np.tile(n, 2), len(cell))
    owner, side = cell // (2 * ALL_CLASSES), cell % (2 * ALL_CLASSES)
    # Row of a left neighbour's class: steps to each class; of a right one's: steps from each.
    table = np.concatenate([steps[:, :CLASSES], steps[:CLASSES].T])
    found = np.add.reduceat(
        _part(table[side] + times[:, None]) - _part(table)[side], np.searchsorted(owner, np.arange(words)), axis=0
    )
    # Where both neighbours are of the class itself, its own cell was counted in both sums.
    both = np.zeros((2, words, CLASSES))
    kind = side % ALL_CLASSES
    inner = kind < CLASSES
    both[side[inner] // ALL_CLASSES, owner[inner], kind[inner]] = times[inner]
    own = np.diag(steps)[:CLASSES]
    found += _part(own + both[0] + both[1]) + _part(own) - _part(own + both[0]) - _part(own + both[1])
    mass = np.maximum(steps.sum(axis=0), steps.sum(axis=1))[:CLASSES]
    total = np.bincount(word, n, words)[:, None]
    return found - 2 * (_part(mass + total) - _part(mass))


def placed(words: DataFrame, steps: np.ndarray) -> DataFrame:
    """(code, n, kind) of the words of `surroundings` seen SEEN times or more: each goes, on its own, to
    the class with the largest gain among those with clustered words, ties to the lowest."""
    held = words.sparkSession.sparkContext.broadcast(steps)
    free = (steps.sum(axis=0) + steps.sum(axis=1))[:CLASSES] == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, WORDS_AT_ONCE):
                part = batch.slice(i, WORDS_AT_ONCE)
                lists = part.column("around")
                word = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                rows = lists.flatten()
                around, times = (rows.field(c).to_numpy().astype(np.int64) for c in ("around", "n"))
                gain = gains(word, around, times, len(lists), held.value)
                kind = pa.array(np.where(free, -np.inf, gain).argmax(axis=1).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("code"), part.column("n"), kind], names=["code", "n", "kind"]
                )

    return words.where(F.col("n") >= SEEN).mapInArrow(run, "code long, n long, kind int")


def _of_ending(code: str) -> Column:
    return (F.col(code).bitwiseAND(ENDINGS - 1) + CLASSES).cast("int")


def gathered(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(kind, cell, n): the rows (code, cell, times) with the class of their word, that of `words` or else
    of its ending, and the sum of their times.

    Rows and classes of a word meet in one shuffle; added up by cell, what a word brings is one row.
    """
    both = rows.select("code", "cell", "times", F.lit(None).cast("int").alias("kind")).unionByName(
        words.select("code", F.lit(None).cast(rows.schema["cell"].dataType).alias("cell"), F.lit(None).cast("long").alias("times"), "kind")
    )
    cells = both.repartition("code").groupBy("code", "cell").agg(F.sum("times").alias("n"), F.max("kind").alias("kind"))
    known = cells.groupBy("code").agg(
        F.max("kind").alias("kind"),
        F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("cell", "n"))).alias("cells"),
    )
    return known.select(F.coalesce("kind", _of_ending("code")).alias("kind"), F.inline("cells"))


def classed(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(ka, kb, times) of the pairs, those classes looked up that are -1: those of `words`, or else of endings.

    For pairs that come as a table; the model finds the classes of a text's neighbours by `looked_up`.
    """
    once = F.lit(1).cast("long").alias("times")
    # A cell is the class on the left of the word, or ALL_CLASSES more than the one on its right.
    right = (F.col("kb") + ALL_CLASSES).cast("int").alias("cell")
    second = pairs.where("ka >= 0 and kb < 0").select(F.col("b").alias("code"), F.col("ka").cast("int").alias("cell"), once)
    first = pairs.where("ka < 0 and kb >= 0").select(F.col("a").alias("code"), right, once)
    both = pairs.where("ka < 0 and kb < 0").select(F.col("b").alias("code"), F.col("a").alias("cell"), once)
    both = gathered(both, words).select(F.col("cell").alias("code"), F.col("kind").alias("kb"), F.col("n").alias("times"))
    single = second.unionByName(first).unionByName(both.select("code", right, "times"))
    on_right = F.col("cell") >= ALL_CLASSES
    return gathered(single, words).select(
        F.when(on_right, F.col("kind")).otherwise(F.col("cell")).alias("ka"),
        F.when(on_right, F.col("cell") - ALL_CLASSES).otherwise(F.col("kind")).alias("kb"),
        F.col("n").alias("times"),
    )


def word_classes(texts: DataFrame, clustered: int = CLUSTERED) -> dict:
    """Counts and classes of all words of encoded texts.

    The most frequent words are exchanged over the classes; their pairs are a table of fixed size,
    which one task clusters. Every other word seen SEEN times or more, however many there are, goes
    to the class of the largest exchange gain by the classes it stands between: its counts are
    gathered by a shuffle and its class comes from them alone. Words seen less often keep the class
    of their last three bytes, which so tells what unseen words, of the same classes, are like. The
    table of words has one row per distinct word and stays distributed.
    """
    texts = texts.select("codes")
    counts = written(token_counts(texts), "token_counts")
    end = int(END_CODE.view(np.int64))
    total, distinct, ends = counts.agg(
        F.sum("n"), F.count("*"), F.sum(F.when(F.col("code") == end, F.col("n")))
    ).first()
    top = counts.where(F.col("code") != end).orderBy(F.desc("n"), "code").limit(HELD_WORDS)
    top = top.toArrow()
    by_rank, n_by_rank = top["code"].to_numpy().view(np.uint64), top["n"].to_numpy()
    seen = seen_map(counts)
    order = np.argsort(by_rank)
    held, held_n = by_rank[order], n_by_rank[order]
    chosen = np.sort(by_rank[:clustered])
    pairs = symbol_pairs(texts, chosen, held)
    width, core = len(chosen) + ENDINGS + 1, len(chosen)

    def cluster(table: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((width, width))
        m[table["a"], table["b"]] = table["n"]
        of = exchange(m, core)
        pick = np.zeros((width, ALL_CLASSES))
        pick[np.arange(width), of] = 1
        steps = pick.T @ m @ pick
        return pd.DataFrame({"of": [of.tolist()], "steps": [steps.ravel().tolist()]})

    found = pairs.groupBy().applyInPandas(cluster, "of array<int>, steps array<double>").first()
    of = np.array(found.of if found else np.arange(width), np.int64)
    steps = np.array(found.steps if found else np.zeros(ALL_CLASSES**2)).reshape(ALL_CLASSES, ALL_CLASSES)
    words = written(placed(surroundings(texts, chosen, of, held, seen), steps), "words")
    # Classes of the held words: at most HELD_WORDS rows of two numbers.
    codes = texts.sparkSession.createDataFrame(pa.table({"code": held.view(np.int64)}))
    known = words.join(F.broadcast(codes), "code").select("code", "kind").toArrow()
    kinds = _ending(held)
    kinds[_places(known["code"].to_numpy().view(np.uint64), held)] = known["kind"].to_numpy()
    place = _places(held, chosen)
    core = place >= 0
    kinds[core] = of[place[core]]
    # Sizes of classes: of words placed, of rarer ones by their endings, and of clustered ones.
    size, distinct_in = np.zeros(ALL_CLASSES), np.zeros(ALL_CLASSES)
    rare = counts.where((F.col("n") < SEEN) & (F.col("code") != end)).select(_of_ending("code").alias("kind"), "n")
    for kind, n, k in words.select("kind", "n").unionByName(rare).groupBy("kind").agg(F.sum("n"), F.count("*")).collect():
        size[kind], distinct_in[kind] = n, k
    rare = core & (held_n < SEEN)
    for at, sign, which in ((_ending(held), -1, rare), (kinds, 1, core)):
        np.add.at(size, at[which], sign * held_n[which])
        np.add.at(distinct_in, at[which], sign)
    size[END_CLASS] = int(ends or 0)
    distinct_in[END_CLASS] = 1
    return {
        "counts": counts,
        "words": words,
        "total": int(total or 0),
        "distinct": int(distinct or 0),
        "model": {
            "room": np.log10(size + 0.5 * (distinct_in + 1)),
            "held": held,
            "held_n": held_n,
            "held_kind": kinds,
            "seen": seen,
            "ends": int(ends or 0),
        },
    }


def _with_steps(classes: dict, texts: DataFrame) -> dict:
    """The model of `word_classes` with transitions, counted over all tokens of `looked_up` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALL_CLASSES**2, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("_cells").flatten().to_numpy(), minlength=len(total))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["cell", "n"])

    steps = np.zeros(ALL_CLASSES**2)
    # At most ALL_CLASSES ** 2 rows of two numbers.
    for r in texts.select("_cells").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        steps[r.cell] = r.n
    smooth = steps.reshape(ALL_CLASSES, ALL_CLASSES) + 0.5
    step = np.log10(smooth) - np.log10(smooth.sum(axis=1, keepdims=True))
    return {**classes, "model": {**classes["model"], "step": step}}


def fit(docs: DataFrame, clustered: int = CLUSTERED) -> dict:
    """Counts and classes of all words of `docs`, and transitions between classes."""
    texts = written(encoded(docs.select("text")), "tokens", "zstd")
    classes = word_classes(texts, clustered)
    return _with_steps(classes, looked_up(texts, classes))


def _bounds(lists: pa.Array) -> np.ndarray:
    """Where each list starts among the flattened values, and where the last one stops; a null is empty."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])


def looked_up(texts: DataFrame, classes: dict) -> DataFrame:
    """Every row of encoded texts with n_tokens, its tokens known, the sum of log10 of their counts and 0.5, and _cells: for each
    token, ALL_CLASSES times the class before it plus its own.

    Counts and classes of frequent words are held by each task; the counts and classes of other words
    are joined once per text, so no frequent word is a join key, and neighbours that lacked a class
    then find it in their own text's list. A null or empty text is its end alone.
    """
    keep = [c for c in texts.columns if c != "codes"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name != "codes")
    held = texts.sparkSession.sparkContext.broadcast(classes["model"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        own, counts = np.append(m["held_kind"], END_CLASS), np.append(m["held_n"], m["ends"])
        log, some = np.log10(counts + 0.5), (counts > 0).astype(np.int64)
        for batch in _slices(batches, 200_000):
            stops = _bounds(batch.column("codes"))[1:]
            flat = batch.column("codes").flatten().to_numpy().view(np.uint64)
            starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
            at = _held_places(flat, m["held"])
            rest = at < 0
            kind = _kinds(at, flat, own, m["seen"])
            before = np.concatenate([[END_CLASS], kind[:-1]])
            both = (kind >= 0) & (before >= 0)
            known = np.add.reduceat(np.where(rest, 0, some[at]), starts)
            logs = np.add.reduceat(np.where(rest, 0.0, log[at]), starts)
            bounds = np.concatenate([[0], stops])
            # Each text's other words, once each.
            row, code = np.searchsorted(stops, np.flatnonzero(rest), "right"), flat[rest]
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))[: len(row)])
            offsets = pa.array(np.searchsorted(row[first], np.arange(len(bounds))).astype(np.int32))
            times = np.diff(np.append(first, len(row))).astype(np.int32)
            # A symbol is a class, or ALL_CLASSES more than the place in its text's list of other words.
            begin = np.searchsorted(row[first], np.arange(len(bounds)))
            number = np.zeros(len(row), np.int64)
            number[first] = 1
            symbol = kind.copy()
            place = np.empty(len(row), np.int64)
            place[order] = np.cumsum(number) - 1 - begin[row]
            symbol[rest] = np.where(kind[rest] < 0, ALL_CLASSES + place, kind[rest])
            left = np.concatenate([[END_CLASS], symbol[:-1]])
            lacking = pa.array(np.concatenate([[0], np.cumsum(~both)])[bounds].astype(np.int32))
            sides = [pa.ListArray.from_arrays(lacking, pa.array(x[~both].astype(np.int32))) for x in (left, symbol)]
            cells = pa.array((before[both] * ALL_CLASSES + kind[both]).astype(np.int16))
            complete = pa.array(np.concatenate([[0], np.cumsum(both)])[bounds].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [
                    pa.array(stops - starts),
                    pa.array(known),
                    pa.array(logs),
                    pa.ListArray.from_arrays(complete, cells),
                    pa.ListArray.from_arrays(offsets, pa.array(code[first].view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(times)),
                    *sides,
                ],
                names=[*keep, "n_tokens", "_known", "_logs", "_cells", "_codes", "_times", "_left", "_right"],
            )

    head = (fields + ", " if fields else "") + "n_tokens long, _known long, _logs double, _cells array<short>"
    schema = head + ", _codes array<long>, _times array<int>, _left array<int>, _right array<int>"
    parts = texts.select(*keep, "codes").mapInArrow(run, schema)
    parts = written(parts.withColumn("_row", F.monotonically_increasing_id()), "parts", "zstd")
    rest = parts.select("_row", F.posexplode(F.arrays_zip("_codes", "_times")).alias("place", "x")).select(
        "_row", "place", F.col("x._codes").alias("code"), F.col("x._times").alias("t")
    )
    n = F.coalesce("n", F.lit(0))
    kind = F.coalesce("kind", _of_ending("code"))
    met = rest.join(classes["counts"], "code", "left").join(classes["words"].select("code", "kind"), "code", "left")
    sums = (
        met.select(
            "_row",
            (F.col("t") * F.log10(n + 0.5)).alias("more"),
            F.when(n > 0, F.col("t")).otherwise(0).alias("found"),
            (F.col("place").cast("long") * ALL_CLASSES + kind).alias("at"),
        )
        .repartition("_row")
        .groupBy("_row")
        .agg(F.sum("more").alias("_more"), F.sum("found").alias("_found"), F.collect_list("at").alias("_kinds"))
    )
    names = [*keep, "n_tokens", "_known", "_logs"]

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, kinds = np.diff(_bounds(batch.column("_left"))), _bounds(batch.column("_kinds"))
            text = np.repeat(np.arange(batch.num_rows), pairs)
            at = batch.column("_kinds").flatten().to_numpy()
            kind = np.zeros(len(at) + 1, np.int64)
            kind[np.repeat(kinds[:-1], np.diff(kinds)) + at // ALL_CLASSES] = at % ALL_CLASSES
            sides = [batch.column(c).flatten().to_numpy() for c in ("_left", "_right")]
            ka, kb = (
                np.where(x < ALL_CLASSES, x, kind[np.where(x < ALL_CLASSES, 0, kinds[text] + x - ALL_CLASSES)])
                for x in sides
            )
            had = np.diff(_bounds(batch.column("_cells")))
            cells = np.concatenate([batch.column("_cells").flatten().to_numpy(), ka * ALL_CLASSES + kb]).astype(np.int16)
            order = np.argsort(np.concatenate([np.repeat(np.arange(batch.num_rows), had), text]), kind="stable")
            offsets = np.concatenate([[0], np.cumsum(had + pairs)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells[order]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], lists], names=[*names, "_cells"])

    more, found = F.coalesce("_more", F.lit(0.0)), F.coalesce("_found", F.lit(0))
    ready = (
        parts.drop("_codes", "_times")
        .join(sums, "_row", "left")
        .withColumn("_logs", F.col("_logs") + more)
        .withColumn("_known", F.col("_known") + found)
        .select(*names, "_cells", "_left", "_right", "_kinds")
        .mapInArrow(complete, head)
    )
    return written(ready, "text_cells", "zstd")


def _summed(texts: DataFrame, fitted: dict) -> DataFrame:
    """The scores of `looked_up` texts."""
    own = ("n_tokens", "_known", "_logs", "_cells")
    keep = [c for c in texts.columns if c not in own]
    names = [*keep, *own[:-1]]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*names).schema.fields)
    value = fitted["model"]["step"] - fitted["model"]["room"]
    shared = texts.sparkSession.sparkContext.broadcast(value.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = np.repeat(np.arange(batch.num_rows), np.diff(_bounds(batch.column("_cells"))))
            steps = shared.value[batch.column("_cells").flatten().to_numpy()]
            steps = np.bincount(text, steps, batch.num_rows).astype(float)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(steps)], names=[*names, "_steps"])

    total = fitted["total"]
    room = float(np.log10(total + 0.5 * (fitted["distinct"] + 1)))
    return texts.mapInArrow(run, f"{fields}, _steps double").select(
        *keep,
        "n_tokens",
        F.col("_known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("_logs") - F.col("n_tokens") * room).alias("base_score"),
        (F.col("_logs") + F.col("_steps")).alias("score"),
    )


def scored(docs: DataFrame, fitted: dict) -> DataFrame:
    """Every row with n_tokens, n_known, train_tokens, base_score and score (log10, whole text).

    score: for each token, log10 of the transition from the class before, plus log10 of its share in
    its own class: (c + 0.5) / (class tokens + 0.5 * (class words + 1)), so an unseen word has a
    share too. base_score is the smoothed unigram sum.
    """
    return _summed(looked_up(encoded(docs), fitted), fitted)


def fitted_scores(docs: DataFrame, held_out: str, clustered: int = CLUSTERED) -> DataFrame:
    """`scored` rows of all `docs` by the model fitted on those whose column `held_out` is false. The words
    of a text are encoded and looked up once, for the fit and for its score."""
    texts = written(encoded(docs), "tokens", "zstd")
    classes = word_classes(texts.where(~F.col(held_out)), clustered)
    texts = looked_up(texts, classes)
    return _summed(texts, _with_steps(classes, texts.where(~F.col(held_out))))
