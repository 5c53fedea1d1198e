"""An isolation forest over rule statistics, its threshold set by labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import Codes, gram_codes, raw, word_codes

SYMBOLS = b"#*$%&|<>"
TREES, SAMPLE = 100, 256
#: Labelled rows the trees are grown from at most.
FIT_ROWS = 8_000
BINS = 1_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(text: bytes, codes: Codes) -> tuple[int, ...]:
    """The counts of COUNTS, in order."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) - int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    again = len(lines) - len(set(lines))
    ids = word_codes(words, codes)
    grams = gram_codes(ids, 3)
    repeated = 0
    if len(grams):
        _, place, times = np.unique(grams, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(times[place] > 1)
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[hit + k] = True
        repeated = int(covered.sum())
    return n, chars, symbols, again, repeated


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row, all of the whole text; a null text counts nothing.

    Words lie between ASCII white space. A line counts as repeated if it has a word and equals an
    earlier line of its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            found = np.array([counts(t, codes) for t in raw(batch.column("text"))], np.int64)
            found = found.reshape(batch.num_rows, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in found.T)], names=["doc_id", *COUNTS]
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def features(stats: np.ndarray) -> np.ndarray:
    """Plain rates of words: their mean length, symbols, and the share in repeated windows.

    Repetition has one rate only. Repeated lines and windows say much the same, and random splits, which
    choose among the rates evenly, would single out texts with a refrain three times as often.
    """
    n, chars, symbols, _, repeated = stats.T.astype(float)
    words = np.maximum(n, 1)
    return np.stack([chars / words, symbols / words, repeated / words], axis=1)


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), (n > 1) * 1.0)


def grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple]:
    """One tree as a list of (feature, cut, left, right, path length); leaves have feature -1."""
    nodes: list[tuple] = []

    def split(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append(())
        low, high = rows.min(axis=0), rows.max(axis=0)
        free = np.flatnonzero(high > low)
        if level >= depth or len(rows) < 2 or not len(free):
            nodes[at] = (-1, 0.0, at, at, level + float(average_path(len(rows))))
            return at
        f = int(rng.choice(free))
        cut = float(rng.uniform(low[f], high[f]))
        left = rows[:, f] < cut
        nodes[at] = (f, cut, split(rows[left], level + 1), split(rows[~left], level + 1), 0.0)
        return at

    split(x, 0)
    return nodes


def forest(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 5) -> dict:
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    depth = int(np.ceil(np.log2(max(size, 2)))) + 4
    grown = [grow(x[rng.choice(len(x), size, replace=False)], rng, depth) for _ in range(trees)]
    return {"trees": [tuple(map(np.array, zip(*t))) for t in grown], "norm": float(average_path(size)) or 1.0}


def anomaly(x: np.ndarray, model: dict) -> np.ndarray:
    """0 to 1, higher for rows that random splits single out after few steps."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, cut, left, right, path in model["trees"]:
        at = np.zeros(len(x), np.int64)
        while True:
            f = feature[at]
            if (f < 0).all():
                break
            at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] < cut[at], left[at], right[at]))
        total += path[at]
    return 2.0 ** (-total / len(model["trees"]) / model["norm"])


def base_failed(min_words: int = 50, max_repeat: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")
    )


def fit(stats: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict:
    """Grow the trees from labelled rows of both kinds, and set the threshold from all labelled rows.

    The trees see at most `rows` labelled rows, chosen by a hash of their statistics, whatever their label:
    a tree of good rows alone cannot split a rate that is the same in all of them. Rows that the base
    rules already fail are left out, as the verdict does not concern them. The threshold is the one of
    BINS steps with the best mean of the shares of good rows kept and bad rows dropped (the middle of
    equal ones); scores of all labelled rows are counted per step and label in Spark. Without labelled
    rows of both kinds, every row is kept.
    """
    by = labels.select("doc_id", F.col("quality").alias("_good")).where("_good is not null").distinct()
    seen = stats.where(~base_failed()).join(by, "doc_id")
    fitted = (
        seen.orderBy(F.xxhash64(*COUNTS, "doc_id"), *COUNTS)
        .limit(rows)
        .select(*COUNTS)
        .collect()
    )
    if not fitted:
        return {"forest": None, "threshold": 2.0}
    model = forest(features(np.array([tuple(r) for r in fitted])))
    scored = scores(seen, model).groupBy(
        F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"), "_good"
    )
    table = np.zeros((BINS + 1, 2))
    for b, good, n in scored.agg(F.count("*").alias("n")).collect():
        table[b, int(good == 1)] = n
    bad, good = table.T
    if not bad.sum():
        return {"forest": model, "threshold": 2.0}
    kept = np.cumsum(good) / good.sum()
    caught = 1 - np.cumsum(bad) / bad.sum()
    best = kept + caught
    level = np.flatnonzero(best >= best.max() - 1e-9)
    return {"forest": model, "threshold": float((level[0] + level[-1]) / 2 + 1) / BINS}


def scores(stats: DataFrame, model: dict) -> DataFrame:
    """Every row with its anomaly; the forest is of fixed size."""
    held = stats.sparkSession.sparkContext.broadcast(model)
    schema = stats.schema.simpleString()[7:-1] + ",anomaly:double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(np.stack([batch.column(c).to_numpy() for c in COUNTS], axis=1))
            yield batch.append_column("anomaly", pa.array(anomaly(x, held.value)))

    return stats.mapInArrow(run, schema)


def judged(stats: DataFrame, model: dict, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Statistics with base_failed, anomaly and kept.

    base_failed: fewer than `min_words` words, or more than `max_repeat` percent of them in
    repeated 3-word windows. kept: not base_failed, and the anomaly is below the threshold.
    """
    failed = base_failed(min_words, max_repeat)
    if model["forest"] is None:
        scored = stats.withColumn("anomaly", F.lit(0.0))
    else:
        scored = scores(stats, model["forest"])
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("anomaly") < model["threshold"])
    )
