"""Language by the nearest of several centroids per language over TF-IDF byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import raw, small_batches, with_columns

SIZES = (2, 3, 4)
DIMS = 1 << 13
#: Fit bounds: rows of each language for the centroids, and centroids of each language.
ROWS_PER_LANG = 300
CENTROIDS = 4
#: A text whose best cosine is this far below the usual one of that centroid is rejected.
REJECT_SIGMAS = 6.0

_LETTER = r"\p{L}"


def grams(text: bytes, dims: int = DIMS) -> np.ndarray:
    """Hashed counts of the byte n-grams of the text, A-Z in lower case, digits and runs dropped in."""
    x = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    total = np.zeros(dims, np.float32)
    code = np.zeros(len(x), np.uint32)
    for k in range(max(SIZES)):
        if len(x) <= k:
            break
        code = code[: len(x) - k] * np.uint32(0x9E3779B1) + x[k:] + np.uint32(k + 1)
        if k + 1 in SIZES:
            slots = ((code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 13)
            total += np.bincount(slots % dims, minlength=dims)
    return total


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of log term counts times rarity, each of length one (or all zero)."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def document_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each n-gram slot occurs; one short row per slot and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in raw(batch.column("text")):
                seen += grams(text) > 0
                n += 1
        slots = np.append(np.nonzero(seen)[0], -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots), pa.array(np.append(seen[seen > 0], n))], names=["slot", "n"]
        )

    rows = (
        docs.select("text")
        .mapInArrow(run, "slot long, n long")
        .groupBy("slot")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    found = np.zeros(DIMS, np.int64)
    total = 0
    for slot, n in rows:
        if slot < 0:
            total = n
        else:
            found[slot] = n
    return found, total


def sphere_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k directions that the unit rows of x gather around: the first by spread, then by turns."""
    k = min(k, len(x))
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(chosen) < k:
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    centres = x[chosen].copy()
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        for j in range(k):
            if (nearest == j).any():
                mean = x[nearest == j].mean(axis=0)
                centres[j] = mean / max(np.linalg.norm(mean), 1e-9)
    return centres


def fit(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, centroids: int = CENTROIDS) -> dict:
    """Learn from text and lang alone. Rarities come from all rows; the centroids of a language from
    `rows_per_lang` of its different texts, those with the lowest hash: copies count once. Hashes
    are ranked first, so only the chosen texts are shuffled.

    No rows give a model without languages, which calls every text `und`.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, n = document_counts(known)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    hashed = known.select("lang", "text", F.xxhash64("text").alias("h"))
    ranked = hashed.select("lang", "h").distinct().selectExpr(
        "lang", "h", "row_number() over (partition by lang order by h) as k"
    )
    # A fixed number of hashes per language.
    chosen = F.broadcast(ranked.where(F.col("k") <= rows_per_lang).select("lang", "h"))
    texts = hashed.join(chosen, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])

    def means(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h")
        x = weigh(np.stack([grams(t.encode()) for t in rows["text"]]), idf)
        centres = sphere_means(x, centroids)
        cosine = x @ centres.T
        out = []
        for j, c in enumerate(centres):
            own = cosine[cosine.argmax(axis=1) == j, j]
            low = float(own.mean() - REJECT_SIGMAS * max(own.std(), 0.01)) if len(own) else 0.0
            out.append((rows["lang"].iloc[0], j, c.astype(np.float32).tolist(), low))
        return pd.DataFrame(out, columns=["lang", "j", "centre", "least"])

    rows = (
        texts.groupBy("lang")
        .applyInPandas(means, "lang string, j int, centre array<float>, least double")
        .collect()
    )
    rows = sorted(rows, key=lambda r: (r.lang, r.j))
    return {
        "idf": idf,
        "langs": [r.lang for r in rows],
        "centres": np.array([r.centre for r in rows], np.float32).reshape(len(rows), DIMS),
        "least": np.array([r.least for r in rows]),
    }


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(_LETTER), F.lit(False))


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Add lang_pred, score (0 to 1) and rejected to every row.

    lang_pred is the language of the nearest centroid by cosine; `und` for a null text, one without
    a letter, or a model without languages. score is the share of the best language among all, by
    a softmax of cosines. rejected: the best cosine lies below the centroid's usual range. The
    model is a few centroids per language, so its size does not follow the rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("text", "lang_pred", "score", "rejected")]
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema += ", lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = sorted(set(m["langs"]))
        of = np.array([names.index(x) for x in m["langs"]])
        for batch in small_batches(batches, "text", 1_000_000):
            ok = np.array(batch.column("_letter").to_pylist())
            n = batch.num_rows
            if names:
                x = weigh(np.stack([grams(t) for t in raw(batch.column("text"))]), m["idf"])
                cosine = x @ m["centres"].T
                near = cosine.argmax(axis=1)
                best = cosine[np.arange(n), near]
                by = np.stack([cosine[:, of == k].max(axis=1) for k in range(len(names))], axis=1)
                odds = np.exp(20 * (by - by.max(axis=1, keepdims=True)))
                score = np.where(ok, odds.max(axis=1) / odds.sum(axis=1), 0.0)
                lang = [names[of[j]] if y else "und" for j, y in zip(near, ok)]
                reject = ~ok | (best < m["least"][near])
            else:
                lang, score, reject = ["und"] * n, np.zeros(n), np.ones(n, bool)
            new = {
                "lang_pred": pa.array(lang, pa.string()),
                "score": pa.array(score.astype(float)),
                "rejected": pa.array(reject),
            }
            yield with_columns(batch, keep, new)

    return docs.select(*keep, "text", has_letter(F.col("text")).alias("_letter")).mapInArrow(run, schema)
