"""A bidirectional gated recurrent network with attention, over words and their characters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import lower_words, raw, small_batches, with_columns

#: Words of a window, and words from one window to the next.
WINDOW, STEP = 24, 12
WORD_SLOTS, CHAR_SLOTS, DIM, HIDDEN = 1 << 12, 1 << 14, 12, 8
#: Fit bounds: labelled documents of each label, and windows taken from each of them.
FIT_DOCS, FIT_WINDOWS = 1_600, 48
#: Steps of a logit in which labelled documents are counted for the threshold.
BINS = 256
#: Share of documents that are not toxic which may reach the threshold.
ALARMS = 0.015
#: Places, as a power of two, of the bit map that tells labelled documents from others.
KEY_BITS = 25
#: Words whose projected inputs a task remembers.
WORDS_HELD = 250_000
#: Words whose inputs are made at once.
WORDS_AT_ONCE = 8_192

_EDGES = b".,;:!?\"'()[]{}<>-_*#%&$|/\\~`+="


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its slot, and the slots of its 3- and 4-byte runs, flat, with their offsets."""
    bare = [w.strip(_EDGES) or w for w in words]
    slots = np.fromiter((xxhash.xxh3_64_intdigest(w) % WORD_SLOTS for w in bare), np.int64, len(bare))
    framed = [b"<" + w + b">" for w in bare]
    length = np.fromiter(map(len, framed), np.int64, len(framed))
    x = np.frombuffer(b"".join(framed) + b"\0\0\0", np.uint8).astype(np.uint32)
    n = int(length.sum())
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    room = np.repeat(start + length, length) - np.arange(n)
    three = (x[:n] * np.uint32(0x9E3779B1) + x[1 : n + 1]) * np.uint32(0x85EBCA6B) + x[2 : n + 2]
    four = (three * np.uint32(0xC2B2AE35) + x[3 : n + 3]) ^ np.uint32(0x5BD1E995)
    both = np.stack([three, four], axis=1)
    both = ((both ^ (both >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(18)
    keep = np.stack([room >= 3, room >= 4], axis=1)
    per_word = np.add.reduceat(keep.sum(axis=1), start) if len(words) else np.empty(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(per_word)[:-1]])
    return slots, both[keep].astype(np.int64), offsets


def spans(n: int, window: int = WINDOW, step: int = STEP) -> list[int]:
    """Where the windows of n words start; the last one ends with the text."""
    if n <= window:
        return [0] if n else []
    return [*range(0, n - window, step), n - window]


class Network:
    """Parameters, scoring and training. Windows are arrays of rows of a table of word inputs."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        h, d = HIDDEN, 2 * DIM
        self.p = {
            "word": draw(WORD_SLOTS, DIM, scale=0.1),
            "char": draw(CHAR_SLOTS, DIM, scale=0.3),
            "w": draw(d, 6 * h, scale=d**-0.5),
            "b": np.zeros(6 * h, np.float32),
            "uf": draw(h, 3 * h, scale=h**-0.5),
            "ub": draw(h, 3 * h, scale=h**-0.5),
            "a": draw(2 * h, h, scale=(2 * h) ** -0.5),
            "v": draw(h, scale=h**-0.5),
            "o": draw(2 * h, scale=(2 * h) ** -0.5),
            "c": np.zeros(1, np.float32),
        }
        self.scale = (1.0, 0.0)
        self.own = np.inf

    def embed(self, words: list[bytes]):
        slots, runs, offsets = inputs(words)
        count = np.diff(np.append(offsets, len(runs)))
        if len(runs):
            char = np.add.reduceat(self.p["char"][runs], np.minimum(offsets, len(runs) - 1), axis=0)
            char[count == 0] = 0
        else:
            char = np.zeros((len(words), DIM), np.float32)
        char /= np.maximum(count, 1)[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][slots], char], axis=1), (slots, runs, count)

    def project(self, words: list[bytes]) -> np.ndarray:
        """What each word adds to the gates of both directions; words go in blocks, to hold few runs at a time."""
        out = np.empty((len(words), 6 * HIDDEN), np.float32)
        for i in range(0, len(words), WORDS_AT_ONCE):
            out[i : i + WORDS_AT_ONCE] = self.embed(words[i : i + WORDS_AT_ONCE])[0] @ self.p["w"] + self.p["b"]
        return out

    @staticmethod
    def _walk(x: np.ndarray, u: np.ndarray, live: np.ndarray | None, tape: list | None) -> np.ndarray:
        """Hidden states over time. x: time, rows, gates; steps that are not live change nothing."""
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((*x.shape[:2], HIDDEN), np.float32)
        k = HIDDEN
        for t in range(len(x)):
            g = h @ u
            zr = _sigmoid(x[t, :, : 2 * k] + g[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(x[t, :, 2 * k :] + r * g[:, 2 * k :])
            new = n + z * (h - n)
            if live is not None:
                new = np.where(live[t][:, None], new, h)
            if tape is not None:
                tape.append((h, z, r, n, g[:, 2 * k :]))
            out[t] = h = new
        return out

    def logits(self, x: np.ndarray, live: np.ndarray | None, tape: dict | None = None) -> np.ndarray:
        """x: time, rows, gates of both directions; live: time, rows, or None if all are."""
        k = 3 * HIDDEN
        forward, backward = ([], []) if tape is not None else (None, None)
        ahead = self._walk(x[:, :, :k], self.p["uf"], live, forward)
        back = self._walk(x[::-1, :, k:], self.p["ub"], None if live is None else live[::-1], backward)
        h = np.concatenate([ahead, back[::-1]], axis=2)
        e = np.tanh(h @ self.p["a"])
        s = e @ self.p["v"]
        if live is not None:
            s = np.where(live, s, -30.0)
        s = np.exp(s - s.max(axis=0))
        s /= s.sum(axis=0)
        c = (s[:, :, None] * h).sum(axis=0)
        if tape is not None:
            tape.update(h=h, e=e, s=s, c=c, forward=forward, backward=backward)
        return c @ self.p["o"] + self.p["c"]

    def _unwalk(self, dh_all, tape, u, live):
        """Gradients of the gates' inputs and of u, back through time."""
        k = HIDDEN
        dx = np.zeros((*dh_all.shape[:2], 3 * k), np.float32)
        du = np.zeros_like(u)
        dh = np.zeros_like(dh_all[0])
        for t in range(len(dh_all) - 1, -1, -1):
            h, z, r, n, gn = tape[t]
            dh = dh + dh_all[t]
            on = live[t][:, None]
            d = np.where(on, dh, 0)
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (h - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            du += h.T @ dg
            dx[t] = np.concatenate([dz, dr, dn], axis=1)
            dh = np.where(on, d * z + dg @ u.T, dh)
        return dx, du

    def gradients(self, ids: np.ndarray, words: list[bytes], y: np.ndarray) -> tuple[dict, float]:
        """ids: rows, time; -1 is no word; places of `words`."""
        emb, (slots, runs, count) = self.embed(words)
        proj = emb @ self.p["w"] + self.p["b"]
        live = (ids >= 0).T
        at = np.maximum(ids, 0).T
        tape: dict = {}
        logit = self.logits(proj[at], live, tape)
        p = _sigmoid(logit)
        d = ((p - y) / len(y)).astype(np.float32)
        h, e, s = tape["h"], tape["e"], tape["s"]
        g = {"o": tape["c"].T @ d, "c": np.array([d.sum()], np.float32)}
        dc = d[:, None] * self.p["o"]
        dh = s[:, :, None] * dc
        ds = (h * dc).sum(axis=2)
        ds = s * (ds - (s * ds).sum(axis=0))
        g["v"] = np.einsum("tbk,tb->k", e, ds)
        de = ds[:, :, None] * self.p["v"] * (1 - e * e)
        g["a"] = np.einsum("tbi,tbk->ik", h, de)
        dh = dh + de @ self.p["a"].T
        k = HIDDEN
        dxf, g["uf"] = self._unwalk(dh[:, :, :k], tape["forward"], self.p["uf"], live)
        dxb, g["ub"] = self._unwalk(dh[::-1, :, k:], tape["backward"], self.p["ub"], live[::-1])
        dx = np.concatenate([dxf, dxb[::-1]], axis=2)[live]
        rows = at[live]
        dproj = np.stack([np.bincount(rows, w, len(words)) for w in dx.T], axis=1).astype(np.float32)
        g["b"] = dproj.sum(axis=0)
        g["w"] = emb.T @ dproj
        demb = dproj @ self.p["w"].T
        g["word"] = np.stack([np.bincount(slots, w, WORD_SLOTS) for w in demb[:, :DIM].T], axis=1)
        share = np.repeat(demb[:, DIM:] / np.maximum(count, 1)[:, None], count, axis=0)
        g["char"] = np.stack([np.bincount(runs, w, CHAR_SLOTS) for w in share.T], axis=1)
        return g, float(-np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))

    def score_ids(self, ids: np.ndarray, proj: np.ndarray, rows: int = 2048) -> np.ndarray:
        """Logits of windows (rows, time) over a table of projected words; -1 is no word."""
        out = np.empty(len(ids), np.float32)
        for i in range(0, len(ids), rows):
            part = ids[i : i + rows].T
            live = part >= 0
            whole = bool(live.all())
            out[i : i + rows] = self.logits(proj[np.maximum(part, 0)], None if whole else live)
        return out

    def train(self, windows: Iterable[list[bytes]], doc: np.ndarray, y: np.ndarray, steps: int = 400, rows: int = 192) -> np.ndarray:
        """windows and the document and label of each. A toxic document has windows that are not.
        Windows are read once, each word kept once: as lists of words they would take the driver's memory.

        First half: every window has its document's label, half of each batch from either. Second
        half: of a toxic document, only windows that score near its best one count as toxic.
        Returns the best logit of each document, -inf of one without windows.
        """
        rng = np.random.default_rng(3)
        table: dict[bytes, int] = {}
        ids = np.full((len(doc), WINDOW), -1, np.int32)
        for i, x in enumerate(windows):
            ids[i, : len(x)] = [table.setdefault(w, len(table)) for w in x]
        words = list(table)
        good, bad = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for step in range(steps):
            if step in (steps // 2, 3 * steps // 4):
                logit = self.score_ids(ids, self.project(words))
                top = np.full(doc.max() + 1, -1e9)
                np.maximum.at(top, doc, logit)
                bad = np.flatnonzero((y == 1) & (logit >= np.minimum(top[doc], np.median(top[doc[y == 1]]))))
                hard = good[np.argsort(-logit[good])[: max(1, len(good) // 20)]]
                good_now = np.concatenate([np.repeat(hard, 5), good])
            elif step < steps // 2:
                good_now = good
            pick = np.concatenate([rng.choice(good_now, rows // 2), rng.choice(bad, rows // 2)])
            used, local = np.unique(ids[pick], return_inverse=True)
            local = local.reshape(len(pick), WINDOW) - int(used[0] < 0)
            names = [words[i] for i in used if i >= 0]
            grads, _ = self.gradients(local, names, y[pick].astype(np.float32))
            rate = 0.02 * (1 - step / steps) + 0.001
            for k, v in grads.items():
                m, s = moment[k]
                m += 0.1 * (v - m)
                s += 0.01 * (v * v - s)
                fix = (1 - 0.99 ** (step + 1)) ** 0.5 / (1 - 0.9 ** (step + 1))
                self.p[k] -= (rate * fix * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
        best = np.full(doc.max() + 1, -np.inf)
        np.maximum.at(best, doc, self.score_ids(ids, self.project(words)))
        return best


def calibrated(
    top: np.ndarray,
    bad: np.ndarray,
    good: np.ndarray,
    at: float = 0.3,
    alarms: float = ALARMS,
    highest: float = np.inf,
) -> tuple[float, float]:
    """Slope and shift that make a document's best logit a score, `at` at the threshold.

    top: different logits in ascending order; bad, good: how many documents of either label have
    each as their best. The threshold is the middle of the range that at most a share `alarms` of the
    good ones reach, and as many toxic ones as that allows, but not above `highest`; the slope makes
    the middle of toxic documents 0.99.
    """
    cuts = np.concatenate([[top[0] - 1], (top[1:] + top[:-1]) / 2, [top[-1] + 1]])
    reach = [np.concatenate([np.cumsum(n[::-1])[::-1], [0]]) for n in (bad, good)]
    caught = np.where(reach[1] <= alarms * good.sum(), reach[0], -1)
    level = np.flatnonzero(caught == caught.max())
    cut = min(float((cuts[level[0]] + cuts[level[-1]]) / 2), highest)
    middle = float(top[np.searchsorted(np.cumsum(bad), bad.sum() / 2)])
    slope = (np.log(99) - np.log(at / (1 - at))) / max(middle - cut, 1e-2)
    return float(slope), float(np.log(at / (1 - at)) - slope * cut)


def parting(best: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the range of logits with the best mean of both labels' shares on their side."""
    top = np.unique(best)
    cuts = np.concatenate([[top[0] - 1], (top[1:] + top[:-1]) / 2, [top[-1] + 1]])
    below = [np.searchsorted(np.sort(best[toxic == k]), cuts) / (toxic == k).sum() for k in (1, 0)]
    level = np.flatnonzero(below[1] - below[0] >= (below[1] - below[0]).max() - 1e-9)
    return float((cuts[level[0]] + cuts[level[-1]]) / 2)


def half(text: str = "text") -> Column:
    """0 or 1 by the hash of a text, so that copies of a text are on one side."""
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def sampled(docs: DataFrame, labels: DataFrame, per_label: int = FIT_DOCS, windows: int = FIT_WINDOWS) -> list:
    """(label, half, windows) of at most `per_label` documents of each label, and `windows` of each.

    The documents are those with the lowest hash of their id; of long ones, windows are taken
    at even distances.
    """
    known = labels.where("toxic in (0, 1)").select("doc_id", "toxic").distinct()
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.where("toxic = 1").orderBy(*order).limit(per_label).unionAll(
        known.where("toxic = 0").orderBy(*order).limit(per_label)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4_000_000):
            cut = []
            for text in raw(batch.column("text")):
                words = lower_words(text)
                at = spans(len(words))
                if len(at) > windows:
                    at = [at[i] for i in np.linspace(0, len(at) - 1, windows).astype(int)]
                cut.append([b" ".join(words[i : i + WINDOW]).decode("utf-8", "replace") for i in at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), batch.column("half"), pa.array(cut, pa.list_(pa.string()))],
                names=["toxic", "half", "windows"],
            )

    # At most 2 * per_label rows of two numbers: small at any size of the input.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text", half().alias("half"))
    return rows.mapInArrow(run, "toxic int, half int, windows array<string>").collect()


def trained(rows: list) -> Network | None:
    """A network from (label, windows) of documents; None without documents of both labels.

    Its `own` is where its training texts part."""
    doc = np.array([i for i, r in enumerate(rows) for _ in r[1]], np.int64)
    y = np.array([r[0] for r in rows for _ in r[1]], np.int64)
    if not (y == 0).any() or not (y == 1).any():
        return None
    net = Network()
    windows = (w.encode().split() for r in rows for w in r[1])
    best = net.train(windows, doc, y)
    label = np.array([r[0] for r in rows])
    net.own = parting(best[best > -np.inf], label[: len(best)][best > -np.inf])
    return net


def fit(docs: DataFrame, labels: DataFrame, per_label: int = FIT_DOCS) -> Network | None:
    """Train on labelled documents, from their texts and labels alone.

    The network trains on a bounded sample. Slope and threshold come from all labelled documents, each by its
    best window of all, as a network judges it that has not seen its text: two more networks train on the
    halves of the sample, and each judges the other half of all labelled documents. A network knows its own
    training texts by heart, so a threshold between these would sit too high for others; it is an upper bound, as
    with few texts the two judges know far less than the network. Where a half lacks documents of a
    label, the network itself judges all. None without documents of both labels.
    """
    rows = sorted((r.toxic, list(r.windows), r.half) for r in sampled(docs, labels, per_label))
    net = trained(rows)
    if net is None:
        return None
    # The judge of half 0 comes first: it trained on half 1.
    judges = [trained([r for r in rows if r[2] != k]) for k in (0, 1)]
    if None in judges:
        judges = [net, net]
    net.scale = calibrated(*best_counts(docs, labels, judges), highest=net.own)
    return net


def perhaps_in(docs: DataFrame, keys: DataFrame, bits: int = KEY_BITS) -> DataFrame:
    """Rows of (doc_id, text) that may have a doc_id of `keys`, so that a join need not shuffle the others.

    A bit map of 2 ** bits places, of one size for any number of keys, tells most others apart; the
    join still decides. With far more keys than places nearly all rows pass, with the same result.
    """
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << bits))
    words = keys.select(slot.alias("slot")).groupBy(F.expr("slot >> 6").alias("word"))
    # At most 2 ** (bits - 6) rows of two numbers.
    found = words.agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("mask")).collect()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[[r.word for r in found]] = [r.mask for r in found]
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot").to_numpy()
            yield batch.filter(pa.array((held.value[at >> 6] >> (at & 63)) & 1 == 1)).select(["doc_id", "text"])

    return docs.select("doc_id", "text", slot.alias("slot")).mapInArrow(run, docs.schema)


def best_counts(docs: DataFrame, labels: DataFrame, judges: list[Network]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best logits of labelled documents over all their windows, each half by its judge, in steps of
    1 / BINS, ascending, and how many toxic and other documents have each. Logits are bounded by the
    weights, so steps are few. A null text has no windows and is in neither half."""
    known = labels.where("toxic in (0, 1)").select("doc_id", "toxic").distinct()
    step = F.round(F.col("best") * BINS).cast("long").alias("step")
    own = perhaps_in(docs.select("doc_id", "text").where("text is not null"), known)
    # The half is known before the join, so each text is shuffled for its own judge alone.
    halves = [own.where(half() == k).join(known, "doc_id").select("toxic", "text") for k in (0, 1)]
    best = [best_windows(rows, judge) for rows, judge in zip(halves, judges)]
    counted = best[0].unionByName(best[1]).where("n_windows > 0").groupBy(step, "toxic")
    found = counted.agg(F.count("*").alias("n")).collect()
    steps = sorted({r.step for r in found})
    counts = {(r.step, r.toxic): r.n for r in found}
    bad, good = (np.array([counts.get((k, toxic), 0) for k in steps]) for toxic in (1, 0))
    return np.array(steps) / BINS, bad, good


def score(
    docs: DataFrame, model: Network | None, threshold: float = 0.3, keep_text: bool = False
) -> DataFrame:
    """Add score (0 to 1), predicted (1 from `threshold` on) and n_windows to every row.

    All windows of the whole text are scored, WINDOW words each, STEP apart; the document's score
    comes from its best window. A null text, one without words, and every text under a None model
    score 0. Columns of the same names are replaced; the text itself is returned on demand only.
    """
    own = ("score", "predicted", "n_windows")
    keep = [c for c in docs.columns if c not in own and (keep_text or c != "text")]
    read = keep if keep_text else [*keep, "text"]
    a, b = model.scale if model is not None else (1.0, 0.0)
    z = F.greatest(F.least(F.col("best") * a + b, F.lit(30.0)), F.lit(-30.0))
    return (
        best_windows(docs.select(*read), model, keep_text)
        .withColumn("score", F.when((F.col("n_windows") > 0) & F.lit(model is not None), 1 / (1 + F.exp(-z))).otherwise(0.0))
        .select(*keep, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_windows")
    )


def best_windows(docs: DataFrame, model: Network | None, keep_text: bool = False) -> DataFrame:
    """Every row with best, the highest logit of all windows of its text (0 if there are none), and n_windows."""
    keep = [c for c in docs.columns if keep_text or c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        places: dict[bytes, int] = {}
        proj = np.empty((1024, 6 * HIDDEN), np.float32)
        for batch in small_batches(batches, "text", 1_500_000):
            n = batch.num_rows
            best, number = np.full(n, -np.inf), np.zeros(n, np.int64)
            if net is not None:
                texts = [lower_words(t) for t in raw(batch.column("text"))]
                if len(places) > WORDS_HELD:
                    places.clear()
                fresh = list(dict.fromkeys(w for t in texts for w in t if w not in places))
                if fresh:
                    first = len(places)
                    places.update(zip(fresh, range(first, first + len(fresh))))
                    if len(places) > len(proj):
                        grown = np.empty((2 * len(places), 6 * HIDDEN), np.float32)
                        grown[:first] = proj[:first]
                        proj = grown
                    proj[first : len(places)] = net.project(fresh)
                parts, owner = [], []
                steps = np.arange(WINDOW)
                for i, words in enumerate(texts):
                    at = spans(len(words))
                    number[i] = len(at)
                    if not at:
                        continue
                    ids = np.fromiter(map(places.__getitem__, words), np.int32, len(words))
                    if len(ids) < WINDOW:
                        ids = np.append(ids, np.full(WINDOW - len(ids), -1, np.int32))
                    parts.append(ids[np.array(at)[:, None] + steps])
                    owner.append(np.full(len(at), i))
                if parts:
                    logit = net.score_ids(np.concatenate(parts), proj)
                    np.maximum.at(best, np.concatenate(owner), logit)
            new = {"best": pa.array(np.where(number > 0, best, 0.0)), "n_windows": pa.array(number)}
            yield with_columns(batch, keep, new)

    schema = (fields + ", " if fields else "") + "best double, n_windows long"
    return docs.mapInArrow(run, schema)
