"""Each operator against a plain version of itself on small tables with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.llm import (
    brown,
    decontamination,
    jaccard,
    langid,
    lines,
    packing,
    quality,
    repeats,
    secrets,
    toxicity,
)
from tonelake.llm.common import remainder
from tonelake.llm.scratch import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    base = prose(180)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    passage = prose(95)
    rows = [base, base, near, near.upper(), None, "", "   \n\t ", "one", "one two three"]
    rows += [prose(rng.randint(1, 120)) for _ in range(40)]
    rows += [prose(30) + " " + passage + " " + prose(20), passage + "\n" + prose(15), "x" * 900, "ab" * 700]
    rows += ["header line number 7\n" + prose(20) + "\nheader line number 9" for _ in range(7)]
    rows += ["é" * 500 + " ñandú", 'password = "abcdEFGH1234"; token: short', "key AKIA" + "B2" * 9, "0f" * 20 + " end"]
    rows.append(prose(30_000))
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows.append((3, texts[3], "en", "s", 0))  # a row given twice
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def found(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_near_duplicates_equal_all_pairs(docs, texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for _ in root:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
        if all(root[root[i]] == root[i] for i in root):
            break
    rows = found(jaccard.near_duplicates(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in rows.items()} == {
        i: (len(s), root[i]) for i, s in enumerate(sets)
    }
    assert jaccard.near_duplicates(docs).count() == len(texts) + 1


@pytest.mark.parametrize("ignored,parts", [(0, 1), (2, 4)])
def test_similar_sets_share_a_signature(ignored, parts):
    rng = np.random.default_rng(1)
    bands = jaccard.Bands(85)
    for n in (7, 13, 40, 200, 1500):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            d = int(0.15 * n / 1.85 * rng.random() * 2)
            b = np.unique(np.concatenate([a[d // 2 :], rng.integers(0, 2**63, d - d // 2).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 85 * (len(a) + len(b) - both) or (len(a) == both == len(b)):
                continue
            made = [
                {int(x) for i in (bands.of(len(s)), bands.of(len(s)) + 1)
                 for x in jaccard.signatures(s, i, bands.limit(i), ignored, parts, 3)}
                for s in (a, b)
            ]
            assert made[0] & made[1]


@pytest.mark.parametrize("shard_bytes,shards_a_bucket", [(4 << 20, 4), (20_000, 2)])
def test_repeats_equal_every_string(docs, texts, monkeypatch, shard_bytes, shards_a_bucket):
    """In one shard, and in many over several buckets, with repeats across them."""
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(repeats, "SHARDS_A_BUCKET", shards_a_bucket)
    copies = texts + [texts[3]]
    seen = collections.Counter()
    data = [(t or "").encode() for t in copies]
    for t in data:
        seen.update(t[i : i + 400] for i in range(len(t) - 399))
    rows = found(repeats.removed(docs))
    for i, t in enumerate(data[:-1]):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 399):
            if seen[t[p : p + 400]] > 1:
                gone[p : p + 400] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int(np.diff(np.append(0, gone.astype(int))).clip(0).sum())
        r = rows[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(t), int(gone.sum()), runs), i
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_packing_round_trip(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    bpe = Tokenizer.from_file(path)
    odd = ["a  b", " lead", "a \n b", "\n \ta", "it's  ok ", "tab\t\tq r", "x y"]
    encode = packing.encoder(path, ranks)
    for t in odd + [t or "" for t in texts]:
        assert list(encode(t)) == bpe.encode(t, add_special_tokens=False).ids
    rows = packing.pack(packing.tokenised(docs, path, ranks), items_per_task=20).collect()
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        ids = np.array(bpe.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.piece == 0 or (r.length == 2048 and r.start)
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in rows if r.doc_id == 1) == len(bpe.encode(texts[1], add_special_tokens=False).ids) + 1


def test_sum_of_squares_fills_bins():
    lengths = np.minimum(2047, np.random.default_rng(2).lognormal(6.3, 0.8, 8000).astype(int) + 1)
    where, offset = packing.best_order(lengths, 2048)
    assert where.max() + 1 <= 1.01 * lengths.sum() / 2048
    assert np.bincount(where, lengths).max() <= 2048


def test_sum_of_squares_takes_the_smallest_sum():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 13, 200)
    where, offset, bins = packing.sum_of_squares(lengths, 12)
    level: dict[int, int] = {}

    def squares(gaps):
        return sum(n * n for g, n in collections.Counter(gaps).items() if g)

    for s, b, at in zip(lengths, where, offset):
        gaps = [12 - x for x in level.values()]
        options = {squares(gaps + [12 - s])}
        for k, g in enumerate(gaps):
            if g >= s:
                options.add(squares(gaps[:k] + gaps[k + 1 :] + [g - s]))
        assert at == level.get(b, 0)
        level[b] = at + s
        assert squares([12 - x for x in level.values()]) == min(options)
    assert len(level) == bins


def test_base_statistics_and_verdict(spark, docs, texts):
    rows = found(quality.statistics(docs))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        held = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert tuple(rows[i])[1:6] == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(held) - len(set(held)), len(again),
        )
    labels = spark.createDataFrame([(i, 1) for i in range(9, 40)] + [(5, 0)], "doc_id long, quality int")
    model = quality.fit(quality.statistics(docs), labels)
    assert found(quality.judged(quality.statistics(docs), model))[5].kept is False
    assert quality.fit(quality.statistics(docs), labels.limit(0))["forest"] is None


def test_quality_forest_on_rows_it_has_not_seen(spark):
    """Texts of symbols or of overlong words among prose of which some repeats itself a little. Odd texts are
    rare, as in the labelled rows; where they are a quarter of all, the forest drops refrains too."""
    rng = random.Random(6)

    def text(i):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(120)]
        if i % 20 == 0:
            words = [w + rng.choice(["##", "$|", "<>"]) for w in words]
        elif i % 20 == 1:
            words = [w * 3 for w in words]
        elif i % 20 == 2:
            words[60 : 63 + i // 20 % 6] = words[: 3 + i // 20 % 6]
        return " ".join(words)

    docs = spark.createDataFrame([(i, text(i)) for i in range(800)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = docs.where("doc_id < 400").select("doc_id", (F.col("doc_id") % 20 > 1).cast("int").alias("quality"))
    out = found(quality.judged(stats := quality.statistics(docs), quality.fit(stats, labels)))
    new = [out[i] for i in range(400, 800)]
    assert np.mean([r.kept for r in new if r.doc_id % 20 > 1]) > 0.9
    assert np.mean([not r.kept for r in new if r.doc_id % 20 < 2]) > 0.95
    assert out[900].base_failed and not out[900].kept and not out[901].kept


def test_secret_spans(spark, docs, texts):
    spans = secrets.base_spans(docs.select("doc_id", "text"))
    rows = found(spans.select("doc_id", secrets.joined("base").alias("s")))
    forms = (
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
        ("access", "(AKIA[A-Z0-9]+)", 16),
        ("hex", "([0-9a-f]+)", 32),
    )
    for i, t in enumerate(texts):
        want = sorted(
            (m.start(), k, m.end(), name)
            for k, (name, pattern, least) in enumerate(forms)
            for m in re.finditer(pattern, t or "")
            if len(m[1]) >= least
        )
        assert rows[i].s == ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in want)
    model = secrets.fit(spans)
    key = "q9Xz7Lp2Vw8Rk4Tn6Yb1Hc3Jd5Fg0"
    more = spark.createDataFrame([(1, f"see {key} now")], "doc_id long, text string")
    out = secrets.scanned(secrets.base_spans(more), model).select(secrets.joined("spans").alias("s")).first()
    assert out.s == f"markov:4:{4 + len(key)}"


def test_copies_of_a_text_do_not_fill_the_secret_samples(spark):
    rng = random.Random(15)

    def drawn(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))

    rows = [(i, f"line {i} token = {drawn(24)} end") for i in range(60)]
    rows += [(100 + i, f"def some_ordinary_function_{i} calls another_ordinary_function") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hot = docs.where("doc_id < 60").orderBy(F.xxhash64("text")).first().text
    more = docs.unionByName(spark.createDataFrame([(1000 + i, hot) for i in range(300)], docs.schema))
    plain, copied = (secrets.base_spans(x) for x in (docs, more))
    values = [r.sample for r in secrets.samples(copied, 20)[0].collect()]
    assert len(values) == len(set(values)) == 20
    one, two = secrets.fit(plain, 20), secrets.fit(copied, 20)
    assert one["table"] == two["table"] and abs(one["threshold"] - two["threshold"]) < 1e-9
    # The threshold is that of all texts, not of the 20: 60 values, and two runs in each of 60 texts.
    assert secrets.run_counts(plain) == secrets.run_counts(copied) == {True: 60, False: 120}
    assert abs(one["threshold"] - math.log2(2 * 0.9 / 0.1)) < 1e-9


def test_keys_without_a_label_are_told_from_words(spark):
    rng = random.Random(21)
    mixed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def drawn(n, chars=mixed):
        return "".join(rng.choice(chars) for _ in range(n))

    parts = ["con", "tri", "ver", "sal", "men", "ting", "able", "ness", "in", "for", "mation", "under", "stand"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(2, 5)))
    prose = lambda: " ".join(word() for _ in range(60))
    rows = [(i, f"{prose()} token = {drawn(24, rng.choice([mixed, '0123456789abcdef']))} end") for i in range(150)]
    rows += [(1000 + i, prose()) for i in range(150)]
    model = secrets.fit(secrets.base_spans(spark.createDataFrame(rows, "doc_id long, text string")))
    plants, texts = {}, []
    for i in range(200):
        left, key = prose(), drawn((12, 16, 20, 32)[i % 4], (mixed, "0123456789abcdef")[i // 4 % 2])
        texts.append((i, f"{left} {key} {prose()}"))
        plants[i] = f"markov:{len(left) + 1}:{len(left) + 1 + len(key)}"
    texts += [(500 + i, prose()) for i in range(200)] + [(900, None), (901, ""), (902, "-" * 40 + " " + "=" * 30)]
    new = secrets.base_spans(spark.createDataFrame(texts, "doc_id long, text string"))
    out = found(secrets.scanned(new, model).select("doc_id", F.size("base").alias("n"), secrets.joined("spans").alias("s")))
    bare = [i for i in plants if out[i].n == 0]
    assert len(bare) >= 150
    for length in (12, 16, 20):
        caught = [out[i].s == plants[i] for i in bare if len(texts[i][1].split()[60]) == length]
        assert np.mean(caught) >= 0.9
    assert all(out[i].s == "" for i in (*range(500, 700), 900, 901, 902))


def test_unigram_base_and_model(docs, texts):
    all_ = texts + [texts[3]]
    token = lambda t: (t or "").encode().lower().split() + [None]
    c = collections.Counter(w for t in all_ for w in token(t))
    n, v = sum(c.values()), len(c)
    fitted = brown.fit(docs.select("text"), clustered=50)
    rows = found(brown.scored(docs.select("doc_id", "text"), fitted))
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(token(t)), len(token(t)), n)
        want = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in token(t))
        assert r.base_score == pytest.approx(want)
        assert r.score < 0


def test_exchange_finds_alternating_classes():
    m = np.zeros((9, 9))
    m[:4, 4:8] = 50
    m[4:8, :4] = 50
    of = brown.exchange(m, 8, classes=2)
    assert len(set(of[:4])) == 1 and len(set(of[4:8])) == 1 and of[0] != of[4]


def alternating(rng, first, second, length):
    return " ".join(rng.choice((first, second)[i % 2]) for i in range(length))


def test_words_beyond_the_core_are_classed_by_their_neighbours(spark):
    rng = random.Random(2)
    first, second = [f"a{i}" for i in range(10)], [f"b{i}" for i in range(10)]
    texts = [alternating(rng, first, second, 200) for _ in range(20)]
    rare = {w: f"{rng.choice(second)} {w} {rng.choice(second)}" for w in ("xone", "ytwo", "zthree", "ufour")}
    rows = [(t,) for t in [*texts, *list(rare.values()) * 4, "b1 once b2"]]
    fitted = brown.fit(spark.createDataFrame(rows, "text string"), clustered=20)
    codes = brown.WordCodes()
    kinds = {r.code: r.kind for r in fitted["words"].collect()}
    got = {kinds[int(np.uint64(codes[w.encode()]).view(np.int64))] for w in rare}
    held = dict(zip(fitted["model"]["held"].tolist(), fitted["model"]["held_kind"].tolist()))
    assert got <= {held[codes[w.encode()]] for w in first}
    assert int(np.uint64(codes[b"once"]).view(np.int64)) not in kinds
    assert held[codes[b"once"]] >= brown.CLASSES


@pytest.mark.parametrize("held", [50, 120])
def test_joined_classes_score_as_held_ones(spark, docs, monkeypatch, held):
    want = found(brown.scored(docs.select("doc_id", "text"), brown.fit(docs.select("text"), clustered=50)))
    monkeypatch.setattr(brown, "HELD_WORDS", held)
    rows = found(brown.scored(docs.select("doc_id", "text"), brown.fit(docs.select("text"), clustered=50)))
    assert rows.keys() == want.keys()
    for key, r in rows.items():
        assert (r.n_tokens, r.n_known) == (want[key].n_tokens, want[key].n_known)
        assert (r.base_score, r.score) == (pytest.approx(want[key].base_score), pytest.approx(want[key].score))


def test_lacking_classes_are_gathered_by_word_not_joined_per_pair(spark):
    """Pairs that lack one class or both, one word in a third of them, against a plain look-up."""
    rng = random.Random(6)
    words = {c * 32 + c % 32: c % brown.CLASSES for c in range(20)}
    code = lambda: rng.choice([0, rng.randrange(30) * 33, rng.randrange(30) * 33])
    side = lambda: rng.choice([(0, 5), (0, brown.END_CLASS), (code(), -1)])
    pairs = [p for p in ((*side(), *side()) for _ in range(3_000)) if -1 in (p[1], p[3])]
    want = collections.Counter()
    for a, ka, b, kb in pairs:
        kinds = [k if k >= 0 else words.get(c, brown.CLASSES + c % brown.ENDINGS) for c, k in ((a, ka), (b, kb))]
        want[tuple(kinds)] += 1
    table = spark.createDataFrame([(c, 3, k) for c, k in words.items()], "code long, n long, kind int")
    got = brown.classed(spark.createDataFrame(pairs, "a long, ka short, b long, kb short"), table)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    sums = got.groupBy("ka", "kb").agg(F.sum("times").alias("n")).collect()
    assert {(r.ka, r.kb): r.n for r in sums} == dict(want)


def test_one_look_up_serves_transitions_and_scores(spark, docs, monkeypatch):
    monkeypatch.setattr(brown, "HELD_WORDS", 60)
    rows = docs.select("doc_id", "text", (F.col("doc_id") % 5 == 1).alias("held_out"))
    fitted = brown.fit(rows.where("not held_out").select("text"), clustered=50)
    want = found(brown.scored(rows, fitted))
    made, looked_up = [], brown.looked_up
    monkeypatch.setattr(brown, "looked_up", lambda *args: made.append(looked_up(*args)) or made[-1])
    got = found(brown.fitted_scores(rows, "held_out", clustered=50))
    for key, r in got.items():
        assert r[:-1] == want[key][:-1] and r.score == pytest.approx(want[key].score)
    (texts,) = made
    # Transitions by a plain walk over the words of the training texts.
    m = fitted["model"]
    kinds = {r.code: r.kind for r in fitted["words"].collect()}
    kinds |= dict(zip(m["held"].view(np.int64).tolist(), m["held_kind"].tolist()))
    codes, steps = brown.WordCodes(), collections.Counter()
    for r in rows.where("not held_out").collect():
        before = brown.END_CLASS
        for word in (r.text or "").encode().lower().split():
            code = int(np.uint64(codes[word]).view(np.int64))
            kind = kinds.get(code, brown.CLASSES + code % brown.ENDINGS)
            steps[before * brown.ALL_CLASSES + kind] += 1
            before = kind
        steps[before * brown.ALL_CLASSES + brown.END_CLASS] += 1
    cells = collections.Counter(c for r in texts.where("not held_out").collect() for c in r._cells)
    assert cells == steps


def test_passages_with_substitutions_are_found(spark, docs):
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(40)]
    changed = list(words)
    for k in (6, 17, 30):
        changed[k] = "other"
    items = spark.createDataFrame([(0, " ".join(words)), (1, None), (2, "too short")], "item_id long, text string")
    more = spark.createDataFrame([(900, "start " + ", ".join(changed) + " end", None, None, 0)], SCHEMA)
    rows = decontamination.contaminated(docs.unionByName(more), items).collect()
    assert [(r.doc_id, r.item_id, r.doc_word) for r in rows] == [(900, 0, 1)]


def test_masks_meet_every_overlap_that_verifies():
    for n in range(1, decontamination.WINDOW + 1):
        masks = decontamination.SHORT.get(n, decontamination.MASKS)
        fits = [sum(1 << (at + i) for i, b in enumerate(m) if b == "1") for m in masks for at in range(n - len(m) + 1)]
        for out in itertools.combinations(range(n), n - math.ceil(n * decontamination.AGREE)):
            gone = sum(1 << i for i in out)
            assert any(not fit & gone for fit in fits), (n, out)


@pytest.mark.parametrize("held", [0, 1_000_000])
def test_items_of_every_length_are_found_with_substitutions(spark, monkeypatch, held):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", held)
    rng, items, rows = random.Random(12), [], []
    for n in range(1, 26):
        for _ in range(3):
            item = [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
            changed, width = list(item), min(n, 20)
            for k in rng.sample(range(width), width - math.ceil(width * decontamination.AGREE)):
                changed[k] = "other"
            rows.append((len(items), " ".join(["start", "of", *changed, "end"]), None, None, 0))
            items.append((len(items), " ".join(item)))
    rows.append((None, items[-1][1], None, None, 0))
    items = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.contaminated(spark.createDataFrame(rows, SCHEMA), items).collect()
    last = len(rows) - 2
    assert {(r.doc_id, r.item_id) for r in out} == {(i, i) for i in range(last + 1)} | {(None, last)}


@pytest.mark.parametrize("held", [0, 1_000_000])
def test_passages_over_both_ends_and_repeated_ids_equal_all_shifts(spark, monkeypatch, held):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", held)
    rng = random.Random(21)

    def prose(n):
        return [rng.choice("abcdefgh") for _ in range(n)]

    items = [(1, prose(30)), (1, prose(9)), (2, prose(25)), (2, prose(60)), (3, prose(4)), (4, ["ab"] * 22)]
    docs = [(i, prose(rng.randint(1, 40))) for i in range(10)]
    for k, (_, item) in enumerate(items):
        docs.append((20 + k, item[3:] + prose(5)))
        docs.append((40 + k, prose(5) + item[:-2]))
        docs.append((60 + k, item + prose(7) + item))
        docs.append((60 + k, prose(3) + item))
        docs.append((80 + k, item[-18:] + item[:18]))
    docs.append((None, items[0][1]))
    want = {}
    for doc_id, words in docs:
        for item_id, item in items:
            compared = min(len(item), decontamination.WINDOW)
            for shift in range(-len(item), len(words)):
                same = [0 <= j + shift < len(words) and words[j + shift] == w for j, w in enumerate(item)]
                agreeing = max(sum(same[j : j + compared]) for j in range(len(item) - compared + 1))
                if agreeing >= decontamination.AGREE * compared:
                    rank = (agreeing, -shift, compared)
                    want[doc_id, item_id] = max(want.get((doc_id, item_id), rank), rank)
    assert len(want) > 20 and min(-r[1] for r in want.values()) < 0
    text = lambda rows: [(i, " ".join(w)) for i, w in rows]
    out = decontamination.contaminated(
        spark.createDataFrame(text(docs), "doc_id long, text string"),
        spark.createDataFrame(text(items), "item_id long, text string"),
    )
    assert dict(out.dtypes) == {"doc_id": "bigint", "item_id": "bigint", "agreeing": "int", "compared": "int", "doc_word": "int"}
    rows = out.collect()
    assert {(r.doc_id, r.item_id): (r.agreeing, -r.doc_word, r.compared) for r in rows} == want
    assert len(rows) == len(want)


def test_hits_leave_their_documents_behind(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    out = decontamination.contaminated(docs, docs.withColumnRenamed("doc_id", "item_id"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    compares = [line for line in plan.splitlines() if "aggregate(" in line]
    assert compares and not any("words#" in line for line in compares)
    assert not re.search(r"Filter .*split\(", plan)  # words are made once a row
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_recurring_lines_go_but_the_first(docs, texts):
    rows = found(lines.without_recurring(docs))
    first = min(i for i, t in enumerate(texts) if t and t.startswith("header line"))
    assert rows[first].text == texts[first]
    for i in range(first + 1, first + 7):
        assert rows[i].text == texts[i].split("\n")[1] and rows[i].n_dropped == 2
    assert rows[0].text == texts[0] and rows[4].text is None


@pytest.mark.parametrize("n", [100, 1_000, 5_000])
def test_templates_with_names_recur_at_every_size(spark, n):
    rng = random.Random(6)

    def name():
        return "".join(rng.choice("abcdefgh") for _ in range(8))

    people, parts = [name() for _ in range(50)], [name() for _ in range(50)]
    rows = [
        (i, f"own {name()}\nThis article was posted by {rng.choice(people)} in section {rng.choice(parts)} on {i}", None, None, 0)
        for i in range(n)
    ]
    rows += [(n + i, f"own {name()}\nThis article was sent to us by {name()} with kind regards", None, None, 0) for i in range(6)]
    out = found(lines.without_recurring(spark.createDataFrame(rows, SCHEMA)))
    assert [i for i in range(n) if not out[i].n_dropped] == [0]
    assert [i for i in range(n, n + 6) if not out[i].n_dropped] == [n]
    assert all(out[i].text.startswith("own ") for i in out)


def test_long_lines_recur_from_two_texts_and_short_ones_with_digits(spark):
    rng = random.Random(8)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))

    passage, own, rare = prose(60), [prose(12) for _ in range(6)], prose(10)
    rows = []
    for i, t in enumerate(own):
        some = ([passage] if i in (1, 4) else []) + ([rare] if i < 4 else [])
        rows.append((i, "\n".join([t, f"Page {i} of 10", "Share this", "Home", f"{i} 17 4", *some]), None, None, 0))
    out = found(lines.without_recurring(spark.createDataFrame(rows, SCHEMA)))
    for i, t in enumerate(own):
        left = [f"Page {i} of 10", "Share this", "Home"] if i == 0 else []
        left += [f"{i} 17 4"] + ([passage] if i == 1 else []) + ([rare] if i < 4 else [])
        assert out[i].text == "\n".join([t, *left])


def test_lines_that_cannot_recur_are_not_shuffled(spark, docs, monkeypatch):
    plans = {}

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, label)

    want = found(lines.without_recurring(docs))
    monkeypatch.setattr(lines, "written", seen)
    for bits in (6, 25):  # with 64 places many lines pass by chance
        monkeypatch.setattr(lines, "LEAF_BITS", bits)
        assert found(lines.without_recurring(docs)) == want
        assert "hashpartitioning" not in plans["lines"] and "Join" not in plans["lines"]


def test_words_of_a_line_as_by_pattern():
    rng = random.Random(12)
    space = " \t\r\x0b\f"
    for _ in range(2_000):
        line = "".join(rng.choice(space + "ab1<*>é\u00a0\u2028\x1c٣") for _ in range(rng.randrange(14)))
        words = [w for w in re.split(f"[{space}]+", line) if w]
        words = ["<*>" if re.search("[0-9]", w) else w for w in words]
        plain = any(not re.search("[0-9]", w) for w in re.split(f"[{space}]+", line) if w)
        got = lines._words(line.encode())
        assert got == ([w.encode() for w in words] if plain else None)


def test_toxicity_learns_words_and_empty_texts_score_zero(spark):
    rng = random.Random(1)
    clean = [" ".join(f"a{rng.randint(0, 80)}" for _ in range(40)) for _ in range(120)]
    toxic = [c.replace(" ", " vileword ", 2) for c in clean[:50]]
    rows = [(i, t) for i, t in enumerate(clean[50:] + toxic + [None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.where("doc_id < 120").select("doc_id", (F.col("doc_id") >= 70).cast("int").alias("toxic"))
    out = found(toxicity.score(docs, toxicity.fit(docs, labels)))
    assert np.mean([out[i].predicted == (i >= 70) for i in range(120)]) > 0.97
    assert out[120].score == out[121].score == 0
    assert toxicity.fit(docs, labels.limit(0)) is None


def test_toxicity_training_holds_no_lists_of_words(monkeypatch):
    """Windows are read once, and inputs of words are made in blocks, whatever their number."""
    rng = random.Random(5)
    windows = [[b"w%d" % rng.randrange(20_000) for _ in range(24)] for _ in range(600)]
    y = np.arange(600) % 2
    seen, embed = [], toxicity.Network.embed
    monkeypatch.setattr(toxicity.Network, "embed", lambda net, words: seen.append(len(words)) or embed(net, words))
    one, other = toxicity.Network(), toxicity.Network()
    assert np.array_equal(one.train(iter(windows), np.arange(600), y, steps=4), other.train(windows, np.arange(600), y, steps=4))
    assert len({w for x in windows for w in x}) > toxicity.WORDS_AT_ONCE >= max(seen)


def test_toxicity_threshold_covers_all_windows_of_long_texts(spark):
    rng = random.Random(3)
    clean = [[f"a{rng.randint(0, 3000)}" for _ in range(2_400)] for _ in range(40)]
    short = [[f"a{rng.randint(0, 3000)}" for _ in range(40)] for _ in range(40)]
    for k, words in enumerate([*clean[:20], *short[:20]]):
        words[len(words) // 2 + k : len(words) // 2 + k] = ["vileword"] * 3
    rows = [(i, " ".join(w)) for i, w in enumerate(clean + short)] + [(80, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 40 < 20).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels)
    rows = sorted((r.toxic, list(r.windows), r.half) for r in toxicity.sampled(docs, labels))
    judges = [toxicity.trained([r for r in rows if r[2] != k]) for k in (0, 1)]
    # Each text's best window by the network of the other half, from the windows one by one.
    halves = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.half().alias("h")).collect()}
    want = collections.Counter()
    for i, text in rows_of(docs):
        words = toxicity.lower_words((text or "").encode())
        if words:
            net = judges[halves[i]]
            proj = net.project(words)
            ids = [np.arange(a, min(a + toxicity.WINDOW, len(words))) for a in toxicity.spans(len(words))]
            best = max(float(net.score_ids(np.array([x]), proj)[0]) for x in ids)
            want[(i % 40 < 20, round(best, 1))] += 1
    top, bad, good = toxicity.best_counts(docs, labels, judges)
    assert bad.sum() == good.sum() == 40
    have = sorted(v for t, n in zip(top, bad) for v in [t] * n), sorted(v for t, n in zip(top, good) for v in [t] * n)
    for kind, values in zip((True, False), have):
        plain = sorted(v for (k, v), n in want.items() if k == kind for _ in range(n))
        assert np.allclose(values, plain, atol=0.06)
    assert np.allclose(model.scale, toxicity.calibrated(top, bad, good, highest=model.own))


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_rows_with_a_key_always_pass_the_bit_map(spark):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    keys = docs.where("doc_id % 7 = 0").select(F.col("doc_id").cast("int").alias("doc_id"))
    for bits in (6, 8, 20):
        left = {r.doc_id for r in toxicity.perhaps_in(docs, keys, bits).collect()}
        assert left >= set(range(0, 2_000, 7))
    assert len(left) < 320
    assert toxicity.perhaps_in(docs, keys.limit(0)).isEmpty()


def test_toxicity_threshold_by_share_of_false_alarms():
    rng = np.random.default_rng(4)
    for size, alarms in ((40, 0.015), (400, 0.015), (400, 0.1), (3, 0.5)):
        logits = np.concatenate([rng.normal(2, 2, size), rng.normal(-2, 2, size)]).round(1)
        toxic = np.arange(2 * size) < size
        top = np.unique(logits)
        bad, good = (np.array([((logits == t) & (toxic == kind)).sum() for t in top]) for kind in (True, False))
        a, b = toxicity.calibrated(top, bad, good, alarms=alarms)
        hit = a * logits + b >= np.log(0.3 / 0.7)
        assert hit[~toxic].mean() <= alarms and a > 0
        best = max(hits.mean() for c in [*top, top[-1] + 1] if (hits := logits[toxic] >= c) is not None
                   and (logits[~toxic] >= c).mean() <= alarms)
        assert hit[toxic].mean() == best


def test_toxicity_and_quality_ignore_held_out_labels(spark):
    """The queries learn from rows they are given: other labels of the held-out rows change no score."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"a{rng.randint(0, 60)}" for _ in range(60)) + (" vileword" * 3 if i % 3 == 0 else "")) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = remainder("doc_id", 4) == 2
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.fit(docs, x.where(~held)) for x in (labels, turned))
    assert one.scale == two.scale and all((one.p[k] == two.p[k]).all() for k in one.p)


def test_language_by_nearest_centroid(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        sounds = ["sch", "ung", "ich"] if i % 2 else ["tion", "the", "ing"]
        rows.append((i, " ".join("".join(rng.choice(sounds) for _ in range(3)) for _ in range(20)), "de" if i % 2 else "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id < 80"))
    odd = spark.createDataFrame([(500, None, None), (501, "123 !", None)], docs.schema)
    out = found(langid.predict(docs.unionByName(odd), model))
    assert np.mean([out[i].lang_pred == rows[i][2] for i in range(80, 120)]) > 0.95
    assert out[500].lang_pred == out[501].lang_pred == "und"


def test_copies_of_a_text_do_not_fill_a_language(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20)), "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hot = docs.orderBy(F.xxhash64("text")).first().text
    more = docs.unionByName(spark.createDataFrame([(100 + i, hot, "en") for i in range(60)], docs.schema))
    model = langid.fit(more, rows_per_lang=20, centroids=4)
    assert len({tuple(c) for c in model["centres"].round(5).tolist()}) == 4


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    plain = empty.select("doc_id", "text")
    assert jaccard.near_duplicates(empty).count() == 0
    assert repeats.removed(plain).count() == 0
    assert lines.without_recurring(empty).count() == 0
    assert decontamination.contaminated(empty, items).count() == 0
    stats = quality.statistics(plain)
    assert quality.judged(stats, quality.fit(stats, labels)).count() == 0
    assert toxicity.score(plain, toxicity.fit(plain, labels)).count() == 0
    assert langid.predict(plain, langid.fit(empty)).count() == 0
    spans = secrets.base_spans(plain)
    assert secrets.scanned(spans, secrets.fit(spans)).count() == 0
    assert brown.scored(plain, brown.fit(plain.select("text"))).count() == 0


def test_sets_are_signed_where_they_are_described(spark, docs):
    got = set()
    for r in jaccard.described(docs, 85, 4).collect():
        got |= {(sig, r.cls, r.band + k) for k, sigs in enumerate(r.sigs) for sig in sigs}
    assert got == {tuple(r) for r in jaccard.signed(docs, 85, 4, 0, 1, 1).collect()} != set()
