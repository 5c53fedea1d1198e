"""Personal data, the Merkle manifest and phrase mining against plain versions of themselves."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from tonelake.llm import collocations, manifest, pii, queries, statements
from tonelake.llm.common import Codes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF_DIR = "/root/testdata/sf0.001"


# --- personal data ---

FORMS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def digits(text):
    return re.sub("[^0-9]", "", text)


def plain_luhn(number):
    table = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(int(d) if i % 2 == 0 else table[int(d)] for i, d in enumerate(number[::-1])) % 10 == 0


RULES = (
    lambda m: True,
    lambda m: all(int(x) <= 255 for x in m.split(".")),
    lambda m: 12 <= len(digits(m)) <= 19 and plain_luhn(digits(m)),
    lambda m: 9 <= len(digits(m)) <= 15,
)


def plain_base(text):
    hits = [(m.start(), k, m.end()) for k, form in enumerate(FORMS) for m in form.finditer(text) if RULES[k](m.group())]
    return sorted(hits)


def base_of(text):
    return [(s.start, pii.KINDS.index(s.kind), s.end) for s in pii.spans_of(text) if s.base]


@pytest.mark.parametrize("alphabet", ["ab@.@.-_%+ 012345 ()+-..A5é \n", "0123456789.  -+", "45 -", "+1 (2)3.4-"])
def test_base_forms_on_random_texts(alphabet):
    rng = random.Random(alphabet)
    for _ in range(6_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 70)))
        assert base_of(text) == plain_base(text), text


def added(text):
    return [(s.kind, text[s.start : s.end]) for s in pii.spans_of(text) if not s.base]


def test_checksums_and_context_admit_further_spans():
    assert added("pay to DE89 3704 0044 0532 0130 00 SOON") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert added("pay to DE88 3704 0044 0532 0130 00 SOON") == []  # its check digits do not hold
    assert added("SSN 536-90-4399 on file") == [("ssn", "536-90-4399")]
    assert added("part 536-90-4399 on file") == []  # nothing speaks for it
    assert added("SSN 666-90-4399 on file") == []
    assert added("call me: (206) 555-0142 today") == [("phone", "(206) 555-0142")]
    assert added("invoice (206) 555-0142 today") == []
    assert added("invoice phone (206) 555-0142") == []  # for and against
    assert added("17 4556 7375 8689 9855 9") == [("card", "4556 7375 8689 9855")]
    assert added("17 4556 7375 8689 9856 9") == []


def test_an_added_span_touches_no_other():
    text = "tel +1 206 555 0142, card 4556 7375 8689 9855 4556737586899855 phone 030 1234567"
    spans = pii.spans_of(text)
    assert [s.kind for s in spans] == ["phone", "card", "card", "phone"]
    for one, other in zip(spans, spans[1:]):
        assert one.end <= other.start


def test_long_runs_take_no_longer_than_their_length():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1 " * 100_000, "+1" * 100_000, "1." * 150_000, "AA11 " * 50_000):
        assert pii.spans_of(text) is not None


def test_report_and_mask(spark):
    rows = [
        (1, "é mail bo@ex.org or 10.0.0.256, 10.0.0.25"),
        (1, "é mail bo@ex.org or 10.0.0.256, 10.0.0.25"),
        (2, None),
        (3, ""),
        (None, "+49 30 1234567 +49 30 1234567"),
        (4, "x " * 200_000 + "a.b@c.de"),
    ]
    docs = spark.createDataFrame([(*r, [7]) for r in rows], "doc_id long, text string, spans array<int>").repartition(2)
    got = {(r.doc_id, r.spans): r for r in pii.report(docs).collect()}
    assert pii.report(docs).count() == len(rows)
    one = got[1, "email:7:16,ip:32:41"]
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 0, 0)
    assert one.base_sha256 == hashlib.sha256(b"email:7:16,ip:32:41").hexdigest()
    assert got[2, ""].base_sha256 == got[3, ""].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert (None, "phone:0:14,phone:15:29") in got and (4, "email:400000:408") not in got
    assert (4, "email:400000:400008") in got
    clear = {r.doc_id: r.text for r in pii.masked(pii.found(docs)).collect()}
    assert clear[1] == "é mail [email] or 10.0.0.256, [ip]" and clear[2] is None and clear[3] == ""
    assert clear[None] == "[phone] [phone]" and clear[4].endswith("x [email]")
    assert pii.report(docs.limit(0)).collect() == []


def test_query_equals_its_contract_on_the_table(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op11_private_spans"](spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    for r in rows:
        want = plain_base(r.text or "")
        counts = collections.Counter(k for _, k, _ in want)
        text = ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in want)
        mine = got[r.doc_id]
        assert [mine[f"n_{k}"] for k in pii.BASE] == [counts[k] for k in range(4)]
        assert mine.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(mine.spans.split(","))


# --- manifest ---


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(doc_id, text, lang, source, n_chars):
    return h(*map(field, (doc_id, source, lang, n_chars, text)))


def climbed(nodes, fanout):
    """The root of a list of nodes, and for each the pairs (left, right) on its way up."""
    at, ways, level = list(range(len(nodes))), [[] for _ in nodes], list(nodes)
    while len(level) > 1:
        for i, p in enumerate(at):
            low = p // fanout * fanout
            ways[i].append(("".join(level[low:p]), "".join(level[p + 1 : low + fanout])))
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        at = [p // fanout for p in at]
    return level[0], ways


def plain_manifest(rows, fanout):
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        trees[x].sort(key=lambda t: t[:3])
    below = [climbed([t[2] for t in trees[x]], fanout) for x in langs]
    root, tops = climbed([b[0] for b in below], fanout) if langs else ("", [])
    out = []
    for x, (sub, ways), top in zip(langs, below, tops):
        for (_, _, leaf, r), way in zip(trees[x], ways):
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                node = leaf_of(*r[:4], r[4] + 1)
            for left, right in way + top:
                node = h(left, node, right)
            proof = h(*(s for pair in way + top for s in pair))
            out.append((r[0], leaf, sub, root, proof, node, node == root))
    return sorted(map(repr, out))


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def signed(docs, **kw):
    return sorted(repr(tuple(r)) for r in manifest.document_manifest(docs, **kw).select(*NAMES).collect())


def many_rows():
    rng = random.Random(9)
    rows = [(i, f"text {i}", rng.choice(["en", "en", "en", "de", None, ""]), None if i % 5 else "s", i) for i in range(150)]
    rows += [(3, "text 3", "en", None, 3)] * 3  # one row four times
    rows += [(None, None, "en", None, None), (None, "é" * 9, None, "", 9), (7, "", "zu", "s", None), (900, None, "é", "s", 0)]
    return rows


@pytest.mark.parametrize("fanout,block", [(2, 1024), (2, 4), (3, 10), (5, 2)])
def test_manifest_equals_a_plain_tree(spark, fanout, block):
    rows = many_rows()
    extra = [(*r, "a", 5, 1) for r in rows]
    docs = spark.createDataFrame(extra, SCHEMA + ", tree string, pos int, node int").repartition(5)
    assert signed(docs, fanout=fanout, block=block) == plain_manifest(rows, fanout)


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_manifest_of_few_rows(spark, n):
    rows = many_rows()[:n]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert signed(docs) == plain_manifest(rows, 2)


def test_only_tampered_rows_fail(spark):
    docs = spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(60)], SCHEMA)
    for r in manifest.document_manifest(docs).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)


# --- phrases ---


def by_statement(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    return con.execute(statements.PHRASES).fetchall()


def phrase_rows():
    rng = random.Random(2)
    vocab = ["new", "york", "City", "of", "the", "a", "é", "État", "x\xa0y", "--", "'s"]
    seps = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!", "\x0b", "\r\n", " ; "]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(vocab) + rng.choice(seps) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["en", "fr", None, "und"]), "s", 0))
    rows += [(500 + i, "one fixed passage, with a piece in it that is copied many times over", "en", "s", 0) for i in range(40)]
    rows += [(600, None, "en", "s", 0), (601, "", None, "s", 0), (602, "...", "en", "s", 0), (603, "a" * 5000, "fr", "s", 0)]
    rows += [(604, "same same " * 8_000, "de", "s", 0), rows[3]]
    return rows


def test_phrases_equal_their_definition(spark):
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", rank int").repartition(4)
    got = sorted(map(tuple, collocations.collocations(docs).collect()))
    assert got == sorted(by_statement(rows)) and len(got) > 20
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_longer_phrases_equal_plain_counts(spark):
    """Four words: two rounds of pruning, and sub-phrases of two and three words."""
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.lang, r.phrase): r.n for r in collocations.frequent_phrases(docs, 4, 6).where("words > 0").collect()}
    want = collections.Counter()
    for _, text, lang, _, _ in rows:
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, 5):
                want.update((lang or "und", " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    assert got == {k: n for k, n in want.items() if n >= 6}


def test_every_phrase_is_owned_once():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghijklmnop.") for _ in range(n)).encode() for n in (0, 1, 2, 3, 500, 4_000)]
    for overlap in (1, 2, 3):
        owned, n = collections.Counter(), 0
        for chunk, closed in collocations.chunks(texts, Codes(), overlap):
            words = chunk.split()
            n += 1
            for i in range(len(words) if closed else len(words) - overlap):
                owned[b" ".join(words[i : i + overlap + 1])] += 1
        want = collections.Counter()
        for t in texts:
            words = re.sub(rb"\.( \.)+", b".", t).split()
            words = words[words[:1] == [b"."] :]
            for i in range(len(words)):
                want[b" ".join(words[i : i + overlap + 1])] += 1
        assert owned == want and n > 50


def test_equal_passages_share_chunks():
    rng = random.Random(3)
    passage = " ".join(f"w{rng.randint(0, 400)}" for _ in range(2_000))
    one = dict(collocations.chunks([("before it " + passage).encode()], Codes(), 2))
    two = dict(collocations.chunks([(passage + " and after").encode()], Codes(), 2))
    assert len(one.keys() & two.keys()) >= len(one) - 3


def test_scores_stay_exact_beyond_64_bits(spark):
    cases = [(3_000_000_017, 4_000_000_037, 5_000_000_029), (10**15 - 1, 10**15 - 1, 10**15 - 1), (10, 10**15 - 1, 11)]
    rows = spark.createDataFrame(cases, "a long, l long, r long").selectExpr("a", "l", "r", f"{collocations.SCORE} as score")
    for a, l, r, score in rows.collect():
        assert score == 1_000_000 * a * a // (l * r)
