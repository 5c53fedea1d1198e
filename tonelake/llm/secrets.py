"""Secrets by fixed forms and by character Markov models; DataFrame functions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.llm.scratch import written

#: Forms of secrets: name, pattern of the whole span, least length of what counts in it, and a
#: pattern that every text with such a span contains.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
VALUE = "[A-Za-z0-9+/_.=-]"
FORMS = (
    ("assign", ASSIGN + VALUE + "+", ASSIGN + VALUE + "{8}"),
    ("access", "AKIA[A-Z0-9]{12,}", "AKIA[A-Z0-9]{12}"),
    ("hex", "[0-9a-f]{32,}", "[0-9a-f]{32}"),
)
MARKOV = "markov"
#: Characters of the models, and the runs of them that are judged.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 12
RUN = "[A-Za-z0-9+/_=-]{%d,}" % LEAST
NAME = "[A-Za-z0-9+/_=-]{8,}"
#: How sure the models must be that a run is random.
SURE = 0.9
#: Fit bounds: different texts whose samples train each model, those with the lowest hash.
FIT_TEXTS = 4_000


def _pieces(text: Column, pattern: str) -> Column:
    """(start, end) of each match, in code points, from what lies between the matches."""
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(text, pattern, -1)

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["between"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,hit:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    pairs = F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda b, h: F.struct(b.alias("between"), h.alias("hit")))
    return F.aggregate(pairs, start, step, lambda s: s["spans"])


def _kind(text: Column, order: int, name: str, pattern: str, holds: str) -> Column:
    """Spans of one form as (start, k, end, kind, hit); an empty array where there are none.

    An assignment is matched greedily first and dropped afterwards if its value is short, so a
    short one still uses up its characters.
    """
    spans = _pieces(text, pattern)
    if name == "assign":
        spans = F.filter(spans, lambda s: F.length(F.regexp_replace(s["hit"], "^" + ASSIGN, "")) >= 8)
    whole = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(order).alias("k"),
            s["end"].alias("end"),
            F.lit(name).alias("kind"),
            s["hit"].alias("hit"),
        ),
    )
    return F.when(text.rlike(holds), whole)


_SPANS = "array<struct<start:int,k:int,end:int,kind:string,hit:string>>"


def base_spans(docs: DataFrame) -> DataFrame:
    """Every row with `base`: the spans of all forms, in order of start, then of FORMS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.from_json(F.lit("[]"), _SPANS)
    found = [F.coalesce(_kind(text, k, *form), none) for k, form in enumerate(FORMS)]
    return docs.withColumn("base", F.array_sort(F.concat(*found)))


def _pair_counts(samples: DataFrame) -> dict[tuple[str, str], int]:
    """How often each two characters of ALPHABET follow each other: at most the alphabet squared."""
    s = F.col("sample")
    at = samples.where(F.length(s) >= 2).select(s, F.explode(F.sequence(F.lit(1), F.length(s) - 1)).alias("i"))
    pairs = at.select(F.substring(s, F.col("i"), F.lit(2)).alias("pair"))
    rows = pairs.groupBy("pair").agg(F.count("*").alias("n")).collect()
    return {r.pair: r.n for r in rows if len(r.pair) == 2 and all(c in ALPHABET for c in r.pair)}


def _log_table(counts: dict, even: bool, smooth: float = 0.5, prior: float = 4.0) -> list[float]:
    """Log2 probabilities of each character after each other one.

    What follows a rare character is drawn towards what follows any, weighing `prior` steps, as words
    have few digits anywhere, one step in a hundred towards any character; `even` draws it towards all
    characters alike, as random strings have them.
    """
    any_ = [(0 if even else sum(counts.get(a + b, 0) for a in ALPHABET)) + smooth for b in ALPHABET]
    share = [0.99 * x / sum(any_) + 0.01 / len(ALPHABET) for x in any_]
    table = []
    for a in ALPHABET:
        row = [counts.get(a + b, 0) + prior * p for b, p in zip(ALPHABET, share)]
        total = math.log2(sum(row))
        table += [math.log2(x) - total for x in row]
    return table


def _values(base: Column) -> Column:
    """What counts of each span: the value of an assignment, else all of it."""
    return F.transform(base, lambda s: F.regexp_replace(s["hit"], "^" + ASSIGN, ""))


def samples(spans: DataFrame, texts: int = FIT_TEXTS) -> tuple[DataFrame, DataFrame]:
    """Labelled samples: values of found spans are random strings, the runs of NAME in texts
    without any span are ordinary words and identifiers. Each comes from at most `texts` different texts,
    those with the lowest hash; copies of a text count once."""
    order, holds = F.xxhash64("text"), F.size("base") > 0
    keys = spans.where("text is not null").select(order.alias("h"), holds.alias("holds")).distinct()
    keys = written(keys, "text_hashes")

    def chosen(kind: bool) -> DataFrame:
        last = keys.where(F.col("holds") == kind).orderBy("h").limit(texts).agg(F.max("h")).first()[0]
        # The hash alone comes first, so only rows of these texts are searched for spans again.
        low = spans.where(F.col("text").isNotNull() & (order <= F.lit(last).cast("long")))
        return low.select("text", "base").where(holds == kind).dropDuplicates(["text"])

    random = chosen(True).select(F.explode(_values(F.col("base"))).alias("sample"))
    names = F.explode(F.regexp_extract_all("text", F.lit(f"({NAME})"), F.lit(1)))
    return random, chosen(False).select(names.alias("sample"))


def ratio(run: Column, table: list[float]) -> Column:
    """Log2 likelihood ratio of a run, its different steps together: above 0, random strings explain
    it better. A step that comes again says nothing new, so rules of dashes do not add up."""
    # One literal that is read once, in place of thousands of expressions.
    values, chars = F.from_json(F.lit(json.dumps(table)), "array<double>"), F.lit(ALPHABET)

    def at(pair: Column, i: int) -> Column:
        return F.instr(chars, F.substring(pair, i, 1))

    places = F.sequence(F.lit(1), F.length(run) - 1)
    steps = F.array_distinct(F.transform(places, lambda i: F.substring(run, i, F.lit(2))))
    return F.aggregate(
        steps,
        F.lit(0.0),
        lambda s, p: s + F.coalesce(F.get(values, (at(p, 1) - 1) * len(ALPHABET) + at(p, 2) - 1), F.lit(0.0)),
    )


def fit(spans: DataFrame, texts: int = FIT_TEXTS, sure: float = SURE) -> dict:
    """Both models as one table of log ratios, and the threshold that a run's ratio must pass.

    The threshold is what makes a run random with probability `sure`: the odds of an ordinary run against a
    random one before it is read, as both kinds are found in all texts, times the odds of `sure`. As
    the whole run counts, short runs need clearer evidence at each step than long ones. Random
    strings never count as the commoner kind. Without samples of one kind nothing is judged random.
    """
    random, names = samples(spans, texts)
    a, b = _pair_counts(random), _pair_counts(names)
    if not a or not b:
        return {"table": None, "threshold": 0.0}
    table = [x - y for x, y in zip(_log_table(a, even=True), _log_table(b, even=False))]
    found = run_counts(spans)
    prior = math.log2(max(found.get(False, 0), 1) / max(found.get(True, 0), 1))
    return {"table": table, "threshold": max(prior, 0.0) + math.log2(sure / (1 - sure))}


def run_counts(spans: DataFrame) -> dict[bool, int]:
    """How many samples of at least LEAST characters texts with spans and texts without have, each
    different text once."""
    holds = F.size("base") > 0
    values = F.size(F.filter(_values(F.col("base")), lambda v: F.length(v) >= LEAST))
    own = F.when(holds, values).otherwise(F.regexp_count("text", F.lit(RUN)))
    rows = spans.where("text is not null").select(F.xxhash64("text").alias("h"), holds.alias("holds"), own.alias("n"))
    each = rows.where("n > 0").groupBy("h", "holds").agg(F.first("n").alias("n"))
    return {r.holds: r.n for r in each.groupBy("holds").agg(F.sum("n").alias("n")).collect()}


def scanned(docs: DataFrame, model: dict) -> DataFrame:
    """Every row of `base_spans` with `spans`: its base spans and the runs the model calls random.

    A run inside a base span is not named again. Spans are (start, k, end, kind, hit), in code
    points, the end exclusive, in order of start, then of FORMS, then the model's.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    if model["table"] is None:
        return docs.withColumn("spans", F.col("base"))
    runs = _kind(text, len(FORMS), MARKOV, RUN, RUN)
    runs = F.filter(runs, lambda s: ratio(s["hit"], model["table"]) > model["threshold"])
    none = F.from_json(F.lit("[]"), _SPANS)
    added = docs.withColumn("_runs", F.coalesce(runs, none))
    fresh = F.filter(
        "_runs",
        lambda r: ~F.exists("base", lambda b: (b["start"] <= r["start"]) & (r["end"] <= b["end"])),
    )
    return added.withColumn("spans", F.array_sort(F.concat("base", fresh))).drop("_runs")


def joined(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def number(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
