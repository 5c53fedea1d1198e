"""One-to-one matching of annotated and found notes or beats.

Both sides are first counted per distinct time, so what is walked is bounded by the length of a
clip (times are whole ticks), not by how many notes share a key.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions import constants as k
from tonelake.operators.folds import sorted_fold, sorted_groups

ONSET_TOLERANCE = round(k.ONSET_TOLERANCE_S * 10_000)
_SEGMENT = "array<struct<truth_at:bigint,truth_rank:bigint,found_at:bigint,found_rank:bigint,n:bigint>>"


def stretches(points: DataFrame, keys: list[str], time: str, gap: int) -> DataFrame:
    """`points` with stretch, the first time of the chain of times at most `gap` apart it lies in."""
    order = Window.partitionBy(*keys).orderBy(time)
    opens = F.coalesce(F.col(time) - F.lag(time).over(order) > gap, F.lit(True))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = points.withColumn("_opens", F.when(opens, F.col(time)))
    return opened.withColumn("stretch", F.last("_opens", ignorenulls=True).over(so_far)).drop("_opens")


def match_times(
    truth: DataFrame, found: DataFrame, keys: list[str], time: str, tolerance: int
) -> DataFrame:
    """Maximum matching of times at most `tolerance` apart, as runs of matched ranks.

    With one tolerance for all, pairing the earliest open time of one side with the earliest of
    the other is a maximum matching, so one walk in time order is enough. No pair crosses a gap wider
    than the tolerance: stretches between gaps are walked apart from each other, and those with times
    of one side only, or with one time of each, not at all. Each row pairs `n` times
    at `truth_at` from rank `truth_rank` on with as many at `found_at` from `found_rank` on.
    """
    sides = truth.select(*keys, F.col(time).alias("at"), F.lit(1).alias("t"), F.lit(0).alias("f"))
    sides = sides.unionByName(
        found.select(*keys, F.col(time).alias("at"), F.lit(0).alias("t"), F.lit(1).alias("f"))
    )
    counted = sides.groupBy(*keys, "at").agg(F.sum("t").alias("truths"), F.sum("f").alias("founds"))
    at_i, t_i, f_i = len(keys) + 1, len(keys) + 2, len(keys) + 3

    def pair(open_: deque, own: list[int], flip: bool) -> list[dict]:
        made = []
        at, count, rank = own
        while open_ and count:
            waiting = open_[0]
            n = min(count, waiting[1])
            a, b = (waiting[0], waiting[2]), (at, rank)
            left, right = (b, a) if flip else (a, b)
            made.append(
                {"truth_at": left[0], "truth_rank": left[1], "found_at": right[0], "found_rank": right[1], "n": n}
            )
            waiting[1] -= n
            waiting[2] += n
            count -= n
            rank += n
            if not waiting[1]:
                open_.popleft()
        own[1], own[2] = count, rank
        return made

    def step(state, row):
        waiting_truth, waiting_found = state if state is not None else (deque(), deque())
        at = row[at_i]
        for side in (waiting_truth, waiting_found):
            while side and side[0][0] < at - tolerance:
                side.popleft()
        truths, founds = [at, row[t_i], 0], [at, row[f_i], 0]
        made = pair(waiting_found, truths, True)
        if truths[1]:
            waiting_truth.append(truths)
        made += pair(waiting_truth, founds, False)
        if founds[1]:
            waiting_found.append(founds)
        return (waiting_truth, waiting_found), (made,)

    cut = stretches(counted, keys, "at", tolerance)
    whole = Window.partitionBy(*keys, "stretch")
    sized = cut.select(
        "*",
        F.count_if(F.col("truths") > 0).over(whole).alias("_truth_times"),
        F.count_if(F.col("founds") > 0).over(whole).alias("_found_times"),
        F.sum("truths").over(whole).alias("_truths"),
        F.sum("founds").over(whole).alias("_founds"),
    ).where("_truths > 0 and _founds > 0")
    # One time of each side, apart or the same: as many pairs as the scarcer side has.
    plain = (F.col("_truth_times") == 1) & (F.col("_found_times") == 1)
    zero = F.lit(0).cast("bigint")
    direct = (
        sized.where(plain)
        .groupBy(*keys, "stretch")
        .agg(
            F.max(F.when(F.col("truths") > 0, F.col("at"))).alias("truth_at"),
            F.max(F.when(F.col("founds") > 0, F.col("at"))).alias("found_at"),
            F.least(F.max("_truths"), F.max("_founds")).alias("n"),
        )
        .select(*keys, "truth_at", zero.alias("truth_rank"), "found_at", zero.alias("found_rank"), "n")
    )
    names = [*keys, "stretch", "at", "truths", "founds"]
    walked = sorted_fold(sized.where(~plain).select(*names), [*keys, "stretch"], ["at"], step, f"segments {_SEGMENT}")
    return direct.unionByName(walked.select(*keys, F.inline("segments")))


def matched_counts(segments: DataFrame, keys: list[str]) -> DataFrame:
    return segments.groupBy(*keys).agg(F.sum("n").alias("matched"))


def matched_pairs(
    segments: DataFrame, truth: DataFrame, found: DataFrame, keys: list[str], time: str, id_: str
) -> DataFrame:
    """Pairs of ids, (truth_id, found_id), from matched ranks. Ranks count within one time only."""

    def ranked(df: DataFrame, side: str) -> DataFrame:
        order = Window.partitionBy(*keys, time).orderBy(id_)
        return df.select(
            *keys,
            F.col(time).alias(f"{side}_at"),
            (F.row_number().over(order) - 1).cast("bigint").alias(f"{side}_rank"),
            F.col(id_).alias(f"{side}_id"),
        )

    single = segments.withColumn("step", F.explode(F.expr("sequence(0L, n - 1)"))).select(
        *keys,
        "truth_at",
        (F.col("truth_rank") + F.col("step")).alias("truth_rank"),
        "found_at",
        (F.col("found_rank") + F.col("step")).alias("found_rank"),
    )
    return (
        single.join(ranked(truth, "truth"), [*keys, "truth_at", "truth_rank"])
        .join(ranked(found, "found"), [*keys, "found_at", "found_rank"])
        .select(*keys, "truth_id", "found_id")
    )


def most_pairs(
    truths: list[tuple[int, int, int]], founds: list[tuple[int, int, int]], tolerance: int
) -> int:
    """Size of the largest matching of (onset, offset, count) points; both lists in onset order.

    Offsets must agree within a fifth of the annotated length, 50 ms at least. Points with equal
    times are interchangeable, so they carry a count and are moved together along augmenting paths.
    """
    least = k.OFFSET_MIN_TOLERANCE_S * 10_000
    near: list[list[int]] = []
    for onset, offset, _ in truths:
        slack = max(k.OFFSET_RATIO * (offset - onset), least)
        near.append(
            [
                j
                for j, (on, off, _) in enumerate(founds)
                if abs(on - onset) <= tolerance and abs(off - offset) <= slack
            ]
        )
    room = [n for *_, n in founds]
    flow: list[dict[int, int]] = [{} for _ in founds]  # found -> {truth: pairs}
    total = 0
    for i, (_, _, count) in enumerate(truths):
        need = count
        while need:
            # breadth first to the nearest found point with room, moving earlier pairs aside
            reached = {i: None}
            queue, end = deque([i]), None
            through: dict[int, int] = {}
            while queue and end is None:
                t = queue.popleft()
                for j in near[t]:
                    if j in through:
                        continue
                    through[j] = t
                    if room[j]:
                        end = j
                        break
                    for other in flow[j]:
                        if other not in reached:
                            reached[other] = j
                            queue.append(other)
            if end is None:
                break
            path, j = [], end
            while True:
                t = through[j]
                path.append((t, j))
                if reached[t] is None:
                    break
                j = reached[t]
            amount = min(need, room[end])
            for (t, j), (_, earlier) in zip(path, path[1:], strict=False):
                amount = min(amount, flow[earlier][t])
            for index, (t, j) in enumerate(path):
                flow[j][t] = flow[j].get(t, 0) + amount
                if index + 1 < len(path):
                    earlier = path[index + 1][1]
                    flow[earlier][t] -= amount
                    if not flow[earlier][t]:
                        del flow[earlier][t]
            room[end] -= amount
            need -= amount
            total += amount
    return total


def matched_with_offsets(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Per clip the most pairs that agree in pitch, onset and offset.

    Candidates cannot cross a gap in onsets wider than the tolerance, so each (clip, pitch) is cut
    there, and notes of equal times are counted before they are grouped.
    """
    keys = ["clip_id", "pitch"]
    sides = truth.select(*keys, "onset", "offset", F.lit(True).alias("is_truth")).unionByName(
        found.select(*keys, "onset", "offset", F.lit(False).alias("is_truth"))
    )
    points = sides.groupBy(*keys, "onset", "offset", "is_truth").agg(F.count(F.lit(1)).alias("n"))
    onsets = points.select(*keys, "onset").distinct()
    placed = points.join(stretches(onsets, keys, "onset", ONSET_TOLERANCE), [*keys, "onset"])
    both = placed.groupBy(*keys, "stretch").agg(
        F.count_if("is_truth").alias("truths"), F.count_if(~F.col("is_truth")).alias("founds")
    ).where((F.col("truths") > 0) & (F.col("founds") > 0))

    def one_stretch(key: tuple, rows: list[tuple]) -> list[tuple]:
        picked = [[row[3:6] for row in rows if row[6] == side] for side in (True, False)]
        return [(key[0], most_pairs(picked[0], picked[1], ONSET_TOLERANCE))]

    wanted = placed.join(both.select(*keys, "stretch"), [*keys, "stretch"], "left_semi").select(
        *keys, "stretch", "onset", "offset", "n", "is_truth"
    )
    return (
        sorted_groups(
            wanted,
            [*keys, "stretch"],
            ["onset", "offset"],
            one_stretch,
            "clip_id bigint, matched bigint",
        )
        .groupBy("clip_id")
        .agg(F.sum("matched").alias("matched"))
    )


def prf(matched: Column, truths: Column, founds: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and their harmonic mean; zero where a side is empty."""
    precision = F.when(founds > 0, matched / founds).otherwise(F.lit(0.0))
    recall = F.when(truths > 0, matched / truths).otherwise(F.lit(0.0))
    both = precision + recall
    return precision, recall, F.when(both > 0, 2 * precision * recall / both).otherwise(F.lit(0.0))
