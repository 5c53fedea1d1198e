"""Steps with declared inputs, and recomputing only what their keys say has changed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.text import canonical_hash


@dataclass(frozen=True)
class Step:
    """A dataset step: rows of its inputs in, rows of one output out, each keyed by `unit`.

    `version` and `fingerprint` name everything besides the inputs that the result depends on;
    `applies` says for which units it runs at all.
    """

    name: str
    version: str
    run: Callable[[dict[str, DataFrame]], DataFrame]
    requires: tuple[str, ...] = ()
    fingerprint: dict[str, str] = field(default_factory=dict)
    applies: Column | None = None


def check_steps(steps: Sequence[Step], sources: Sequence[str] = ()) -> None:
    seen = set(sources)
    for step in steps:
        if step.name in seen:
            raise ValueError(f"duplicate step: {step.name}")
        missing = [r for r in step.requires if r not in seen]
        if missing:
            raise ValueError(f"step {step.name} requires {missing}, which nothing before it makes")
        seen.add(step.name)


def cache_keys(units: DataFrame, steps: Sequence[Step], source: str = "source") -> DataFrame:
    """`units` with one key column per step, chained through the steps each one reads.

    `units` has (unit, config, <source>): the source's own content hash and the configuration.
    A step that does not apply has a null key, and counts as absent for the steps after it.
    """
    check_steps(steps, (source,))
    keyed = units
    for step in steps:
        prints = F.concat_ws(";", *[F.lit(f"{k}={v}") for k, v in sorted(step.fingerprint.items())])
        inputs = F.concat_ws(
            ";",
            *[F.concat(F.lit(f"{r}="), F.coalesce(F.col(r), F.lit("absent"))) for r in step.requires],
        )
        key = canonical_hash(
            stage=F.lit(step.name),
            version=F.lit(step.version),
            config=F.col("config"),
            fingerprint=prints,
            inputs=inputs,
        )
        applies = F.lit(True) if step.applies is None else step.applies
        keyed = keyed.withColumn(step.name, F.when(applies, key))
    return keyed


def long_keys(keyed: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """(unit, stage, cache_key, place) for every step that applies."""
    cells = F.array(
        *[
            F.struct(F.lit(s.name).alias("stage"), F.col(s.name).alias("cache_key"), F.lit(i).alias("place"))
            for i, s in enumerate(steps)
        ]
    )
    return keyed.select("unit", F.inline(cells)).where(F.col("cache_key").isNotNull())


def pending(
    keyed: DataFrame, manifest: DataFrame, steps: Sequence[Step], force_from: str | None = None
) -> DataFrame:
    """(unit, stage, cache_key) still to compute; `force_from` and later steps run regardless."""
    names = [s.name for s in steps]
    if force_from is not None and force_from not in names:
        raise ValueError(f"no such step: {force_from}")
    forced_from = names.index(force_from) if force_from is not None else len(names)
    keys = long_keys(keyed, steps)
    known = manifest.select("unit", "stage", "cache_key")
    fresh = keys.where(F.col("place") < forced_from).join(
        known, ["unit", "stage", "cache_key"], "left_anti"
    )
    return fresh.unionByName(keys.where(F.col("place") >= forced_from))


def recompute(
    units: DataFrame,
    tables: dict[str, DataFrame],
    manifest: DataFrame,
    stored: dict[str, DataFrame],
    steps: Sequence[Step],
    force_from: str | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Outputs of all steps, computed for pending units only, and the manifest afterwards.

    `stored` holds each step's earlier rows; rows of recomputed units are replaced.
    """
    work = pending(cache_keys(units, steps), manifest, steps, force_from)
    outputs = dict(tables)
    for step in steps:
        todo = work.where(F.col("stage") == step.name).select("unit")
        inputs = {name: outputs[name].join(todo, "unit", "left_semi") for name in step.requires if name in outputs}
        made = step.run(inputs)
        earlier = stored.get(step.name)
        outputs[step.name] = (
            made if earlier is None else earlier.join(todo, "unit", "left_anti").unionByName(made)
        )
    done = work.select("unit", "stage", "cache_key")
    kept = manifest.select("unit", "stage", "cache_key").join(done, ["unit", "stage"], "left_anti")
    return {s.name: outputs[s.name] for s in steps}, kept.unionByName(done)
