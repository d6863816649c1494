"""Small tables of configurations and stages: grids, neighbours, coverage picks, order and states. All on the driver."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import identity


def expand_grid(fixed: dict, axes: dict[str, list], most: int = 256) -> list[dict]:
    """All combinations of the axes over the fixed parameters, each once, in the order of the axes; more than `most` is an error."""
    out, seen = [], set()
    for values in itertools.product(*axes.values()):
        config = fixed | dict(zip(axes, values))
        if (key := identity(config)) not in seen:
            seen.add(key)
            out.append(config)
    if len(out) > most:
        raise ValueError(f"{len(out)} configurations; at most {most}")
    return out


def parameter_neighbors(grid: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """(a, b, axis): configurations that differ in one axis alone, by one step of its values."""
    ranked = grid
    for c in axes:
        values = grid.select(c).distinct().withColumn(f"__{c}", F.dense_rank().over(Window.orderBy(c)))  # a grid's few values
        ranked = ranked.join(F.broadcast(values), c)
    a = ranked.select(F.col(key).alias("a"), *[F.col(f"__{c}").alias(f"x_{c}") for c in axes])
    b = ranked.select(F.col(key).alias("b"), *[F.col(f"__{c}").alias(f"y_{c}") for c in axes])
    out = None
    for axis in axes:
        on = F.col(f"y_{axis}") - F.col(f"x_{axis}") == 1
        for c in axes:
            if c != axis:
                on = on & (F.col(f"x_{c}") == F.col(f"y_{c}"))
        own = a.join(b, on).select("a", "b", F.lit(axis).alias("axis"))
        out = own if out is None else out.unionByName(own)
    return out


def coverage_subset(items: list[tuple[str, set]], limit: int, seed: int) -> list[str]:
    """Items in a seeded order that cover classes, the rarest first, then filled up to `limit` in that order."""
    order = sorted(items)
    random.Random(seed).shuffle(order)
    count: dict = {}
    for _, classes in order:
        for c in classes:
            count[c] = count.get(c, 0) + 1
    chosen: list[str] = []
    for c in sorted(count, key=lambda c: (count[c], str(c))):
        if len(chosen) < limit and not any(c in cs for k, cs in order if k in chosen):
            chosen.append(next(k for k, cs in order if c in cs))
    return chosen + [k for k, _ in order if k not in chosen][: max(0, limit - len(chosen))]


def spread(rows: list[dict], criteria: list[str], group: str, key: str, limit: int) -> list:
    """Keys of up to `limit` rows: the first of each group, then whichever is farthest in percentile ranks from all chosen."""
    rows = sorted(rows, key=lambda r: r[key])
    place = {r[key]: [sum(o[c] <= r[c] for o in rows) / len(rows) for c in criteria] for r in rows}
    chosen: list = []
    for r in rows:
        if len(chosen) < limit and r[group] not in {o[group] for o in rows if o[key] in chosen}:
            chosen.append(r[key])
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(place[a], place[b]))
    while len(chosen) < min(limit, len(rows)):
        rest = [r[key] for r in rows if r[key] not in chosen]
        chosen.append(max(rest, key=lambda k: min(apart(k, c) for c in chosen)))
    return chosen


def stage_order(needs: dict[str, list[str]]) -> list[str]:
    """Stages after what they need, otherwise by name; a cycle or an unknown stage is an error."""
    if unknown := {d for ds in needs.values() for d in ds} - set(needs):
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    out: list[str] = []
    while len(out) < len(needs):
        ready = sorted(s for s in needs if s not in out and set(needs[s]) <= set(out))
        if not ready:
            raise ValueError("the stages need each other")
        out.append(ready[0])
    return out


def stage_states(needs: dict[str, list[str]], observed: dict[str, str], valid: dict[str, bool]) -> dict[str, str]:
    """completed, corrupt, running, failed, blocked, pending or missing, from what a scheduler and the artifacts show."""
    out: dict[str, str] = {}
    for s in stage_order(needs):
        if s in valid:
            out[s] = "completed" if valid[s] else "corrupt"
        elif observed.get(s) in ("running", "failed"):
            out[s] = observed[s]
        elif any(out[d] in ("failed", "corrupt", "blocked", "missing") for d in needs[s]):
            out[s] = "blocked"
        elif any(out[d] != "completed" for d in needs[s]):
            out[s] = "pending"
        else:
            out[s] = observed.get(s, "missing")
    return out


def next_actions(states: dict[str, str]) -> dict[str, str]:
    """What to do about each state before a run is submitted again."""
    names = {"completed": "reuse_verified", "corrupt": "refuse_artifact_reuse", "running": "reconcile_job_first", "blocked": "resubmit_after_dependencies", "pending": "resubmit_after_dependencies"}
    return {s: names.get(state, "resubmit") for s, state in states.items()}


def experiment_matrix(splits: DataFrame, seeds: list[int]) -> DataFrame:
    """Every split with every seed."""
    return splits.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))


def matched_runs(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Expected runs with how often each was observed: missing, complete or duplicate; unexpected ones too."""
    seen = observed.groupBy(*keys).agg(F.count("*").alias("n"))
    both = expected.select(*keys).distinct().withColumn("__e", F.lit(True)).join(seen, keys, "full_outer")
    status = F.when(F.col("__e").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").otherwise("complete")
    return both.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))
