"""The loop behind every iterative algorithm: step until nothing changes, cutting the lineage on the way."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.store import Store, files_for


def iterate_to_fixed_point(
    state: DataFrame,
    step_fn: Callable[[DataFrame], DataFrame],
    converged_fn: Callable[[DataFrame, DataFrame], bool],
    *,
    max_iters: int = 30,
    materialize_every: int = 1,
    checkpoint_dir: str | None = None,
) -> tuple[DataFrame, int]:
    """(final state, rounds). The round that finds no change counts. Reaching max_iters warns and returns the last state.

    Every `materialize_every` rounds the state is written to the shared folder, or below checkpoint_dir, and read back;
    how many files it gets follows from the rows of the round before.
    """
    if max_iters < 1:
        raise ValueError(f"max_iters must be at least 1, got {max_iters}")
    if materialize_every < 1:
        raise ValueError(f"materialize_every must be at least 1, got {materialize_every}")
    store, files = Store(state.sparkSession, checkpoint_dir), None
    for k in range(1, max_iters + 1):
        after = step_fn(state)
        if k % materialize_every == 0 or k == max_iters:
            after, seen = store.measured(after, files, rows=F.count(F.lit(1)))
            files = files_for(2 * seen["rows"])
        if converged_fn(state, after):
            return after, k
        state = after
        if checkpoint_dir is None and k > 2 * materialize_every:
            store.forget()
    not_converged(max_iters)
    return state, max_iters


def written_each_round(materialize_every: int) -> None:
    """For loops whose rounds need a number from the round before, which is read while that one is written."""
    if materialize_every != 1:
        raise ValueError(f"every round is written: materialize_every can only be 1, not {materialize_every}")


def not_converged(rounds: int) -> None:
    warnings.warn(f"no fixed point within {rounds} iterations; the result is that of the last one", UserWarning, stacklevel=3)


def same_rows(a: DataFrame, b: DataFrame, on: list[str]) -> bool:
    """Whether both frames hold the same set of rows in these columns; nulls equal nulls."""
    a, b = a.select(*on).distinct(), b.select(*on).distinct()
    marked = a.selectExpr(*on, "1 as side").union(b.selectExpr(*on, "2 as side"))
    return marked.groupBy(*on).agg({"side": "sum"}).where("`sum(side)` <> 3").isEmpty()
