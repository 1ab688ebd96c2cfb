"""Figures that are counted while a job writes its rows.

The figures are observed in the last stage of the job, the one that writes, so they
cost no scan of their own. A task of that stage that fails, or runs once more on another
executor, counts once, as only the attempt that Spark takes for done is added. Observing
below a shuffle would not do: tasks of an earlier stage may run again when an executor
is lost, and would count again.

A table that Spark finds empty while the job runs has no last stage that could be
observed. What was written is looked at then.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation

AT_ONCE, AT_MOST = 0.5, 30.0  # seconds that the figures of a job that has ended may take to arrive


def write_observed(
    df: DataFrame, figures: dict[str, Column], write: Callable[[DataFrame], Any], read: Callable[[], DataFrame]
) -> dict[str, Any]:
    """Write rows whose last stage has no shuffle above the write, and give the figures over them.

    ``read`` opens the written rows, for the case that nothing was observed.
    """
    columns = [figure.alias(name) for name, figure in figures.items()]
    watch = Observation()
    write(df.observe(watch, *columns))
    if _arrives(watch, AT_ONCE) or (not read().isEmpty() and _arrives(watch, AT_MOST)):
        return {name: watch.get[name] for name in figures}
    return read().agg(*columns).first().asDict()


def _arrives(watch: Observation, seconds: float) -> bool:
    end = time.monotonic() + seconds
    while not watch._jo.future().isCompleted():
        if time.monotonic() > end:
            return False
        time.sleep(0.01)
    return True
