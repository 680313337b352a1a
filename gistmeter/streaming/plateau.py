"""Plateaus found while a tuning log arrives."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state of a trial lives in the store that keeps its changes, as states of this kind need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Plateau(StatefulProcessor):
    """One ring of the last results of each trial, and whether it has stopped: one value, read and written once a micro-batch."""

    def __init__(self, trial: str, iteration: str, metric: str, spread: float, results: int, least: int, grace: int):
        self.names, self.spread, self.results, self.least, self.grace = (trial, iteration, metric), spread, results, least, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("trial", "last long, late long, stopped long, iterations array<long>, metrics array<double>")

    def _flat(self, values: list) -> bool:
        """Whether these results deviate by less than the spread; a null metric takes a place but has no value."""
        window = [float(v) for v in values if v is not None and v == v]
        if len(window) < max(self.least, 1):
            return False
        mean = sum(window) / len(window)
        return sqrt(sum((v - mean) * (v - mean) for v in window) / len(window)) < self.spread

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:  # noqa: N802
        trial, iteration, metric = self.names
        last, late, stopped, order, values = self.state.get() or (-1, 0, 0, [], [])
        arrived = [(row[iteration], row[metric]) for row in rows]
        fresh = sorted((r for r in arrived if r[0] is not None and r[0] > last), key=lambda r: r[0])
        order, values = [*order, *(r[0] for r in fresh)], [*values, *(r[1] for r in fresh)]
        found = None
        # A trial that has stopped is not looked at again.
        for k in range(len(order) - len(fresh), 0 if stopped else len(order)):
            if order[k] >= self.grace and self._flat(values[max(0, k + 1 - self.results) : k + 1]):
                found = order[k]
                break
        keep = max(len(order) - max(self.results - 1, 0), 0)
        last = order[-1] if order else last
        stopped = int(bool(stopped or found is not None))
        self.state.update((last, late + len(arrived) - len(fresh), stopped, order[keep:], [None if v is None or v != v else float(v) for v in values[keep:]]))
        if found is not None:
            yield Row(**{trial: key[0], "stop_iteration": found})

    def close(self) -> None:
        pass


def plateaus_of_stream(
    stream: DataFrame, trial: str, iteration: str, metric: str, spread: float = 0.01, results: int = 4, min_results: int | None = None, grace_period: int = 1
) -> DataFrame:
    """(trial, stop_iteration), once for each trial, when its last ``results`` values first deviate by less than ``spread``.

    The same as ``operators.trials.first_plateau`` when a trial's results come in the order of their iterations from
    one micro-batch to the next; inside a micro-batch any order will do. A result whose iteration is not above the
    last one that an earlier micro-batch had is late: it is counted in the state and takes part in no window. The
    state of a trial is ``results - 1`` values, whatever its length, and comes back from the checkpoint. A micro-batch
    holds a trial's new rows in one task, so bound it by files per trigger. Needs ``STATE_STORE``.
    """
    least = results if min_results is None else min_results
    kind = dict(stream.dtypes)[trial]
    slim = stream.select(trial, iteration, metric)
    processor = _Plateau(trial, iteration, metric, spread, results, least, grace_period)
    return slim.groupBy(trial).transformWithState(processor, f"{trial} {kind}, stop_iteration long", outputMode="Append", timeMode="None")
