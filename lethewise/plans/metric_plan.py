"""A plan of metrics that depend on others, run once each, with results of earlier runs and of a reference."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethewise.tables import written


@dataclass(frozen=True)
class Metric:
    """``compute`` takes the results of ``needs`` by name, and returns rows (item, value) or (value)."""

    name: str
    compute: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    options: dict = field(default_factory=dict, hash=False, compare=False)


HANDLERS: dict[str, Callable[..., DataFrame]] = {}


def metric(name: str) -> Callable:
    """Register a function as a handler; handlers hold no state."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        HANDLERS[name] = f
        return f

    return add


class Plan:
    """Metrics in an order in which each follows those it needs."""

    def __init__(self, metrics: list[Metric]):
        self.metrics = {m.name: m for m in metrics}
        if len(self.metrics) < len(metrics):
            raise ValueError("two metrics have one name")
        self.order: list[str] = []
        state: dict[str, int] = {}

        def visit(name: str) -> None:
            if state.get(name) == 1:
                raise ValueError(f"{name} needs itself")
            if name not in self.metrics:
                raise KeyError(f"no metric {name!r}")
            if name not in state:
                state[name] = 1
                for n in self.metrics[name].needs:
                    visit(n)
                state[name] = 2
                self.order.append(name)

        for m in metrics:
            visit(m.name)

    def run(self, done: dict[str, DataFrame] | None = None, sink: Callable[[str, DataFrame], None] | None = None) -> dict[str, DataFrame]:
        """Results by name. Those in ``done`` are taken as they are; each new one goes to ``sink`` as soon as it is there.
        A result that others need is written once, and they read it."""
        results = dict(done or {})
        needed = {n for m in self.metrics.values() for n in m.needs}
        for name in self.order:
            if name not in results:
                m = self.metrics[name]
                results[name] = m.compute(*[results[n] for n in m.needs], **m.options)
                if name in needed:
                    results[name] = written(results[name], "metric")
                if sink:
                    sink(name, results[name])
        return results


def summary(results: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """Rows (metric, value) of the means of the named metrics that have one."""
    out = None
    for n in sorted(n for n in names if n in results):
        one = results[n].agg(F.avg("value").alias("value")).select(F.lit(n).alias("metric"), "value")
        out = one if out is None else out.unionByName(one)
    return out.where("value is not null")


def with_reference(mine: DataFrame, logged: DataFrame, key: str = "metric") -> DataFrame:
    """Metrics with the value of the same name in a log; null where it has none."""
    return mine.join(logged.select(key, F.col("value").alias("reference")), key, "left")


def metric_subset(results: DataFrame, exact: list[str] = (), prefixes: list[str] = (), without: list[str] = (), name: str = "metric") -> DataFrame:
    """Results whose name is one of ``exact`` or begins with one of ``prefixes`` (all, without either), and has no string of
    ``without`` in it."""
    wanted = [F.col(name).isin(list(exact))] if exact else []
    wanted += [F.col(name).startswith(p) for p in prefixes]
    out = results.where(reduce(lambda a, b: a | b, wanted)) if wanted else results
    for part in without:
        out = out.where(~F.contains(F.col(name), F.lit(part)))
    return out
