"""Chains of operators: text form, composition, registries and a fluent trace."""

from __future__ import annotations

import re
import shlex
from collections.abc import Callable, Iterable
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import stats, traces, windows
from tidewire.plans.expressions import compile_expression

Step = Callable[[DataFrame], DataFrame]
ALGORITHMS: dict[tuple[str, str], Callable] = {}
#: Time units in seconds.
UNITS = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9, "ps": 1e-12}


def register(category: str, name: str) -> Callable[[Callable], Callable]:
    """Add a function to the registry under (category, name)."""

    def add(f: Callable) -> Callable:
        if (category, name) in ALGORITHMS:
            raise ValueError(f"{category}/{name} is registered")
        ALGORITHMS[category, name] = f
        return f

    return add


def algorithm(category: str, name: str) -> Callable:
    if (category, name) not in ALGORITHMS:
        raise KeyError(f"no {category}/{name}; known: {sorted(n for c, n in ALGORITHMS if c == category)}")
    return ALGORITHMS[category, name]


def pipe(value, *steps: Callable):
    """Steps from left to right."""
    return reduce(lambda v, f: f(v), steps, value)


def compose(*steps: Callable) -> Callable:
    """Steps from right to left."""
    return lambda value: pipe(value, *reversed(steps))


def curry(f: Callable, *args, **named) -> Callable:
    return partial(f, *args, **named)


def seconds(text: str) -> float:
    """``1.5ms`` as seconds."""
    m = re.fullmatch(r"\s*([-+0-9.eE]+)\s*(s|ms|us|ns|ps)?\s*", text)
    if not m:
        raise ValueError(f"not a time: {text!r}")
    return float(m[1]) * UNITS[m[2] or "s"]


class Trace:
    """A fluent view of samples with keys, order, value and rate; every step is lazy."""

    def __init__(self, df: DataFrame, keys: Iterable[str], order: Iterable[str], value: str, fs: float):
        self.df, self.keys, self.order, self.value, self.fs = df, list(keys), list(order), value, fs

    def _with(self, df: DataFrame, value: str | None = None, order: Iterable[str] | None = None) -> Trace:
        return Trace(df, self.keys, order or self.order, value or self.value, self.fs)

    def map(self, expression: str) -> Trace:
        """A new value from an expression over ``x``."""
        return self._with(self.df.withColumn(self.value, compile_expression(expression, {"x": F.col(self.value)})))

    def filter(self, kind: str, *cutoff: float) -> Trace:
        out = traces.filtered(self.df, self.keys, self.order, self.value, self.fs, kind, cutoff[0] if len(cutoff) == 1 else tuple(cutoff))
        return self._with(out, "value", ["idx"])

    def normalize(self, method: str = "minmax") -> Trace:
        out = stats.normalize(self.df, self.keys, self.value, method)
        return self._with(out.drop(self.value).withColumnRenamed("normalized", self.value))

    def diff(self) -> Trace:
        out = windows.difference(self.df, self.keys, self.order, self.value)
        return self._with(out.drop(self.value).withColumnRenamed("diff", self.value))

    def integrate(self) -> Trace:
        out = windows.integrate(self.df, self.keys, self.order, self.value, 1 / self.fs)
        return self._with(out.drop(self.value).withColumnRenamed("integral", self.value))

    def slice(self, index: str, start: str, stop: str) -> Trace:
        """Samples of ``index`` within [start, stop), given as times such as 1ms; indexes are truncated."""
        a, b = int(seconds(start) * self.fs), int(seconds(stop) * self.fs)
        return self._with(self.df.filter((F.col(index) >= a) & (F.col(index) < b)))

    def measure(self) -> DataFrame:
        return traces.waveform_measurements(self.df, self.keys, self.order, self.value, self.fs)

    def stats(self) -> DataFrame:
        return stats.basic_stats(self.df, self.keys, self.value)

    def spectrum(self) -> DataFrame:
        return traces.fft(self.df, self.keys, self.order, self.value, self.fs)


def run_chain(text: str, load: Callable[[str], Trace]):
    """``load "name" | filter lowpass 1e6 | normalize | measure``: each part is a method of :class:`Trace`."""
    parts = [shlex.split(p) for p in text.split("|")]
    if not parts or parts[0][:1] != ["load"] or len(parts[0]) != 2:
        raise ValueError("a chain begins with: load <name>")
    out = load(parts[0][1])
    names = {"lowpass": "low", "highpass": "high", "bandpass": "band", "bandstop": "stop"}
    for verb, *args in parts[1:]:
        if verb.startswith("_") or not hasattr(Trace, verb):
            raise ValueError(f"unknown step {verb!r}")
        values = []
        for a in args:
            try:
                values.append(float(a))
            except ValueError:
                values.append(names.get(a, a))
        out = getattr(out, verb)(*values)
    return out
