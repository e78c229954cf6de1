"""Pipelines of DataFrame stages: composition, branches, retries, timing. One lazy plan; actions only at sinks."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]


def compose(*stages: Stage) -> Stage:
    """Left to right."""
    return lambda df: reduce(lambda d, s: d.transform(s), stages, df)


def conditional(test: Callable[[DataFrame], bool], yes: Stage, no: Stage = lambda df: df) -> Stage:
    return lambda df: (yes if test(df) else no)(df)


def branch(stages: dict[str, Stage], combine: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> Stage:
    """Independent branches of one input; by default their rows by name."""

    def union(parts: dict[str, DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts.values())

    return lambda df: (combine or union)({name: stage(df) for name, stage in stages.items()})


parallel = branch


def retry(stage: Stage, times: int = 3, delay: float = 0.0, should: Callable[[Exception], bool] = lambda e: True) -> Stage:
    """Planning errors are tried again; execution has Spark's own task retries."""

    def run(df: DataFrame) -> DataFrame:
        for attempt in range(times + 1):
            try:
                return stage(df)
            except Exception as e:
                if attempt == times or not should(e):
                    raise
                time.sleep(delay)
        raise AssertionError

    return run


def chunk_analyzer(function: Callable[[str], str | None], keep: str = "true", text_col: str = "chunk", name: str = "analysis") -> Stage:
    """A stage that runs a Python function over the texts of the chunks that a condition keeps, in Arrow batches; null for the others."""

    def run(df: DataFrame) -> DataFrame:
        @F.pandas_udf("string")
        def analyse(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else function(t))

        return df.withColumn(name, F.when(F.expr(keep), analyse(F.when(F.expr(keep), F.col(text_col)))))

    return run


def transformers(*functions: Callable[[Column], Column], text_col: str = "chunk") -> Stage:
    """A stage that applies column functions to a text column, left to right."""
    return lambda df: df.withColumn(text_col, reduce(lambda c, f: f(c), functions, F.col(text_col)))


@dataclass
class Registry:
    """Named functions, registered for SQL too: tools, prompt templates, aggregates."""

    known: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str, function: Callable) -> Callable:
        if name in self.known:
            raise ValueError(f"{name} is registered")
        self.known[name] = function
        return function

    def use(self, spark: SparkSession) -> None:
        """Make Python functions of pandas series callable from SQL by their names."""
        for name, function in self.known.items():
            if hasattr(function, "returnType"):
                spark.udf.register(name, function)

    def __getitem__(self, name: str) -> Callable:
        return self.known[name]


@dataclass(frozen=True)
class Outcome:
    """A value or an error, with what to do next: steps after an error are skipped until one recovers."""

    value: object = None
    error: Exception | None = None

    @classmethod
    def of(cls, function: Callable, *args) -> Outcome:
        try:
            return cls(function(*args))
        except Exception as e:
            return cls(error=e)

    def map(self, function: Callable) -> Outcome:
        return self if self.error else Outcome.of(function, self.value)

    def flat_map(self, function: Callable[[object], Outcome]) -> Outcome:
        return self if self.error else function(self.value)

    def recover(self, function: Callable[[Exception], object]) -> Outcome:
        return Outcome.of(function, self.error) if self.error else self

    def get(self):
        if self.error:
            raise self.error
        return self.value

    def get_or_else(self, default):
        return default if self.error else self.value


@dataclass
class Pipeline:
    """Named stages; an optional stage that fails is recorded and left out."""

    stages: list[tuple[str, Stage, bool]] = field(default_factory=list)
    events: list[tuple[str, float, str]] = field(default_factory=list)

    def add(self, name: str, stage: Stage, required: bool = True) -> Pipeline:
        self.stages.append((name, stage, required))
        return self

    def only(self, include=None, exclude=()) -> Pipeline:
        return Pipeline([s for s in self.stages if (include is None or s[0] in include) and s[0] not in exclude])

    def run(self, df: DataFrame) -> DataFrame:
        for name, stage, required in self.stages:
            began = time.time()
            try:
                df = stage(df)
                self.events.append((name, time.time() - began, "completed"))
            except Exception as e:
                self.events.append((name, time.time() - began, f"failed: {e}"[:500]))
                if required:
                    raise
        return df
