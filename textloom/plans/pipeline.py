"""A pipeline of stages, each a function of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Stage = Callable[[DataFrame], DataFrame]


class Pipeline:
    def __init__(self, *stages: Stage, needs: tuple[str, ...] = ()):
        self.stages, self.needs = stages, needs

    def __call__(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.needs if c not in df.columns]
        if missing:
            raise ValueError(f"the input lacks {missing}")
        for s in self.stages:
            df = df.transform(s)
        return df
