"""Components: stages over DataFrames with state that can be saved, fitted and measured; and the settings around them."""

from __future__ import annotations

import importlib
import json
import os
import time
from abc import ABC, abstractmethod
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class Component(ABC):
    """A stage that ``decode``s a DataFrame; its public attributes are its state, and must be JSON values."""

    needs: tuple[str, ...] = ()

    @abstractmethod
    def decode(self, df: DataFrame) -> DataFrame: ...

    def train(self, df: DataFrame) -> Component:
        """Fit the state; nothing to do by default."""
        return self

    def evaluate(self, df: DataFrame) -> DataFrame:
        return self.decode(df)

    def __call__(self, df: DataFrame) -> DataFrame:
        lacking = [c for c in self.needs if c not in df.columns]
        if lacking:
            raise ValueError(f"{type(self).__name__} needs {lacking}")
        return self.decode(df)

    def save(self, path: str) -> None:
        state = {k: v for k, v in vars(self).items() if not k.startswith("_")}
        Path(path).write_text(json.dumps({"class": class_path(type(self)), "state": state}, indent=2))

    @staticmethod
    def load(path: str) -> Component:
        found = json.loads(Path(path).read_text())
        new = object.__new__(class_of(found["class"]))
        vars(new).update(found["state"])
        return new


class DocumentComponent(Component):
    """A component over ``doc_id, text``."""

    needs = ("doc_id", "text")


def class_path(cls: type) -> str:
    return f"{cls.__module__}.{cls.__qualname__}"


def class_of(path: str) -> type:
    module, _, name = path.rpartition(".")
    return getattr(importlib.import_module(module), name)


def data_dir(spark: SparkSession) -> str:
    """Where models and lexicons lie: the setting ``spark.textloom.home``, else a folder of the user's home."""
    return spark.conf.get("spark.textloom.home", None) or os.path.expanduser("~/.textloom")


def overlay(defaults: dict, *later: dict) -> dict:
    """Settings with later ones over earlier ones; a null says nothing."""
    out = dict(defaults)
    for d in later:
        out |= {k: v for k, v in d.items() if v is not None}
    return out


class Timer:
    """Wall clock of a block, and how many things a second it did."""

    def __enter__(self) -> Timer:
        self._began = time.time()
        return self

    def __exit__(self, *_) -> None:
        self.seconds = time.time() - self._began

    def rate(self, n: int) -> float:
        return n / max(self.seconds, 1e-9)
