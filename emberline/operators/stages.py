"""Named pipeline stages with declared input and output columns, as Spark ML transformers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Transformer
from pyspark.sql import DataFrame

REGISTRY: dict[str, type[Stage]] = {}


class Stage(Transformer):
    """A DataFrame function that says which columns it needs and which it adds."""

    name = ""
    inputs: Sequence[str] = ()
    outputs: Sequence[str] = ()

    def work(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if missing := [c for c in self.inputs if c not in dataset.columns]:
            raise ValueError(f"stage {self.name}: missing columns {missing}")
        out = self.work(dataset)
        if missing := [c for c in self.outputs if c not in out.columns]:
            raise ValueError(f"stage {self.name}: promised columns {missing}")
        return out


def stage(name: str, inputs: Sequence[str], outputs: Sequence[str]) -> Callable[[Callable[[DataFrame], DataFrame]], type[Stage]]:
    """Registers a function as a stage; a name can be taken once."""

    def add(f: Callable[[DataFrame], DataFrame]) -> type[Stage]:
        if name in REGISTRY:
            raise ValueError(f"stage {name} exists")
        kind = type(name, (Stage,), {"name": name, "inputs": tuple(inputs), "outputs": tuple(outputs), "work": lambda self, df: f(df), "__doc__": f.__doc__})
        REGISTRY[name] = kind
        return kind

    return add
