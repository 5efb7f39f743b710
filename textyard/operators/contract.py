"""What every vectorizer offers.

``fit(corpus)`` returns a model and only the model has ``transform``, so a transform
before a fit cannot be written. A corpus has a row id and ``text`` or ``tokens``; every
other column is passed through. ``transform`` adds ``features``.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame


class Model(ABC):
    name: str
    dim: int

    @abstractmethod
    def transform(self, corpus: DataFrame) -> DataFrame: ...


class Vectorizer(ABC):
    name: str
    # whether it reads ``text`` besides ``tokens``
    reads_text = False

    @abstractmethod
    def fit(self, corpus: DataFrame) -> Model: ...

    def fit_transform(self, corpus: DataFrame) -> DataFrame:
        return self.fit(corpus).transform(corpus)
