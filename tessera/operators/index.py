"""What every index over points offers."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Index(Protocol):
    """Points are (id, vec); results are (id, dist), by distance and then id."""

    def build(self, points: DataFrame) -> Index: ...

    def insert(self, points: DataFrame) -> Index: ...

    def nearest_neighbors(self, query: Sequence[float], k: int) -> DataFrame: ...

    def range_search(self, query: Sequence[float], radius: float) -> DataFrame: ...
