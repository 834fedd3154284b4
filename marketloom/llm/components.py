"""Connected components with every round written to a shared table."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import components as stars
from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), as a stored table: the least node that can be reached."""
    made: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        made.append(stored(df, "component-edges"))
        return made[-1]

    out = stored(stars.components(edges, keep), "components")
    discard(*made)
    return out
