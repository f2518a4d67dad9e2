"""Texts of Arrow batches in small lists, so that a task holds few Python strings at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ROWS = 256


def text_udf(schema: str, kind: pa.DataType, make: Callable[[], Callable[[list], list]]) -> Callable[[Column], Column]:
    """A column function of texts (None counts as the function wants); ``make`` runs once a task and gives the function of a list."""
    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = make()
        for b in batches:
            for k in range(0, len(b), ROWS):        # handed on as they come: results of a whole batch may be larger than its texts
                yield pa.array(of(b.slice(k, ROWS).to_pylist()), kind)
    return run.asNondeterministic()
