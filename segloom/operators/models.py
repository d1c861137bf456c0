"""A user's model functions over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def batched_model_map(rows: DataFrame, column: str, batch_fn: Callable[[list[str]], list[str]], single_fn: Callable[[str], str], size: int = 8) -> DataFrame:
    """Adds result: batch_fn over `size` values at a time; a batch that fails, or answers with another number, is halved, down to single_fn."""

    def call(items: list[str]) -> list[str]:
        if len(items) == 1:
            return [single_fn(items[0])]
        try:
            out = batch_fn(items)
            if len(out) == len(items):
                return list(out)
        except Exception:  # noqa: BLE001  a model's failure of any kind
            pass
        mid = len(items) // 2
        return call(items[:mid]) + call(items[mid:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            values = f[column].tolist()
            f["result"] = [r for i in range(0, len(values), size) for r in call(values[i : i + size])]
            yield f

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", result string"
    return rows.mapInPandas(run, schema)
