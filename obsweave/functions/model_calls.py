"""Calls of a pluggable model from the tasks, in batches, with failures kept to the rows that cause them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def answers(model: Callable[[list[dict]], list], records: list[dict]) -> list:
    """One answer per record; None for a record that makes the model fail.

    When a batch fails, or gives another number of answers, its records are asked one by one.
    """
    try:
        got = list(model(records))
        if len(got) == len(records):
            return got
    except Exception:
        if len(records) == 1:
            return [None]
    return [None] if len(records) == 1 else [x for r in records for x in answers(model, [r])]


def ask_rows(df: DataFrame, model: Callable[[list[dict]], list], key: str, batch: int = 32) -> DataFrame:
    """(key, answer) for each row: ``model`` gets lists of at most ``batch`` rows as dicts and gives one text each."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at:at + batch]
                got = answers(model, part.to_dict("records"))
                yield pd.DataFrame({key: part[key].to_numpy(), "answer": [None if x is None else str(x) for x in got]})

    return df.mapInPandas(run, f"`{key}` {kind}, answer string")
