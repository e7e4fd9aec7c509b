"""De-duplication against a ring of the last kept keys."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverloom.functions import values as V
from riverloom.operators.project import col


class Ring:
    """The last ``size`` keys that were kept; a key that fell out counts as new."""

    def __init__(self, size: int):
        self.size, self.order, self.known = size, deque(), set()

    def admit(self, key: str) -> bool:
        if key in self.known:
            return False
        if len(self.order) >= self.size:
            self.known.discard(self.order.popleft())
        self.order.append(key)
        self.known.add(key)
        return True


def fifo_deduplicate(df: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """Rows whose key is not among the last ``size`` kept keys, in the order of a column.

    Which keys are in the ring depends on all rows before, so this is one ordered pass in one task; it holds the ring
    and a batch. Without ``exact_window`` de-duplication needs no such pass.
    """
    shown = F.concat_ws("|", *[V.key_text(col(k), V.dtype(df, k)) for k in keys])
    one = df.withColumn("__key", shown).coalesce(1).sortWithinPartitions(col(order))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ring = Ring(size)
        for pdf in batches:
            kept = [ring.admit(k) for k in pdf["__key"]]
            yield pdf.loc[kept].drop(columns="__key")

    return one.mapInPandas(run, df.schema)
