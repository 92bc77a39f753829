"""Folds over sorted rows: for operators whose state depends on what they accepted before.

Rows are dealt by key and sorted within partitions (a sort that spills); a task holds one Arrow batch and the
state of the key it is at. No group is gathered, so a key may have any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def sorted_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: str | Sequence[str], step: Callable, out: str, kind: T.DataType | None = None) -> DataFrame:
    """Adds `out`: step(state, value) -> (state, result) along `order` of each key, the state None at its start.
    `value` is the input column, or a tuple of several. Null keys are a key of their own."""
    kind = kind or T.LongType()
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind, True)])
    names, single = ([inputs], True) if isinstance(inputs, str) else (list(inputs), False)
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, at = None, object()
        for pdf in batches:
            marks = list(zip(*[pdf[k].where(pdf[k].notna(), None) for k in keys])) if keys else [()] * len(pdf)
            values = pdf[names[0]].tolist() if single else list(zip(*[pdf[n].tolist() for n in names]))
            results = []
            for mark, value in zip(marks, values):
                if mark != at:
                    state, at = None, mark
                state, result = step(state, value)
                results.append(result)
            yield pdf.assign(**{out: pd.Series(results, index=pdf.index, dtype=object)})

    dealt = df.repartition(*keys) if keys else df.repartition(1)
    return dealt.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
