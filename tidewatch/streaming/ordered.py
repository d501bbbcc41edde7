"""The folds of ``operators.folds`` over a stream: keyed state, event-time timers, the rows of the batch form.

Rows of a key are kept until the watermark has passed them and then folded in order of time, so that the order in which they arrive,
and how micro-batches cut them, changes nothing. The price is a delay by the watermark. A state that says nothing any more is
removed by a timer, ``idle`` seconds of event time after the key's last row.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

from ..operators.folds import Fold, restored, stored
from ..operators.windowed import micros

#: The state store that keyed state of this kind needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ordered(StatefulProcessor):
    def __init__(self, fold: Fold, key: str, kinds: dict[str, str], reports: list[str]) -> None:
        self.fold, self.key, self.names, self.reports = fold, key, list(kinds), reports
        self.whole = {c for c, kind in kinds.items() if kind in ("tinyint", "smallint", "int", "bigint")}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # rows wait in chunks, as they came: a row by itself would cost a call of the store each way
        self.waiting = handle.getListState("waiting", "rows binary")
        self.kept = handle.getValueState("kept", "state string, last long")

    def _plain(self, column: pd.Series, name: str) -> list:
        """Python values; whole numbers that pandas made floats because of nulls are whole again."""
        whole = name in self.whole
        if not column.hasnans:
            return column.tolist()
        return [None if missing else int(v) if whole else v.item() if hasattr(v, "item") else v for v, missing in zip(column, column.isna(), strict=True)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            new = list(zip(*(self._plain(frame[c], c) for c in self.names), strict=True))
            self.waiting.appendValue((pickle.dumps(new),))
            self.handle.registerTimer(int(min(r[0] for r in new)) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((r for (chunk,) in self.waiting.get() for r in pickle.loads(chunk)), key=lambda r: (r[0], r[1]))
        due, later = [r for r in rows if r[0] < passed], [r for r in rows if r[0] >= passed]
        state, last = self.kept.get() if self.kept.exists() else (None, None)
        if due:
            now, found = self.fold.step(restored(state) if state else self.fold.start(), due)
            last = max(last or 0, due[-1][0])
            self.kept.update((stored(now), last))
            if found:
                yield pd.DataFrame([(key[0], *r) for r in found], columns=[self.key, *self.reports])
            self.waiting.clear()
            if later:
                self.waiting.put([(pickle.dumps(later),)])
        if later:
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        elif last is not None and self.fold.idle is not None:
            end = (last + int(self.fold.idle * 1_000_000)) // 1000 + 1
            if end * 1000 <= passed:
                self.kept.clear()
            else:
                self.handle.registerTimer(end)

    def close(self) -> None:
        pass


def ordered(df: DataFrame, key: str, ts: str, order: str, fold: Fold, marked: str | None = None) -> DataFrame:
    """key and the fold's reports of a watermarked stream; each row is folded once the watermark has passed it.

    ``marked`` is the column that has the watermark, if not ``ts``. Times travel as microseconds, so no session time zone touches them. Needs the state store ``STORE``.
    """
    values = [f"v{i}" for i in range(len(fold.columns))]
    rows = df.select(F.col(key), F.col(marked or ts).alias("_ts"), micros(ts).alias("t"), F.col(order).alias("o"), *[F.col(c).alias(v) for c, v in zip(fold.columns, values, strict=True)])
    kinds = {c: dict(rows.dtypes)[c] for c in ("t", "o", *values)}
    schema = StructType([rows.schema[key], *_parse_datatype_string(fold.reports)])
    processor = _Ordered(fold, key, kinds, schema.names[1:])
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventtime")


def valid_at(events: DataFrame, table: DataFrame, key: str, ts: str, begins: str = "valid_from", ends: str = "valid_to", how: str = "inner") -> DataFrame:
    """``events``, a stream or a table, with the rows of a stored ``table`` that hold at their time: begins <= ts < ends.

    A null end holds for ever. The table is read anew for every micro-batch; a key may have any number of validities.
    """
    known = table.withColumnRenamed(key, "_key").withColumnRenamed(begins, "_from").withColumnRenamed(ends, "_to")
    holds: Column = (F.col(key) == F.col("_key")) & (F.col(ts) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(ts) < F.col("_to")))
    return events.join(known, holds, how).drop("_key", "_from", "_to")
