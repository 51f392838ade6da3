"""State with timers and expiry, and joins of two streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.sources.workers import importable

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def keyed_state(events: DataFrame) -> None:
    """Sets the session's state store to the one that timers, lists and maps need."""
    importable(events.sparkSession)
    events.sparkSession.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Pauses(StatefulProcessor):
    """Reports a user when it has been silent for ``pause`` microseconds of event time. A key holds many users, so that a batch costs a few round trips for each key, not for each user or pause.

    Times that may still begin a pause are kept, sorted by user and time, each with the number of events that it stands for: those that are followed for good are counted with the next one.
    A key has one timer, for the first pause to end; a late event may move it. Only the watermark decides, once a timer has gone off, so results don't depend on how rows are dealt to batches.
    """

    def __init__(self, pause: int) -> None:
        self.pause = pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "timer long, users binary, times binary, counts binary")

    def _load(self) -> tuple[int | None, list[np.ndarray]]:
        """The timer that is set, and users, times and counts."""
        timer, *columns = self.open.get() if self.open.exists() else (None, b"", b"", b"")
        return timer, [np.frombuffer(bytes(x), np.int64) for x in columns]

    def _store(self, timer: int | None, users: np.ndarray, times: np.ndarray, counts: np.ndarray) -> None:
        """Keeps these, with a timer at the end of the first pause, in milliseconds as timers have them, in place of ``timer``."""
        first = int((times[self._last(users, times)].min() + self.pause) // 1000) if len(times) else None
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is not None and timer != first:
            self.handle.registerTimer(first)
        if first is None:
            self.open.clear()
        else:
            self.open.update((first, users.tobytes(), times.tobytes(), counts.tobytes()))

    def _last(self, users: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Which of the sorted times their user follows with nothing within the pause."""
        return np.append((np.diff(users) != 0) | (np.diff(times) > self.pause), True) if len(times) else np.zeros(0, bool)

    def _over(self, times: np.ndarray, timerValues) -> np.ndarray:
        """Times whose pause has ended before the watermark: no event can come into it any more."""
        return times + self.pause < timerValues.getCurrentWatermarkInMs() * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer, (users, times, counts) = self._load()
        chunks = [(x["user"].to_numpy(np.int64), x["t"].to_numpy(np.int64)) for x in rows]
        users, times = (np.concatenate([old, *new]) for old, new in zip((users, times), zip(*chunks, strict=True), strict=True))
        order = np.lexsort((times, users))
        users, times, total = users[order], times[order], np.cumsum(np.append(counts, np.ones(len(order) - len(counts), np.int64))[order])
        stays = self._last(users, times) | ~self._over(times, timerValues)
        self._store(timer, users[stays], times[stays], np.diff(total[stays], prepend=0))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, (users, times, counts) = self._load()
        last = self._last(users, times)
        run, n = np.cumsum(last) - last, np.diff(np.cumsum(counts)[last], prepend=0)
        over = self._over(times[last], timerValues)
        self._store(None, *(x[~over[run]] for x in (users, times, counts)))
        found = users[last][over]
        yield pd.DataFrame({"user": pd.Series([None] * len(found) if key[0] == NOBODY else found, dtype=object), "t": times[last][over], "n": n[over]})


#: Keys that users are dealt to, and the key of null.
KEYS, NOBODY = 1024, -1


def silent_users(events: DataFrame, pause_hours: int = 6, late: str = "1 hour") -> DataFrame:
    """(user_id, last_seen, n): each event that its user follows with nothing for so long, and how many events the user had since the pause before.

    A row comes when the watermark has passed the end of the pause; then nothing is kept of the user but later events. Null users are one user; rows with a null time are left out.
    """
    keyed_state(events)
    key = F.when(F.col("user_id").isNull(), NOBODY).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(KEYS)).cast("int"))
    rows = events.where("ts is not null").select(key.alias("key"), F.coalesce(F.col("user_id").cast("long"), F.lit(0)).alias("user"), "ts", F.unix_micros("ts").alias("t")).withWatermark("ts", late)
    found = rows.groupBy("key").transformWithStateInPandas(Pauses(pause_hours * 3_600_000_000), "user long, t long, n long", "Append", "EventTime")
    return found.select(F.col("user").alias("user_id"), F.timestamp_micros("t").cast("timestamp_ntz").alias("last_seen"), "n")


class FirstOfEach(StatefulProcessor):
    """Lets the first row of each value through for each key; what it has seen expires so many milliseconds of processing time after it came."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "value string", "id long", ttlDurationMs=self.keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        least: dict[str, int] = {}
        for chunk in rows:
            for value, i in chunk.groupby("value", dropna=False)["id"].min().items():
                value = None if pd.isna(value) else value
                least[value] = min(i, least.get(value, i))
        fresh = {v: i for v, i in least.items() if not self.seen.containsKey((v,))}
        for v, i in fresh.items():
            self.seen.updateValue((v,), (int(i),))
        if fresh:
            yield pd.DataFrame({"key": key[0], "value": pd.Series(list(fresh), dtype=object), "id": list(fresh.values())})


def first_of_each(events: DataFrame, *, key: str, value: str, id_col: str, keep_ms: int = 86_400_000) -> DataFrame:
    """(key, value, id_col): for each key and value the least id of the batch in which it first came, again once it is forgotten ``keep_ms`` later."""
    keyed_state(events)
    rows = events.select(F.col(key).alias("key"), F.col(value).alias("value"), F.col(id_col).alias("id"))
    found = rows.groupBy("key").transformWithStateInPandas(FirstOfEach(keep_ms), "key long, value string, id long", "Append", "ProcessingTime")
    return found.select(F.col("key").alias(key), F.col("value").alias(value), F.col("id").alias(id_col))


def followed_within(first: DataFrame, then: DataFrame, *, key: str, time: str, id_col: str, out: str, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(id_col, out): rows of the stream ``first`` with those of ``then`` that have the same key and come after them, ``within`` at most; with null if none does.

    Both sides are kept as state until the watermark, that of the slower stream, has passed what could still match; only then comes a row without a match. Null keys or times match nothing.
    """
    a = first.select(F.col(key).alias("key"), F.col(time).alias("at"), F.col(id_col).alias(id_col)).withWatermark("at", late)
    b = then.select(F.col(key).alias("other_key"), F.col(time).alias("other_at"), F.col(id_col).alias(out)).withWatermark("other_at", late)
    soon = (F.col("key") == F.col("other_key")) & (F.col("other_at") > F.col("at")) & (F.col("other_at") <= F.col("at") + F.expr(f"INTERVAL {within}"))
    return a.join(b, soon, "leftOuter").select(id_col, out)
