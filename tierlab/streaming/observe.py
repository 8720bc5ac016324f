"""Streams of solved problems: each batch gives the same rows as the batch operators over the same input."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import trigrams
from ..operators import policy as P
from ..staging import shared_dir

MOST_FAILURES = 64


def shadow_stream(records: DataFrame, rate: float, key: str = "rec_idx") -> DataFrame:
    """Rows that bypass the cache, by a hash of the key: a replayed batch draws the same rows."""
    u = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 6), 16, 10).cast("long") / float(1 << 24)
    return records.where(u < rate)


def running_risk(records: DataFrame, tau: list[float]) -> DataFrame:
    """n, bad and cost of a policy over all records so far, by accepting tier (complete or update mode)."""
    return P.replay(records, tau).groupBy("accepted_at").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("true_correct")).alias("bad"), F.sum("cost").alias("cost"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by type in event-time windows; rows later than `late` are dropped by the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


class FailureMemory(StatefulProcessor):
    """Each key's latest distinct failures, a list in the state store. A failure that the list holds is no news; one that fell out of it is news again."""

    def __init__(self, most: int, forget_ms: int | None):
        self.most, self.forget_ms = most, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getListState("memory", "hash string, seq long", self.forget_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["seq", "hash"])  # one key's rows of one batch
        held = deque(self.memory.get())
        known, fresh = {h for h, _ in held}, []
        for seq, h in zip(batch["seq"].tolist(), batch["hash"].tolist()):
            if h not in known:
                known.add(h)
                held.append((h, seq))
                fresh.append((key[0], seq, h))
                if len(held) > self.most:
                    known.discard(held.popleft()[0])
        if fresh:
            self.memory.put(list(held))
            yield pd.DataFrame(fresh, columns=["problem", "seq", "hash"])

    def close(self) -> None:
        pass


def failure_memory(failures: DataFrame, most: int = MOST_FAILURES, forget_ms: int | None = None) -> DataFrame:
    """problem, seq, hash: each failure a problem hasn't in its memory, which holds its `most` latest distinct ones, in order of
    seq within a batch; forget_ms: entries this old go. A batch that is replayed gives the same rows again."""
    with_state_store(failures.sparkSession)
    rows = failures.select(F.col("problem").cast("long").alias("problem"), F.col("seq").cast("long").alias("seq"), F.col("hash").cast("string").alias("hash"))
    mode = "none" if forget_ms is None else "processingTime"
    return rows.groupBy("problem").transformWithStateInPandas(FailureMemory(most, forget_ms), "problem long, seq long, hash string", "append", mode)


class GramIndex(StatefulProcessor):
    """The items that hold a gram, a list a gram in the state store; a new item meets those in it and the smaller ids of its batch."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "id long, size long", self.forget_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = sorted({(i, n) for part in rows for i, n in zip(part["id"].tolist(), part["size"].tolist())})
        if key[0].startswith(_SELF):
            yield pd.DataFrame([(i, n, None, None) for i, n in new], columns=_MET).astype("Int64")
            return
        met, held = [], [(i, n) for i, n in self.items.get()]
        seen = {i for i, _ in held}
        for at in range(0, len(held), 10_000):  # a common gram's list is met in parts
            part = [(i, n, j, m) for i, n in new for j, m in held[at : at + 10_000] if i != j]
            if part:
                yield pd.DataFrame(part, columns=_MET).astype("Int64")
        met = [(i, n, j, m) for at, (i, n) in enumerate(new) for j, m in new[:at] if i != j and j not in seen]
        if met:
            yield pd.DataFrame(met, columns=_MET).astype("Int64")
        added = [(i, n) for i, n in new if i not in seen]
        if added:
            self.items.appendList(added)

    def close(self) -> None:
        pass


ANSWER = np.dtype([("at", "i8"), ("seq", "i8"), ("key", "i8"), ("none", "?"), ("oddity", "f8"), ("wrong", "?")])
LEVEL = np.dtype([("key", "i8"), ("none", "?"), ("tau", "f8")])


class AdaptiveLevel(StatefulProcessor):
    """The levels of a lane's keys, and its rows that the watermark hasn't passed yet; those it passes are taken in order of time and seq.

    Every call of the state store is a message, so a lane has one timer, at the earliest time that waits in it, one packed
    value for a batch of rows, and one for its levels: calls go with lanes and batches, not with rows or keys.
    """

    def __init__(self, start: float, alpha: float, eta: float):
        self.start, self.alpha, self.eta = start, alpha, eta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = handle.getValueState("levels", "packed binary")
        self.waiting = handle.getListState("waiting", "packed binary")
        self.earliest = handle.getValueState("earliest", "at long")

    def _wake(self, at: int) -> None:
        self.earliest.update((at,))
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            came = np.empty(len(part), ANSWER)
            for c in ANSWER.names:
                came[c] = part[c].to_numpy()
            self.waiting.appendValue((came.tobytes(),))
            first = int(came["at"].min()) if first is None else min(first, int(came["at"].min()))
        known = self.earliest.get()
        if first is not None and (known is None or first < known[0]):
            self._wake(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, known = timerValues.getCurrentWatermarkInMs(), self.earliest.get()
        if known is None or known[0] > passed:  # an older timer of the same batch took them
            return
        held = np.concatenate([np.frombuffer(bytes(r[0]), ANSWER) for r in self.waiting.get()])
        held = held[np.lexsort((held["wrong"], held["oddity"], held["seq"], held["at"]))]
        n = int(np.searchsorted(held["at"], passed, "right"))
        packed = self.levels.get()
        levels = {} if packed is None else {(k, none): tau for k, none, tau in np.frombuffer(bytes(packed[0]), LEVEL).tolist()}
        out = []
        for _, seq, number, none, oddity, wrong in held[:n].tolist():
            tau = levels.get((number, none), self.start)
            accepted = oddity <= tau
            err = accepted and wrong
            out.append((seq, tau, accepted, err))
            levels[number, none] = tau + self.eta * (self.alpha - (1.0 if err else 0.0))
        self.levels.update((np.array([(*k, tau) for k, tau in levels.items()], LEVEL).tobytes(),))
        if n < len(held):
            self.waiting.put([(held[n:].tobytes(),)])
            self._wake(int(held["at"][n]))
        else:
            self.waiting.clear()
            self.earliest.clear()
        keys = pd.Series(pd.arrays.IntegerArray(held["key"][:n].copy(), held["none"][:n].copy()))  # a null key is a key
        yield pd.DataFrame(out, columns=["seq", "tau", "accepted", "err"]).assign(key=keys)[["key", "seq", "tau", "accepted", "err"]]

    def close(self) -> None:
        pass


def adaptive_level(answers: DataFrame, start: float, alpha: float, eta: float, late: str = "1 hour", lanes: int = 256) -> DataFrame:
    """key, seq, tau, accepted, err of a stream of answers (key, ts, seq, score, wrong): the level of tolerated oddity that each
    answer meets in its key, tau <- tau + eta * (alpha - err) after it, from `start` on.

    An answer's oddity is 1 - score; it is accepted up to the level, and an accepted wrong answer is an error, so the rate
    of errors of a key goes to alpha whatever its answers do. Answers are taken in order of ts and seq: each waits in the
    state until the watermark (the latest ts less `late`) has passed it, so files may come in any order; one that comes
    after that is late and takes no part. A null score is the oddest, a null wrong counts as wrong, a null ts or seq takes no part.
    Keys share `lanes` of state by their hash (a stream that goes on keeps the number it began with).
    """
    with_state_store(answers.sparkSession)
    timed = answers.where(F.col("ts").isNotNull() & F.col("seq").isNotNull()).withWatermark("ts", late)
    rows = timed.select(
        F.pmod(F.xxhash64(F.col("key").cast("long")), F.lit(lanes)).alias("lane"), F.coalesce(F.col("key").cast("long"), F.lit(0)).cast("long").alias("key"), F.col("key").isNull().alias("none"), "ts", F.unix_millis("ts").alias("at"), F.col("seq").cast("long").alias("seq"),
        (1 - F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("oddity"), F.coalesce("wrong", F.lit(True)).alias("wrong"),
    )
    return rows.groupBy("lane").transformWithStateInPandas(AdaptiveLevel(start, alpha, eta), "key long, seq long, tau double, accepted boolean, err boolean", "append", "eventTime")


_SELF, _MET = "item ", ["id", "size", "other", "other_size"]


def met_items(items: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """id, size, other, other_size of a stream of items (id, text): a row for each gram that an item shares with one that came
    before it (or in its batch with a smaller id), and one row without another for the item itself.

    The index is keyed state, so a batch reads and writes the lists of its own grams only, however many items came before.
    An item that comes again meets the others, not itself, and is not entered twice. forget_ms: entries this old go.
    """
    with_state_store(items.sparkSession)
    sized = items.select(F.col("id").cast("long").alias("id"), trigrams(F.col("text")).alias("gs")).select("id", F.size("gs").cast("long").alias("size"), "gs")
    keys = F.array_append("gs", F.concat(F.lit(_SELF), F.col("id").cast("string")))
    rows = sized.select("id", "size", F.explode(keys).alias("g"))
    mode = "none" if forget_ms is None else "processingTime"
    return rows.groupBy("g").transformWithStateInPandas(GramIndex(forget_ms), "id long, size long, other long, other_size long", "append", mode)


def warm_cache(items: DataFrame, at: str, forget_ms: int | None = None):
    """Starts the query that writes, for each item, its best similarity to all items before it to at/best, a folder a batch
    (overwritten when a batch comes again); state and offsets are in at/checkpoint, so a query started again goes on."""

    def step(met: DataFrame, batch: int) -> None:
        both = met.where("other is not null").groupBy("id", "size", "other", "other_size").agg(F.count(F.lit(1)).alias("both"))
        best = both.groupBy("id").agg(F.max(F.col("both") / (F.col("size") + F.col("other_size") - F.col("both"))).alias("best"))
        met.where("other is null").select("id").distinct().join(best, "id", "left").na.fill(0.0).write.mode("overwrite").parquet(f"{at}/best/batch={batch}")

    return met_items(items, forget_ms).writeStream.foreachBatch(step).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()


def with_state_store(spark: SparkSession) -> None:
    """Keyed lists need the RocksDB state store; a session that names another provider keeps it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def to_table(stream: DataFrame, name: str, mode: str = "append", at: str | None = None) -> DataFrame:
    """All that the stream has now, written to a table in the shared folder; a table at the same place goes on where it stopped."""
    spark = stream.sparkSession
    at = at or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = out.format("parquet").option("path", f"{at}/rows").start()
    else:
        query = out.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
