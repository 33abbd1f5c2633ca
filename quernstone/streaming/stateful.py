"""Stateful stream operators with event-time timers.

Each is a processor that Spark calls for a key with its new rows, and again when
the watermark passes a time that the key asked for.  All follow event time and give
the same rows however the input is cut into micro-batches, as long as no row comes
later than the watermark's delay.  Rows without a time or key are left out.  What is
open when the input ends comes out once a later row, of any key, has moved the
watermark: a source should send a heartbeat, a row with a time and nothing else.

State is kept by RocksDB, which these operators need: see ``STATE_STORE``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Session settings of a query with these operators.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
HOUR = 3_600_000_000
DELAY = "1 hour"


def _timed(rows: DataFrame, time: str, delay: str) -> DataFrame:
    """``rows`` with a watermark, and their time in microseconds as ``micros``."""
    timed = rows.filter(F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.withColumn("micros", F.unix_micros(F.col(time)))


def _kept(rows: DataFrame, condition: Column) -> DataFrame:
    """Filter after the watermark has seen the rows.

    Spark moves a filter before the watermark unless it needs the event time, and
    heartbeats would be gone.
    """
    return rows.filter(condition | (F.col("micros") < -(1 << 62)))


def _ms(micros: int) -> int:
    """Milliseconds at which a time in microseconds has passed."""
    return -(-micros // 1000)


def _when(c: str | Column) -> Column:
    return F.timestamp_micros(c)


class _Table:
    """A table of a key's rows as one value of the state: read and written whole, in Arrow's format."""

    def __init__(self, handle, name: str):
        self.value = handle.getValueState(name, "rows binary")

    def get(self) -> pd.DataFrame | None:
        return pa.ipc.open_stream(bytes(self.value.get()[0])).read_pandas() if self.value.exists() else None

    def put(self, rows: pd.DataFrame) -> None:
        if not len(rows):
            self.value.clear()
            return
        table = pa.Table.from_pandas(rows, preserve_index=False)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        self.value.update((out.getvalue().to_pybytes(),))


#: Keys of the state of operators on many keys; each holds the rows that are hashed to it.
SLOTS = 128


def _slot(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SLOTS)).cast("int")


def _ms_of(micros: np.ndarray) -> np.ndarray:
    return -(-micros // 1000)


class _Processor(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle = handle
        self.open(handle)

    def open(self, handle) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


#: No time.
NEVER = np.iinfo(np.int64).max


class ReviewProcessor(_Processor):
    """Queue items by alert: the earliest time is kept, later ones are ignored.

    A key holds the items of all alerts that are hashed to it; its timer is that of the first that is due.
    """

    def __init__(self, low: float, high: float, hours: float):
        self.low, self.high, self.age = low, high, int(hours * HOUR)

    def open(self, handle) -> None:
        self.items = _Table(handle, "items")

    def _due(self, items: pd.DataFrame) -> np.ndarray:
        """Milliseconds at which an item resolves, or is forgotten."""
        queued, retracted = items["queued"].to_numpy(), items["retracted"].to_numpy()
        none = queued == NEVER
        since = np.where(none, retracted, queued)
        return _ms_of(since + self.age * np.where(items["done"].to_numpy(), 2, 1))

    def _hold(self, items: pd.DataFrame) -> None:
        self.items.put(items)
        if len(items):
            self.handle.registerTimer(int(self._due(items).min()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        back = new["status"] == "retracted"
        at = new["micros"].to_numpy()
        queued = ~back & (new["confidence"] >= self.low) & (new["confidence"] < self.high)
        fresh = pd.DataFrame({"id": new["id"].to_numpy(), "queued": np.where(queued, at, NEVER), "retracted": np.where(back, at, NEVER), "done": False})
        held = self.items.get()
        if held is not None:
            # what is resolved does not change
            fresh = pd.concat([held, fresh[~fresh["id"].isin(held.loc[held["done"], "id"])]])
        self._hold(fresh.groupby("id", as_index=False).agg({"queued": "min", "retracted": "min", "done": "max"}))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        items = self.items.get()
        if items is None:
            return
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        due = self._due(items) <= now
        if not due.any():
            return
        resolves = due & ~items["done"].to_numpy() & (items["queued"] != NEVER).to_numpy()
        out = items[resolves & (items["retracted"] > items["queued"].where(resolves, 0) + self.age).to_numpy()]
        # kept as long once more, so that a repeated alert is not queued anew
        items = items[~due | resolves].assign(done=(items["done"] | resolves)[~due | resolves])
        self._hold(items[self._due(items) > now])
        if len(out):
            yield pd.DataFrame({"id": out["id"], "queued": out["queued"], "resolved": out["queued"] + self.age})


def review_resolutions(alerts: DataFrame, low: float = 0.4, high: float = 0.6, hours: float = 24.0, time: str = "ts", delay: str = DELAY) -> DataFrame:
    """(id, queued_at, resolved_at): items of the review queue that nobody retracted in time.

    ``alerts`` has id, confidence, status and a time.  An alert with a confidence
    from ``low`` to below ``high`` is queued once, at its earliest time; a row with
    status ``retracted`` takes it back.  After ``hours`` a timer resolves what is
    left.  A repeated alert is known for as long after that.
    """
    wanted = (F.col("status") == "retracted") | ((F.col("confidence") >= low) & (F.col("confidence") < high))
    rows = _kept(_timed(alerts.select("id", "confidence", "status", time), time, delay), wanted & F.col("id").isNotNull())
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.withColumns({"confidence": F.coalesce("confidence", F.lit(-1.0)), "status": F.coalesce("status", F.lit(""))})
    made = rows.withColumn("slot", _slot("id")).groupBy("slot").transformWithStateInPandas(
        ReviewProcessor(low, high, hours), f"id {kind}, queued bigint, resolved bigint", "Append", "EventTime"
    )
    return made.select("id", _when("queued").alias("queued_at"), _when("resolved").alias("resolved_at"))


class IncidentProcessor(_Processor):
    """Open incidents of a (type, area); a row joins all those that its time touches."""

    def __init__(self, gap_seconds: int, resolve_hours: float):
        self.gap, self.age = gap_seconds, int(resolve_hours * HOUR)

    def open(self, handle) -> None:
        self.incidents = handle.getListState("incidents", "first bigint, last bigint, n bigint, rank int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(i) for i in self.incidents.get()] if self.incidents.exists() else []
        for pdf in rows:
            for t, rank in zip(pdf["micros"].tolist(), pdf["rank"].tolist()):
                merged, apart = (t, t, 1, int(rank)), []
                for i in held:
                    # in whole seconds, as the batch form has it
                    if t // 1_000_000 - i[1] // 1_000_000 <= self.gap and i[0] // 1_000_000 - t // 1_000_000 <= self.gap:
                        merged = (min(merged[0], i[0]), max(merged[1], i[1]), merged[2] + i[2], max(merged[3], i[3]))
                    else:
                        apart.append(i)
                held = [*apart, merged]
        self.incidents.put(held)
        for i in held:
            self.handle.registerTimer(_ms(i[1] + self.age))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.incidents.exists():
            return
        held = [tuple(i) for i in self.incidents.get()]
        now = expiredTimerInfo.getExpiryTimeInMs()
        over = [i for i in held if _ms(i[1] + self.age) <= now]
        if not over:
            return
        if len(over) < len(held):
            self.incidents.put([i for i in held if _ms(i[1] + self.age) > now])
        else:
            self.incidents.clear()
        first, last, n, rank = map(list, zip(*over))
        yield pd.DataFrame({
            "type": [key[0]] * len(over), "area": [key[1]] * len(over), "first": first, "last": last, "n": n, "severity": rank,
            "resolved": [t + self.age for t in last],
        })


def resolved_incidents(alerts: DataFrame, gap_seconds: int = 7200, hours: float = 4.0, time: str = "ts", delay: str = DELAY) -> DataFrame:
    """(type, area, first, last, n, severity, resolved_at) of each incident, ``hours`` after its last alert.

    ``alerts`` has type, area, rank and a time.  Alerts at most ``gap_seconds``
    apart are one incident, also where a late one closes the gap between two.
    ``hours`` must be longer than the gap.  A NULL area is an area.
    """
    if hours * 3600 <= gap_seconds:
        raise ValueError("an incident must be open for longer than the gap")
    rows = _kept(_timed(alerts.select("type", "area", "rank", time), time, delay), F.expr("type is not null and rank is not null"))
    schema = "type string, area string, first bigint, last bigint, n bigint, severity int, resolved bigint"
    made = rows.groupBy("type", "area").transformWithStateInPandas(IncidentProcessor(gap_seconds, hours), schema, "Append", "EventTime")
    return made.select("type", "area", _when("first").alias("first"), _when("last").alias("last"), "n", "severity", _when("resolved").alias("resolved_at"))


class ConsensusProcessor(_Processor):
    """Reports wait until the watermark passes them, and are then taken in order of time.

    A vote loses half its weight every ``half_minutes``.  Weights on one axis of
    time are summed up once by status, so that the votes of a report are a
    difference of two sums; the reports of the last hours are kept for the next time.
    """

    def __init__(self, half_minutes: float, hours: float, admin: float, ttl_hours: float):
        self.half, self.window, self.admin, self.ttl = half_minutes * 60e6, int(hours * HOUR), admin, int(ttl_hours * HOUR)

    def open(self, handle) -> None:
        self.waiting = _Table(handle, "waiting")
        self.recent = _Table(handle, "recent")
        self.shown = handle.getValueState("shown", "status string, t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows))[["micros", "id", "status", "admin"]].rename(columns={"micros": "t"})
        held = self.waiting.get()
        self.waiting.put(fresh if held is None else pd.concat([held, fresh]))
        self.handle.registerTimer(_ms(int(fresh["t"].max())))
        return iter(())

    def _decided(self, reports: pd.DataFrame, old: int) -> pd.DataFrame:
        """status, ratio and confidence at each report but the first ``old``, by the rule of ``facts.consensus``."""
        t = reports["t"].to_numpy()
        code, names = pd.factorize(reports["status"].to_numpy(dtype=object), sort=True)
        admin = reports["admin"].to_numpy(dtype=bool)
        weight = np.where(admin, self.admin, 1.0) * 2.0 ** ((t - t[0]) / self.half)
        end = np.arange(old + 1, len(t) + 1)
        begin = np.searchsorted(t, t[old:] - self.window, side="left")
        fade = 2.0 ** ((t[0] - t[old:]) / self.half)

        def in_window(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(values)])
            return sums[end] - sums[begin]

        of = [code == s for s in range(len(names))]
        n = np.stack([in_window(o.astype(np.int64)) for o in of])
        admins = np.stack([in_window((o & admin).astype(np.int64)) for o in of])
        w = np.stack([np.floor(in_window(weight * o) * fade * 1e9 + 0.5) / 1e9 for o in of])
        w[n == 0] = 0.0
        at = np.arange(n.shape[1])
        top = np.where(n > 0, w, -1.0).argmax(0)  # the first of the heaviest, by name
        crowd = np.where((n >= 4) & (n >= 3 * n[top, at]) & (admins[top, at] == 0), n, 0)
        crowd[top, at] = 0
        top = np.where(crowd.max(0) > 0, crowd.argmax(0), top)
        total = w.sum(0)
        ratio = np.where(total > 0, np.floor(w[top, at] / np.where(total > 0, total, 1.0) * 1e4 + 0.5) / 1e4, 0.0)
        high = (ratio >= 0.75) & (admins[top, at] > 0)
        return pd.DataFrame({"status": names[top], "ratio": ratio, "confidence": np.where(high, "high", np.where(ratio >= 0.5, "medium", "low"))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting = self.waiting.get()
        due = waiting[_ms_of(waiting["t"].to_numpy()) <= now] if waiting is not None else None
        shown, last = self.shown.get() if self.shown.exists() else (None, None)
        if due is None or not len(due):
            if last is not None and waiting is None and _ms(last + self.ttl) < now:
                self.shown.clear()
                self.recent.put(pd.DataFrame())
            return
        self.waiting.put(waiting[_ms_of(waiting["t"].to_numpy()) > now])
        due = due.sort_values(["t", "id"])
        recent = self.recent.get()
        while len(due):
            # as far as weights on one axis have their range
            most = np.searchsorted(due["t"].to_numpy(), due["t"].iloc[0] + int(256 * self.half), side="right")
            part, due = due.iloc[:most], due.iloc[most:]
            if recent is not None:
                recent = recent[part["t"].iloc[0] - recent["t"] <= self.window]
            old = 0 if recent is None else len(recent)
            reports = pd.concat([recent, part], ignore_index=True) if old else part.reset_index(drop=True)
            said = self._decided(reports, old)
            t, status = part["t"].to_numpy(), said["status"].to_numpy()
            before, then = np.append([shown], status[:-1]), np.append([t[0] if last is None else last], t[:-1])
            changed = (status != before) | (t - then > self.ttl)
            shown, last = status[-1], int(t[-1])
            recent = reports[last - reports["t"] <= self.window]
            if changed.any():
                rows = pd.DataFrame({"key": key[0], "direction": key[1], "t": t[changed], "id": part["id"].to_numpy()[changed]})
                yield pd.concat([rows, said[changed].reset_index(drop=True)], axis=1)
        self.recent.put(recent)
        self.shown.update((shown, last))
        self.handle.registerTimer(_ms(last + self.ttl) + 1)


def consensus_changes(
    updates: DataFrame, half_minutes: float = 30.0, hours: float = 6.0, admin: float = 5.0, ttl_hours: float = 36.0, time: str = "ts", delay: str = DELAY
) -> DataFrame:
    """(key, direction, ts, id, status, ratio, confidence) whenever a report changes the consensus.

    ``updates`` has id, key, direction, status, source_type and a time.  At each
    report, in order of time and id, the consensus of the last ``hours`` is that of
    ``facts.consensus``; it comes out if it differs from the one before, or if
    that is older than ``ttl_hours``, when it is forgotten.  A NULL direction is
    the empty one.
    """
    rows = _kept(_timed(updates.select("id", "key", "direction", "status", "source_type", time), time, delay), F.expr("key is not null and status is not null and id is not null"))
    rows = rows.withColumns({
        "direction": F.coalesce("direction", F.lit("")), "admin": F.coalesce(F.col("source_type") == "admin", F.lit(False)), "id": F.col("id").cast("bigint"),
    })
    schema = "key string, direction string, t bigint, id bigint, status string, ratio double, confidence string"
    made = rows.groupBy("key", "direction").transformWithStateInPandas(ConsensusProcessor(half_minutes, hours, admin, ttl_hours), schema, "Append", "EventTime")
    return made.select("key", "direction", _when("t").alias("ts"), "id", "status", "ratio", "confidence")


class LiveStatusProcessor(_Processor):
    """The latest status of a key by event time, until it is ``ttl_hours`` old."""

    def __init__(self, ttl_hours: float):
        self.ttl = int(ttl_hours * HOUR)

    def open(self, handle) -> None:
        self.latest = handle.getValueState("latest", "t bigint, id bigint, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.latest.get()) if self.latest.exists() else None
        best = max((r for pdf in rows for r in zip(pdf["micros"].tolist(), pdf["id"].tolist(), pdf["status"].tolist())), key=lambda r: r[:2])
        if held is not None and best[:2] <= held[:2]:
            return
        self.latest.update(best)
        self.handle.registerTimer(_ms(best[0] + self.ttl))
        yield pd.DataFrame({"key": [key[0]], "t": [best[0]], "id": [best[1]], "status": [best[2]], "expired": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.latest.exists():
            return
        t, i, status = self.latest.get()
        if _ms(t + self.ttl) <= expiredTimerInfo.getExpiryTimeInMs():
            self.latest.clear()
            yield pd.DataFrame({"key": [key[0]], "t": [t], "id": [i], "status": [status], "expired": [True]})


def live_status(updates: DataFrame, ttl_hours: float = 36.0, time: str = "ts", delay: str = DELAY) -> DataFrame:
    """(key, ts, id, status, expired): each newer status of a key, and each that got too old.

    Late rows change nothing.  State holds a key for ``ttl_hours`` after its latest
    status; the row with ``expired`` says that it is gone.
    """
    rows = _kept(_timed(updates.select("id", "key", "status", time), time, delay), F.expr("key is not null and status is not null and id is not null"))
    rows = rows.withColumn("id", F.col("id").cast("bigint"))
    made = rows.groupBy("key").transformWithStateInPandas(
        LiveStatusProcessor(ttl_hours), "key string, t bigint, id bigint, status string, expired boolean", "Update", "EventTime"
    )
    return made.select("key", _when("t").alias("ts"), "id", "status", "expired")


#: Pairs that a corroboration of sources holds at once, about.
PAIRS = 500_000
#: Alerts on either side of a tile of pairs; a source with a larger share of a type and area than this has tiles without its own alerts.
TILE, SHARE = 2048, 0.25


class CorroborationProcessor(_Processor):
    """Alerts of the last while; each new one meets those of its type and area from other sources.

    A key holds the (type, area) that are hashed to it.  Pairs come as tiles, for
    ``pairs_of``: up to ``tile`` alerts, as many earlier ones, and which of these, one
    after the other, each of the former meets.  So what a micro-batch makes here grows
    with its alerts, and with a small share of its pairs.  ``sources`` asks for the
    different sources that each alert meets, before or after it, instead of pairs.
    """

    def __init__(self, seconds: int, sources: bool, tile: int = TILE):
        self.window, self.sources, self.tile = seconds * 1_000_000, sources, tile

    def open(self, handle) -> None:
        self.alerts = _Table(handle, "alerts")

    def _held(self, alerts: pd.DataFrame, now_ms: int) -> pd.DataFrame:
        return alerts[_ms_of(alerts["t"].to_numpy() + self.window) >= now_ms]

    def _reach(self, later: pd.DataFrame, earlier: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``later`` the first place in ``earlier``, in order of ``axis``, and the place after the last."""
        at, axis = later["axis"].to_numpy(), earlier["axis"].to_numpy()
        return np.searchsorted(axis, at - self.window, side="left"), np.searchsorted(axis, at, side="right")

    def _met(self, later: pd.DataFrame, earlier: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs, the earlier in order of ``axis``; some at a time."""
        low, high = self._reach(later, earlier)
        sizes = high - low
        ends = np.cumsum(sizes)
        begin = 0
        while begin < len(sizes):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
            count = sizes[begin:end]
            a = np.repeat(np.arange(begin, end), count)
            b = np.arange(len(a)) + np.repeat(low[begin:end] - (np.cumsum(count) - count), count)
            apart = later["code"].to_numpy()[a] != earlier["code"].to_numpy()[b]
            yield a[apart], b[apart]
            begin = end

    def _tiles(self, later: pd.DataFrame, earlier: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Pairs of both in order of ``axis``; those of one source among them are left to ``pairs_of``."""
        low, high = self._reach(later, earlier)
        some = high > low
        low, high, later = low[some], high[some], later[some]
        ids, t, code = (later[c].to_numpy() for c in ("id", "t", "code"))
        others, codes = earlier["id"].to_numpy(), earlier["code"].to_numpy()
        for i in range(0, len(ids), self.tile):
            mine = slice(i, i + self.tile)
            for j in range(low[i], high[mine][-1], self.tile):
                first, end = np.maximum(low[mine], j), np.minimum(high[mine], j + self.tile)
                met = end > first
                if not met.any():
                    continue
                begin, over = first[met].min(), end[met].max()
                row = {
                    "ids": ids[mine][met], "ts": t[mine][met], "code": code[mine][met],
                    "first": (first[met] - begin).astype(np.int32), "last": (end[met] - 1 - begin).astype(np.int32),
                    "others": others[begin:over], "codes": codes[begin:over], "pairs": int((end - first)[met].sum()),
                }
                yield pd.DataFrame({k: [v] for k, v in row.items()})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        fresh = pd.concat(list(rows))[["type", "area", "source", "id", "micros"]].rename(columns={"micros": "t"}).assign(fresh=True)
        held = self.alerts.get()
        if held is not None:
            fresh = pd.concat([self._held(held, now).assign(fresh=False), fresh])
        self.alerts.put(self._held(fresh, now).drop(columns="fresh"))
        self.handle.registerTimer(_ms(int(fresh["t"].max()) + self.window) + 1)
        group = fresh.groupby(["type", "area"], sort=False).ngroup().to_numpy()
        t = fresh["t"].to_numpy() - fresh["t"].min()
        # groups one after the other on one axis, farther apart than an alert looks back
        every = fresh.assign(group=group, axis=group * (t.max() + self.window + 1) + t, code=pd.factorize(fresh["source"])[0].astype(np.int32)).sort_values("axis")
        if not self.sources:
            # large sources of a group are numbered; in turn, one of each group meets all others of its group
            sizes = every.groupby(["group", "code"]).size()
            large = sizes[sizes > SHARE * sizes.groupby("group").transform("sum")]
            number = large.groupby("group").cumcount().rename("number")
            every = every.join(number, on=["group", "code"]).fillna({"number": -1})
            for n in (-1, *range(int(number.max()) + 1 if len(number) else 0)):
                mine = every[every["number"] == n]
                theirs = every if n < 0 else every[every["number"] != n]
                yield from self._tiles(mine[mine["fresh"]], theirs)
                yield from self._tiles(mine[~mine["fresh"]], theirs[theirs["fresh"]])
            return
        new, old = every[every["fresh"]], every[~every["fresh"]]
        for later, earlier in ((new, every), (old, new)):
            for a, b in self._met(later, earlier):
                if not len(a):
                    continue
                for one, x, other, y in ((later, a, earlier, b), (earlier, b, later, a)):
                    many = int(every["code"].max()) + 1
                    met, code = np.divmod(np.unique(x * many + other["code"].to_numpy()[y]), many)
                    names = every["source"].to_numpy()[np.unique(every["code"].to_numpy(), return_index=True)[1]]
                    yield pd.DataFrame({"id": one["id"].to_numpy()[met], "source": names[code]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.alerts.get()
        if held is not None:
            self.alerts.put(self._held(held, expiredTimerInfo.getExpiryTimeInMs()))
        return iter(())


def _meeting(alerts: DataFrame, schema: str, processor: CorroborationProcessor, time: str, delay: str) -> DataFrame:
    rows = _timed(alerts.select("id", "type", "area", "source", time), time, delay)
    rows = _kept(rows, F.expr("id is not null and type is not null and area is not null and source is not null"))
    schema = schema.format(id=rows.schema["id"].dataType.simpleString())
    return rows.withColumn("slot", _slot("type", "area")).groupBy("slot").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def corroboration_tiles(alerts: DataFrame, seconds: int = 1800, time: str = "ts", delay: str = DELAY, tile: int = TILE) -> DataFrame:
    """The pairs of ``corroborated`` as tiles, from which ``pairs_of`` makes them: for a sink that pairs would fill."""
    schema = "ids array<{id}>, ts array<bigint>, code array<int>, first array<int>, last array<int>, others array<{id}>, codes array<int>, pairs bigint"
    return _meeting(alerts, schema, CorroborationProcessor(seconds, False, tile), time, delay)


def pairs_of(tiles: DataFrame, time: str = "ts") -> DataFrame:
    """Pairs (id, other, ts) of ``corroboration_tiles``; compiled, as no array leaves the step."""
    i = F.col("__i")
    alerts = tiles.select("ts", "code", "first", "last", "others", "codes", F.posexplode("ids").alias("__i", "id"))
    alerts = alerts.select("id", _when(F.col("ts")[i]).alias(time), F.col("code")[i].alias("code"), F.col("first")[i].alias("first"), F.col("last")[i].alias("last"), "others", "codes")
    reach = F.slice("others", F.col("first") + 1, F.col("last") - F.col("first") + 1)
    met = alerts.select("id", time, "code", "first", "codes", F.posexplode(reach).alias("__p", "other"))
    return met.filter(F.col("codes")[F.col("first") + F.col("__p")] != F.col("code")).select("id", "other", time)


def corroborated(alerts: DataFrame, seconds: int = 1800, sources: bool = False, time: str = "ts", delay: str = DELAY) -> DataFrame:
    """Pairs (id, other, ts) of alerts of one type and area, other source, at most ``seconds`` before ``ts``.

    ``alerts`` has id, type, area, source and a time; rows without one of these are
    left out.  With ``sources`` the rows are (id, source): what each alert of a pair
    meets, mostly once a micro-batch.  State holds alerts for ``seconds`` after the watermark has passed them.
    """
    if sources:
        return _meeting(alerts, "id {id}, source string", CorroborationProcessor(seconds, True), time, delay)
    return pairs_of(corroboration_tiles(alerts, seconds, time, delay), time)


class BandProcessor(_Processor):
    """Messages of the last while by band of their sketch; those that share one are candidates.

    A key holds the bands that are hashed to it, each with its messages, and is read
    and written whole, once a micro-batch.
    """

    def __init__(self, seconds: int, most: int, threshold: float):
        self.window, self.most, self.threshold = seconds * 1_000_000, most, threshold

    def open(self, handle) -> None:
        self.members = _Table(handle, "members")

    def _held(self, members: pd.DataFrame, now_ms: int) -> pd.DataFrame:
        """What a message that is not late can still meet."""
        return members[_ms_of(members["t"].to_numpy() + self.window) >= now_ms]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        fresh = pd.concat(list(rows))[["band", "micros", "id", "n"]].rename(columns={"micros": "t"}).assign(fresh=True)
        held = self.members.get()
        if held is not None:
            fresh = pd.concat([self._held(held, now).assign(fresh=False), fresh])
        held = fresh.drop_duplicates(["band", "t", "id", "n"]).sort_values(["band", "t", "id"])
        if not held["fresh"].any():
            return
        band, t, i, n, new = (held[c].to_numpy() for c in ("band", "t", "id", "n", "fresh"))
        found = []
        for lag in range(1, min(self.most, len(t) - 1) + 1):
            close = (band[lag:] == band[:-lag]) & (t[lag:] - t[:-lag] <= self.window)
            if not close.any():
                break
            k = np.flatnonzero(close & (new[lag:] | new[:-lag])) + lag
            k = k[np.minimum(n[k], n[k - lag]) > self.threshold * np.maximum(n[k], n[k - lag]) - 1e-4]
            found.append(pd.DataFrame({"id": i[k], "other": i[k - lag]}))
        self.members.put(self._held(held.drop(columns="fresh"), now))
        self.handle.registerTimer(_ms(int(t[new].max()) + self.window) + 1)
        pairs = pd.concat(found).drop_duplicates() if found else ()
        if len(pairs):
            yield pairs

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.members.get()
        if held is not None:
            self.members.put(self._held(held, expiredTimerInfo.getExpiryTimeInMs()))
        return iter(())


#: Bands of two min-wise hashes: a pair at a similarity of 0.6 is missed with probability 2e-8.
BANDS, BAND_ROWS = 40, 2


def bands(words: pd.Series) -> pd.Series:
    """Band hashes of arrays of word hashes; none for no words.

    The least of words XOR a fixed mask is a min-wise hash, as words are hashed already.
    """
    masks = np.random.default_rng(1).integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)

    def of(w) -> list[int]:
        if w is None or not len(w):
            return []
        hashes = np.asarray(w, dtype=np.int64).view(np.uint64)
        least = np.full(len(masks), np.iinfo(np.uint64).max, dtype=np.uint64)
        for k in range(0, len(hashes), 4096):
            np.minimum(least, (hashes[k : k + 4096, None] ^ masks).min(0), out=least)
        mixed = np.arange(BANDS, dtype=np.uint64)
        for column in least.reshape(BANDS, BAND_ROWS).T:
            mixed = (mixed ^ column) * odd
            mixed ^= mixed >> np.uint64(32)
        return mixed.view(np.int64).tolist()

    with np.errstate(over="ignore"):
        return words.map(of)


def near_duplicate_candidates(
    messages: DataFrame, key: str, text: str, time: str, seconds: int = 1800, most: int = 50, least_chars: int = 15, threshold: float = 0.6, delay: str = DELAY
) -> DataFrame:
    """(key, other): pairs within ``seconds`` that share a band of their sketches, the later first.

    Keys are whole numbers.  Of a band's messages each meets the ``most`` before it.
    State holds key, time and number of words for ``seconds`` after a message, and
    goes when the watermark has passed that.  Messages of fewer than
    ``least_chars`` characters are left out.  A pair may come several times;
    ``identity.similar_pairs`` verifies them, each once.
    """
    from ..functions.text import message_fingerprint, word_set

    rows = _timed(messages.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), time), time, delay)
    rows = _kept(rows.withColumn("f", message_fingerprint(F.col("text"))), F.col("id").isNotNull() & (F.length("f") >= least_chars))
    rows = rows.withColumn("w", F.transform(word_set(F.col("f")), lambda w: F.xxhash64(w)))
    rows = rows.select("id", time, "micros", F.size("w").alias("n"), F.explode(F.pandas_udf(bands, "array<bigint>")(F.col("w"))).alias("band"))
    rows = rows.withColumn("slot", F.pmod("band", F.lit(SLOTS)).cast("int"))
    made = rows.groupBy("slot").transformWithStateInPandas(BandProcessor(seconds, most, threshold), "id bigint, other bigint", "Append", "EventTime")
    return made.select(F.col("id").alias(key), "other")
