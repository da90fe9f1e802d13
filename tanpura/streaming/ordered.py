"""Folds that need a key's rows in the order of their time, for streams whose files come in any order.

A key's rows wait in the state until the watermark, which stands a set delay behind the latest row of all, has passed
them; a timer then hands them to the fold in order. So the result doesn't depend on how the log is cut into micro-batches
as long as no row is later than the delay. A row that comes after a later one of its key was handed on can't change what
was decided; it is given out at once, marked late, instead of being lost. What waits is a delay's worth of rows.

The state goes by groups of keys: a group has one timer, and its rows and its keys are kept as lists in text (JSON), so
that calls of the state aren't made for each key or row. What a group keeps of a key is read with each timer only as long
as the fold needs it; after that it is put away in a list that only late rows have read.

The watermark has to be of a column that doesn't reach the fold, as Spark would drop late rows before it otherwise:
in_order() sees to that.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tanpura.streaming.guard import GROUPS

#: Rows of a piece of what waits, and additions to what is put away after which it is written anew, without repeats.
PIECE, ADDITIONS = 1000, 64


def place(us: int, id: int | None) -> tuple[int, bool, int]:
    """Order of a key's rows: time, then id (null first)."""
    return us, id is not None, id or 0


class InOrder(StatefulProcessor):
    """Hands keys' rows to fold() in order. What fold() keeps of a key is None or anything that JSON can write."""

    #: Names of the columns that fold() gives and of those that a late row gives, in order; all get a column late.
    COLUMNS: tuple[str, ...] = ()

    def fold(self, key: int | None, kept: Any, rows: list[tuple[int, int | None, str]], until: int) -> tuple[list[tuple], Any]:
        """A key's rows before the time until, all that there are since the last call, to rows of COLUMNS and what is kept now."""
        raise NotImplementedError

    def needed(self, kept: Any, until: int) -> bool:
        """Whether what is kept can matter to a row at or after until."""
        return kept is not None

    def due(self, kept: Any) -> int | None:
        """A time at which fold() is to be called even if no row waits."""
        return None

    def late_row(self, key: int | None, row: tuple[int, int | None, str]) -> tuple:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Lists of (key, us, id, what), the first of them at the time low.
        self.waiting = handle.getListState("waiting", "low long, rows string")
        # Lists of (key, us and id of its last row, kept): what the fold needs, as of the last timer, and the rest.
        self.live = handle.getValueState("live", "until long, additions int, keys string")
        self.past = handle.getListState("past", "keys string")
        self.timer = handle.getValueState("timer", "ms long")

    def alive(self) -> tuple[int | None, int, dict]:
        until, additions, keys = self.live.get() if self.live.exists() else (None, 0, "[]")
        return until, additions, {k[0]: k for k in json.loads(keys)}

    def put_away(self) -> dict:
        """The latest of each key."""
        return {k[0]: k for (keys,) in self.past.get() for k in json.loads(keys)}

    def table(self, rows: list[tuple], late: bool) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=list(self.COLUMNS), dtype=object)
        return made.assign(late=late)

    def pieces(self, rows: list) -> list[tuple[int, str]]:
        rows.sort(key=lambda r: r[1])
        return [(rows[i][1], json.dumps(rows[i : i + PIECE])) for i in range(0, len(rows), PIECE)]

    def wake(self, us: int | None) -> None:
        """Have the timer at the first millisecond after us, if that is earlier than it stands."""
        if us is None:
            return
        ms = us // 1000 + 1
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is None or ms < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until, _, live = self.alive()
        past, first = None, None
        for part in rows:
            null_key, null_id = part["no_key"].tolist(), part["no_id"].tolist()
            cells = zip(part["key"].tolist(), part["us"].tolist(), part["id"].tolist(), part["what"].tolist(), null_key, null_id, strict=True)
            good, late = [], []
            for k, us, i, what, no_key, no_id in cells:
                row = (None if no_key else k, us, None if no_id else i, what)
                if until is not None and us < until:
                    past = self.put_away() if past is None else past
                    last = live.get(row[0]) or past.get(row[0])
                    if last and place(*row[1:3]) < place(*last[1:3]):
                        late.append(self.late_row(row[0], row[1:]))
                        continue
                good.append(row)
            if good:
                pieces = self.pieces(good)
                self.waiting.appendList(pieces)
                first = pieces[0][0] if first is None else min(first, pieces[0][0])
            if late:
                yield self.table(late, True)
        self.wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        before, additions, live = self.alive()
        ready, left, rest = {}, [], []
        for low, rows in self.waiting.get():
            if low >= until:
                left.append((low, rows))
                continue
            for row in json.loads(rows):
                if row[1] < until:
                    ready.setdefault(row[0], []).append(tuple(row[1:]))
                else:
                    rest.append(row)
        left += self.pieces(rest)
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        # What is put away can matter to rows before the last timer's time only.
        past = self.put_away() if before is not None and any(r[0] < before for rows in ready.values() for r in rows) else {}
        made, stay, go = [], [], []
        for k in [*ready, *(k for k in live if k not in ready)]:
            rows = sorted(ready.get(k, ()), key=lambda r: (place(*r[:2]), r[2]))
            _, us, id, kept = live.get(k) or past.get(k) or (k, None, None, None)
            rows_made, kept = self.fold(k, kept, rows, until)
            made += rows_made
            us, id = rows[-1][:2] if rows else (us, id)
            (stay if self.needed(kept, until) else go).append((k, us, id, kept))
        if go:
            if additions < ADDITIONS:
                self.past.appendValue((json.dumps(go),))
                additions += 1
            else:
                self.past.put([(json.dumps(list((self.put_away() | {k[0]: k for k in go}).values())),)])
                additions = 1
        self.live.update((until, additions, json.dumps(stay)))
        self.timer.clear()
        self.wake(min((t for t in (*(low for low, _ in left), *(self.due(k[3]) for k in stay)) if t is not None), default=None))
        if made:
            yield self.table(made, False)

    def close(self) -> None:
        pass


class InFlight(InOrder):
    """Accepts a call iff so many seconds have passed since the session's last accepted one, which is kept; a late call gets null."""

    COLUMNS = ("recording_id", "session_id", "accepted")
    SCHEMA = "recording_id long, session_id long, accepted boolean, late boolean"

    def __init__(self, seconds: float):
        self.gap = round(seconds * 1_000_000)

    def fold(self, key, kept, rows, until):
        last, made = kept, []
        for us, recording, _ in rows:
            taken = last is None or us >= last + self.gap
            last = us if taken else last
            made.append((recording, key, taken))
        return made, last

    def needed(self, kept, until):
        return kept is not None and kept + self.gap > until

    def late_row(self, key, row):
        return row[1], key, None


class Expiry(InOrder):
    """Drops a dismissed notification so many milliseconds after its first DISMISS, unless the session's next ADD comes before; a late row gives its event.

    Kept are the notification and when it expires.
    """

    COLUMNS = ("session_id", "toast_id", "expires_ms")
    SCHEMA = "session_id long, toast_id long, expires_ms long, late boolean"

    def __init__(self, delay_ms: int):
        self.delay = delay_ms

    def fold(self, key, kept, rows, until):
        toast, expires = kept or (None, None)
        made = []
        for us, event, what in rows:
            if what == "ADD":
                if expires is not None and expires <= us // 1000:
                    made.append((key, toast, expires))
                toast, expires = event, None
            elif toast is not None and expires is None:
                expires = us // 1000 + self.delay
        if expires is not None and expires * 1000 < until:  # no ADD can come before it any more
            made.append((key, toast, expires))
            toast = expires = None
        return made, None if toast is None else (toast, expires)

    def due(self, kept):
        return None if kept[1] is None else kept[1] * 1000

    def late_row(self, key, row):
        return key, row[1], None


class Pending(InOrder):
    """Calls without a result within so many microseconds. The key is the recording, what is = and the session's number (none: null), or DONE; a late row has no decision.

    Kept are the open calls, as (us, what).
    """

    DONE = ""
    COLUMNS = ("recording_id", "session_id")
    SCHEMA = "recording_id long, session_id long, late boolean"

    def __init__(self, within: int):
        self.within = within

    @staticmethod
    def session(what: str) -> int | None:
        return int(what[1:]) if what[1:] else None

    def fold(self, key, kept, rows, until):
        calls = kept or []
        for us, _, what in rows:
            if what == self.DONE:
                calls = [c for c in calls if c[0] < us - self.within]
            else:
                calls.append((us, what))
        over = [c for c in calls if c[0] + self.within < until]
        left = [c for c in calls if c[0] + self.within >= until]
        return [(key, self.session(what)) for _, what in over], left or None

    def due(self, kept):
        return min(us + self.within for us, _ in kept)

    def late_row(self, key, row):
        return key, self.session(row[2])


def in_order(rows: DataFrame, key: str, at: str, what: Column, order: str, processor: InOrder, delay: str, before: Column) -> DataFrame:
    """The stream rows folded by key. at is a timestamp, key and order are longs (a null key is a key); rows whose time isn't below before only move the watermark."""
    marked = rows.withWatermark(at, delay)
    # Only numbers derived from it go on, so that late rows reach the fold.
    events = marked.select(F.col(key).alias("key"), F.unix_micros(at).alias("us"), F.col(order).alias("id"), what.alias("what")).where(F.col("us") < F.unix_micros(before))
    # Never null: pandas makes doubles of longs among which one is null.
    whole = events.withColumns({"no_key": F.col("key").isNull(), "no_id": F.col("id").isNull()}).withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("key", "id")})
    grouped = whole.withColumn("group", F.pmod(F.xxhash64("key", "no_key"), F.lit(GROUPS)).cast("int")).groupBy("group")
    return grouped.transformWithStateInPandas(processor, processor.SCHEMA, "Append", "EventTime")
