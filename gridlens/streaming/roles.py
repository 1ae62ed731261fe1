"""Roles of rows over an unbounded feed: the ordered scan of a sheet as a state machine with one state a sheet.

The feed brings facts of rows (`operators.rows.row_facts`: one for each row of a sheet, empty ones too) in any order and
number. A sheet's state is what the scan remembers: the next row, whether there was an anchor, the last of them, the group and
two sums. A row that comes before its turn waits in the state until all rows before it are there; one that comes again
is dropped. So the roles are those of `operators.rows.row_roles` over the finished sheet, however the feed is cut, and a
query that is started again from its checkpoint goes on where it stood.

Each row has a time (`at`). A sheet that has brought nothing for `idle`, by the watermark of the whole feed, is over: rows that
still wait get their roles as if those missing were empty, and the state goes. A row that is late by more than `idle` is
dropped, so a sheet that is over does not begin again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridlens.operators.rows import TOLERANCE
from gridlens.sources.grids import SHEET

_FACTS = "has_id boolean, term boolean, qty double, top int, filled boolean, known boolean, occupied boolean"
_NAMES = [f.split()[0] for f in _FACTS.split(", ")]
ROLES = "workbook_id string, sheet string, r int, role string, group_id int, anchor_idx int"
_SCAN = "next int, anchor int, groups int, grand double, start double"
#: The scan before the first row: no anchor, no group, nothing summed.
_BEGIN = (1, None, 0, 0.0, 0.0)


def step(scan: tuple, row: int, facts: tuple) -> tuple[tuple, tuple]:
    """(the scan after a row, its role, group and anchor)."""
    _, anchor, groups, grand, start = scan
    has_id, term, qty, top, filled, known, occupied = facts
    is_anchor = bool(has_id and not term and top in (None, row))
    late = anchor is not None
    if is_anchor:
        anchor, groups, start = row, groups + 1, grand
    is_child = bool(occupied and not has_id and filled and anchor is not None)
    near = lambda total: qty is not None and abs(total - qty) < TOLERANCE
    if not occupied or not known:
        role = "blank"
    elif is_anchor:
        role = "anchor"
    elif term:
        role = "repeat_header" if late else "header"
    elif is_child:
        role = "child"
    elif not has_id and anchor is not None and near(grand - start):
        role = "total"
    elif not has_id and near(grand):
        role = "grand_total"
    else:
        role = "blank"
    if (is_anchor or is_child) and qty is not None:
        grand += qty
    inside = role in ("anchor", "child")
    return (row + 1, anchor, groups, grand, start), (role, groups - 1 if inside else None, anchor if role == "child" else None)


class RoleScan(StatefulProcessor):
    """The scan of one sheet."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scan = handle.getValueState("scan", _SCAN)
        self.waiting = handle.getMapState("waiting", "r int", _FACTS)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        scan = tuple(self.scan.get()) if self.scan.exists() else _BEGIN
        latest = 0
        for frame in rows:
            latest = max(latest, int(frame["at"].max().value // 1_000_000))
            fresh = {r: facts for r, *facts in frame[["r", *_NAMES]].sort_values("r").itertuples(index=False)}
            out = []
            for r in sorted(fresh):
                if r < scan[0]:
                    continue
                if r > scan[0]:
                    self.waiting.updateValue((int(r),), self._plain(fresh[r]))
                    continue
                scan = self._taken(scan, r, self._plain(fresh[r]), out)
                while self.waiting.containsKey((scan[0],)):
                    r = scan[0]
                    facts = tuple(self.waiting.getValue((r,)))
                    self.waiting.removeKey((r,))
                    scan = self._taken(scan, r, facts, out)
            yield self._frame(key, out)
        self.scan.update(scan)
        timers = list(self.handle.listTimers())
        if all(t < latest + self.idle_ms for t in timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(latest + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        scan = tuple(self.scan.get()) if self.scan.exists() else _BEGIN
        out: list[tuple] = []
        for (r,), facts in sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator()):
            scan = self._taken(scan, r, facts, out)
        self.waiting.clear()
        self.scan.clear()
        yield self._frame(key, out)

    def close(self) -> None:
        pass

    @staticmethod
    def _plain(facts: list) -> tuple:
        """Facts as Python values, none where a frame holds NaN."""
        kinds = (bool, bool, float, int, bool, bool, bool)
        return tuple(None if pd.isna(v) else kind(v) for kind, v in zip(kinds, facts, strict=True))

    @staticmethod
    def _taken(scan: tuple, r: int, facts: tuple, out: list[tuple]) -> tuple:
        scan, found = step(scan, int(r), facts)
        out.append((int(r), *found))
        return scan

    @staticmethod
    def _frame(key: Any, rows: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(rows, columns=["r", "role", "group_id", "anchor_idx"]).astype({"r": "Int32", "role": object, "group_id": "Int32", "anchor_idx": "Int32"})
        found.insert(0, "workbook_id", key[0])
        found.insert(1, "sheet", key[1])
        return found


def facts_of_feed(facts: DataFrame) -> DataFrame:
    """Row facts in the flat form that the state holds."""
    return facts.select(*SHEET, "at", "r", F.col("id").isNotNull().alias("has_id"), F.coalesce("id.term", F.lit(False)).alias("term"), "qty", F.col("region.r1").alias("top"), F.coalesce("region.filled", F.lit(False)).alias("filled"), "known", "occupied")


def roles_of_feed(facts: DataFrame, idle_seconds: int = 3600) -> DataFrame:
    """(workbook_id, sheet, r, role, group_id, anchor_idx) of a feed of row facts with their time `at`, each row once, as soon as its turn is reached.

    The session needs the state store that keeps states on disk: spark.sql.streaming.stateStore.providerClass, as
    `session.local_session` sets it.
    """
    fed = facts_of_feed(facts).withWatermark("at", f"{idle_seconds} seconds")
    return fed.groupBy(*SHEET).transformWithStateInPandas(RoleScan(idle_seconds * 1000), ROLES, "Append", "EventTime")
