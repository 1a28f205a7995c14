"""Chunker for streams whose frames come out of order: a buffer in state, event-time timers, and an end.

Frames wait in the clip's state until those before them are there.  The watermark stays `wait` behind the latest
event time; once it passes a frame that waits, the gap before that frame is given up and what waits goes on, in order,
up to the next gap.  A frame that comes after its place has been passed is told as late, or dropped by Spark if it is
behind the watermark.  A clip without frames for `idle` of event time has ended: what waits is flushed, its state
is deleted, and the same key begins anew.

State holds the frames that came behind a gap; `wait` bounds them.  It is one row for a pack of clips of neighbouring numbers, read
once and written once when frames of the pack come, and a pack has one timer, for what is due first: clips are many, and each question
to the store is a round trip.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.segment import CutRules, CutState, cut_step
from .online import by_clip, level, packed, told

IN = "clip_id long, frame_idx int, ptype string, luma double, ts timestamp"
KINDS = "long, double, double, double, int, int, int, int, long".split(", ")
NAMES = "clip, luma, base, chroma_base, last, chunk, held, next, end".split(", ")
STATE = "timer long, " + ", ".join(f"{n} array<{k}>" for n, k in zip(NAMES, KINDS, strict=True)) + ", w_clip array<long>, w_idx array<int>, w_kind array<string>, w_luma array<double>, w_ms array<long>"
OUT = "clip_id long, frame_idx int, ptype string, luma double, diff double, is_cut boolean, chunk_id int, late boolean"
WAIT_MS, IDLE_MS = 10_000, 60_000


EPOCH = datetime(1970, 1, 1)


def ms_of(ts: datetime | None) -> int:
    """Milliseconds of a timestamp, of whatever zone; a frame without one counts as the oldest."""
    if ts is None:
        return 0
    own = ts.astimezone(timezone.utc).replace(tzinfo=None) if ts.tzinfo else ts
    return (own - EPOCH) // timedelta(milliseconds=1)


ROW = Row(*(c.split()[0] for c in OUT.split(", ")))


class Clip:
    """State of a clip: its detector, the event time of its end, and what waits: {frame_idx: (ptype, luma, ms)}."""

    def __init__(self) -> None:
        self.cut, self.chunk, self.n, self.next, self.end = CutState(), 0, 0, 0, None
        self.waiting: dict[int, tuple] = {}

    def due(self) -> int:
        """When the clip ends or its first gap is given up."""
        return min([self.end, *(f[2] for f in self.waiting.values())])


def restored(held: tuple | None) -> tuple[int | None, dict[int, Clip]]:
    """The timer of a pack and its clips."""
    clips: dict[int, Clip] = {}
    if held is None:
        return None, clips
    timer, *rest = held
    for clip, luma, base, chroma_base, last, chunk, n, after, end in zip(*rest[: len(NAMES)], strict=True):
        c = clips[clip] = Clip()
        c.cut.luma, c.cut.base, c.cut.chroma_base, c.cut.last, c.chunk, c.n, c.next, c.end = luma, base, chroma_base, last, chunk, n, after, end
    for clip, idx, kind, luma, ms in zip(*rest[len(NAMES) :], strict=True):
        clips[clip].waiting[idx] = (kind, level(luma), ms)
    return timer, clips


def stored(timer: int, clips: dict[int, Clip]) -> tuple:
    own = [(i, c.cut.luma, c.cut.base, c.cut.chroma_base, c.cut.last, c.chunk, c.n, c.next, c.end) for i, c in clips.items()]
    waiting = [(i, idx, *f) for i, c in clips.items() for idx, f in c.waiting.items()]
    columns = lambda rows, n: [list(v) for v in zip(*rows, strict=True)] or [[] for _ in range(n)]
    return timer, *columns(own, len(NAMES)), *columns(waiting, 5)


class OrderedChunks(StatefulProcessor):
    """Cuts and chunk numbers of the frames of a pack of clips, whatever the order in which they come."""

    def __init__(self, rules: CutRules = CutRules(), soft_cap: int = 48, idle_ms: int = IDLE_MS):
        self.rules, self.soft_cap, self.idle_ms = rules, soft_cap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.step = handle, cut_step(self.rules)
        self.held = handle.getValueState("pack", STATE)

    def _released(self, clip, c: Clip, frames: list[tuple]) -> list[Row]:
        """Rows of frames (index, ptype, luma) that go on, in order."""
        out = []
        for idx, kind, luma in frames:
            diff, cut, _ = self.step(c.cut, idx, kind, luma, None)
            if c.n and (kind == "I" or cut or (c.n >= self.soft_cap and kind == "P")):
                c.chunk, c.n = c.chunk + 1, 0
            c.n, c.next = c.n + 1, idx + 1
            out.append(ROW(clip, idx, kind, told(luma), told(diff), cut, c.chunk, False))
        return out

    def _save(self, timer: int | None, clips: dict[int, Clip], fired: int | None = None) -> None:
        """Writes the state and moves the timer; Spark itself drops the one that has fired."""
        due = min((c.due() for c in clips.values()), default=None)
        if due != timer:
            if timer is not None and timer != fired:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if clips:
            self.held.update(stored(due, clips))
        else:
            self.held.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        timer, clips = restored(self.held.get())
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for clip, frames in by_clip(rows, lambda r: (r.frame_idx, r.ptype, level(r.luma), ms_of(r.ts))).items():
            c = clips.setdefault(clip, Clip())
            if c.end is not None and now >= c.end:  # its timer comes after these rows
                out += self._ended(clip, c)
                c = clips[clip] = Clip()
            new: dict[int, tuple] = {}
            for idx, *f in frames:
                new.setdefault(idx, tuple(f))
                c.end = max(c.end or self.idle_ms, f[2] + self.idle_ms)
            out += [ROW(clip, i, new[i][0], told(new[i][1]), None, False, None, True) for i in sorted(new) if i < c.next]
            ready, at = [], c.next
            while at in new or at in c.waiting:
                old = c.waiting.pop(at, None)
                ready.append((at, *new.pop(at, old)[:2]))
                at += 1
            out += self._released(clip, c, ready)
            c.waiting |= {i: f for i, f in new.items() if i > c.next}
        self._save(timer, clips)
        return iter(out)

    def _ended(self, clip, c: Clip) -> list[Row]:
        """Rows of what waits."""
        return self._released(clip, c, [(i, *f[:2]) for i, f in sorted(c.waiting.items())])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        timer, clips = restored(self.held.get())
        fired = expiredTimerInfo.getExpiryTimeInMs()
        now, out = max(fired, timerValues.getCurrentWatermarkInMs()), []
        for clip, c in list(clips.items()):
            if now >= c.end:
                out += self._ended(clip, clips.pop(clip))
                continue
            # gaps are given up: up to the last frame that has waited long enough, and what follows it without a gap
            waiting = sorted((i, *f) for i, f in c.waiting.items())
            n = max((k for k, w in enumerate(waiting, 1) if w[3] <= now), default=0)
            while 0 < n < len(waiting) and waiting[n][0] == waiting[n - 1][0] + 1:
                n += 1
            out += self._released(clip, c, [w[:3] for w in waiting[:n]])
            c.waiting = {w[0]: w[1:] for w in waiting[n:]}
        self._save(timer, clips, fired)
        return iter(out)

    def close(self) -> None:
        pass


def ordered_chunks(frames: DataFrame, rules: CutRules = CutRules(), soft_cap: int = 48, wait_ms: int = WAIT_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """A streaming DataFrame of frames (IN) with diff, is_cut and chunk_id; late ones come with late = true and no chunk."""
    own = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{wait_ms} milliseconds")
    return packed(own).transformWithState(OrderedChunks(rules, soft_cap, idle_ms), OUT, "append", "eventTime")
