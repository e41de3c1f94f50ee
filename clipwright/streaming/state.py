"""Operators whose state ends: tracks, layouts and smoothed speakers of videos that stop are let go."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A video without a frame for so long is over, and its state is dropped.
IDLE_MS = 600_000


class Ending(StatefulProcessor):
    """A processor that sets a timer after each batch of a key and clears its state when the last one expires."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")
        self.start(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(at)
        self.timer.update((at,))
        yield self.step(key[0], pd.concat(list(rows)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.timer.clear()
        self.drop()
        return iter(())

    def close(self) -> None:
        pass


class Tracks(Ending):
    """Live tracks as map state, each under its own key, and how many a video has had."""

    def __init__(self, reach: float, lost_after: int, idle_ms: int):
        super().__init__(idle_ms)
        self.reach, self.lost_after = reach, lost_after

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.made = handle.getValueState("made", "n long")
        self.live = handle.getMapState("live", "track string", "made long, frame long, x long, y long, class string")

    def step(self, video, frames: pd.DataFrame) -> pd.DataFrame:
        made = self.made.get()[0] if self.made.exists() else 0
        live = {key[0]: list(value) for key, value in self.live.iterator()} if self.live.exists() else {}
        before, out = {k: tuple(v) for k, v in live.items()}, []
        for r in frames.sort_values(["frame_no", "det_id"]).itertuples():
            live = {k: t for k, t in live.items() if r.frame_no - t[1] <= self.lost_after}
            near = [(((r.cx - t[2]) ** 2 + (r.cy - t[3]) ** 2) ** 0.5, t[0], k) for k, t in live.items() if t[4] == r.class_name]
            near = [n for n in near if n[0] < self.reach]
            if near:
                track = min(near)[2]
                live[track][1:4] = [int(r.frame_no), int(r.cx), int(r.cy)]
            else:
                made += 1
                track = f"{r.class_name}_{made}"
                live[track] = [made, int(r.frame_no), int(r.cx), int(r.cy), r.class_name]
            out.append((video, r.frame_no, r.det_id, track))
        for track in before.keys() - live.keys():
            self.live.removeKey((track,))
        for track, value in live.items():
            if before.get(track) != tuple(value):
                self.live.updateValue((track,), tuple(value))
        self.made.update((made,))
        return pd.DataFrame(out, columns=["video_id", "frame_no", "det_id", "track"])

    def drop(self) -> None:
        self.made.clear()
        self.live.clear()


class Layouts(Ending):
    """The last layouts of a video as list state."""

    def __init__(self, steady: int, idle_ms: int):
        super().__init__(idle_ms)
        self.steady = steady

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getListState("past", "layout string")

    def step(self, video, frames: pd.DataFrame) -> pd.DataFrame:
        past, out, n = [x[0] for x in self.past.get()] if self.past.exists() else [], [], self.steady
        for r in frames.sort_values("frame_no").itertuples():
            own = "split_screen" if r.speakers >= 2 else "single_speaker"
            past = [*past, own][-2 * n :]
            now, old = past[-n:], past[:-n]
            out.append((video, r.frame_no, own if len(now) == n and set(now) == {own} else old[0] if old and len(set(old)) == 1 else own))
        self.past.put([(x,) for x in past])
        return pd.DataFrame(out, columns=["video_id", "frame_no", "layout"])

    def drop(self) -> None:
        self.past.clear()


class Speakers(Ending):
    """The last boxes of each speaker, one cell of a hundred pixels, as map state."""

    def __init__(self, last: int, idle_ms: int):
        super().__init__(idle_ms)
        self.last = last

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.boxes = handle.getMapState("boxes", "speaker string", "past array<long>")

    def step(self, video, frames: pd.DataFrame) -> pd.DataFrame:
        held = {key[0]: [list(value[0][i : i + 4]) for i in range(0, len(value[0]), 4)] for key, value in self.boxes.iterator()} if self.boxes.exists() else {}
        out, seen = [], set()
        for r in frames.sort_values(["ts", "det_id"]).itertuples():
            speaker = f"{r.cx // 100}_{r.cy // 100}"
            seen.add(speaker)
            held[speaker] = past = [*held.get(speaker, []), [int(r.x1), int(r.y1), int(r.x2), int(r.y2)]][-self.last :]
            weight = len(past) * (len(past) + 1) / 2
            out.append((video, speaker, r.det_id, *(int(sum(b[c] * (i + 1) for i, b in enumerate(past)) / weight // 1) for c in range(4))))
        for speaker in seen:
            self.boxes.updateValue((speaker,), ([x for box in held[speaker] for x in box],))
        return pd.DataFrame(out, columns=["video_id", "speaker", "det_id", "s_x1", "s_y1", "s_x2", "s_y2"])

    def drop(self) -> None:
        self.boxes.clear()


def _with_state(stream: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    return stream.groupBy("video_id").transformWithStateInPandas(processor, schema, "append", "ProcessingTime")


def tracked(stream: DataFrame, reach: float = 100.0, lost_after: int = 10, idle_ms: int = IDLE_MS) -> DataFrame:
    """`operators.tracking.tracked` over a stream of detections, whose frames arrive in order for each video.

    Needs the RocksDB state store. A track unseen for `lost_after` frames leaves the state, and all of a video's when no frame of it has come for `idle_ms`; should it go on
    later, it starts anew.
    """
    return _with_state(stream, Tracks(reach, lost_after, idle_ms), "video_id long, frame_no int, det_id long, track string")


def stable_layout(stream: DataFrame, steady: int = 5, idle_ms: int = IDLE_MS) -> DataFrame:
    """`operators.tracking.stable_layout` over a stream of frames, with state that ends as in `tracked`."""
    return _with_state(stream, Layouts(steady, idle_ms), "video_id long, frame_no int, layout string")


def smoothed_speakers(stream: DataFrame, last: int = 5, idle_ms: int = IDLE_MS) -> DataFrame:
    """`operators.reports.smoothed_speakers` over a stream of detections in order of ts and det_id, with state that ends as in `tracked`."""
    return _with_state(stream, Speakers(last, idle_ms), "video_id long, speaker string, det_id long, s_x1 long, s_y1 long, s_x2 long, s_y2 long")
