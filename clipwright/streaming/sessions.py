"""Stateful operators over streams of appearances and frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def appearance_sessions(stream: DataFrame, gap_seconds: int = 2, late: str = "10 seconds") -> DataFrame:
    """Runs of appearances (video_id, actor, ts: timestamp) no more than the gap apart; rows later than the watermark are dropped.

    A session window ends `gap` after its last row, so that much is taken off again.
    """
    gap = f"{gap_seconds} seconds"
    found = stream.withWatermark("ts", late).groupBy("video_id", "actor", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("video_id", "actor", F.col("w.start").alias("start"), (F.col("w.end") - F.expr(f"interval {gap}")).alias("end"), "n")


def tracked(stream: DataFrame, reach: float = 100.0, lost_after: int = 10) -> DataFrame:
    """`operators.tracking.tracked` with each video's live tracks kept as state between batches, and for good: `streaming.state.tracked` lets go of videos that end.

    Frames of a video have to arrive in order of frame_no, as a player reads them.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        made, live = (state.get[0], [list(t) for t in zip(*state.get[1:])]) if state.exists else (0, [])
        out = []
        rows = pd.concat(list(batches)).sort_values(["frame_no", "det_id"])
        for r in rows.itertuples():
            live = [t for t in live if r.frame_no - t[1] <= lost_after]
            near = [(((r.cx - t[2]) ** 2 + (r.cy - t[3]) ** 2) ** 0.5, i) for i, t in enumerate(live) if t[4] == r.class_name]
            near = [n for n in near if n[0] < reach]
            if near:
                track = live[min(near, key=lambda n: n[0])[1]]
                track[1:4] = [r.frame_no, r.cx, r.cy]
            else:
                made += 1
                track = [f"{r.class_name}_{made}", r.frame_no, r.cx, r.cy, r.class_name]
                live.append(track)
            out.append((key[0], r.frame_no, r.det_id, track[0]))
        columns = [list(c) for c in zip(*live)] if live else [[], [], [], [], []]
        state.update((made, *columns))
        yield pd.DataFrame(out, columns=["video_id", "frame_no", "det_id", "track"])

    return stream.groupBy("video_id").applyInPandasWithState(
        step,
        "video_id long, frame_no int, det_id long, track string",
        "made int, tracks array<string>, frames array<long>, xs array<long>, ys array<long>, classes array<string>",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def stable_layout(stream: DataFrame, steady: int = 5) -> DataFrame:
    """`operators.tracking.stable_layout` with the last layouts of each video kept as state for good; see `streaming.state.stable_layout`."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(list(batches)).sort_values("frame_no").itertuples():
            own = "split_screen" if r.speakers >= 2 else "single_speaker"
            past = [*past, own][-2 * steady :]
            now, old = past[-steady:], past[:-steady]
            layout = own if len(now) == steady and set(now) == {own} else old[0] if old and len(set(old)) == 1 else own
            out.append((key[0], r.frame_no, layout))
        state.update((past,))
        yield pd.DataFrame(out, columns=["video_id", "frame_no", "layout"])

    return stream.groupBy("video_id").applyInPandasWithState(step, "video_id long, frame_no int, layout string", "past array<string>", "append", GroupStateTimeout.NoTimeout)
