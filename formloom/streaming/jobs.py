"""The state of running jobs from a stream of progress events: latest stage, stalled jobs, finished ones forgotten.

A job is stalled when no event of it is newer than the time-out, by event time: the stream's watermark decides, not the
clock, so a replay gives the same answers. A finished job's state stays until the watermark has passed every event that may
still come late for it, and then goes; a stalled one's goes after `forget`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Stages that end a job, and how long a job may be silent.
ENDS, SILENT_SECONDS, LATE_SECONDS, FORGET_SECONDS = ("done", "rejected", "failed"), 300, 600, 86_400
CHANGES = "doc_id long, state string, stage string, at timestamp, events long"
_STATE = "stage string, at_ms long, events long, phase string"


def job_states(events: DataFrame, ends: tuple[str, ...] = ENDS, silent: int = SILENT_SECONDS, late: int = LATE_SECONDS, forget: int = FORGET_SECONDS) -> DataFrame:
    """Changes of jobs, as a stream in append mode, from events (doc_id, stage, ts): doc_id, state (running, stalled,
    finished), stage, at (of the newest event) and how many events were counted.

    A batch gives a job's state once, after all its events of the batch. Events later than `late` seconds behind the newest are
    dropped by the watermark; one that is late but not too late counts, and changes the stage only if it is the newest (of equal
    times the greater stage). Nothing changes a finished job any more. Events with a null key or time are left out."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        stage, at, n, phase = state.get if state.exists else ("", -1, 0, "new")
        mark = state.getCurrentWatermarkMs()
        wake = lambda ms: state.setTimeoutTimestamp(max(int(ms), mark + 1))
        out: list[tuple] = []
        if state.hasTimedOut:
            if phase == "running":
                out.append((key[0], "stalled", stage, at, n))
                state.update((stage, at, n, "stalled"))
                wake(at + 1000 * forget)
            else:
                state.remove()  # finished and beyond late events, or stalled for too long
        else:
            for frame in frames:
                if phase != "finished":
                    n += len(frame)
                    for s, t in sorted(zip(frame["stage"], frame["ms"].astype("int64")), key=lambda e: (e[1], e[0])):
                        if (int(t), s) >= (at, stage):
                            stage, at = s, int(t)
            if phase != "finished" and at >= 0:
                phase = "finished" if stage in ends else "running"
                out.append((key[0], phase, stage, at, n))
                state.update((stage, at, n, phase))
            if state.exists:
                wake(at + 1000 * (late if phase == "finished" else silent))
        if out:
            frame = pd.DataFrame(out, columns=["doc_id", "state", "stage", "at", "events"])
            yield frame.assign(at=pd.to_datetime(frame["at"], unit="ms", utc=True))

    timed = events.filter("doc_id is not null and ts is not null and stage is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "stage", F.col("ts").cast("timestamp").alias("ts"))
    timed = timed.withWatermark("ts", f"{late} seconds").withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("doc_id").applyInPandasWithState(update, CHANGES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
