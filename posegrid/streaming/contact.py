"""The contact lock over a stream of frames: anchor and correction of each clip are the state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

OUT = "clip string, frame int, correction double"
STATE = "frame int, active boolean, anchor double, correction double"


def contact_lock(frames: DataFrame, decay: float = 0.8) -> DataFrame:
    """(clip, frame, correction) from a stream of (clip, frame, active, v).

    Frames of a clip come in order from batch to batch and in any order within one; a frame that
    is not newer than the last one seen is late and is dropped.
    """

    def step(key, batches, state):
        last, on, anchor, c = state.get if state.exists else (-1, False, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values("frame")
        out = []
        for f, active, v in zip(rows["frame"].tolist(), rows["active"].tolist(), rows["v"].tolist(), strict=True):
            if f <= last:
                continue
            if active and not on:
                anchor = v + c
            c = anchor - v if active else c * decay
            last, on = f, active
            out.append((key[0], f, c))
        state.update((last, bool(on), float(anchor), float(c)))
        yield pd.DataFrame(out, columns=["clip", "frame", "correction"])

    return frames.groupBy("clip").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
