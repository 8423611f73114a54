"""Structured Streaming: score samples as they arrive, and keep running transitions."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.train import SomModel


def score_stream(stream: DataFrame, model: SomModel, features: str = "features") -> DataFrame:
    """The frozen map's best nodes for a stream of samples; stateless, so any trigger and
    sink will do. The same call scores a batch DataFrame."""
    return model.transform(stream, features)


def running_transitions(scored: DataFrame, sequence: str = "seq_id", order: str = "ord") -> DataFrame:
    """``sequence, from_nid, to_nid`` of every step in a scored stream.

    The last node of each sequence is the only state, carried from one micro-batch to the
    next. Events are taken in their order within a micro-batch; an event that arrives
    after a later one was seen is a step from where the sequence then stood.
    """
    kind = scored.schema[sequence].dataType.simpleString()

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        events = pd.concat(list(frames)).sort_values(order)
        came = events["nid"].tolist()
        left = [last, *came[:-1]]
        rows = [(key[0], a, b) for a, b in zip(left, came) if a is not None]
        state.update((int(came[-1]),))
        yield pd.DataFrame(rows, columns=[sequence, "from_nid", "to_nid"])

    return scored.select(sequence, F.col(order), "nid").groupBy(sequence).applyInPandasWithState(
        step, f"`{sequence}` {kind}, from_nid int, to_nid int", "last int", "append", GroupStateTimeout.NoTimeout)
