"""Per-key steps of streams on Spark's own state: what one key remembers, and when it is forgotten.

Rows reach a key after each task has thinned its own (``thinned``), so a busy key sends one row per task and instant,
or one row per task, instead of all its rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

#: Arrow rows of the keys in a bucket: the instants (with their smallest tie) that the watermark has not passed, and with
#: a null tie the one that was kept last.
UNIQUE_STATE = "held binary"
_HELD = pa.schema([("g", pa.string()), ("us", pa.int64()), ("tie", pa.int64())])
UNIQUE_ROWS = "g string, us bigint, tie bigint"
#: A job's latest event.
CHANGE_STATE = "us bigint, id bigint, queue string, type string"
CHANGE_ROWS = "queue string, type string, change bigint"


def key_text(key: str) -> Column:
    """A key of any type as text that is never null; null keys share one text."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def key_value(text: str, kind) -> Column:
    """The key that ``key_text`` wrote."""
    return F.when(F.col(text) != "", F.substring(text, 2, 2**31 - 1)).cast(kind)


def thinned(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of the rows that a task holds together, the first of each ``by`` in ``order`` (a minus sign turns it round).

    Rows of one key may be left in several tasks: what follows reduces them further.
    """
    sort = [(o.lstrip("-"), "descending" if o.startswith("-") else "ascending") for o in order]
    keys = [(k, "ascending") for k in by]

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).sort_by(keys + sort).combine_chunks()
            first = np.zeros(table.num_rows, dtype=bool)
            first[0] = True
            for k in by:
                column = table[k].to_numpy()
                first[1:] |= column[1:] != column[:-1]
            yield from table.filter(pa.array(first)).to_batches()

    return df.mapInArrow(thin, df.schema)


def _ms(us: int) -> int:
    """The last millisecond before ``us``: a timer set to it fires as soon as the watermark has reached ``us``."""
    return -(-us // 1000) - 1


def keep_once(window: int) -> Callable:
    """Keep an event that comes at least ``window`` microseconds after the last kept one of its key.

    Events wait until the watermark has passed them, so they are judged in the order of their times, whatever the
    order of arrival.  A key is forgotten when the watermark is a window beyond its last kept event.  A call sees all
    keys of a bucket, as a call costs far more than a key.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs() * 1000
        parts = [pa.ipc.open_stream(state.get[0]).read_all()] if state.exists else []
        if not state.hasTimedOut:
            parts += [pa.Table.from_pandas(f, schema=_HELD, preserve_index=False) for f in frames]
        held = pa.concat_tables(parts)
        kept_last = held.filter(pc.is_null(held["tie"]))
        last = dict(zip(kept_last["g"].to_pylist(), kept_last["us"].to_pylist()))
        events = held.filter(pc.is_valid(held["tie"])).sort_by([(c, "ascending") for c in _HELD.names])
        g, us = events["g"].to_numpy(), events["us"].to_numpy()
        changes = np.append(True, g[1:] != g[:-1])[: len(g)]
        first = changes | np.append(True, us[1:] != us[:-1])[: len(us)]
        events, g, us = events.filter(pa.array(first)), g[first], us[first]
        edges = [*np.flatnonzero(changes[first]).tolist(), len(g)]
        instants, kept, wake = us.tolist(), [], []
        for begin, end in zip(edges, edges[1:]):
            before = last.get(g[begin])
            ready = bisect_right(instants, passed, begin, end)
            i = begin if before is None else bisect_left(instants, before + window, begin, ready)
            while i < ready:
                kept.append(i)
                before = last[g[begin]] = instants[i]
                i = bisect_left(instants, before + window, i + 1, ready)
            if ready < end:
                wake.append(_ms(instants[ready]))
        out = events.take(pa.array(kept, pa.int64())).to_pandas()
        waiting = events.filter(pa.array(us > passed))
        awaited = set(waiting["g"].unique().to_pylist())
        done = {k: _ms(x + window) for k, x in last.items() if k not in awaited}
        wake += [x for x in done.values() if x * 1000 >= passed]
        if wake:
            last = {k: x for k, x in last.items() if k in awaited or done[k] * 1000 >= passed}
            ends = pa.table({"g": list(last), "us": list(last.values()), "tie": [None] * len(last)}, schema=_HELD)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _HELD) as writer:
                writer.write_table(pa.concat_tables([waiting, ends]))
            state.update((sink.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(max(min(wake), passed // 1000))
        elif state.exists:
            state.remove()
        yield out

    return step


def state_change(terminal: frozenset[str], forget_ms: int) -> Callable:
    """-1 for the queue and type that a job leaves and +1 for those it comes to; older events change nothing.

    A job whose latest event is one of ``terminal`` is forgotten ``forget_ms`` after it; its count stays.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = tuple(state.get) if state.exists else None
        new = old
        for frame in frames:
            for row in zip(frame["us"], frame["id"], frame["queue"], frame["type"]):
                if new is None or row[:2] > new[:2]:
                    new = row
        new = (int(new[0]), int(new[1]), *[None if pd.isna(x) else x for x in new[2:]])
        state.update(new)
        if new[3] in terminal:
            state.setTimeoutTimestamp(max(new[0] // 1000 + forget_ms, state.getCurrentWatermarkMs()))
        rows = []
        if old is None or old[2:] != new[2:]:
            rows = [(*new[2:], 1)] if old is None else [(*old[2:], -1), (*new[2:], 1)]
        yield pd.DataFrame(rows, columns=["queue", "type", "change"]).astype({"queue": object, "type": object, "change": "int64"})

    return step
