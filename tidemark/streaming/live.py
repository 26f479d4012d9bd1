"""Live session summaries of a stream: each micro-batch is merged into one small state a session, whatever order events come in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.params import FeatureParams
from ..operators.live import EDGE, MOST, RECENT, SEEN, SUMS, contributions, live_view
from ..operators.sessions import SESSION

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType()}
_ORDER = ["at_us", "seq", "event_id"]
_PLACE = [("at_us", T.LongType()), ("seq", T.LongType()), ("event_id", T.StringType())]
_TOTALS = T.StructType(
    [T.StructField(k, _KINDS[t]) for k, t in (SUMS | MOST).items()]
    + [T.StructField(f"{side}_{k}", t) for side in ("first", "last") for k, t in [*_PLACE, *((c, T.StringType()) for c in EDGE)]]
)
_EVENT = T.StructType([T.StructField(k, t) for k, t in _PLACE] + [T.StructField(c, T.StringType()) for c in SEEN])
_STATE = T.StructType(
    [T.StructField(c, T.StringType()) for c in SESSION] + _TOTALS.fields + [T.StructField(f"recent_{c}", T.ArrayType(T.StringType())) for c in SEEN]
)
_LOWEST = -(1 << 63)


def _plain(x):
    """A value of pandas as the state store takes it."""
    return None if x is None or x is pd.NA or x != x else x.item() if hasattr(x, "item") else x


class LiveProcessor(StatefulProcessor):
    """Totals of a session as one value, its ``recent`` last events as a list; both end ``keep_seconds`` after the last event, or never where that is None.

    A micro-batch's events of a session are first merged among themselves, column by column, then with
    the state. Emits the new state once for each batch.
    """

    def __init__(self, recent: int = RECENT, keep_seconds: int | None = 86_400) -> None:
        self.recent, self.keep_ms = recent, keep_seconds and keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", _TOTALS, ttlDurationMs=self.keep_ms)
        self.last = handle.getListState("recent", _EVENT, ttlDurationMs=self.keep_ms)

    @staticmethod
    def _edges(events: pd.DataFrame) -> dict:
        timed = events[events["at_us"].notna()].sort_values(_ORDER)
        if not len(timed):
            return {f"{side}_{c}": None for side in ("first", "last") for c in (*_ORDER, *EDGE)}
        ends = {"first": timed.iloc[0], "last": timed.iloc[-1]}
        return {f"{side}_{c}": _plain(row[c]) for side, row in ends.items() for c in (*_ORDER, *EDGE)}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batches = [b for b in rows if len(b)]
        if not batches:
            return
        events = pd.concat(batches)
        # without a number an event comes before those with one; such numbers never leave this function
        events["seq"] = events["seq"].astype("Int64").fillna(_LOWEST)
        events["at_us"] = events["at_us"].astype("Int64")
        now = {k: _plain(events[k].sum()) for k in SUMS} | {k: _plain(events[k].max()) for k in MOST} | self._edges(events)
        if self.totals.exists():
            old = dict(zip(_TOTALS.names, self.totals.get()))
            now |= {k: old[k] + now[k] for k in SUMS} | {k: max(old[k], now[k]) for k in MOST}
            place = lambda s, side: tuple(s[f"{side}_{c}"] for c in _ORDER)
            for side, older in (("first", lambda a, b: a <= b), ("last", lambda a, b: a >= b)):
                have = old[f"{side}_at_us"] is not None
                if have and (now[f"{side}_at_us"] is None or older(place(old, side), place(now, side))):
                    now |= {f"{side}_{c}": old[f"{side}_{c}"] for c in (*_ORDER, *EDGE)}
        self.totals.update(tuple(now[k] for k in _TOTALS.names))

        kept = pd.DataFrame(list(self.last.get()) if self.last.exists() else [], columns=_EVENT.names).astype({"at_us": "Int64", "seq": "Int64"})
        both = pd.concat([kept, events[_EVENT.names]]) if len(kept) else events[_EVENT.names]
        # as in a batch, an event without a number or a time is taken for the newest
        rank = both.assign(seq=both["seq"].where(both["seq"] != _LOWEST)).sort_values(["seq", "at_us", "event_id"], na_position="last").tail(self.recent)
        seen = [[_plain(x) for x in row] for row in rank.itertuples(index=False)]
        self.last.put([tuple([r[0], _LOWEST if r[1] is None else r[1], *r[2:]]) for r in seen])
        lists = {f"recent_{c}": [r[len(_PLACE) + k] for r in seen] for k, c in enumerate(SEEN)}
        yield pd.DataFrame([{**dict(zip(SESSION, map(str, key))), **now, **lists}], columns=_STATE.names)

    def close(self) -> None:
        pass


def live_states(events: DataFrame, p: FeatureParams = FeatureParams(), recent: int = RECENT, keep_seconds: int | None = 86_400) -> DataFrame:
    """The state of each session that a micro-batch touches, as ``operators.live.session_states`` has it. Output mode ``update``.

    ``events``: a stream of enriched events. A state that ends by time keeps a query running that takes what is available now. Needs the RocksDB state store, which ``sessions.state_store`` sets.
    """
    rows = contributions(events, p).withColumns({c: F.col(c).cast("string") for c in SESSION})
    states = rows.groupBy(*SESSION).transformWithStateInPandas(LiveProcessor(recent, keep_seconds), outputStructType=_STATE, outputMode="Update", timeMode="ProcessingTime" if keep_seconds else "None")
    edge = lambda side: F.when(F.col(f"{side}_at_us").isNotNull(), F.struct(F.col(f"{side}_at_us").alias("at_us"), *(F.col(f"{side}_{c}").alias(c) for c in EDGE)))
    seen = F.transform(F.arrays_zip(*(f"recent_{c}" for c in SEEN)), lambda x: F.struct(*(x[f"recent_{c}"].alias(c) for c in SEEN)))
    return states.select(*SESSION, *SUMS, *MOST, edge("first").alias("first"), edge("last").alias("last"), seen.alias("recent"))


def live_summaries(events: DataFrame, p: FeatureParams = FeatureParams(), recent: int = RECENT, keep_seconds: int | None = 86_400) -> DataFrame:
    """The live summary of each session that a micro-batch touches. Output mode ``update``."""
    return live_view(live_states(events, p, recent, keep_seconds))
