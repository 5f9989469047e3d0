"""The readings around each subject's index event, refreshed as events come and go.

The index event and the profile around it are stored as ``SubjectStates``. New
events are folded in by themselves. Where they move a subject's index event, its
profile no longer holds and is recomputed; nobody else's old events are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sweep as sw
from ..operators.joins import subject_join
from ..operators.states import SubjectStates, moved
from ..sources.stages import StageStore

KEY, TS, ID, KIND, VALUE = "user_id", "ts", "event_id", "event_type", "value"


class ProfileAroundIndex:
    """First event of one kind per subject, and of the readings of another kind
    the last one at or before it and the extremes at or after it."""

    def __init__(self, store: StageStore, index_kind: str, reading_kind: str):
        self.index_kind, self.reading_kind = index_kind, reading_kind
        first = sw.Pick(F.when(F.col(TS).isNotNull(), F.struct(TS, ID, VALUE)), least=True)
        until, since = F.col(TS) <= F.col("index_ts"), F.col(TS) >= F.col("index_ts")
        latest, lowest = sw.latest(TS, ID, VALUE), sw.lowest(TS, VALUE)
        picks = {
            "last": sw.Pick(F.when(until, latest.best)),
            "low": sw.Pick(F.when(since, lowest.best), least=True),
            "high": sw.Pick(F.when(since & F.col(VALUE).isNotNull(), F.struct(VALUE))),
        }
        self.index = SubjectStates(store, "index", KEY, {"first": first})
        self.profile = SubjectStates(store, "profile", KEY, picks)

    def _starts(self, events: DataFrame) -> DataFrame:
        return events.filter(F.col(KIND) == self.index_kind)

    def _readings(self, events: DataFrame, index: DataFrame) -> DataFrame:
        """Readings with the subject's index time; others than listed are left out."""
        times = index.filter("first is not null").select(KEY, F.col(f"first.{TS}").alias("index_ts"))
        readings = events.filter(F.col(KIND) == self.reading_kind).select(KEY, TS, ID, VALUE)
        return subject_join(readings, times, KEY)

    def build(self, events: DataFrame) -> None:
        index = self.index.build(self._starts(events))
        self.profile.build(self._readings(events, index))

    def fold(self, new: DataFrame, every: DataFrame) -> None:
        """Take in new events; of ``every`` event (new ones included) only the
        readings of subjects with another index event than before are used."""
        before = self.index.table()
        index = self.index.fold(self._starts(new))
        again = self.index.store.write(f"moved_{self.index.version()}", moved(before, index, KEY, "first"))
        listed = subject_join(index, again, KEY, "left_semi", hot_rows=None)
        self.profile.renew(again, self._readings(every, listed), self._readings(new, index))

    def retract(self, gone: DataFrame, remaining: DataFrame) -> None:
        """Withdraw events; ``remaining`` are all others."""
        before = self.index.table()
        index = self.index.retract(self._starts(gone), self._starts(remaining))
        again = self.index.store.write(f"moved_{self.index.version()}", moved(before, index, KEY, "first"))
        self.profile.retract(self._readings(gone, before), self._readings(remaining, index), again)

    def table(self) -> DataFrame:
        """One row per subject with an index event."""
        index = self.index.table().select(KEY, F.col(f"first.{TS}").alias("index_ts"), F.col(f"first.{VALUE}").alias("index_value"))
        profile = self.profile.table().select(
            KEY,
            F.col("last.value").alias("last_value"),
            F.col("low.value").alias("min_value"),
            F.col("low.at").alias("min_ts"),
            F.col("high.value").alias("max_value"),
        )
        return index.join(profile, KEY, "left")
