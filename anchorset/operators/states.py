"""Aggregates per subject that take in new facts without reading the old ones.

The state of a subject is the best fact of every ``Pick`` (latest, lowest,
highest, …) and the number of its facts. States of two sets of facts merge into
the state of both, so new facts are aggregated by themselves and merged with the
stored states. Facts that are withdrawn change a state only where one of them is
the best of a pick; those subjects alone are recomputed from their remaining
facts, the others only lose the count.

Every refresh writes a new version of the state table, whose size follows the
subjects and not the facts. A version counts once its job has ended well, so a
refresh that breaks off leaves the last one in place and can be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import StageStore
from .joins import keys, subject_join
from .sweep import Pick

COUNT = "n_facts"


class SubjectStates:
    """The stored states of one kind of facts; ``picks`` name their columns."""

    def __init__(self, store: StageStore, name: str, key: str | Sequence[str], picks: dict[str, Pick]):
        self.store, self.name, self.on, self.picks = store, name, keys(key), picks

    def states_of(self, facts: DataFrame) -> DataFrame:
        """The state of every subject in the facts; combined ahead of the shuffle."""
        best = [pick.of(pick.best).alias(name) for name, pick in self.picks.items()]
        return facts.filter(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in self.on))).groupBy(*self.on).agg(
            *best, F.count(F.lit(1)).alias(COUNT)
        )

    def merged(self, *states: DataFrame) -> DataFrame:
        """One state per subject from several."""
        every = reduce(lambda a, b: a.unionByName(b), states)
        best = [pick.of(name).alias(name) for name, pick in self.picks.items()]
        return every.groupBy(*self.on).agg(*best, F.sum(COUNT).alias(COUNT))

    # --- versions ---

    def _path(self, version: int) -> str:
        return f"states_{self.name}_{version}"

    def version(self) -> int:
        """The last complete version; 0 if there is none."""
        found = 0
        while self.store.has(self._path(found + 1)):
            found += 1
        return found

    def table(self, version: int = 0) -> DataFrame:
        """Key, best facts (structs) and number of facts per subject."""
        return self.store.read(self._path(version or self.version()))

    def _write(self, states: DataFrame) -> DataFrame:
        return self.store.write(self._path(self.version() + 1), states)

    # --- refreshes ---

    def build(self, facts: DataFrame) -> DataFrame:
        return self._write(self.states_of(facts))

    def fold(self, new: DataFrame) -> DataFrame:
        """Take in further facts; reads them and the states."""
        return self._write(self.merged(self.table(), self.states_of(new)))

    def renew(self, subjects: DataFrame, facts: DataFrame, new: DataFrame | None = None) -> DataFrame:
        """Recompute the listed subjects from ``facts``, and fold ``new`` facts
        into the others."""
        listed = subjects.select(*self.on).distinct()
        own = subject_join(facts, listed, self.on, "left_semi")
        kept = subject_join(self.table(), listed, self.on, "left_anti", hot_rows=None)
        if new is not None:
            kept = self.merged(kept, self.states_of(subject_join(new, listed, self.on, "left_anti")))
        return self._write(kept.unionByName(self.states_of(own)))

    def touched_by(self, gone: DataFrame) -> DataFrame:
        """The subjects of which a withdrawn fact is the best of some pick."""
        lost, held = self.states_of(gone), self.table()
        both = lost.alias("lost").join(held.alias("held"), self.on)
        same = reduce(lambda a, b: a | b, (F.col(f"lost.{n}") == F.col(f"held.{n}") for n in self.picks))
        return both.filter(F.coalesce(same, F.lit(False))).select(*self.on)

    def retract(self, gone: DataFrame, remaining: DataFrame, also: DataFrame | None = None) -> DataFrame:
        """Withdraw facts. ``remaining`` are all facts without them, of which only
        those of touched subjects (and of those in ``also``) are aggregated; a
        subject without facts goes."""
        touched = self.touched_by(gone)
        if also is not None:
            touched = touched.unionByName(also.select(*self.on)).distinct()
        touched = self.store.write(f"{self._path(self.version() + 1)}_touched", touched)
        less = self.states_of(subject_join(gone, touched, self.on, "left_anti")).select(*self.on, F.col(COUNT).alias("_less"))
        kept = subject_join(self.table(), touched, self.on, "left_anti", hot_rows=None).join(less, self.on, "left")
        kept = kept.withColumn(COUNT, F.col(COUNT) - F.coalesce("_less", F.lit(0))).drop("_less")
        # The least and greatest key reach the scan, which skips what lies outside.
        bounds = touched.agg(*(f(k).alias(f"{name}_{k}") for k in self.on for name, f in (("low", F.min), ("high", F.max)))).first()
        for k in self.on:
            remaining = remaining.filter(F.col(k).between(bounds[f"low_{k}"], bounds[f"high_{k}"]))
        own = self.states_of(subject_join(remaining, touched, self.on, "left_semi"))
        return self._write(kept.filter(F.col(COUNT) > 0).unionByName(own))


def moved(before: DataFrame, after: DataFrame, key: str | Sequence[str], *columns: str) -> DataFrame:
    """Subjects whose columns differ between two tables, or that only one has."""
    on = keys(key)
    old = before.select(*on, F.struct(*columns).alias("_old"))
    both = after.select(*on, F.struct(*columns).alias("_new")).join(old, on, "full")
    return both.filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(*on)
