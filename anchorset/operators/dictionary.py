"""Text rules over columns with few distinct texts.

Every rule is run once per distinct text instead of once per row. The dictionary
holds, for each distinct text that any rule matches, a bit set of the matching
rules; it is stored, joined back, and flags are the bits, so a subject's flags
are one ``bit_or``. Spark broadcasts the dictionary if its stored size allows;
otherwise it is joined by text, where very frequent texts are split over tasks
(``subject_join``). Where texts are mostly distinct a dictionary would only add a
shuffle: beyond ``share`` distinct texts a row, the rules run on the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import Rule, fold_rules
from ..sources.stages import StageStore
from .joins import subject_join

WORD = 63  # rules per bit set
SHARE = 0.2


def _words(rules: dict[str, Rule]) -> list[list[str]]:
    names = list(rules)
    return [names[i : i + WORD] for i in range(0, len(names), WORD)]


def _bits(hits: dict[str, Column], rules: dict[str, Rule]) -> list[Column]:
    """One bit set per ``WORD`` rules; an unknown outcome sets no bit."""
    sets = []
    for at, names in enumerate(_words(rules)):
        bits = [F.when(hits[n], F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, n in enumerate(names)]
        sets.append(reduce(lambda a, b: a.bitwiseOR(b), bits).alias(f"_rules_{at}"))
    return sets


def with_rules(df: DataFrame, text: str, rules: dict[str, Rule]) -> DataFrame:
    """The rows with the bit sets of the rules their text matches, by running
    every rule on every row."""
    columns = df.columns
    rows, hits = fold_rules(df, text, rules)
    return rows.select(*columns, *_bits(hits, rules))


def distinct_share(df: DataFrame, text: str) -> float:
    """About how many distinct texts there are per row; one pass."""
    row = df.agg(F.approx_count_distinct(text).alias("kinds"), F.count(text).alias("n")).first()
    return row["kinds"] / row["n"] if row["n"] else 0.0


def with_dictionary(
    df: DataFrame, text: str, rules: dict[str, Rule], store: StageStore, name: str = "dictionary", share: float = SHARE
) -> DataFrame:
    """The same rows and bit sets by way of a dictionary of distinct texts."""
    if distinct_share(df, text) > share:
        return with_rules(df, text, rules)
    texts = df.filter(F.col(text).isNotNull()).select(text).distinct()
    marks = [f"_rules_{i}" for i in range(len(_words(rules)))]
    matched = reduce(lambda a, b: a | b, (F.col(m) != 0 for m in marks))
    listed = store.border(name, with_rules(texts, text, rules).filter(matched))
    joined = subject_join(df, listed, text, "left")
    return joined.select(*df.columns, *(F.coalesce(m, F.lit(0)).alias(m) for m in marks))


def flags_by_dictionary(
    df: DataFrame, key: str, text: str, rules: dict[str, Rule], store: StageStore, share: float = SHARE
) -> DataFrame:
    """One row per key with a 0/1 column per rule that any of its texts matches."""
    marked = with_dictionary(df.select(key, text), text, rules, store, share=share)
    words = _words(rules)
    either = marked.groupBy(key).agg(*(F.bit_or(f"_rules_{at}").alias(f"_rules_{at}") for at in range(len(words))))
    flags = [
        F.shiftright(f"_rules_{at}", i).bitwiseAND(F.lit(1)).cast("int").alias(n)
        for at, names in enumerate(words)
        for i, n in enumerate(names)
    ]
    return either.select(key, *flags)
