"""Text rules: LIKE and SIMILAR TO patterns as plain Spark column predicates.

A pattern is a constant, so it is translated once on the driver; the rows are
matched inside the JVM by ``like``, ``=`` or ``rlike``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_REGEX_OPERATORS = set("|()*+?{}[]")
_REGEX_LITERALS = set(".^$")


def top_level_branches(pattern: str) -> list[str]:
    """Split a SIMILAR TO pattern at each ``|`` outside groups and classes."""
    branches, current, depth, in_class, i = [], "", 0, False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            current += pattern[i : i + 2]
            i += 2
            continue
        if ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        elif not in_class:
            depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0 and not in_class:
            branches.append(current)
            current = ""
        else:
            current += ch
        i += 1
    return [*branches, current]


def similar_to_regex(pattern: str) -> str:
    """Java regex that accepts exactly the strings SIMILAR TO accepts.

    Alternatives are anchored one by one, and ``\\z`` (not ``$``) closes them
    because ``$`` would also accept a trailing newline. The pieces between
    wildcards are found from left to right, each at its first place. Where all
    matches of a piece are equally long, or nothing has to follow, no later place
    can do better, so the place is kept in an atomic group and the text is walked
    once. Only other pieces may be searched again.
    """
    parts = []
    for branch in top_level_branches(pattern):
        first, *rest = _pieces(branch)
        regex = "\\A" + _regex_body(first)
        if not rest:
            parts.append(regex + "\\z")
            continue
        *inner, last = rest
        while inner and not last and not inner[-1]:
            inner.pop()
        for i, piece in enumerate(inner):
            if piece:
                ends = not last and i == len(inner) - 1
                find = ".*?(?:" + _regex_body(piece) + ")"
                regex += f"(?>{find})" if ends or _width(piece) is not None else find
        # An open end needs nothing more; a fixed one is looked for from the end.
        regex += ".*(?:" + _regex_body(last) + ")\\z" if last else ""
        parts.append(regex)
    return "(?s)" + (parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")")


def _pieces(branch: str) -> list[str]:
    """What lies between the wildcards ``%`` outside groups and classes."""
    pieces, depth, in_class, i, start = [], 0, False, 0, 0
    while i < len(branch):
        ch = branch[i]
        if ch == "\\":
            i += 2
            continue
        if ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        elif not in_class:
            depth += (ch == "(") - (ch == ")")
            if ch == "%" and depth == 0:
                pieces.append(branch[start:i])
                start = i + 1
        i += 1
    # A repeated wildcard ("%+") belongs to one piece with what surrounds it.
    if any(p[:1] in ("*", "+", "?", "{") for p in (*pieces[1:], branch[start:])):
        return [branch]
    return [*pieces, branch[start:]]


def _width(pattern: str) -> int | None:
    """The length of every string a piece accepts, or None if they differ."""
    widths = set()
    for branch in top_level_branches(pattern):
        width, i = 0, 0
        while i < len(branch):
            ch = branch[i]
            if ch == "\\":
                width, i = width + 1, i + 2
            elif ch == "[":
                end = _class_end(branch, i)
                width, i = width + 1, end + 1
            elif ch == "(":
                end = _closing(branch, i)
                inner = _width(branch[i + 1 : end])
                if inner is None:
                    return None
                width, i = width + inner, end + 1
            elif ch in "%*+?{":
                return None
            else:
                width, i = width + 1, i + 1
        widths.add(width)
    return widths.pop() if len(widths) == 1 else None


def _class_end(pattern: str, start: int) -> int:
    i = start + 1
    while i < len(pattern) and pattern[i] != "]":
        i += 2 if pattern[i] == "\\" else 1
    return i


def longest_literal(pattern: str) -> str:
    """The longest run of plain characters that every accepted string holds; ""
    where there is none or the pattern has alternatives outside groups."""
    if len(top_level_branches(pattern)) > 1:
        return ""
    runs, current, i = [], "", 0
    while i < len(pattern):
        ch, plain = pattern[i], None
        if ch == "\\":
            plain, i = pattern[i + 1 : i + 2], i + 2
        elif ch == "[":
            i = _class_end(pattern, i) + 1
        elif ch == "(":
            i = _closing(pattern, i) + 1
        elif ch == "{":
            i = pattern.index("}", i) + 1
        else:
            plain, i = (None if ch in "%_*+?" else ch), i + 1
        if plain is not None and pattern[i : i + 1] not in ("*", "+", "?", "{"):
            current += plain
        else:
            runs.append(current)
            current = ""
    return max([*runs, current], key=len)


def _regex_body(pattern: str) -> str:
    out, in_class, i = "", False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            if i + 1 == len(pattern):
                raise ValueError(f"pattern ends with its escape character: {pattern!r}")
            nxt = pattern[i + 1]
            out += nxt if nxt.isalnum() or nxt.isspace() else "\\" + nxt
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
            out += "\\" + ch if ch in "[&" else ch
        elif ch == "%":
            out += ".*"
        elif ch == "_":
            out += "."
        elif ch in _REGEX_LITERALS:
            out += "\\" + ch
        else:
            in_class = ch == "["
            out += "(?:" if ch == "(" else ch
        i += 1
    return out


def like_patterns(pattern: str) -> list[str] | None:
    """LIKE patterns that together accept what the SIMILAR TO pattern accepts,
    or None if it repeats something or uses a character class.

    Groups of alternatives are multiplied out: ``%(a|b)%`` is ``%a%`` or ``%b%``.
    """
    out = []
    for branch in top_level_branches(pattern):
        partial, i = [""], 0
        while i < len(branch):
            ch = branch[i]
            if ch == "\\" and i + 1 < len(branch):
                kept = branch[i : i + 2] if branch[i + 1] in "%_\\" else branch[i + 1]
                partial, i = [p + kept for p in partial], i + 2
            elif ch == "(":
                end = _closing(branch, i)
                inner = like_patterns(branch[i + 1 : end])
                if inner is None or branch[end + 1 : end + 2] in ("*", "+", "?", "{"):
                    return None
                partial, i = [p + q for p in partial for q in inner], end + 1
            elif ch in _REGEX_OPERATORS or ch == "\\":
                return None
            else:
                partial, i = [p + ch for p in partial], i + 1
        if branch[:1] in ("*", "+", "?", "{"):
            return None
        out += partial
    return out


# More alternatives than this are left to one regular expression.
MAX_ALTERNATIVES = 64


def alternatives(branch: str) -> list[str]:
    """SIMILAR TO patterns without groups of alternatives that together accept
    what the branch accepts; the branch itself where a group is repeated or
    there would be too many."""
    out, i = [""], 0
    while i < len(branch):
        ch = branch[i]
        if ch == "\\":
            out, i = [p + branch[i : i + 2] for p in out], i + 2
        elif ch == "[":
            end = _class_end(branch, i) + 1
            out, i = [p + branch[i:end] for p in out], end
        elif ch == "(":
            end = _closing(branch, i)
            if branch[end + 1 : end + 2] in ("*", "+", "?", "{"):
                return [branch]
            inner = [q for b in top_level_branches(branch[i + 1 : end]) for q in alternatives(b)]
            out, i = [p + q for p in out for q in inner], end + 1
            if len(out) > MAX_ALTERNATIVES:
                return [branch]
        else:
            out, i = [p + ch for p in out], i + 1
    return out


def _closing(pattern: str, start: int) -> int:
    """Position of the bracket that closes the one at ``start``."""
    depth, i = 0, start
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
        elif pattern[i] in "()":
            depth += 1 if pattern[i] == "(" else -1
            if depth == 0:
                return i
        i += 1
    raise ValueError(f"unbalanced brackets in {pattern!r}")


def _has_group(pattern: str) -> bool:
    i = 0
    while i < len(pattern):
        if pattern[i] == "(":
            return True
        i += 2 if pattern[i] == "\\" else 1
    return False


def _is_search(pattern: str) -> bool:
    """True if a LIKE pattern has wildcards at its ends only, so that Spark runs
    it as an equality, a prefix, a suffix or a substring test."""
    return not {"%", "_", "\\"} & set(pattern.strip("%"))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


@dataclass(frozen=True)
class Rule:
    """One text rule: a pattern, optional exclusions, optional case folding.

    A NULL text gives NULL, so it passes neither the pattern nor an exclusion.
    """

    pattern: str
    similar: bool = False
    lower: bool = True
    none_of: tuple[str, ...] = field(default=())

    def matches(self, text: Column | str, folded: Column | None = None) -> Column:
        """Condition on a text column; ``folded`` is its lower-case form if the
        caller has it already."""
        col = F.col(text) if isinstance(text, str) else text
        if self.lower:
            col = F.lower(col) if folded is None else folded
        hit = self._similar(col) if self.similar else _like(col, self.pattern)
        for pattern in self.none_of:
            hit = hit & ~_like(col, pattern)
        return hit

    def _similar(self, col: Column) -> Column:
        """Substring tests for the alternatives that allow them, which need no
        regular expression; the others by ``rlike``, behind a substring test of
        what they hold in any case."""
        tests = []
        for branch in top_level_branches(self.pattern):
            for one in alternatives(branch):
                # A group that is left has too many alternatives or is repeated.
                plain = None if _has_group(one) else like_patterns(one)
                if plain is not None and all(_is_search(p) for p in plain):
                    tests += [_like(col, p) for p in plain]
                    continue
                literal, regex = longest_literal(one), col.rlike(similar_to_regex(one))
                tests.append(F.contains(col, F.lit(literal)) & regex if literal else regex)
        return any_of(tests)

    @property
    def exact(self) -> bool:
        """True if the rule is an equality test, so that rules with different
        patterns (and the same folding) never match the same text."""
        wild = {"%", "_", "\\"} | (_REGEX_OPERATORS if self.similar else set())
        return not wild & set(self.pattern) and not self.none_of


def _like(col: Column, pattern: str) -> Column:
    if not {"%", "_", "\\"} & set(pattern):
        return col == F.lit(pattern)
    if _is_search(pattern):
        return col.like(pattern)
    # Spark's own translation of inner wildcards walks a text again and again.
    return col.rlike(similar_to_regex(_like_as_similar(pattern)))


def _like_as_similar(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        if pattern[i] == "\\":
            if i + 1 == len(pattern):
                raise ValueError(f"pattern ends with its escape character: {pattern!r}")
            out, i = out + pattern[i : i + 2], i + 2
        else:
            out += "\\" + pattern[i] if pattern[i] in _REGEX_OPERATORS else pattern[i]
            i += 1
    return out


def like(pattern: str, lower: bool = True, none_of: Iterable[str] = ()) -> Rule:
    return Rule(pattern, similar=False, lower=lower, none_of=tuple(none_of))


def similar(pattern: str, lower: bool = True, none_of: Iterable[str] = ()) -> Rule:
    return Rule(pattern, similar=True, lower=lower, none_of=tuple(none_of))


_FOLDED = "_folded"


def fold_rules(df: DataFrame, text: str, rules: dict[str, Rule]) -> tuple[DataFrame, dict[str, Column]]:
    """Conditions of many rules over one text, which is lower-cased once per row
    in an extra column instead of once per rule."""
    if any(rule.lower for rule in rules.values()):
        df = df.withColumn(_FOLDED, F.lower(text))
    return df, {name: rule.matches(text, F.col(_FOLDED)) for name, rule in rules.items()}


def tag_rows(df: DataFrame, name: str, conditions: dict[str, Column]) -> DataFrame:
    """One row per input row and condition it meets, named in column ``name``.

    The array is exploded whole and filtered afterwards: dropping the NULLs
    inside the array would take a lambda, which Spark does not compile.
    """
    marks = F.array(*[F.when(cond, F.lit(tag)) for tag, cond in conditions.items()])
    return df.withColumn(name, F.explode(marks)).filter(F.col(name).isNotNull()).drop(_FOLDED)
