"""Random patterns and values against plain Python."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from anchorset.functions.patterns import (
    alternatives,
    like_patterns,
    longest_literal,
    similar_to_regex,
    top_level_branches,
)

LITERAL = st.text("ab. ", min_size=0, max_size=3)


def _joined(parts):
    return "".join(parts)


ATOM = st.one_of(LITERAL, st.sampled_from(["%", "_", "\\|", "\\(", "\\%", "\\_"]))
BRANCH = st.lists(ATOM, max_size=4).map(_joined)
GROUP = st.lists(BRANCH, min_size=1, max_size=3).map(lambda bs: "(" + "|".join(bs) + ")")
SIDE = st.lists(st.one_of(ATOM, GROUP), max_size=4).map(_joined)
PATTERN = st.lists(SIDE, min_size=1, max_size=3).map("|".join)
TEXT = st.text("ab. |(%_\n", max_size=8)


def _like(pattern: str, text: str) -> bool:
    """LIKE by recursion over the pattern."""
    if not pattern:
        return not text
    head = pattern[0]
    if head == "%":
        return any(_like(pattern[1:], text[i:]) for i in range(len(text) + 1))
    if head == "_":
        return bool(text) and _like(pattern[1:], text[1:])
    if head == "\\":
        return bool(text) and text[0] == pattern[1] and _like(pattern[2:], text[1:])
    return bool(text) and text[0] == head and _like(pattern[1:], text[1:])


@settings(max_examples=600, deadline=None)
@given(PATTERN, TEXT)
def test_regular_expression_and_like_forms_agree(pattern, text):
    plain = like_patterns(pattern)
    assert plain is not None
    regex = re.compile(similar_to_regex(pattern).replace("\\z", "\\Z"))
    assert any(_like(p, text) for p in plain) == bool(regex.search(text))


@settings(max_examples=400, deadline=None)
@given(PATTERN, TEXT)
def test_alternatives_and_literals_agree(pattern, text):
    """Each branch equals the union of its alternatives, and an accepted text
    holds the literal that guards it."""
    for branch in top_level_branches(pattern):
        accepts = lambda p: bool(re.search(similar_to_regex(p).replace("\\z", "\\Z"), text))
        parts = alternatives(branch)
        assert accepts(branch) == any(map(accepts, parts))
        assert all(longest_literal(p) in text for p in parts if accepts(p))


@settings(max_examples=300, deadline=None)
@given(PATTERN)
def test_branches_join_to_the_pattern(pattern):
    assert "|".join(top_level_branches(pattern)) == pattern
