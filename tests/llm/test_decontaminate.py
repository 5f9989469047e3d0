"""SimHash decontamination against brute force."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from anchorset.llm import decontaminate as D

ITEMS = "item_id bigint, text string"


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def grams(w, n):
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def similarity(a, b):
    a, b = Counter(a), Counter(b)
    both = sum(min(a[g], b[g]) for g in a)
    either = sum(a.values()) + sum(b.values()) - both
    return both, either


def brute(docs, items):
    """(doc, item): number of windows and the best similarity."""
    found = {}
    for d, text in docs:
        for i, item in items:
            target = words(item)
            n = min(len(target), D.WIDTH)
            if not n:
                continue
            goal, own = grams(target, n), grams(words(text), n)
            starts = range(max(len(own) - len(goal), 0) + 1) if own else ()
            hits = [similarity(own[s : s + len(goal)], goal) for s in starts]
            hits = [both / either for both, either in hits if 10 * both >= 8 * either]
            if hits:
                found[d, i] = (len(hits), max(hits))
    return found


def result(docs, items):
    return {(r["doc_id"], r["item_id"]): (r["n_windows"], r["similarity"]) for r in D.contaminated(docs, items).collect()}


def test_passages_and_near_copies(spark, docs_of):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, some(n)) for i, n in enumerate((60, 60, 33, 14, 8, 3, 1, 25))]
    items.append((8, items[0][1]))  # a repeated item text
    items.append((9, ["unique"] + items[2][1][1:]))  # overlaps another item
    docs = []
    for d in range(40):
        _, item = items[d % len(items)]
        passage = list(item)
        for _ in range(d // 14):  # 0, 1 or 2 words changed
            passage[rng.randrange(len(passage))] = "changed"
        docs.append((d, " ".join(some(d % 3 * 20) + passage + some(d % 4 * 15)).upper() + "."))
    docs += [(100, " ".join(some(300))), (101, " ".join(items[0][1] * 3)), (102, " ".join(items[0][1][:50]))]
    items = [(i, ", ".join(w)) for i, w in items]
    found = result(docs_of(docs), spark.createDataFrame(items, ITEMS))
    assert found == brute(docs, items) and len(found) > 25


def test_index_reaches_the_whole_radius(spark):
    """Every value that differs in at most RADIUS bits shares a probed block."""
    rng = random.Random(3)
    masks = set(D.near_masks())
    width = D.BITS // D.BLOCKS
    for _ in range(500):
        flips = sum(1 << b for b in rng.sample(range(D.BITS), rng.randint(0, D.RADIUS)))
        assert any((flips >> i * width) & ((1 << width) - 1) in masks for i in range(D.BLOCKS))


def test_fingerprint_is_the_majority(spark):
    values = [[random.Random(i * 50 + j).getrandbits(64) - (1 << 63) for j in range(i + 1)] for i in range(6)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, shingles array<bigint>")
    for r in D.fingerprints(df, ["i"]).collect():
        own = values[r["i"]]
        plain = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in own) > len(own))
        assert r["fingerprint"] % (1 << 64) == plain


def test_plan_has_no_python(spark, docs_of):
    items = spark.createDataFrame([(1, "one two three four five six")], ITEMS)
    plan = D.contaminated(docs_of(["one two three four five six"]), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows(spark, docs_of, clashing):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(1, None), (2, ""), (3, " ,.; "), (4, passage), (4, passage), (None, passage), (5, "x " * 60_000 + passage)]
    items = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (None, "..")], ITEMS)
    found = D.contaminated(clashing(docs_of(docs)), clashing(items)).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["similarity"]) for r in found) == [(0, 1, 1.0), (4, 1, 1.0), (5, 1, 1.0)]


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b c d e f")], ITEMS)
    assert D.contaminated(docs_of(["a b c d e f"]), none).collect() == []
    assert D.contaminated(docs_of([]), some).collect() == []


def test_without_broadcast(spark, docs_of, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    passage = " ".join(f"p{i}" for i in range(20))
    items = spark.createDataFrame([(1, passage)], ITEMS)
    found = D.contaminated(docs_of([f"a b {passage} c", "nothing here"]), items)
    assert [(r["doc_id"], r["n_windows"]) for r in found.collect()] == [(1, 3)]
    assert found.agg(F.max("similarity")).first()[0] == 1.0
