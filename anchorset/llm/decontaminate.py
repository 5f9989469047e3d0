"""Benchmark decontamination with SimHash windows, in Spark SQL functions only.

A benchmark item of L words is looked for in every window of L words of every
text (the whole text where it is shorter). Words are runs of letters and digits,
lower-cased; a window is the multiset of its ``WIDTH``-word shingles (items with
fewer words: of shingles as long as the item). A window matches an item when the
weighted Jaccard similarity, the sum of the lesser over the sum of the greater
counts, is at least ``SHARE``.

1. Windows. A window can only match if, of its m shingles, all but m / 9 are the
   item's. So one of its first and one of its last m // 9 + 1 shingles is; windows
   without these are left out, which loses nothing.
2. Fingerprints. Each window has a 64-bit SimHash: a bit is set where more than
   half of the shingle hashes have it. Items likewise.
3. Index. Fingerprints are cut into ``BLOCKS`` blocks. If two differ in at most
   ``RADIUS`` bits, some block differs in at most RADIUS // BLOCKS bits; items are
   listed under all block values that close to theirs, so looking up the blocks
   of a window finds all items within the radius (and of its size).
4. Verification. The weighted similarity of every candidate is computed exactly.

The radius is 4.8 standard deviations above the expected distance of two windows
at the least similarity, so the fingerprints lose next to nothing.

Rows: null and empty texts and items match nothing. Repeated rows of documents
give one result row, repeated items too; an id with several texts gives the best
match of each. Null ids are kept. Empty tables give an empty result. The item
side is broadcast up to ``BROADCAST_ROWS`` rows and shuffled beyond.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stages import StageStore
from .text import clash_free, place_of

WIDTH = 5
SHARE = (8, 10)
BITS, BLOCKS, RADIUS = 64, 8, 23
BROADCAST_ROWS = 1_000_000

_WORD_GAP = r"[^\p{L}\p{N}]+"
_KEY = ["k1", "k2"]
_WINDOW = [*_KEY, "m", "start"]


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), _WORD_GAP), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words, by position."""
    last = F.size(hashes) - width
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(width), *(F.get(hashes, i + j) for j in range(width))))


def with_shingles(rows: DataFrame, text_col: str, width: int) -> DataFrame:
    """Replace the text by the array ``shingles``. Word hashes are a column of
    their own, so that they are computed once per text."""
    hashed = rows.withColumn("_words", word_hashes(F.col(text_col))).drop(text_col)
    return hashed.withColumn("shingles", shingle_hashes(F.col("_words"), width)).drop("_words")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.filter(F.col(text_col).isNotNull()).select(
        F.xxhash64(F.lit(1), id_col).alias("k1"),
        F.xxhash64(F.lit(2), text_col).alias("k2"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
    )


def fingerprints(windows: DataFrame, by: list[str]) -> DataFrame:
    """(by…, fingerprint) from rows with an array ``shingles``."""
    bits = windows.select(*by, F.explode("shingles").alias("g"))
    ones = [F.sum(F.shiftright("g", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(BITS)]
    counted = bits.groupBy(*by).agg(F.count(F.lit(1)).alias("size"), *ones)
    fingerprint = F.lit(0).cast("long")
    for b in range(BITS):
        value = (1 << b) - (1 << 64 if b == 63 else 0)
        fingerprint = fingerprint.bitwiseOR(
            F.when(F.col(f"b{b}") * 2 > F.col("size"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long"))
        )
    return counted.select(*by, fingerprint.alias("fingerprint"))


def blocks(fingerprint: Column) -> list[Column]:
    width = BITS // BLOCKS
    mask = F.lit((1 << width) - 1)
    return [F.shiftrightunsigned(fingerprint, i * width).bitwiseAND(mask) for i in range(BLOCKS)]


def near_masks() -> list[int]:
    """All ways to change a block in at most RADIUS // BLOCKS bits."""
    width = BITS // BLOCKS
    flips = range(RADIUS // BLOCKS + 1)
    return [sum(1 << i for i in bits) for n in flips for bits in combinations(range(width), n)]


def sized(df: DataFrame) -> DataFrame:
    """A table of bounded size is broadcast; a larger one is left to Spark."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _matches(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, share):
    """(k1, k2, id, item, start, n_words, similarity); k1 and k2 tell the row."""
    store = StageStore.for_session(docs.sparkSession)
    rows = keyed(clash_free(docs, id_col, text_col), id_col, text_col)
    items = clash_free(items, item_col, item_text_col).select(
        F.col(item_col).alias("item"), F.col(item_text_col).alias("text")
    )
    words = items.filter("text is not null").withColumn("words", word_hashes(F.col("text")))
    words = store.border("items", words.select("item", F.least(F.size("words"), F.lit(WIDTH)).alias("width"), "text"))
    # At most WIDTH values.
    widths = [r["width"] for r in words.filter("width > 0").select("width").distinct().collect()]
    found = [_of_width(rows, words, width, share, store) for width in sorted(widths)]
    if not found:
        kinds = [df.schema[c].dataType.simpleString() for df, c in ((rows, "id"), (items, "item"))]
        schema = f"k1 bigint, k2 bigint, id {kinds[0]}, item {kinds[1]}, start int, n_words int, similarity double"
        return docs.sparkSession.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def matching_windows(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    share: tuple[int, int] = SHARE,
) -> DataFrame:
    """(id, item, start, n_words, similarity) of every matching window; start
    counts words."""
    found = _matches(docs, items, id_col, text_col, item_col, item_text_col, share)
    return found.drop(*_KEY).withColumnsRenamed({"id": id_col, "item": item_col})


def clean_documents(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows that hold no item, with all their columns. Rows are told by id
    and text, so of several rows with one id, or none, only those that match go."""
    found = _matches(docs, items, id_col, text_col, item_col, item_text_col, SHARE)
    places = [f"_{i}" for i in range(len(docs.columns))]
    whose, text = (places[place_of(docs, c)] for c in (id_col, text_col))
    plain = docs.toDF(*places).withColumns({"k1": F.xxhash64(F.lit(1), whose), "k2": F.xxhash64(F.lit(2), text)})
    return plain.join(found.select(*_KEY).distinct(), _KEY, "left_anti").select(*places).toDF(*docs.columns)


def _of_width(rows: DataFrame, words: DataFrame, width: int, share: tuple[int, int], store: StageStore) -> DataFrame:
    num, den = share
    items = with_shingles(words.filter(F.col("width") == width).drop("width"), "text", width)
    items = store.border(f"items_{width}", items.withColumn("m", F.size("shingles")).distinct())
    # Shingles outside a matching window's share: m * (den - num) / (den + num) at most.
    slack = F.floor(F.col("m") * (den - num) / (den + num)).cast("int")

    # 1. Where shingles of items are, and the windows they allow.
    sizes = items.select(F.explode("shingles").alias("g"), "m").distinct()
    sizes = sized(store.border(f"sizes_{width}", sizes.groupBy("g").agg(F.collect_set("m").alias("sizes"))))
    # The outer form: Spark would check the plain one's array for emptiness below
    # the projections, and for that compute it again for every use of a word.
    placed = with_shingles(rows, "text", width).select(
        *_KEY, F.size("shingles").alias("n"), F.posexplode_outer("shingles").alias("at", "g")
    )
    hits = store.border(f"hits_{width}", placed.join(sizes, "g").select(*_KEY, "n", "at", "sizes"))
    hits = hits.select(*_KEY, "n", "at", F.explode("sizes").alias("m"))
    top = F.greatest(F.col("n") - F.col("m"), F.lit(0))
    first = F.sequence(F.greatest(F.col("at") - slack, F.lit(0)), F.least(F.col("at"), top))
    final = F.col("at") - F.col("m") + 1
    last = F.sequence(F.greatest(final, F.lit(0)), F.least(final + slack, top))
    long = hits.filter("n >= m")
    allowed = (
        long.filter(F.greatest(F.col("at") - slack, F.lit(0)) <= F.least(F.col("at"), top))
        .select(*_KEY, "m", F.explode(first).alias("start"))
        .distinct()
        .join(
            long.filter(F.greatest(final, F.lit(0)) <= F.least(final + slack, top))
            .select(*_KEY, "m", F.explode(last).alias("start"))
            .distinct(),
            _WINDOW,
        )
        .unionByName(hits.filter("n < m").select(*_KEY, "m", F.lit(0).alias("start")).distinct())
    )
    lists = allowed.groupBy(*_KEY).agg(F.collect_list(F.struct("m", "start")).alias("windows"))
    texts = rows.join(store.border(f"allowed_{width}", lists), _KEY).dropDuplicates(_KEY)
    windows = with_shingles(texts, "text", width).select(
        *_KEY, "id", "shingles", F.explode("windows").alias("w")
    )
    windows = windows.select(
        *_KEY, "id", "w.*", F.slice("shingles", F.col("w.start") + 1, F.col("w.m")).alias("shingles")
    )
    windows = store.border(f"windows_{width}", windows)

    # 2. and 3. Fingerprints within the radius.
    listed = fingerprints(items, ["item", "m"])
    probes = F.array(
        *(
            F.struct(F.lit(i).alias("block"), block.bitwiseXOR(F.lit(mask)).alias("value"))
            for i, block in enumerate(blocks(F.col("fingerprint")))
            for mask in near_masks()
        )
    )
    listed = listed.select("item", "m", F.col("fingerprint").alias("item_print"), F.explode(probes).alias("p"))
    listed = sized(store.border(f"index_{width}", listed.select("item", "m", "item_print", "p.*")))
    own = F.array(
        *(F.struct(F.lit(i).alias("block"), b.alias("value")) for i, b in enumerate(blocks(F.col("fingerprint"))))
    )
    prints = fingerprints(windows, _WINDOW).select(*_WINDOW, "fingerprint", F.explode(own).alias("p"))
    apart = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print")))
    candidates = (
        prints.select(*_WINDOW, "fingerprint", "p.*")
        .join(listed, ["m", "block", "value"])
        .filter(apart <= RADIUS)
        .select(*_WINDOW, "item")
        .distinct()
    )
    candidates = store.border(f"candidates_{width}", candidates)

    # 4. Exact weighted similarity.
    weights = sized(items.select("item", F.explode("shingles").alias("g")).groupBy("item", "g").agg(F.count(F.lit(1)).alias("of_item")))
    counted = (
        windows.join(candidates, _WINDOW)
        .select(*_WINDOW, "id", "item", F.size("shingles").alias("size"), F.explode("shingles").alias("g"))
        .groupBy(*_WINDOW, "id", "item", "size", "g")
        .agg(F.count(F.lit(1)).alias("of_window"))
        .join(weights, ["item", "g"])
    )
    both = counted.groupBy(*_WINDOW, "id", "item", "size").agg(F.sum(F.least("of_window", "of_item")).alias("both"))
    either = F.col("size") + F.col("m") - F.col("both")
    return both.filter(F.col("both") * den >= either * num).select(
        *_KEY, "id", "item", "start", (F.col("size") + width - 1).alias("n_words"), (F.col("both") / either).alias("similarity")
    )


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """(id, item, n_windows, similarity): the items each document holds, with
    the number of matching windows and the best similarity."""
    found = matching_windows(docs, items, id_col=id_col, item_col=item_col)
    return found.groupBy(id_col, item_col).agg(
        F.count(F.lit(1)).alias("n_windows"), F.max("similarity").alias("similarity")
    )
