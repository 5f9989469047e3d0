"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bktree, bpe, chat, decontaminate, langid, linedup, minhash, parity, prefixtrie, quality, repair, repeats, warc
from ..sources.stages import StageStore
from .ship import ship_package

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
OFFSET_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

# A conversation whose texts hold the template's own control strings.
CONTROL_TURNS = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_conversation(table(spark, sf_dir, "conversations"), -1, CONTROL_TURNS)
    return chat.format_digests(rows, OFFSET_TOKENIZER).drop("n_tokens", "loss_tokens")


def op6_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.jaccard_classes(table(spark, sf_dir, "documents"))


def op7_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.length("kept").cast("bigint").alias("n_kept")
    )


def op9_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linedup.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("_lines.n_lines").alias("n_lines"),
        F.size("_lines.removed").alias("n_removed"),
        F.col("_lines.removed").alias("removed_lines"),
        F.array_sort("_lines.partners").alias("partners"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_double_array_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation takes its first turns, eight at the most, from the one
    whose id is the next lower multiple of five."""
    turns = prefixtrie.turns_of(table(spark, sf_dir, "conversations"))
    turns = StageStore.for_session(spark).border("turns", turns)
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    base = F.col("conv_id") - F.col("conv_id") % 5
    return prefixtrie.trie_nodes(prefixtrie.shared_heads(turns, head, base, 8))


def op12_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bktree.near_classes(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Query] = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_decontamination": op2_decontamination,
    "op3_byte_level_bpe": op3_byte_level_bpe,
    "op4_warc": op4_warc,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_parity_sketch_join": op6_parity_sketch_join,
    "op7_minhash_fingerprints": op7_minhash_fingerprints,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_line_alignment": op9_line_alignment,
    "op10_language_id": op10_language_id,
    "op11_double_array_trie": op11_double_array_trie,
    "op12_bk_tree": op12_bk_tree,
    "op13_conversation_repair": op13_conversation_repair,
}

_TURNS = """
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
"""


def _escaped(text: str) -> str:
    """SQL for the escaped form of a text; a backslash is an ordinary character
    in DuckDB's literals."""
    back = "\\"
    text = f"replace({text}, '{back}', '{back * 2}')"
    for mark in chat.CONTROL:
        text = f"replace({text}, '{mark}', '{mark[0]}{back}{mark[1:]}')"
    return text


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text, bit by bit."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), lambda i: ascii({text}[i])::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""


def _edit(state: str, letters: str, cost: str) -> str:
    """SQL for a state's least cost and audit with more edits behind."""
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letters}'}}"


def _turn_edits(states: tuple[str, ...], initial: str) -> str:
    """SQL for a row that becomes the turn due after any of some states, by keeping or a new role."""
    kept = [f"CASE WHEN NOT gone AND initial = '{initial}' THEN {_edit(s, 'K', 'broken')} END" for s in states]
    return ", ".join(kept + [f"CASE WHEN NOT gone THEN {_edit(s, 'R', '(1 + broken)')} END" for s in states])


# Least costs and audits by state of the pattern, with turns inserted ahead.
_INSERTED = f"""s0 AS z0, s1 AS z1,
    list_min([s2, {_edit("s0", "I", "5")}, {_edit("s1", "I", "5")}, {_edit("s3", "I", "5")}]) AS z2,
    list_min([s3, {_edit("s2", "I", "5")}, {_edit("s0", "II", "10")}, {_edit("s1", "II", "10")}]) AS z3"""

ORACLES: dict[str, str] = {
    "op2_decontamination": """
        WITH words AS (
                 SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w
                 FROM documents WHERE text IS NOT NULL
                 UNION ALL
                 SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')
                 FROM benchmark WHERE text IS NOT NULL),
             s AS (SELECT kind, id, greatest(len(w) - 4, 0) AS n,
                          unnest(list_transform(range(1, len(w) - 3), lambda i: {'at': i - 1, 'g': array_to_string(w[i:i+4], ' ')})) AS x
                   FROM words),
             item AS (SELECT id AS item_id, n AS m, x.g AS g, count(*) AS k FROM s WHERE kind = 'i' GROUP BY ALL),
             hit AS (SELECT id AS doc_id, n, x.at AS pos, x.g AS g, item_id, m, k
                     FROM s JOIN item ON kind = 'd' AND x.g = item.g),
             start AS (SELECT DISTINCT doc_id, item_id, unnest(range(greatest(pos - m + 1, 0), least(pos, greatest(n - m, 0)) + 1)) AS s
                       FROM hit),
             shared AS (SELECT doc_id, item_id, s, g, any_value(n) AS n, any_value(m) AS m, least(count(*), any_value(k)) AS c
                        FROM start JOIN hit USING (doc_id, item_id) WHERE pos >= s AND pos < s + m GROUP BY ALL),
             w AS (SELECT doc_id, item_id, s, sum(c)::BIGINT AS c, least(any_value(n), any_value(m)) + any_value(m) AS total
                   FROM shared GROUP BY ALL)
        SELECT doc_id, item_id, count(*) AS n_windows, max(c / (total - c)) AS similarity
        FROM w WHERE 10 * c >= 8 * (total - c) GROUP BY ALL""",
    "op6_parity_sketch_join": f"""
        WITH RECURSIVE w AS (
                 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                                                   '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
                       WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                       ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) END) AS g
                   FROM w),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g)
                   WHERE a.doc_id <> b.doc_id GROUP BY ALL),
             e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
                   WHERE 100 * c >= 90 * (x.n + y.n - c)),
             r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
        SELECT id AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id
        FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY id""",
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
             o AS (SELECT html, max(page_id) AS owner FROM p WHERE n >= 1000 GROUP BY html)
        SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN owner <> page_id THEN owner END AS refers_to
        FROM p LEFT JOIN o USING (html)""",
    # Token counts depend on the tokenizer's merges, so they are left out on both sides.
    "op5_chat_formatting": f"""
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
                   AS loss_sha256,
               sum(length({_escaped("text")}) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13
                   WHEN 'assistant' THEN 7 ELSE 25 + length({_escaped("role")}) END)::BIGINT AS formatted_chars
        FROM ({_TURNS}) GROUP BY conv_id""",
    "op11_double_array_trie": f"""
        WITH t AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS w,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                              md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
                   FROM conversations WHERE conv_id IS NOT NULL),
             own AS (SELECT conv_id, list(w ORDER BY pos) AS w, conv_id::VARCHAR AS name FROM t GROUP BY conv_id),
             h AS (SELECT *, {_crc32("name")} % 9 AS h FROM own),
             r AS (SELECT h.conv_id, list_concat(coalesce(b.w[1:h], []), h.w[h + 1:]) AS w
                   FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
             d AS (SELECT *, list_transform(w, lambda x: md5(length(x.role) || ':' || x.role || x.text)) AS d, unnest(range(0, len(w) + 1)) AS k FROM r),
             n AS (SELECT array_to_string(d[1:k], '') AS key, any_value(k) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                          any_value(CASE WHEN k > 0 THEN octet_length(encode(w[k].text)) ELSE 0 END) AS size,
                          string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (k = len(w)) AS ends
                   FROM d GROUP BY key),
             c AS (SELECT key[:-33] AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
             f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (key)),
             up AS (SELECT unnest(list_transform(range(0, depth + 1), lambda j: left(key, 32 * j))) AS key,
                           (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * size AS saved FROM f),
             s AS (SELECT key, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY key)
        SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves,
               saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
        FROM f JOIN s USING (key) LEFT JOIN f p ON f.depth > 0 AND p.key = left(f.key, 32 * (f.depth - 1))""",
    "op13_conversation_repair": f"""
        WITH RECURSIVE o AS (
                 SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
             x AS (SELECT *, {_crc32("name")} % 20 AS fault FROM o),
             e AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                          CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                          unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM x WHERE fault <> 0),
             g AS (SELECT *, left(role, 1) AS initial, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM e),
             d AS (SELECT *, last = '' AS is_blank, last <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS is_repeat,
                          lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM g),
             r AS (SELECT *, is_blank OR is_repeat AS gone, NOT is_blank AND NOT is_repeat AND last NOT IN ('.', '!', '?') AS is_broken FROM d),
             q AS (SELECT *, CASE WHEN is_broken THEN 5 ELSE 0 END AS broken FROM r),
             dp AS (SELECT DISTINCT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR) AS s1,
                           NULL::STRUCT(c BIGINT, a VARCHAR) AS s2, NULL::STRUCT(c BIGINT, a VARCHAR) AS s3 FROM conversations
                    UNION ALL
                    SELECT conv_id, pos, {_edit("z0", "D", "2")},
                           list_min([{_edit("z1", "D", "2")}, CASE WHEN NOT gone AND initial = 's' THEN {_edit("z0", "K", "broken")} END]),
                           list_min([{_edit("z2", "D", "2")}, {_turn_edits(("z0", "z1", "z3"), "u")}]),
                           list_min([{_edit("z3", "D", "2")}, {_turn_edits(("z2",), "a")}])
                    FROM (SELECT q.*, {_INSERTED} FROM dp JOIN q ON q.conv_id IS NOT DISTINCT FROM dp.conv_id AND q.pos = dp.pos + 1)),
             done AS (SELECT conv_id, list_min([z0, z3]) AS z FROM (SELECT conv_id, {_INSERTED} FROM dp
                      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1)),
             step AS (SELECT conv_id, z.a AS a, unnest(range(1, length(z.a) + 1)) AS j FROM done),
             placed AS (SELECT conv_id, j, a[j] AS edit, sum((a[j] <> 'I')::INT) OVER w AS pos, sum((a[j] <> 'D')::INT) OVER w AS m
                        FROM step WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
             said AS (SELECT p.*, q.role, q.text, max(CASE WHEN m = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END)
                                 OVER (PARTITION BY p.conv_id) AS first_s
                      FROM placed p LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM p.conv_id AND q.pos = p.pos),
             line AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - first_s) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                 || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS lines
                      FROM said WHERE edit <> 'D' GROUP BY conv_id),
             counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank,
                               count(*) FILTER (is_repeat) AS duplicate, count(*) FILTER (is_broken) AS truncated,
                               count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
        SELECT done.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, z.c AS cost, z.a AS audit,
               sha256(coalesce(lines, '')) AS repaired_sha256
        FROM done LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM done.conv_id
        LEFT JOIN line ON line.conv_id IS NOT DISTINCT FROM done.conv_id""",
}
