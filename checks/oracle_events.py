"""Checking SQL for the queries on the order and event tables.

Written in ranked and nested-query form on purpose: the Spark plans aggregate.
"""

from __future__ import annotations


def rounded(x: str, digits: int) -> str:
    """Half away from zero on the digits as they are printed; numbers too large
    for a decimal have no digits to lose."""
    digits_of = f"try_cast(cast({x} AS varchar) AS decimal(38,18))"
    return f"coalesce(cast(round({digits_of}, {digits}) AS double), round(cast({x} AS double), {digits}))"


def _top(cols: str, source: str, key: str, order: str) -> str:
    """First row per key by the given order."""
    return (
        f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn"
        f" FROM {source}) ranked WHERE rn = 1"
    )


INDEX = "idx AS (" + _top(
    "user_id, ts AS index_ts, value AS index_value",
    "(SELECT * FROM events WHERE event_type = 'purchase') p",
    "user_id",
    "ts, event_id",
) + ")"


def _seen(kind: str, side: str) -> str:
    return (
        f"(SELECT e.*, i.index_ts FROM events e JOIN idx i ON e.user_id = i.user_id"
        f" WHERE e.event_type = '{kind}' AND e.ts {side} i.index_ts) s"
    )


def _last(kind: str) -> str:
    return _top(
        "user_id, value AS last_value, epoch_us(ts) AS last_us",
        _seen(kind, "<="),
        "user_id",
        "ts DESC, event_id DESC",
    )


def _extreme(kind: str, which: str) -> str:
    way = "ASC" if which == "min" else "DESC"
    return _top(
        f"user_id, value AS {which}_value, epoch_us(ts) AS extreme_us, ts AS extreme_ts",
        _seen(kind, ">="),
        "user_id",
        f"value {way}, ts",
    )


TREATMENTS = "treatments AS (SELECT l.*, p_name, p_type FROM lineitem l JOIN part ON l_partkey = p_partkey)"
RED_WIDGETS = (
    "(lower(p_name) LIKE '%red%widget%' OR lower(p_name) LIKE '%blue%ring%' OR lower(p_name) = 'old gear')"
)
SEGMENT_CASES = (
    "WHEN lower(c_mktsegment) LIKE '%machine%' THEN 0 WHEN lower(c_mktsegment) LIKE '%house%' THEN 1"
    " WHEN lower(c_mktsegment) LIKE '%build%' THEN 2"
)
VIEW_PAIR = (
    f"pair AS (SELECT u.user_id, l.last_value, n.min_value, x.max_value"
    f" FROM (SELECT DISTINCT e.user_id FROM events e JOIN idx USING (user_id) WHERE event_type = 'view') u"
    f" LEFT JOIN ({_last('view')}) l USING (user_id)"
    f" LEFT JOIN ({_extreme('view', 'min')}) n USING (user_id)"
    f" LEFT JOIN ({_extreme('view', 'max')}) x USING (user_id))"
)
REL_DROP = rounded("(last_value - min_value) / nullif(last_value, 0)", 4)


def _onset(prior: bool) -> str:
    banned = (
        " AND e.user_id NOT IN (SELECT e2.user_id FROM events e2 JOIN idx i2 ON e2.user_id = i2.user_id"
        " WHERE e2.event_type = 'error' AND e2.value > 60 AND e2.ts < i2.index_ts)"
        if prior
        else ""
    )
    return (
        f"WITH {INDEX}, hits AS (SELECT e.user_id, e.ts FROM events e JOIN idx i ON e.user_id = i.user_id"
        f" WHERE e.event_type = 'error' AND e.value > 60 AND e.ts >= i.index_ts{banned})"
        " SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM hits) THEN 1 ELSE 0 END AS flag,"
        " (SELECT epoch_us(min(h.ts)) FROM hits h WHERE h.user_id = idx.user_id) AS first_us FROM idx"
    )


def _flag(name: str, condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END AS {name}"


KINDS = ("view", "click", "error", "signup")

_WIDE = (
    "wide AS (SELECT idx.*, c_mktsegment, c_acctbal, "
    + ", ".join(
        f"l_{k}.last_value AS last_{k}, n_{k}.min_value AS min_{k}, x_{k}.max_value AS max_{k}" for k in KINDS
    )
    + ", e1.t AS error_time, e2.t AS signup_time FROM idx LEFT JOIN customer ON c_custkey = idx.user_id"
    + "".join(
        f" LEFT JOIN ({_last(k)}) l_{k} ON l_{k}.user_id = idx.user_id"
        f" LEFT JOIN ({_extreme(k, 'min')}) n_{k} ON n_{k}.user_id = idx.user_id"
        f" LEFT JOIN ({_extreme(k, 'max')}) x_{k} ON x_{k}.user_id = idx.user_id"
        for k in KINDS
    )
    + f" LEFT JOIN (SELECT user_id, min(ts) AS t FROM {_seen('error', '>=')} WHERE value > 60"
    f" AND user_id NOT IN (SELECT user_id FROM {_seen('error', '<')} WHERE value > 60) GROUP BY user_id) e1"
    " ON e1.user_id = idx.user_id"
    f" LEFT JOIN (SELECT user_id, min(ts) AS t FROM {_seen('signup', '>=')} WHERE value > 60 GROUP BY user_id) e2"
    " ON e2.user_id = idx.user_id)"
)


def _grade(drop: str, flag: str) -> str:
    return (
        f"CASE WHEN {drop} <= 0 THEN NULL WHEN {drop} > 0 AND {drop} < 3 THEN 1"
        f" WHEN {drop} > 3 AND {drop} <= 5 THEN 2 WHEN {drop} > 5 THEN 3 WHEN {flag} = 1 THEN 3 END"
    )


NADIR = f"nadir AS (SELECT user_id, min_value AS nadir, extreme_ts AS nadir_ts FROM ({_extreme('view', 'min')}) m)"
PRIOR = "prior AS (SELECT e.*, nadir, nadir_ts FROM events e JOIN nadir n ON e.user_id = n.user_id WHERE e.event_type = 'view' AND e.ts < nadir_ts)"
RECENT = "recent AS (SELECT * FROM prior WHERE ts >= nadir_ts - INTERVAL 72 HOUR)"
MAXES = (
    f"mw AS ({_top('user_id, value, ts', 'recent', 'user_id', 'value DESC, ts')}), "
    f"mp AS ({_top('user_id, value, ts', 'prior', 'user_id', 'value DESC, ts')})"
)
MINUTES = "(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) // 60000000)"
RATIOS = (
    f"base AS ({_last('view')}), ratios AS (SELECT e.user_id, e.event_id,"
    f" {rounded('e.value / nullif(b.last_value, 0)', 3)} AS ratio,"
    f" {MINUTES} // 60 AS hour_offset,"
    f" cast(ceil(({MINUTES} // 60) / 24) AS bigint) AS day_offset"
    " FROM events e JOIN idx i ON e.user_id = i.user_id JOIN base b ON b.user_id = e.user_id"
    " WHERE e.event_type = 'view' AND e.ts >= i.index_ts)"
)


def _bands(col: str, edges, closed: str, labels, default, open_top=True) -> str:
    op = "<" if closed == "left" else "<="
    cases = " ".join(f"WHEN {col} {op} {e} THEN {n}" for e, n in zip(edges, labels))
    top = f" WHEN {col} IS NOT NULL THEN {labels[len(edges)]}" if open_top else ""
    return f"CASE {cases}{top} ELSE {default} END"


# Purchases, views, and of views at one instant the one with the highest id.
EVERY = (
    "p AS (SELECT * FROM events WHERE event_type = 'purchase'),"
    " v1 AS (SELECT * FROM events WHERE event_type = 'view' AND value IS NOT NULL),"
    " v AS (" + _top("user_id, ts, value", "v1", "user_id, ts", "event_id DESC") + ")"
)

ORACLES = {
    "subject_detail": f"""
        SELECT c_custkey, r_name AS region, CASE {SEGMENT_CASES} END AS segment_code,
               cast(trunc(trunc(c_acctbal) / 60) AS bigint) AS balance_hours, 0 AS start
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "age_string_cast": """
        SELECT * FROM (SELECT o_orderkey, cast(CASE WHEN age LIKE '%>%' THEN 91.4
               ELSE try_cast(age AS decimal(10,2)) END AS double) AS age
          FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '> ' || split_part(o_orderpriority, '-', 1)
                  WHEN split_part(o_orderpriority, '-', 1) = '4' THEN ''
                  ELSE split_part(o_orderpriority, '-', 1) END AS age FROM orders) a) b
        WHERE age >= 2""",
    "first_stay": _top(
        "o_custkey, o_orderkey, epoch_us(o_orderdate) AS order_us", "orders", "o_custkey", "o_orderdate, o_orderkey"
    ),
    "pattern_like": "SELECT p_partkey, p_name, p_type FROM part WHERE lower(p_name) LIKE '%widget%'",
    "pattern_not_like": """
        SELECT p_partkey, p_name, p_type FROM part
        WHERE (lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%gear%')
          AND lower(p_name) NOT LIKE '%small%' AND lower(p_name) NOT LIKE '%old%'""",
    "pattern_similar": """
        SELECT p_partkey, p_name, p_type FROM part WHERE regexp_full_match(lower(p_name),
          '(?s)(red|blue|hot) (ring|bolt)|.*large gi.mo|new.*d.*t|col[cd] rod+')""",
    "pattern_similar_text": r"""
        SELECT doc_id, lang FROM documents WHERE regexp_full_match(lower(text),
          '(?s).*(thorre|ondernt|[aeiou]ationh).*|.*é\..*\(.*') AND lower(text) NOT LIKE '%copyright%'""",
    "pattern_within": """
        SELECT user_id, event_id, event_type, value FROM events
        WHERE event_type LIKE '%i%' AND value IS NOT NULL
          AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 120)""",
    "cohort": f"""
        WITH {TREATMENTS}
        SELECT l_orderkey AS o_orderkey, l_linenumber, p_name, o_custkey, c_acctbal
        FROM treatments JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        WHERE {RED_WIDGETS} AND c_acctbal >= 18""",
    "exclude_ids": """
        SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN
          (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1-%')""",
    "not_in_list": """
        SELECT c_custkey, c_nationkey FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""",
    "variant_count": """
        SELECT l_orderkey FROM (SELECT l_orderkey, count(*) AS c FROM
          (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem) v GROUP BY l_orderkey) n
        WHERE c = 2""",
    "variant_count_literal": """
        WITH v AS (SELECT l_orderkey, l_returnflag, count(*) AS c FROM
          (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) d GROUP BY l_orderkey, l_returnflag)
        SELECT l_orderkey FROM v WHERE c = 1 AND l_orderkey NOT IN
          (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
        UNION SELECT l_orderkey FROM v WHERE c = 2""",
    "index_event": f"WITH {INDEX} SELECT user_id, epoch_us(index_ts) AS index_us, index_value FROM idx",
    "last_before": f"WITH {INDEX} {_last('view')}",
    "last_before_onepass": f"WITH {INDEX} {_last('view')}",
    "extreme_after_min": f"WITH {INDEX} SELECT user_id, min_value, extreme_us FROM ({_extreme('view', 'min')}) m",
    "extreme_after_max": f"WITH {INDEX} SELECT user_id, max_value, extreme_us FROM ({_extreme('click', 'max')}) m",
    "measure_profile": f"WITH {INDEX} "
    + " UNION ALL ".join(
        f"""SELECT u.user_id, '{k}' AS measure, last_value, last_us, n.extreme_us AS min_us, min_value, max_value
            FROM (SELECT DISTINCT user_id FROM events JOIN idx USING (user_id) WHERE event_type = '{k}') u
            LEFT JOIN ({_last(k)}) l ON l.user_id = u.user_id
            LEFT JOIN ({_extreme(k, 'min')}) n ON n.user_id = u.user_id
            LEFT JOIN ({_extreme(k, 'max')}) x ON x.user_id = u.user_id"""
        for k in KINDS
    ),
    "baseline_threshold": f"WITH {INDEX} SELECT * FROM ({_last('view')}) b WHERE last_value >= 10",
    "change_scores": f"""
        WITH {INDEX}, {VIEW_PAIR}
        SELECT user_id, {REL_DROP} AS relative_drop,
               {rounded("last_value - min_value", 4)} AS absolute_drop,
               {rounded("(max_value - last_value) / nullif(last_value, 0)", 4)} AS relative_rise FROM pair""",
    "change_pairs": f"""
        WITH {INDEX}, {VIEW_PAIR}
        SELECT user_id, CASE WHEN min_value IS NOT NULL THEN last_value END AS both_last,
               CASE WHEN last_value IS NOT NULL THEN min_value END AS both_min,
               last_value AS base_last, CASE WHEN last_value IS NOT NULL THEN max_value END AS base_max FROM pair""",
    "first_event_after": _onset(False),
    "new_onset": _onset(True),
    "merged_measurements": f"""
        WITH {INDEX}, merged AS (
          SELECT user_id, date_trunc('hour', ts) AS ts, value FROM events WHERE event_type = 'view'
          UNION SELECT user_id, date_trunc('hour', ts), value FROM events WHERE event_type = 'click')
        {_top("user_id, value AS last_value, epoch_us(ts) AS last_us",
              "(SELECT m.* FROM merged m JOIN idx i ON m.user_id = i.user_id WHERE m.ts <= i.index_ts) s",
              "user_id", "ts DESC, value DESC")}""",
    "source_union": """
        SELECT user_id, value FROM events WHERE event_type = 'view' AND value IS NOT NULL
        UNION SELECT user_id, value FROM events WHERE event_type = 'click' AND value IS NOT NULL
        UNION SELECT user_id, value FROM events WHERE event_type = 'signup' AND value IS NOT NULL""",
    "history_flags": "SELECT doc_id, "
    + ", ".join(
        [
            _flag("has_and", "lower(text) LIKE '% and %'"),
            _flag("has_number", "regexp_matches(text, '[0-9][0-9][0-9]')"),
            _flag("has_mail", "regexp_matches(lower(text), '[a-z]@[a-z]')"),
            _flag("has_license", "regexp_matches(lower(text), 'license|copyright|lizenz')"),
            _flag("has_paren", "text LIKE '%(%)%'"),
            _flag("has_break", "contains(text, chr(10)) AND lower(text) NOT LIKE '%the%'"),
            _flag("has_upper", "text LIKE '%The %'"),
        ]
    )
    + " FROM documents",
    "ever_flag": f"""
        WITH {TREATMENTS} SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey IN
          (SELECT l_orderkey FROM treatments WHERE {RED_WIDGETS}) THEN 1 ELSE 0 END AS matched FROM orders""",
    "timed_flags": f"WITH {INDEX} SELECT user_id, "
    + ", ".join(
        [
            _flag("error_before", f"user_id IN (SELECT user_id FROM {_seen('error', '<')})"),
            _flag("error_from", f"user_id IN (SELECT user_id FROM {_seen('error', '>=')})"),
            _flag("signup_until", f"user_id IN (SELECT user_id FROM {_seen('signup', '<=')})"),
            _flag("click_ever", "user_id IN (SELECT user_id FROM events WHERE event_type = 'click')"),
        ]
    )
    + " FROM idx",
    "treatment_before_stay": f"""
        WITH {TREATMENTS} SELECT DISTINCT o_orderkey FROM treatments JOIN orders ON l_orderkey = o_orderkey
        WHERE lower(p_name) LIKE '%gear%' AND lower(p_name) NOT LIKE '%small%' AND l_shipdate < o_orderdate""",
    "multi_source_flag": f"""
        WITH {TREATMENTS}, listed AS (
          SELECT l_orderkey AS k FROM treatments WHERE regexp_full_match(lower(p_name), '(?s).*red.*(ring|rod).*')
          UNION SELECT l_orderkey FROM treatments WHERE lower(p_type) = 'promo'
          UNION SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%')
        SELECT o_orderkey, o_orderstatus,
               CASE WHEN o_orderkey IN (SELECT k FROM listed) THEN 1 ELSE 0 END AS flagged FROM orders""",
    "feature_matrix": f"""
        WITH {INDEX}, {_WIDE} SELECT user_id, index_value, c_mktsegment, c_acctbal,
          {", ".join(f"last_{k}, min_{k}, max_{k}" for k in KINDS)},
          epoch_us(error_time) AS error_us, epoch_us(signup_time) AS signup_us FROM wide""",
    "bands": f"""
        WITH {INDEX}, {VIEW_PAIR}, d AS (SELECT *, {REL_DROP} AS drop_ FROM pair)
        SELECT user_id, {_bands("drop_", [0.25, 0.5, 0.75], "left", [1, 2, 3, 4], 0)} AS left_bands,
          {_bands("drop_", [0.25, 0.5, 0.75, 1.0], "right", [1, 2, 3, 4], "NULL", False)} AS right_bands,
          {_bands("min_value", [1, 5, 10], "right", [4, 3, 2, 1], 0)} AS nadir_band,
          CASE WHEN drop_ < 0.5 THEN 0 WHEN drop_ >= 0.5 THEN 1 END AS limit_flag,
          {_grade("(last_value - min_value)", "0")} AS grade FROM d""",
    "composite_scores": f"""
        WITH {INDEX}, {_WIDE}, f AS (SELECT *, CASE WHEN error_time IS NULL THEN 0 ELSE 1 END AS ne,
          CASE WHEN signup_time IS NULL THEN 0 ELSE 1 END AS ls, max_view - min_view AS drop_ FROM wide)
        SELECT user_id, CASE WHEN ne = 1 OR ls = 1 THEN 1 ELSE 0 END AS any_flag,
          epoch_us(CASE WHEN ne = 1 AND ls = 1 THEN least(error_time, signup_time)
            WHEN ne = 1 THEN error_time WHEN ls = 1 THEN signup_time END) AS first_us,
          CASE WHEN ne = 1 AND drop_ > 3 THEN 1 WHEN ls = 1 THEN 1 WHEN drop_ > 5 THEN 1 ELSE 0 END AS severe,
          {_grade("drop_", "ls")} AS grade,
          {rounded("last_view * (1.0::double / 3) + last_click * 0", 4)} AS mean_literal,
          {rounded("last_view * (1.0::double / 3) + last_click * (2.0::double / 3)", 4)} AS mean_usual,
          {rounded("max_click / nullif(pow(max_view / 100, 2), 0)", 2)} AS ratio_pow,
          {rounded("c_acctbal / 18", 3)} AS scaled,
          CASE WHEN last_signup IS NULL THEN min_signup ELSE last_signup END AS filled,
          CASE {SEGMENT_CASES} ELSE 9 END AS segment_code FROM f""",
    "prior_window_extreme": f"""
        WITH {INDEX}, {NADIR}, {PRIOR}, {RECENT}, {MAXES}
        SELECT n.user_id, nadir, epoch_us(nadir_ts) AS nadir_us, mw.value AS max_window,
          epoch_us(mw.ts) AS max_window_us, mp.value AS max_prior, epoch_us(mp.ts) AS max_prior_us,
          {rounded("mw.value - nadir", 4)} AS delta_window, {rounded("mp.value - nadir", 4)} AS delta_prior
        FROM nadir n LEFT JOIN mw ON mw.user_id = n.user_id LEFT JOIN mp ON mp.user_id = n.user_id""",
    "lookback_readings": f"WITH {INDEX}, {NADIR}, {PRIOR}, {RECENT} SELECT user_id, event_id, value FROM recent",
    "every_last_before": f"""
        WITH {EVERY} SELECT p.user_id, p.event_id, v.value AS last_value, epoch_us(v.ts) AS last_us
        FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "every_extreme_after": f"""
        WITH {EVERY}, s AS (SELECT p.event_id, v.value, v.ts FROM p JOIN v1 AS v ON p.user_id = v.user_id AND v.ts >= p.ts),
             low AS ({_top("event_id, value, ts", "s", "event_id", "value, ts")}),
             high AS ({_top("event_id, value, ts", "s", "event_id", "value DESC, ts")})
        SELECT p.user_id, p.event_id, low.value AS min_value, epoch_us(low.ts) AS min_us,
          high.value AS max_value, epoch_us(high.ts) AS max_us
        FROM p LEFT JOIN low ON low.event_id = p.event_id LEFT JOIN high ON high.event_id = p.event_id""",
    "every_prior_window": f"""
        WITH {EVERY}, s AS (SELECT p.event_id, v.value, v.ts FROM p JOIN v1 AS v ON p.user_id = v.user_id
               AND v.ts < p.ts AND v.ts >= p.ts - INTERVAL 72 HOURS),
             high AS ({_top("event_id, value, ts", "s", "event_id", "value DESC, ts")})
        SELECT p.user_id, p.event_id, high.value AS max_window, epoch_us(high.ts) AS max_window_us
        FROM p LEFT JOIN high ON high.event_id = p.event_id""",
    "refreshed_profile": f"""
        WITH every AS (SELECT * FROM events), events AS (SELECT * FROM every WHERE NOT coalesce(value > 150, false)),
             {INDEX}, last AS ({_last("view")}), low AS ({_extreme("view", "min")}), high AS ({_extreme("view", "max")})
        SELECT i.user_id, epoch_us(index_ts) AS index_us, index_value, last_value, min_value,
          low.extreme_us AS min_us, max_value
        FROM idx i LEFT JOIN last ON last.user_id = i.user_id LEFT JOIN low ON low.user_id = i.user_id
        LEFT JOIN high ON high.user_id = i.user_id""",
    "lookback_bounded": f"WITH {INDEX}, {NADIR}, {PRIOR}, {RECENT} SELECT user_id, event_id, value FROM recent",
    "tie_audit": """
        WITH v AS (SELECT user_id, date_trunc('hour', ts) AS hour, value FROM events WHERE event_type = 'view'),
             r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY hour DESC) AS place FROM v WHERE hour IS NOT NULL)
        SELECT user_id, epoch_us(hour) AS hour_us, count(*) AS n_rows FROM r WHERE place = 1
        GROUP BY user_id, hour HAVING count(DISTINCT value) > 1""",
    # Within the size up to which sketches are exact.
    "coverage_sketches": """
        SELECT event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, count(DISTINCT user_id) AS subjects
        FROM events GROUP BY ALL""",
    "attrition_overlap": f"""
        WITH {INDEX}, base AS ({_last("view")}),
             s AS (SELECT DISTINCT 1 AS step, 'index' AS stage, user_id FROM idx
                   UNION SELECT 2, 'baseline', user_id FROM base
                   UNION SELECT 3, 'limit', user_id FROM base WHERE last_value >= 10
                   UNION SELECT 4, 'error', user_id FROM events WHERE event_type = 'error' AND value > 60),
             n AS (SELECT DISTINCT step, stage FROM s)
        SELECT a.stage, b.stage AS other, (SELECT count(*) FROM s x JOIN s y ON x.user_id = y.user_id
            WHERE x.step = a.step AND y.step = b.step) AS subjects FROM n a JOIN n b ON a.step <= b.step""",
    "dictionary_flags": f"""
        WITH {TREATMENTS}, t AS (SELECT l_orderkey, lower(p_name) AS n FROM treatments),
             m AS (SELECT l_orderkey, n LIKE 'red %' AS a, n LIKE '%widget%' AS b, n LIKE '%ring' OR n LIKE '%rod' AS c,
                     n LIKE '%gear%' AND n NOT LIKE '%small%' AND n NOT LIKE '%old%' AS d,
                     regexp_full_match(n, 'col[cd] .*|.*new.*d.*t') AS e FROM t)
        SELECT l_orderkey AS o_orderkey, max(a::INT) AS has_red, max(b::INT) AS has_widget, max(c::INT) AS has_ring_or_rod,
          max(d::INT) AS has_plain_gear, max(e::INT) AS has_cold FROM m GROUP BY l_orderkey""",
    "exclude_by_flag": f"""
        WITH {INDEX} SELECT user_id, index_value FROM idx
        WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150)""",
    "ratio_series": f"WITH {INDEX}, {RATIOS} SELECT user_id, event_id, ratio, hour_offset, day_offset FROM ratios",
    "daily_coverage": f"""
        WITH {INDEX}, {RATIOS} SELECT day_offset, count(*) AS subjects
        FROM (SELECT DISTINCT user_id, day_offset FROM ratios) d GROUP BY day_offset ORDER BY day_offset""",
    "event_pipeline": f"""
        WITH {INDEX}, {_WIDE}, {NADIR}, {PRIOR}, {RECENT}, {MAXES},
        f AS (SELECT w.*, mw.value AS max_window, mp.value AS max_prior,
          {rounded("(last_view - min_view) / nullif(last_view, 0)", 4)} AS drop_,
          {rounded("mw.value - min_view", 4)} AS delta_window,
          CASE WHEN error_time IS NULL THEN 0 ELSE 1 END AS ne,
          CASE WHEN signup_time IS NULL THEN 0 ELSE 1 END AS ls
          FROM wide w LEFT JOIN mw ON mw.user_id = w.user_id LEFT JOIN mp ON mp.user_id = w.user_id
          WHERE last_view IS NOT NULL AND min_view IS NOT NULL AND w.user_id NOT IN
            (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150))
        SELECT user_id, epoch_us(index_ts) AS index_us, index_value, c_mktsegment, last_view, min_view,
          drop_ AS "drop", {_bands("drop_", [0.25, 0.5, 0.75], "left", [1, 2, 3, 4], 0)} AS drop_band,
          last_click, max_click, {rounded("(max_click - last_click) / nullif(last_click, 0)", 4)} AS click_rise,
          ne AS new_error, ls AS late_signup, CASE WHEN ne = 1 OR ls = 1 THEN 1 ELSE 0 END AS any_flag,
          max_prior, delta_window,
          CASE WHEN ne = 1 AND delta_window > 3 THEN 1 WHEN delta_window > 5 THEN 1 WHEN ls = 1 THEN 1
            ELSE 0 END AS severe, {rounded("c_acctbal / 10", 3)} AS balance_10 FROM f""",
    "attrition": f"""
        WITH {INDEX}, base AS ({_last("view")})
        SELECT 1 AS step, 'users' AS stage, count(DISTINCT user_id) AS subjects FROM events
        UNION ALL SELECT 2, 'index', count(DISTINCT user_id) FROM idx
        UNION ALL SELECT 3, 'baseline', count(DISTINCT user_id) FROM base
        UNION ALL SELECT 4, 'limit', count(DISTINCT user_id) FROM base WHERE last_value >= 10""",
}
