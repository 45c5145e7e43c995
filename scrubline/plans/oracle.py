"""SQL for DuckDB that gives the same rows as each registered query."""

from __future__ import annotations

from scrubline.functions.text import NA_TOKENS
from scrubline.plans.views import BOOL_CYCLE, DATE_FORMS, HEADER_ENDINGS, NA_CYCLE, UNPARSABLE_DATE

# Whitespace spelled out, since RE2 has no Unicode mode.
_WS = (
    r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
    r"\x{205F}\x{3000}]+"
)
_NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_lit(v) for v in values) + "]"


def _norm(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}', ' ', 'g'))"


def _na(c: str) -> str:
    """Normalized cell, NULL when missing."""
    tokens = ", ".join(_lit(t) for t in NA_TOKENS)
    return f"CASE WHEN lower({_norm(c)}) NOT IN ({tokens}) THEN {_norm(c)} END"


def _bool(c: str) -> str:
    return (
        f"CASE WHEN lower({c}) IN ('true','t','yes','y','1') THEN true "
        f"WHEN lower({c}) IN ('false','f','no','n','0') THEN false END"
    )


def _bare(c: str) -> str:
    signed = (
        f"CASE WHEN starts_with({c}, '(') AND ends_with({c}, ')') "
        f"THEN '-' || substr({c}, 2, length({c}) - 2) ELSE {c} END"
    )
    body = f"regexp_replace(replace(replace({signed}, ',', ''), ' ', ''), '%$', '')"
    return f"CASE WHEN regexp_matches({body}, '{_NUMBER}') THEN {body} END"


def _num(c: str) -> str:
    return f"(TRY_CAST({_bare(c)} AS DOUBLE) + 0.0::DOUBLE)"


def _date(c: str) -> str:
    formats = (
        "%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d", "%d/%m/%Y", "%m/%d/%Y",
        "%d-%m-%Y", "%m-%d-%Y", "%Y.%m.%d", "%Y/%m/%d %H:%M:%S", "%m/%d/%Y %H:%M:%S",
        "%d/%m/%Y %H:%M:%S",
    )
    return f"try_strptime({c}, {_list(formats)})"


_BALANCE = "CAST(c_acctbal AS DECIMAL(18,2))"


def _thousands(c: str) -> str:
    text = f"CAST({c} AS VARCHAR)"
    return (
        f"(CASE WHEN {c} < 0 THEN '-' ELSE '' END || "
        f"format('{{:,}}', CAST(split_part(ltrim({text}, '-'), '.', 1) AS BIGINT)) || '.' || "
        f"split_part({text}, '.', 2))"
    )


V1 = f"""v1 AS (SELECT c_custkey,
  CASE c_custkey % 4 WHEN 0 THEN '  ' || c_name || '  '
    WHEN 1 THEN replace(c_name, '#', chr(160) || chr(9) || '#')
    WHEN 2 THEN c_name || chr(9) ELSE c_name END AS name_raw,
  CASE WHEN c_custkey % 3 = 0 THEN {_list(NA_CYCLE)}[((c_custkey // 3) % 9 + 1)::INT]
    ELSE c_mktsegment END AS segment_raw,
  CASE WHEN {_BALANCE} < 0 THEN '(' || {_thousands('-' + _BALANCE)} || ')'
    WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN {_thousands(_BALANCE)}
    WHEN c_custkey % 5 = 2 THEN CAST({_BALANCE} AS VARCHAR)
    WHEN c_custkey % 5 = 3 THEN CAST({_BALANCE} AS VARCHAR) || '%'
    ELSE ' ' || CAST({_BALANCE} AS VARCHAR) || ' ' END AS bal_raw,
  {_list(BOOL_CYCLE)}[(c_custkey % 10 + 1)::INT] AS active_raw,
  CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '0' END AS flag01_raw
  FROM customer)"""

_forms = " ".join(
    f"WHEN o_orderkey % 6 = {i} THEN strftime(o_orderdate, {_lit(f)})"
    for i, f in enumerate(DATE_FORMS)
)
V2 = f"""v2 AS (SELECT o_orderkey,
  CASE WHEN o_orderkey % 50 = 0 THEN strftime(o_orderdate, {_lit(UNPARSABLE_DATE)}) {_forms} END
    AS date_raw,
  strftime(o_orderdate, '%m/%d/%Y %H:%M:%S') AS us_ts_raw FROM orders)"""

_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate"
_PLACE = (
    "(((l_orderkey::HUGEINT * 100 + l_linenumber) * 100000000000 + l_partkey) * 10000000000"
    " + l_suppkey)"
)


def _gap(value: str, k: int) -> str:
    return (
        f"CASE WHEN (l_orderkey + l_partkey) % 100 = 7 "
        f"OR (l_orderkey + l_linenumber + l_partkey + {k}) % 50 = 0 THEN NULL ELSE {value} END"
    )


V3 = f"""v3 AS (SELECT {_KEY}, {_PLACE} AS place,
  {_gap('CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR)', 0)} AS qty_raw,
  {_gap('CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)', 1)} AS price_raw,
  {_gap('l_returnflag', 2)} AS flag_raw, CAST(NULL AS VARCHAR) AS note_raw FROM lineitem)"""

V4 = """v4 AS (SELECT *, 0 AS copy_no FROM events
  UNION ALL SELECT *, 1 FROM events WHERE event_id % 50 = 0
  UNION ALL SELECT * REPLACE (value + 1.0 AS value), 2 FROM events WHERE event_id % 100 = 1)"""

V5 = f"""v5 AS (SELECT p_partkey // 10 AS file_id, CAST(p_partkey % 10 AS INT) AS position,
  p_type || {_list(HEADER_ENDINGS)}[(p_partkey % 5 + 1)::INT] AS name_raw FROM part)"""

# The fields each line was joined from, so that the expected cells need no CSV parsing.
V7 = """v7 AS (SELECT CAST(o_orderkey % 40 AS INT) AS file_id, o_orderkey,
  [',', ';', chr(9), '|'][(o_orderkey % 4 + 1)::INT] AS d,
  CAST(o_orderkey AS VARCHAR) AS id,
  CASE WHEN (o_orderkey // 40) % 10 = 5
    THEN o_orderpriority || [',', ';', chr(9), '|'][(o_orderkey % 4 + 1)::INT] || ' "x"'
    ELSE o_orderpriority END AS priority,
  CASE WHEN (o_orderkey // 40) % 3 = 0 THEN '  ' || o_orderstatus || ' ' ELSE o_orderstatus END AS status,
  CASE WHEN (o_orderkey // 40) % 20 <> 3
    THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS price,
  CASE WHEN (o_orderkey // 40) % 20 = 7 THEN 'more' END AS extra_1,
  CASE (o_orderkey // 40) % 20 WHEN 3 THEN 3 WHEN 7 THEN 5 ELSE 4 END AS cells FROM orders)"""

_PROFIT = (
    "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(3,2)))"
)


def _money(c: str) -> str:
    return f"CAST(round({c}, 2) AS DOUBLE)"


def _cell_counts(view: str, columns: list[str]) -> str:
    """One row of counters per column of a view."""
    parts = []
    for c in columns:
        parts.append(
            f"SELECT '{c}' AS column_name, count(*) AS total, count(t) AS nonmissing, "
            f"count(n) AS \"numeric\", count(*) FILTER (n = floor(n)) AS whole, "
            f"count(*) FILTER (n <> floor(n)) AS fractional, count(b) AS \"boolean\", "
            f"count(d) AS dates FROM (SELECT t, {_num('t')} AS n, {_bool('t')} AS b, "
            f"{_date('t')} AS d FROM (SELECT {_na(c)} AS t FROM {view}))"
        )
    return " UNION ALL ".join(parts)


_PROFILE = (
    _cell_counts("v1", ["name_raw", "segment_raw", "bal_raw", "active_raw", "flag01_raw"])
    + " UNION ALL "
    + _cell_counts("v2", ["date_raw", "us_ts_raw"])
)


def _fill(statistic: str | None) -> str:
    def filled(c: str) -> str:
        value = f"CAST({c} AS DOUBLE)"
        if statistic is None:
            return f"round({value}, 4) AS {c}"
        return f"round(coalesce({value}, (SELECT {statistic}({value}) FROM v3)), 4) AS {c}"

    return (
        f"WITH {V3} SELECT {_KEY}, {filled('qty_raw')}, {filled('price_raw')}, flag_raw, note_raw "
        "FROM v3"
    )


def _mode(c: str) -> str:
    return (
        f"(SELECT {c} FROM v3 WHERE {c} IS NOT NULL GROUP BY {c} "
        f"ORDER BY count(*) DESC, min(place) ASC, {c} LIMIT 1)"
    )


_NOT_EMPTY = "NOT (qty_raw IS NULL AND price_raw IS NULL AND flag_raw IS NULL)"
_STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"


def _audit(rows: str, dataset: str, keys: str, empty: str) -> str:
    """Counters per dataset of rows with a flag for emptiness and a duplicate key."""
    return (
        f"SELECT {dataset} AS dataset, count(*) + 1 AS rows_in, "
        f"count(*) FILTER ({empty}) AS empty_rows_dropped, "
        f"count(*) FILTER (NOT ({empty})) - count(DISTINCT CASE WHEN NOT ({empty}) THEN {keys} END) "
        f"AS duplicate_rows_dropped, "
        f"count(DISTINCT CASE WHEN NOT ({empty}) THEN {keys} END) AS rows_out "
        f"FROM {rows} GROUP BY {dataset}"
    )


def _candidates(name: str, columns: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, count(DISTINCT {c}) / count(*) AS ratio "
        f"FROM {name}"
        for i, c in enumerate(columns)
    )
    return (
        f"(SELECT '{name}' AS table_name, CAST(position AS INT) AS position, column_name, "
        f"round(ratio, 6) AS ratio FROM ({parts}) WHERE ratio > 0.9 "
        f"ORDER BY ratio DESC, position LIMIT 3)"
    )


_LINK = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>.*?</a\s*>"""
_LINK_TEXT = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["''][^"'']*["''][^>]*>(.*?)</a\s*>"""


def _plain(c: str) -> str:
    text = f"regexp_replace({c}, '(?s)<[^>]*>', '', 'g')"
    for entity, char in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
        ("&amp;", "&"),
    ):
        text = f"replace({text}, '{entity}', '{char}')"
    return f"trim(regexp_replace({text}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


_STATEMENTS = f"""SELECT c_custkey // 25 AS page_id, 0 AS table_no,
  CAST(row_number() OVER (PARTITION BY c_custkey // 25 ORDER BY c_custkey) AS INT) AS row_no,
  false AS is_header, c_name AS c0, c_mktsegment || ' & Co' AS c1, {_thousands(_BALANCE)} AS c2
  FROM customer
  UNION ALL SELECT DISTINCT c_custkey // 25, 0, 0, true, 'Name', 'Segment', 'Balance' FROM customer"""

_MISSPELL = "CASE WHEN contains({0}, 'a') THEN replace({0}, 'a', 'aaa') ELSE {0} || '111' END"


def _typed_customer(balance: str, active: str, flag: str) -> str:
    return (
        f"WITH {V1} SELECT c_custkey, {_na('name_raw')} AS name_raw, "
        f"{_na('segment_raw')} AS segment_raw, {balance} AS bal_raw, {active} AS active_raw, "
        f"{flag} AS flag01_raw FROM v1"
    )


_CLEAN_TEXT = _typed_customer(
    f"CAST({_num(_norm('bal_raw'))} AS VARCHAR)",
    f"CAST({_bool('active_raw')} AS VARCHAR)",
    "flag01_raw",
)

_DEFECTS = f"""WITH e AS (SELECT event_id,
    CASE WHEN event_id % 50 = 3 THEN NULL ELSE user_id END AS user_id,
    CASE WHEN event_id % 100 = 5 THEN {_MISSPELL.format('event_type')} ELSE event_type END
      AS event_type,
    CASE WHEN event_id % 1000 = 0 THEN 100000.0 + event_id % 900000
      WHEN event_id % 100 = 1 THEN -value ELSE value END AS value,
    CASE WHEN event_id % 50 = 4 THEN NULL ELSE props END AS props FROM events)
  SELECT * FROM e UNION ALL SELECT * FROM e WHERE event_id % 50 = 0"""

_EVENT_TYPES = ["click", "purchase", "signup", "view"]


def all_oracles() -> dict[str, str]:
    fields = "SELECT file_id, o_orderkey, {} FROM v7"
    return {
        "normalize_whitespace": f"WITH {V1} SELECT 'customer' AS src, c_custkey AS id, "
        f"{_norm('name_raw')} AS cleaned FROM v1 UNION ALL "
        f"SELECT 'documents', doc_id, {_norm('text')} FROM documents",
        "na_normalize": f"WITH {V1} SELECT c_custkey, {_na('segment_raw')} AS segment FROM v1",
        "parse_boolean": f"WITH {V1} SELECT c_custkey, {_bool(_norm('active_raw'))} AS active, "
        f"{_bool(_norm('flag01_raw'))} AS flag01, {_bool(_norm('segment_raw'))} AS segment FROM v1",
        "parse_numeric": f"WITH {V1}, n AS (SELECT c_custkey, {_num('t')} AS value FROM "
        f"(SELECT c_custkey, {_norm('bal_raw')} AS t FROM v1)) SELECT c_custkey, value, "
        "CASE WHEN value = floor(value) THEN 'int' WHEN value IS NOT NULL THEN 'float' END AS kind "
        "FROM n",
        "parse_dates": f"WITH {V2} SELECT o_orderkey, strftime({_date('date_raw')}, '%Y-%m-%d') "
        f"AS order_day, strftime({_date('us_ts_raw')}, '%d.%m.%Y %H:%M:%S') AS order_time FROM v2",
        "column_profile": f"WITH {V1}, {V2} {_PROFILE}",
        "infer_types": f"WITH {V1}, {V2}, p AS ({_PROFILE}) SELECT column_name, "
        "CASE WHEN nonmissing = 0 THEN 'string' "
        "WHEN \"numeric\" / nonmissing >= 0.9 THEN "
        "CASE WHEN fractional > 0 THEN 'float' ELSE 'integer' END "
        "WHEN \"boolean\" / nonmissing >= 0.9 THEN 'boolean' "
        "WHEN dates / nonmissing >= 0.9 THEN 'date' ELSE 'string' END AS type FROM p",
        "clean_typed": _typed_customer(
            _num(_norm("bal_raw")), _bool("active_raw"), "CAST(flag01_raw AS BIGINT)"
        ),
        "clean_text": _CLEAN_TEXT,
        "clean_rejects": f"WITH {V2} SELECT o_orderkey, 'date_raw' AS column_name, "
        f"date_raw AS raw_value, 'date' AS wanted_type FROM v2 WHERE {_date('date_raw')} IS NULL",
        "fill_mean": _fill("avg"),
        "fill_median": _fill("median"),
        "fill_zero": f"WITH {V3} SELECT {_KEY}, coalesce(CAST(qty_raw AS DOUBLE), 0) AS qty_raw, "
        "coalesce(CAST(price_raw AS DOUBLE), 0) AS price_raw, flag_raw, note_raw FROM v3",
        "fill_mode": f"WITH {V3} SELECT CAST(place AS VARCHAR) AS row_place, "
        f"coalesce(qty_raw, {_mode('qty_raw')}) AS qty_raw, "
        f"coalesce(price_raw, {_mode('price_raw')}) AS price_raw, "
        f"coalesce(flag_raw, {_mode('flag_raw')}) AS flag_raw, note_raw FROM v3",
        "fill_constant": f"WITH {V3} SELECT {_KEY}, coalesce(qty_raw, 'X') AS qty_raw, "
        "coalesce(price_raw, 'X') AS price_raw, coalesce(flag_raw, 'X') AS flag_raw, "
        "'X' AS note_raw FROM v3",
        "fill_per_file": f"WITH {V7}, m AS (SELECT file_id, avg(CAST(price AS DOUBLE)) AS mean "
        "FROM v7 GROUP BY file_id) SELECT file_id, o_orderkey, "
        f"{_norm('priority')} AS priority, round(coalesce(CAST(price AS DOUBLE), mean), 4) AS price FROM v7 JOIN m USING (file_id)",
        "fill_median_per_file": f"WITH {V3}, y AS (SELECT *, CAST(year(l_shipdate) AS INT) AS "
        "ship_year, CAST(qty_raw AS DOUBLE) AS q, CAST(price_raw AS DOUBLE) AS p FROM v3), "
        "m AS (SELECT ship_year, median(q) AS mq, median(p) AS mp FROM y GROUP BY ship_year) "
        "SELECT ship_year, CAST(place AS VARCHAR) AS row_place, round(coalesce(q, mq), 4) AS qty_raw, "
        "round(coalesce(p, mp), 4) AS price_raw FROM y JOIN m USING (ship_year)",
        "key_candidates": _candidates(
            "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
        )
        + " UNION ALL "
        + _candidates(
            "orders",
            ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
             "o_orderpriority"],
        ),
        "drop_empty_rows": f"WITH {V3} SELECT {_KEY}, qty_raw, price_raw, flag_raw, note_raw "
        f"FROM v3 WHERE {_NOT_EMPTY}",
        "remove_empty_columns": f"WITH {V3} SELECT {_KEY}, "
        "round(CAST(qty_raw AS DOUBLE), 4) AS qty_raw, "
        f"round(CAST(price_raw AS DOUBLE), 4) AS price_raw, flag_raw FROM v3 WHERE {_NOT_EMPTY}",
        "sanitize_names": f"WITH {V5}, b AS (SELECT *, trim(regexp_replace(lower(name_raw), "
        "'[^a-z0-9]+', '_', 'g'), '_') AS base FROM v5), n AS (SELECT *, row_number() OVER "
        "(PARTITION BY file_id, base ORDER BY position) AS k FROM b) SELECT file_id, position, "
        "name_raw, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS name FROM n",
        "merge_name_parts": "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN p_brand "
        "ELSE p_brand || ' ' || p_type END AS full_name FROM part",
        "spelling_fix_join": "SELECT p_partkey, lower(p_type) AS kind FROM part",
        "dedup_whole_row": f"WITH {V4} SELECT DISTINCT * EXCLUDE (copy_no) "
        f"REPLACE ({_STAMP} AS ts) FROM v4",
        "dedup_by_keys": f"WITH {V4} SELECT * EXCLUDE (k) REPLACE ({_STAMP} AS ts) FROM (SELECT *, "
        "row_number() OVER (PARTITION BY user_id, ts, event_type ORDER BY copy_no, event_id) AS k "
        "FROM v4) WHERE k = 1",
        "inject_defects": _DEFECTS,
        "delimiter_vote": f"WITH {V7}, c AS (SELECT file_id, d, cells, count(*) AS n FROM v7 "
        "GROUP BY ALL) SELECT file_id, d AS delimiter, round(max(n) / sum(n), 6) AS share, "
        "CAST(sum(n) AS BIGINT) AS lines FROM c GROUP BY file_id, d",
        "file_width": f"WITH {V7} SELECT file_id, max(cells) AS width, min(cells) AS min_width "
        "FROM v7 GROUP BY file_id",
        "clean_csv_lines": f"WITH {V7} "
        + fields.format(
            f"id, {_norm('priority')} AS priority, trim(status) AS status, price, extra_1"
        ),
        "ragged_pad": f"WITH {V7} " + fields.format("id, priority, status, price, extra_1"),
        "ragged_truncate": f"WITH {V7} " + fields.format("id, priority, status, price"),
        "ragged_error_report": f"WITH {V7} "
        + fields.format(
            "cells, 4 AS wanted, CASE WHEN cells < 4 THEN 'short' ELSE 'long' END AS problem"
        )
        + " WHERE cells <> 4",
        "cleaning_audit": f"WITH {V3}, {V4} "
        + _audit(
            "v3", "CAST(year(l_shipdate) AS VARCHAR)", "(qty_raw, price_raw, flag_raw)",
            f"NOT ({_NOT_EMPTY})",
        )
        + " UNION ALL "
        + _audit("v4", "event_type", "(user_id, ts)", "false"),
        "html_table_extract": _STATEMENTS,
        "html_untidy_extract": _STATEMENTS,
        "top_economies": "WITH t AS (SELECT n_name, n_regionkey, "
        f"CAST(sum({_BALANCE}) * 100 AS BIGINT) AS total FROM customer JOIN nation "
        "ON c_nationkey = n_nationkey GROUP BY ALL), r AS (SELECT *, row_number() OVER "
        "(PARTITION BY n_regionkey ORDER BY total DESC, n_name) AS row_no FROM t) "
        "SELECT n_name AS country, round_even(total / 1000 * 100, 0) / 100 AS gdp_billion FROM r "
        "WHERE row_no BETWEEN 1 AND 10 ORDER BY total DESC, country LIMIT 10",
        "html_link_extract": "WITH l AS (SELECT page_id, "
        f"regexp_extract_all(html, '{_LINK}', 1) AS h, regexp_extract_all(html, '{_LINK_TEXT}', 1) "
        "AS b FROM pages), x AS (SELECT page_id, unnest(range(len(h))) AS i, unnest(h) AS href, "
        f"unnest(b) AS body FROM l) SELECT page_id, CAST(i AS INT) AS link_no, href, "
        f"{_plain('body')} AS link_text FROM x",
        "basic_stats": "SELECT sum(l_quantity) AS sum_value, avg(l_quantity) AS avg_value, "
        "min(l_quantity) AS min_value, max(l_quantity) AS max_value, "
        "count(l_quantity) AS count_value FROM lineitem",
        "count_by_group": "SELECT l_returnflag, sum(l_quantity) AS total FROM lineitem "
        "GROUP BY 1 ORDER BY total DESC, 1",
        "pivot_two_way": "SELECT l_returnflag, "
        "sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS \"F\", "
        "sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS \"O\", "
        "sum(CASE WHEN l_linestatus IN ('F', 'O') THEN 0 ELSE l_quantity END) AS other "
        "FROM lineitem GROUP BY 1",
        "heatmap_matrix": "SELECT strftime(ts, '%Y-%m-%d') AS day, "
        + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in _EVENT_TYPES)
        + f", count(*) FILTER (event_type IS NULL OR event_type NOT IN {tuple(_EVENT_TYPES)}) AS other"
        + " FROM events GROUP BY 1",
        "quantity_by_dealer": "SELECT l_suppkey AS dealer_id, sum(l_quantity) AS quantity_sold "
        "FROM lineitem GROUP BY 1",
        "quantity_by_model": "SELECT p_brand AS model, sum(l_quantity) AS quantity_sold "
        "FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
        "profit_by_dealer": f"SELECT l_suppkey AS dealer_id, {_money(f'sum({_PROFIT})')} AS profit "
        "FROM lineitem GROUP BY 1",
        "profit_by_date_model": "SELECT strftime(l_shipdate, '%Y-%m-%d') AS sale_date, "
        f"p_brand AS model, {_money(f'sum({_PROFIT})')} AS profit FROM lineitem JOIN part "
        "ON l_partkey = p_partkey GROUP BY 1, 2",
        "profit_by_year_dealer": "SELECT CAST(year(l_shipdate) AS INT) AS sale_year, "
        f"l_suppkey AS dealer_id, {_money(f'sum({_PROFIT})')} AS profit FROM lineitem GROUP BY 1, 2",
        "profit_one_model_by_dealer": f"SELECT l_suppkey AS dealer_id, "
        f"{_money(f'sum({_PROFIT})')} AS profit FROM lineitem JOIN part ON l_partkey = p_partkey "
        "WHERE p_brand = 'Brand#12' GROUP BY 1",
        "sales_kpis": f"SELECT {_money(f'sum({_PROFIT})')} AS profit, "
        "sum(l_quantity) AS quantity_sold, avg(l_quantity) AS avg_quantity FROM lineitem",
        "monthly_sales_profit": "SELECT strftime(l_shipdate, '%Y-%m') AS sale_month, "
        f"{_money('sum(CAST(l_extendedprice AS DECIMAL(12,2)))')} AS sales, "
        f"{_money(f'sum({_PROFIT})')} AS profit FROM lineitem GROUP BY 1",
        "events_per_type": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
        "count_two_level": "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2",
        "daily_series": "SELECT strftime(ts, '%Y-%m-%d') AS day, "
        "arg_max(value, (ts, event_id)) AS close, "
        f"{_money('sum(CASE WHEN event_type = ' + _lit('purchase') + ' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END)')}"
        " AS revenue FROM events GROUP BY 1",
        "stream_dedup_events": f"WITH {V4} SELECT * EXCLUDE (k) REPLACE ({_STAMP} AS ts) FROM (SELECT *, "
        "row_number() OVER (PARTITION BY user_id, ts, event_type ORDER BY copy_no, event_id) AS k "
        "FROM v4) WHERE k = 1",
        "stream_clean_customers": _CLEAN_TEXT,
        "stream_profile_customers": f"WITH {V1} "
        + _cell_counts("v1", ["name_raw", "segment_raw", "bal_raw", "active_raw", "flag01_raw"]),
    }
