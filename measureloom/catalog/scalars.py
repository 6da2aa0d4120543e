"""C: cleaning, calendar, direction and display expressions over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from measureloom.catalog.registry import (
    CONTRACT, DISCOUNT, H1, RETURNS, SALES, TIME, facts_sql, favorable_sql, lock_of,
    query, r4, rows_sql, sales, table,
)
from measureloom.functions import calendar as cal
from measureloom.functions import cleaning, display, labels, timeforms
from measureloom.functions.sums import steady_sum
from measureloom.operators.aggregate import member_facts
from measureloom.operators.compare import member_comparison
from measureloom.operators.onerow import attach
from measureloom.operators.scope import lock_frame, within


@query("c01_number_coercion", f"""SELECT o_orderpriority, count(*) AS rows,
  count(*) FILTER (WHERE o_orderpriority <> '4-NOT SPECIFIED') AS parsed,
  {r4('''sum(CASE o_orderpriority WHEN '1-URGENT' THEN -o_totalprice
    WHEN '4-NOT SPECIFIED' THEN NULL ELSE o_totalprice END)''')} AS total
FROM orders GROUP BY o_orderpriority""")
def number_coercion(spark, d):
    grouped = F.format_number("o_totalprice", 2)
    text = (F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("("), grouped, F.lit(")")))
            .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("¥"), grouped))
            .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("  "), grouped, F.lit(" ")))
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit("n/a "), grouped))
            .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    typed = table(spark, d, "orders").select("o_orderpriority", text.alias("amount"))
    value = cleaning.number(typed, "amount")
    return typed.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("rows"), F.count(value).alias("parsed"),
        F.sum(value).alias("total"))


@query("c02_timestamp_coercion", """SELECT o_orderpriority, count(*) AS rows,
  count(*) FILTER (WHERE o_orderpriority <> '4-NOT SPECIFIED') AS parsed,
  count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS aware,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(min(o_orderdate) AS DATE)
    + CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END END AS first_day,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(max(o_orderdate) AS DATE)
    + CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END END AS last_day
FROM orders GROUP BY o_orderpriority""")
def timestamp_coercion(spark, d):
    def fmt(pattern):
        return F.date_format("o_orderdate", pattern)

    # 20:00 UTC is the next day in Shanghai.
    text = (F.when(F.col("o_orderpriority") == "1-URGENT", fmt("yyyy/M/d"))
            .when(F.col("o_orderpriority") == "2-HIGH", fmt("yyyyMMdd"))
            .when(F.col("o_orderpriority") == "3-MEDIUM", fmt("yyyy年M月d日"))
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit("day "), fmt("d")))
            .otherwise(F.concat(fmt("yyyy-MM-dd"), F.lit("T20:00:00Z"))))
    typed = table(spark, d, "orders").select("o_orderpriority", text.alias("at"))
    day = F.to_date(cleaning.timestamp(typed, "at", "Asia/Shanghai"))
    return typed.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("rows"), F.count(day).alias("parsed"),
        F.count_if(cleaning.has_offset(typed, "at")).alias("aware"),
        F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query("c01_awkward_numbers", f"""SELECT o_orderpriority, count(*) AS rows,
  count(*) FILTER (WHERE o_orderpriority <> '5-LOW') AS parsed,
  {r4("sum(CASE o_orderpriority WHEN '3-MEDIUM' THEN -o_totalprice WHEN '5-LOW' THEN NULL ELSE o_totalprice END)")} AS total
FROM orders GROUP BY o_orderpriority""")
def awkward_numbers(spark, d):
    shown = F.format_number("o_totalprice", 2)
    wrap = lambda before, after: F.concat(F.lit(before), shown, F.lit(after))
    text = (F.when(F.col("o_orderpriority") == "1-URGENT", wrap("¥ ", "\t"))
            .when(F.col("o_orderpriority") == "2-HIGH", wrap("\u3000￥\u00a0", "\u2003"))
            .when(F.col("o_orderpriority") == "3-MEDIUM", wrap(" (¥", ") "))
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", wrap("\n+", "\r"))
            .otherwise(wrap("1 ", "")))  # a blank inside is no number
    typed = table(spark, d, "orders").select("o_orderpriority", text.alias("amount"))
    value = cleaning.number(typed, "amount")
    return typed.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("rows"), F.count(value).alias("parsed"), F.sum(value).alias("total"))


@query("c02_mixed_forms", """SELECT o_orderpriority, o_orderstatus, count(*) AS rows, count(*) AS parsed,
  CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day
FROM orders GROUP BY ALL""")
def mixed_forms(spark, d):
    def fmt(pattern):
        return F.date_format("o_orderdate", pattern)

    low = F.when(F.col("o_orderstatus") == "F", fmt("d-MMM-yyyy")).when(
        F.col("o_orderstatus") == "O", fmt("MM-dd-yyyy")).otherwise(fmt("d MMMM yyyy"))
    text = (F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(fmt("yyyy/M/d"), F.lit(" 10:05 PM")))
            .when(F.col("o_orderpriority") == "2-HIGH", fmt("M/d/yyyy"))
            .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(fmt("MMMM d, yyyy"), F.lit("\u00a0")))
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(fmt("yyyy-MM-dd"), F.lit(" 9:30 AM")))
            .otherwise(low))
    typed = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", text.alias("at"))
    day = F.to_date(cleaning.timestamp(typed, "at", "Asia/Shanghai"))
    return typed.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"), F.count(day).alias("parsed"),
        F.min(day).alias("first_day"), F.max(day).alias("last_day"))


# Forms of no fixed list: weekdays and ordinals, packed times, years of two digits, quarters.
@query("c02_free_forms", """SELECT o_orderpriority, count(*) AS rows, count(*) FILTER (WHERE o_orderpriority <> '5-LOW') AS parsed,
  CAST(min(CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '4-NOT SPECIFIED' THEN date_trunc('quarter', o_orderdate)
    ELSE o_orderdate END) AS DATE) AS first_day, CAST(max(CASE o_orderpriority WHEN '5-LOW' THEN NULL
    WHEN '4-NOT SPECIFIED' THEN date_trunc('quarter', o_orderdate) ELSE o_orderdate END) AS DATE) AS last_day,
  max(CASE o_orderpriority WHEN '2-HIGH' THEN 15 WHEN '1-URGENT' THEN 22 WHEN '5-LOW' THEN NULL ELSE 0 END) AS hour
FROM orders GROUP BY o_orderpriority""")
def free_forms(spark, d):
    fmt = lambda pattern: F.date_format("o_orderdate", pattern)
    priority = F.col("o_orderpriority")
    text = (F.when(priority == "1-URGENT", F.concat(fmt("EEEE, d"), F.lit("th of "), fmt("MMMM yyyy"), F.lit(" at 10 p.m.")))
            .when(priority == "2-HIGH", F.concat(fmt("yyyyMMdd"), F.lit("1530")))
            .when(priority == "3-MEDIUM", fmt("d-MMM-yy"))
            .when(priority == "4-NOT SPECIFIED", F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string")))
            .otherwise(F.concat(fmt("d"), F.lit(" days"))))
    typed = table(spark, d, "orders").select("o_orderpriority", text.alias("at"))
    moment = cleaning.timestamp(typed, "at")
    return typed.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("rows"), F.count(moment).alias("parsed"), F.min(F.to_date(moment)).alias("first_day"),
        F.max(F.to_date(moment)).alias("last_day"), F.max(F.hour(moment)).alias("hour"))


@query("c02_unread_forms", """SELECT CASE WHEN o_orderpriority = '5-LOW' THEN repeat('9', length(CAST(day(o_orderdate) AS VARCHAR))) || ' aaaa'
    ELSE '9999-99-99' END AS form, count(*) AS rows, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS unread
FROM orders GROUP BY 1""")
def unread_forms(spark, d):
    text = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.date_format("o_orderdate", "d"), F.lit(" days"))).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    return timeforms.forms(table(spark, d, "orders").select(text.alias("at")), "at")


@query("c02_instants", """WITH e AS (SELECT event_type, CAST(ts AS TIMESTAMP) + INTERVAL 8 HOUR AS moment FROM events)
SELECT event_type, CAST(min(moment) AS DATE) AS first_day, CAST(max(moment) AS DATE) AS last_day, count(*) FILTER (
  WHERE moment >= TIMESTAMP '2024-01-15' AND moment < TIMESTAMP '2024-01-22') AS in_week FROM e GROUP BY event_type""")
def instants(spark, d):
    # The stored times, taken as instants of UTC, in the days and weeks of Shanghai.
    events = table(spark, d, "events").select("event_type", F.convert_timezone(
        F.lit("UTC"), F.current_timezone(), F.col("ts").cast("timestamp_ntz")).cast("timestamp").alias("ts"))
    day = F.to_date(cleaning.timestamp(events, "ts", "Asia/Shanghai"))
    week = within(events, "ts", dt.date(2024, 1, 15), dt.date(2024, 1, 21), "Asia/Shanghai")
    return events.groupBy("event_type").agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count_if(week).alias("in_week"))


@query("c03_storage_scale", f"""SELECT l_returnflag, {r4('sum(l_discount * 100)')} AS points,
  {r4('max(l_discount * 100)')} AS highest FROM lineitem GROUP BY l_returnflag""")
def storage_scale(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_discount", "discount")
    value = cleaning.row_value(lines, DISCOUNT)
    return lines.groupBy("l_returnflag").agg(F.sum(value).alias("points"),
                                             F.max(value).alias("highest"))


@query("c04_row_ratio", f"""SELECT l_returnflag,
  count(CASE WHEN l_discount > 0 THEN l_tax / l_discount END) AS defined,
  {r4('sum(CASE WHEN l_discount > 0 THEN l_tax / l_discount * 100 END)')} AS total
FROM lineitem GROUP BY l_returnflag""")
def row_ratio(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_returnflag", F.col("l_tax").alias("returned"), F.col("l_discount").alias("quantity"))
    value = cleaning.row_value(lines, RETURNS)
    return lines.groupBy("l_returnflag").agg(F.count(value).alias("defined"),
                                             F.sum(value).alias("total"))


_KEYS = {
    "xun": ("strftime(o_orderdate, '%Y-%m') || '-X' || CASE WHEN day(o_orderdate) <= 10 THEN '1' "
            "WHEN day(o_orderdate) <= 20 THEN '2' ELSE '3' END"),
    "week": "strftime(o_orderdate, '%G-W%V')",
    "month": "strftime(o_orderdate, '%Y-%m')",
    "quarter": "year(o_orderdate) || 'Q' || quarter(o_orderdate)",
    "half": "year(o_orderdate) || '-H' || CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END",
    "year": "year(o_orderdate)::VARCHAR",
    "period": "'locked-period'",
}


@query("c05_period_keys", " UNION ALL ".join(
    f"SELECT '{f}' AS frequency, {k} AS key, count(*) AS orders FROM orders GROUP BY ALL"
    for f, k in _KEYS.items()))
def period_keys(spark, d):
    days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n"))
    keys = F.array(*[F.struct(F.lit(f).alias("frequency"),
                              cal.period_key(F.col("day"), f).alias("key")) for f in _KEYS])
    return days.select(F.explode(keys).alias("k"), "n").groupBy("k.frequency", "k.key").agg(
        F.sum("n").alias("orders"))


# How each spelling of a period is written for a day, and the SQL of what it must resolve to.
_SPELLED = {
    "month": ("concat(year(d), '年', month(d), '月')", "strftime(d, '%Y-%m')",
              "date_trunc('month', d)::DATE", "last_day(d)"),
    "quarter": ("concat(year(d), '年第', element_at(array('一','二','三','四'), quarter(d)), '季度')",
                "year(d) || 'Q' || quarter(d)", "date_trunc('quarter', d)::DATE",
                "(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE"),
    "half": ("concat(year(d), if(month(d) <= 6, '上半年', '下半年'))",
             "year(d) || 'H' || CASE WHEN month(d) <= 6 THEN 1 ELSE 2 END",
             "make_date(year(d), CASE WHEN month(d) <= 6 THEN 1 ELSE 7 END, 1)",
             "make_date(year(d), CASE WHEN month(d) <= 6 THEN 6 ELSE 12 END, "
             "CASE WHEN month(d) <= 6 THEN 30 ELSE 31 END)"),
    "week": ("concat(extract(YEAROFWEEK from d), '-w', weekofyear(d))", "strftime(d, '%G-W%V')",
             "date_trunc('week', d)::DATE", "(date_trunc('week', d) + INTERVAL 6 DAY)::DATE"),
    "xun": ("concat(date_format(d, 'yyyy-MM'), if(day(d) <= 10, '上旬', "
            "if(day(d) <= 20, '中旬', '下旬')))",
            "strftime(d, '%Y-%m') || '-X' || CASE WHEN day(d) <= 10 THEN 1 "
            "WHEN day(d) <= 20 THEN 2 ELSE 3 END",
            "date_trunc('month', d)::DATE + CASE WHEN day(d) <= 10 THEN 0 "
            "WHEN day(d) <= 20 THEN 10 ELSE 20 END",
            "CASE WHEN day(d) <= 10 THEN date_trunc('month', d)::DATE + 9 "
            "WHEN day(d) <= 20 THEN date_trunc('month', d)::DATE + 19 ELSE last_day(d) END"),
    "year": ("concat(year(d), '全年')", "year(d)::VARCHAR", "make_date(year(d), 1, 1)",
             "make_date(year(d), 12, 31)"),
}


@query("c06_period_labels", "WITH days AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) "
       + " UNION ".join(
           f"SELECT '{g}' AS granularity, {label} AS label, ({a})::DATE AS \"start\", "
           f"({b})::DATE AS \"end\" FROM days" for g, (_, label, a, b) in _SPELLED.items()))
def period_labels(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    spelled = F.array(*[F.expr(spec[0]) for spec in _SPELLED.values()])
    texts = days.select(F.explode(spelled).alias("text")).distinct()
    return texts.select(cal.period_bounds(F.col("text")).alias("p")).select(
        "p.granularity", "p.label", "p.start", "p.end")


@query("c07_null_members", """SELECT coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END,
  '(空值)') AS name, count(*) AS orders FROM orders GROUP BY ALL""")
def null_members(spark, d):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return table(spark, d, "orders").groupBy(cleaning.member(status).alias("name")).agg(
        F.count(F.lit(1)).alias("orders"))


_IDS = [m.id for m in CONTRACT]
_ROWS = f"WITH {SALES}, {facts_sql(_IDS, ('brand', 'segment'))}, {rows_sql()}"


def _rows(spark, d):
    df = sales(spark, d)
    facts = member_facts(df, CONTRACT, ("brand", "segment"), lock_of(df), TIME)
    return member_comparison(facts, CONTRACT)


@query("c08_favorable", f"""{_ROWS} SELECT measure_id, dimension, name,
  {r4('delta')} AS delta, {favorable_sql('delta')} AS favorable FROM rows_""")
def favorable(spark, d):
    return _rows(spark, d).select("measure_id", "dimension", "name", "delta", "favorable")


@query("c09_delta_state", f"""{_ROWS} SELECT measure_id, name, direction, CASE
  WHEN current IS NULL OR baseline IS NULL THEN 'unknown' WHEN current = baseline THEN 'unchanged'
  WHEN direction = 'neutral' THEN 'neutral'
  WHEN (direction = 'higher_is_better') = (current > baseline) THEN 'favorable'
  ELSE 'unfavorable' END AS state
FROM rows_, (VALUES ('higher_is_better'), ('lower_is_better'), ('neutral')) v(direction)
WHERE dimension = 'brand'""")
def delta_state(spark, d):
    each = F.explode(F.array(*[F.lit(x) for x in (
        "higher_is_better", "lower_is_better", "neutral")])).alias("direction")
    return _rows(spark, d).where("dimension = 'brand'").select(
        "measure_id", "name", "baseline", "current", each).select(
        "measure_id", "name", "direction",
        labels.delta_state(F.col("baseline"), F.col("current"), F.col("direction")).alias("state"))


@query("c10_slug", """SELECT p_type || ' / ' || p_brand || ' 单品' AS label,
  lower(trim(regexp_replace(p_type || ' / ' || p_brand || ' 单品', '[^0-9A-Za-z_\\-]+', '_', 'g'),
    '_')) AS id, count(*) AS parts FROM part GROUP BY ALL""")
def slug(spark, d):
    label = F.concat("p_type", F.lit(" / "), "p_brand", F.lit(" 单品"))
    return table(spark, d, "part").select(label.alias("label")).groupBy("label").agg(
        F.count(F.lit(1)).alias("parts")).withColumn("id", labels.slug(F.col("label")))


def _shown_sql(v: str, digits: int) -> str:
    return f"CASE WHEN {v} < 0 THEN '-' ELSE '' END || format('{{:,.{digits}f}}', abs({v}))"


@query("c11_format_metric", f"""WITH b AS (SELECT c_nationkey::BIGINT AS nation,
  round(avg(c_acctbal), 3) AS v FROM customer GROUP BY 1)
SELECT nation, CASE WHEN v = floor(v) THEN {_shown_sql('v', 0)} ELSE {_shown_sql('v', 1)} END
    AS plain,
  CASE WHEN v > 0 THEN '+' ELSE '' END || {_shown_sql('v', 1)} || '%' AS signed_percent,
  {_shown_sql('v', 1)} || 'pp' AS points, {_shown_sql('v', 2)} AS two_digits FROM b""")
def format_metric(spark, d):
    b = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("nation")).agg(
        F.round(F.avg("c_acctbal"), 3).alias("v"))
    v = F.col("v")
    return b.select(
        "nation", display.format_metric(v, F.lit("decimal")).alias("plain"),
        display.format_metric(v, F.lit("signed_percent")).alias("signed_percent"),
        display.format_metric(v, F.lit("percentage_point")).alias("points"),
        display.format_metric(v, F.lit("decimal"), F.lit(2)).alias("two_digits"))


@query("c12_format_magnitude", """WITH b AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders
  GROUP BY 1 UNION ALL SELECT -1, sum(o_totalprice) FROM orders
  UNION ALL SELECT -2, -sum(o_totalprice) / 1000 FROM orders)
SELECT o_custkey, CASE WHEN v < 0 THEN '-' ELSE '' END || CASE
  WHEN abs(v) >= 1e8 THEN format('{:.1f}', abs(v) / 1e8) || '亿'
  WHEN abs(v) >= 1e7 THEN format('{:,.0f}', floor(abs(v) / 1e4 + 0.5)) || '万'
  WHEN abs(v) >= 1e4 THEN format('{:.1f}', round(abs(v) / 1e4, 1)) || '万'
  ELSE format('{:,.0f}', floor(abs(v) + 0.5)) END AS shown FROM b""")
def format_magnitude(spark, d):
    orders = table(spark, d, "orders")
    per = orders.groupBy("o_custkey").agg(steady_sum(F.col("o_totalprice")).alias("v"))
    whole = orders.agg(steady_sum(F.col("o_totalprice")).alias("t")).select(F.explode(F.array(
        F.struct(F.lit(-1).cast("bigint").alias("o_custkey"), F.col("t").alias("v")),
        F.struct(F.lit(-2).cast("bigint").alias("o_custkey"), (-F.col("t") / 1000).alias("v")))
    ).alias("s")).select("s.*")
    return per.unionByName(whole).select(
        "o_custkey", display.format_magnitude(F.col("v")).alias("shown"))


@query("c13_parse_shown", f"""SELECT o_orderstatus, count(*) AS shown,
  {r4('''sum(CASE o_orderstatus WHEN 'F' THEN -round(o_totalprice / 1e4, 2)
    WHEN 'O' THEN round(o_totalprice, 2) ELSE round(o_totalprice / 1e4, 2) END)''')} AS total,
  CASE o_orderstatus WHEN 'F' THEN '万' WHEN 'O' THEN '%' ELSE 'pp' END AS unit,
  2::BIGINT AS decimals, 1::BIGINT AS numbers FROM orders GROUP BY o_orderstatus""")
def parse_shown(spark, d):
    wan = F.format_number(F.round(F.col("o_totalprice") / 1e4, 2), 2)
    text = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("▼ "), wan, F.lit(" 万")))
            .when(F.col("o_orderstatus") == "O",
                  F.concat(F.lit("▲"), F.format_number("o_totalprice", 2), F.lit("%")))
            .otherwise(F.concat(F.lit("合计 "), wan, F.lit("PP"))))
    parsed = table(spark, d, "orders").select(
        "o_orderstatus", display.parse_shown(text).alias("p"))
    return parsed.groupBy("o_orderstatus", F.col("p.unit").alias("unit")).agg(
        F.count("p").alias("shown"), F.sum("p.value").alias("total"),
        F.max("p.decimals").cast("bigint").alias("decimals"),
        F.max("p.count").cast("bigint").alias("numbers"))


@query("c14_truncated_labels", """SELECT label, CASE WHEN length(label) > 12
  THEN left(label, 11) || '…' ELSE label END AS shown, count(*) AS parts
FROM (SELECT p_name || ' 商品 ' || p_brand AS label FROM part) GROUP BY ALL""")
def truncated_labels(spark, d):
    label = F.concat("p_name", F.lit(" 商品 "), "p_brand").alias("label")
    return table(spark, d, "part").select(label).groupBy("label").agg(
        F.count(F.lit(1)).alias("parts")).withColumn("shown", labels.truncated(F.col("label"), 12))


@query("c15_comparison_labels", """WITH months AS (SELECT DISTINCT date_trunc('month', o_orderdate)
  ::DATE AS m FROM orders)
SELECT m AS "start", strftime(m, '%Y-%m') AS month_label,
  year(m) || 'Q' || quarter(m) AS quarter_label,
  year(m) || 'H' || CASE WHEN month(m) <= 6 THEN 1 ELSE 2 END AS half_label,
  year(m)::VARCHAR AS year_label, strftime(m, '%Y-%m-%d') AS other_label FROM months""")
def comparison_labels(spark, d):
    months = table(spark, d, "orders").select(
        F.to_date(F.trunc("o_orderdate", "month")).alias("start")).distinct()
    return months.select("start", *[
        cal.period_display(F.col("start"), F.lit(g)).alias(f"{n}_label")
        for g, n in (("month", "month"), ("quarter", "quarter"), ("half", "half"),
                     ("year", "year"), ("custom", "other"))])


