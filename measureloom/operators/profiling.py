"""Profile columns, draft their roles and measure semantics, and suggest analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measureloom.functions import cleaning
from measureloom.functions.labels import slug
from measureloom.operators.onerow import attach

NUMERIC_SHARE = 0.8     # fixed value: share of readable cells that makes a text column numeric

# Name patterns of the roles and of measure semantics.
TIME = r"(?i)日期|时间|date|time|年月|ym|month|年份|year"
AMOUNT = r"(?i)金额|销售额|营收|收入|amount|revenue|sales|gmv|cost|成本|费用"
QUANTITY = (r"(?i)数量|台数|件数|销量|人数|人次|工单数|缺陷数|qty|quantity|units|count|headcount"
            r"|tickets?")
PRICE = r"(?i)单价|均价|价格|price"
RATE = r"(?i)率|占比|比例|百分比|rate|ratio|percent|pct|%|满意度"
DURATION = r"(?i)时长|耗时|处理时间|响应时间|分钟|小时|duration|latency|minutes?|hours?"
SCORE = r"(?i)得分|评分|分数|score|rating|nps|csat"
INVENTORY = r"(?i)库存|存量|余额|结存|inventory|stock|balance"
DEFECT = r"(?i)缺陷率|不良率|故障率|返修率|defect|failure|rework"
TARGET = r"(?i)目标|预算|计划|指标|target|budget|plan|quota"
IDENTIFIER = r"(?i)单号|订单号|发票号|流水号|编码|编号|id$|_id|no$|number"
NOISE = r"(?i)名称|地址|街道|省份|城市|项目名|业务员|仓库名|发票|订单号"
CUSTOMER = r"(?i)客户|经销商|门店|store|customer|dealer|account"
PRODUCT = r"(?i)型号|产品|sku|商品|product|model|item"
DIMENSION = (r"(?i)战区|大区|区域|渠道|品类|类别|分类|地区|省|市|region|channel|category|zone|area"
             r"|类")
HOURS, PEOPLE = r"(?i)小时|hours?", r"(?i)人数|人次|headcount"
CHANNEL, REGION = r"(?i)渠道|channel", r"(?i)战区|大区|区域|region|zone"
STRUCTURE = r"(?i)结构|高端|变频|渗透"


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, rows, null_pct, distinct_count, numeric.

    All columns are profiled in one scan. A text column is numeric when more than 80 % of its
    filled cells read as numbers. ``approximate`` replaces the exact distinct counts by sketches,
    which is the choice for wide tables at scale.
    """
    fields = [f for f in df.schema.fields
              if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    one = _sketched(df, fields) if approximate else _counted(df, fields)
    entries = []
    for i, f in enumerate(fields):
        filled, rows = F.col(f"_n{i}"), F.col("_rows")
        if isinstance(f.dataType, T.NumericType):
            numeric = F.lit(True)
        elif isinstance(f.dataType, T.StringType):
            numeric = F.coalesce(F.col(f"_p{i}") / F.when(filled > 0, filled) > NUMERIC_SHARE,
                                 F.lit(False))
        else:
            numeric = F.lit(False)
        entries.append(F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"), rows.alias("rows"),
            F.coalesce((rows - filled) / F.when(rows > 0, rows) * 100, F.lit(0.0)).alias("null_pct"),
            F.col(f"_d{i}").alias("distinct_count"), numeric.alias("numeric")))
    return one.select(F.explode(F.array(*entries)).alias("c")).select("c.*")


def _cell(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    return cleaning.finite(c) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else c


def _sketched(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Counts of rows, filled cells, cells that read as numbers and, roughly, distinct cells, as one row."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        aggs += [F.count(_cell(f)).alias(f"_n{i}"), F.approx_count_distinct(_cell(f)).alias(f"_d{i}")]
        if isinstance(f.dataType, T.StringType):
            aggs.append(F.count(cleaning.number(df, f.name)).alias(f"_p{i}"))
    return df.agg(*aggs)


def _is_wide(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.IntegralType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampType,
                                 T.TimestampNTZType)) or isinstance(kind, T.DecimalType) and kind.precision > 18


def _counted(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """The same counts, all exact, from one scan.

    Cells are reduced, where they are read, to (column, digest) with a count, so a column of any
    cardinality and any hot value is spread over all tasks and no text is shuffled. The 64-bit digest
    of a value of up to eight bytes is one to one; longer values take two digests.
    """
    cells = []
    for i, f in enumerate(fields):
        c = _cell(f)
        second = F.xxhash64(F.lit(1), c) if _is_wide(f.dataType) else F.lit(0).cast("long")
        reads = cleaning.number(df, f.name).isNotNull() if isinstance(f.dataType, T.StringType) else F.lit(False)
        cells.append(F.struct(F.lit(i).alias("i"), F.when(c.isNotNull(), F.xxhash64(c)).alias("h"),
                              F.when(c.isNotNull(), second).alias("g"), reads.alias("reads")))
    # A projection of its own, so that every cell is looked at once.
    apart = df.select(*[c.alias(f"_c{i}") for i, c in enumerate(cells)])
    every = F.array(*[F.col(f"_c{i}") for i in range(len(fields))])
    values = apart.select(F.explode(every).alias("c")).groupBy("c.i", "c.h", "c.g").agg(
        F.count(F.lit(1)).alias("n"), F.max("c.reads").alias("reads"))
    there = F.col("h").isNotNull()
    columns = values.groupBy("i").agg(
        F.sum("n").alias("rows"), F.sum(F.when(there, F.col("n"))).alias("n"), F.count_if(there).alias("d"),
        F.sum(F.when(F.col("reads"), F.col("n"))).alias("p"))
    # One row per column of the table, as a map.
    one = columns.agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("rows", "n", "d", "p")))).alias("m"))
    return one.select(F.coalesce(F.col("m")[0]["rows"], F.lit(0)).alias("_rows"), *[
        F.coalesce(F.col("m")[i][k], F.lit(0)).alias(f"_{k}{i}") for i in range(len(fields)) for k in "ndp"])


def infer_roles(profile: DataFrame) -> DataFrame:
    """Add ``role`` to a column profile by name pattern, then by cardinality."""
    name, n, distinct = F.col("column"), F.col("rows"), F.col("distinct_count")
    measure_name = name.rlike(AMOUNT) | name.rlike(QUANTITY) | name.rlike(PRICE)
    role = (
        F.when(name.rlike(TARGET), "target").when(name.rlike(TIME), "time")
        .when(F.col("numeric") & measure_name, "measure")
        .when(name.rlike(IDENTIFIER), "id").when(name.rlike(CUSTOMER), "customer")
        .when(name.rlike(PRODUCT), "product").when(name.rlike(DIMENSION), "dimension")
        .when(F.col("numeric") & (distinct > n * 0.3), "measure")
        .when(distinct <= F.greatest(F.lit(50.0), n * 0.1), "dimension").otherwise("other"))
    return profile.withColumn("role", role)


def _semantics(name: Column) -> Column:
    def kind(type_: str, how: str, unit: Column | str, direction: str, additivity: str) -> Column:
        return F.struct(
            F.lit(type_).alias("semantic_type"), F.lit(how).alias("aggregation"),
            (F.lit(unit) if isinstance(unit, str) else unit).alias("unit"),
            F.lit(direction).alias("direction"), F.lit(additivity).alias("additivity"))

    time_unit = F.when(name.rlike(HOURS), "hour").otherwise("minute")
    return (
        F.when(name.rlike(DEFECT),
               kind("defect_rate", "mean", "percent", "lower_is_better", "non_additive"))
        .when(name.rlike(DURATION),
              kind("duration", "mean", time_unit, "lower_is_better", "non_additive"))
        .when(name.rlike(RATE), kind("rate", "mean", "percent", "neutral", "non_additive"))
        .when(name.rlike(SCORE), kind("score", "mean", "point", "higher_is_better", "non_additive"))
        .when(name.rlike(INVENTORY), kind("inventory", "sum", "unit", "neutral", "semi_additive"))
        .when(name.rlike(PRICE), kind("price", "mean", "currency_per_unit", "neutral",
                                      "non_additive"))
        .when(name.rlike(AMOUNT) & ~name.rlike(QUANTITY),
              kind("amount", "sum", "currency", "neutral", "additive"))
        .when(name.rlike(QUANTITY) & name.rlike(PEOPLE),
              kind("people", "sum", "person", "neutral", "additive"))
        .when(name.rlike(QUANTITY), kind("quantity", "sum", "count", "neutral", "additive"))
        .otherwise(kind("other", "sum", "unit", "neutral", "additive")))


def infer_measures(roles: DataFrame) -> DataFrame:
    """Measure contract drafts of all measure columns, in column order.

    The primary draft is the first amount, or the first measure when there is none. Repeated ids
    get their position appended. (Rows here are columns of a table, so windows stay tiny.)
    """
    drafts = (roles.where(F.col("role") == "measure")
              .withColumn("s", _semantics(F.col("column")))
              .select("position", F.col("column").alias("field"), "s.*")
              .withColumn("slug", slug(F.col("field"))))
    by_position = W.orderBy("position")
    drafts = drafts.withColumn("nth", F.row_number().over(by_position)).withColumn(
        "copy", F.row_number().over(W.partitionBy("slug").orderBy("position")))
    lead = W.orderBy(F.when(F.col("semantic_type") == "amount", 0).otherwise(1), "position")
    scale = F.when(F.col("semantic_type").isin("rate", "percentage", "defect_rate")
                   & (F.col("unit") == "percent"), "confirm_fraction_or_percent")
    return drafts.select(
        F.when(F.col("copy") == 1, F.col("slug")).otherwise(
            F.concat("slug", F.lit("_"), F.col("nth").cast("string"))).alias("id"),
        "field", "semantic_type", "aggregation", "unit", "direction", "additivity",
        scale.alias("storage_scale"), (F.row_number().over(lead) == 1).alias("primary"))


def candidate_dimensions(roles: DataFrame) -> DataFrame:
    """Dimensions worth a breakdown: 2 to 40 members and not a name or address."""
    return roles.where((F.col("role") == "dimension") & F.col("distinct_count").between(2, 40)
                       & ~F.col("column").rlike(NOISE))


def time_coverage(df: DataFrame, time: str, timezone: str | None = None) -> DataFrame:
    """One row: first and last day, distinct years, distinct months, unreadable rows."""
    day = F.to_date(cleaning.timestamp(df, time, timezone))
    months = (df.select(day.alias("d")).groupBy(F.trunc("d", "month").alias("m"))
              .agg(F.min("d").alias("low"), F.max("d").alias("high"),
                   F.count(F.lit(1)).alias("n")))
    return months.agg(
        F.min("low").alias("first_day"), F.max("high").alias("last_day"),
        F.count_distinct(F.year("m")).alias("years"), F.count("m").alias("months"),
        F.coalesce(F.sum(F.when(F.col("m").isNull(), F.col("n"))), F.lit(0)).alias("unreadable"))


# Which role (and name) suggests which analysis, and why.
_RULES = (
    ("dimension", CHANNEL, "channel_mix", "100% stack"),
    ("dimension", REGION, "region_ranking", "ranking and member × month heat"),
    ("dimension", STRUCTURE, "penetration_trend", "penetration over time"),
    ("product", ".", "product_boards", "ranking, growth and decline"),
    ("customer", ".", "customer_pareto", "top shares and Pareto"),
    ("target", ".", "attainment", "target against actual"),
)


def suggested_analyses(roles: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """(analysis, column, reason) rows from the drafted roles."""
    spark = roles.sparkSession
    rules = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(_RULES)],
        "priority int, role string, pattern string, analysis string, reason string")
    usable = candidate_dimensions(roles).unionByName(
        roles.where(F.col("role").isin("product", "customer", "target")))
    matched = usable.join(rules, "role").where(F.expr("column rlike pattern"))
    first = matched.groupBy("column").agg(F.min("priority").alias("priority"))
    picked = matched.join(first, ["column", "priority"]).select("analysis", "column", "reason")
    flags = roles.agg(
        F.coalesce(F.max(F.col("role") == "measure"), F.lit(False)).alias("has_measure"),
        F.max(F.when(F.col("role") == "time", F.col("column"))).alias("time"))
    if coverage is not None:
        flags = attach(flags, coverage.select("years"))
    else:
        flags = flags.withColumn("years", F.lit(0))
    lead = flags.select(
        F.when(~F.col("has_measure"), "blocked").when(F.col("time").isNull(), "snapshot")
        .when(F.col("years") >= 2, "time_comparison").otherwise("single_year").alias("analysis"),
        F.col("time").alias("column"),
        F.when(~F.col("has_measure"), "no numeric measure found")
        .when(F.col("time").isNull(), "structure and ranking only")
        .when(F.col("years") >= 2, "choose a comparison")
        .otherwise("previous period or custom baseline only").alias("reason"))
    return lead.unionByName(picked)


def sample_values(df: DataFrame, n: int = 2) -> DataFrame:
    """One or two filled values of every column, the smallest and the largest as text.

    All columns are sampled in one aggregate, and the choice does not depend on the order of rows.
    Only for callers that asked to see data.
    """
    if n not in (1, 2):
        raise ValueError("one or two samples a column")
    fields = [f.name for f in df.schema.fields]
    text = [F.col(f"`{name}`").cast("string") for name in fields]
    ends = df.agg(*[F.min(t).alias(f"lo{k}") for k, t in enumerate(text)],
                  *[F.max(t).alias(f"hi{k}") for k, t in enumerate(text)])
    cells = [F.struct(F.lit(name).alias("column"), F.array_distinct(
        F.array(*[f"{end}{k}" for end in ("lo", "hi")[:n]])).alias("samples")) for k, name in enumerate(fields)]
    return ends.select(F.explode(F.array(*cells)).alias("c")).select(
        "c.column", F.explode("c.samples").alias("sample")).where(F.col("sample").isNotNull())
