"""Loan applications and audit rows derived from the base tables.

One application per order. Callers name the columns they need and only the tables
behind those columns are joined, so a query on two order columns never reads lineitem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskloom.functions.scorecard import default_risk_proxy

LINE_COLUMNS = {"debt_to_income", "credit_utilization", "delinquencies_2yrs", "line_count"}
HISTORY_COLUMNS = {"inquiries_6mths", "open_accounts", "total_accounts", "credit_history_months"}
PROXY_INPUTS = ["credit_score", "debt_to_income", "credit_utilization",
                "delinquencies_2yrs", "inquiries_6mths"]
INQUIRY_DAYS = 180

# Fixed values of the derivation: order priority and market segment to categories.
PURPOSE_BY_PRIORITY = {
    "1": "medical", "2": "debt_consolidation", "3": "home_improvement", "4": "other", "5": "car",
}
OWNERSHIP_BY_SEGMENT = {
    "AUTOMOBILE": "RENT", "BUILDING": "MORTGAGE", "FURNITURE": "OWN",
    "HOUSEHOLD": "OTHER", "MACHINERY": "RENT",
}

ALL_COLUMNS = [
    "application_id", "customer_id", "application_ts", "age", "annual_income", "credit_score",
    "loan_amount", "employment_length", "debt_to_income", "credit_utilization",
    "delinquencies_2yrs", "inquiries_6mths", "open_accounts", "total_accounts",
    "loan_purpose", "home_ownership", "employment_status", "default_risk",
    "sex", "age_group", "ethnicity", "marital_status",
]
SCORING_COLUMNS = [
    "application_id", "credit_score", "annual_income", "debt_to_income",
    "employment_length", "loan_amount", "credit_utilization",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lookup(key: Column, values: dict[str, str]) -> Column:
    chain = F
    for k, v in values.items():
        chain = chain.when(key == k, F.lit(v))
    return chain


def line_sums() -> dict[str, Column]:
    """Exact integer sums of the lines of an order."""
    return {
        "line_count": F.count("l_orderkey"),
        "discount_points": F.sum(F.round(F.col("l_discount") * 100).cast("bigint")),
        "quantity": F.sum(F.col("l_quantity").cast("bigint")),
        "returned": F.count_if(F.col("l_returnflag") == "R"),
    }


def ratios_of_sums() -> dict[str, Column]:
    """Ratios from the sums of an order; null without lines."""
    lines = F.nullif(F.col("line_count"), F.lit(0))
    return {
        "debt_to_income": F.col("discount_points") / (F.lit(10.0) * lines),
        "credit_utilization": F.col("quantity") / (F.lit(50.0) * lines),
    }


def line_ratios(lineitem: DataFrame) -> DataFrame:
    """Per order: line count and ratios from exact integer sums (partial aggregation first)."""
    sums = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*[v.alias(k) for k, v in line_sums().items()])
    return sums.select("o_orderkey", "line_count", "returned", *[v.alias(k) for k, v in ratios_of_sums().items()])


def account_history(orders: DataFrame) -> DataFrame:
    """Per customer and day: trailing inquiries and account totals.

    Orders are counted per (customer, day) before any window runs, so a window
    partition holds at most one row per calendar day however many orders one
    customer has.
    """
    daily = (
        orders.groupBy(F.col("o_custkey"), F.unix_date(F.to_date("o_orderdate")).alias("day_no"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))
    )
    customer = Window.partitionBy("o_custkey")
    trailing = customer.orderBy("day_no").rangeBetween(1 - INQUIRY_DAYS, 0)
    return daily.select(
        "o_custkey", "day_no",
        (F.sum("n").over(trailing) - 1).cast("int").alias("inquiries_6mths"),
        F.sum("n_open").over(customer).cast("int").alias("open_accounts"),
        F.sum("n").over(customer).cast("int").alias("total_accounts"),
        F.min("day_no").over(customer).alias("first_day_no"),
    )


def months_between(later: Column, earlier: Column) -> Column:
    """Whole calendar months from one date to another."""
    return (F.year(later) * 12 + F.month(later)) - (F.year(earlier) * 12 + F.month(earlier))


def derive_applications(orders: DataFrame, customer: DataFrame, nation: DataFrame,
                        region: DataFrame, lineitem: DataFrame | None,
                        history: DataFrame | None, columns: list[str]) -> DataFrame:
    """Join what ``columns`` need onto ``orders`` (a batch or a streaming frame).

    Without ``lineitem`` the orders bring the columns of ``line_ratios`` themselves.
    """
    needed = set(columns)
    if "default_risk" in needed:
        needed |= set(PROXY_INPUTS)

    people = customer.withColumnRenamed("c_custkey", "o_custkey")
    if "ethnicity" in needed:
        # Small tables carry no hint: Spark broadcasts them by their measured size.
        people = people.join(
            nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"),
            "c_nationkey", "left",
        ).join(
            region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"),
            "n_regionkey", "left",
        )

    if needed & HISTORY_COLUMNS:
        # Customer attributes ride along on the per-day history: one join on
        # (customer, day), whose keys are far less skewed than the customer alone.
        people = history.join(people, "o_custkey")
        base = orders.withColumn("day_no", F.unix_date(F.to_date("o_orderdate"))) \
            .join(people, ["o_custkey", "day_no"])
    else:
        base = orders.join(people, "o_custkey")

    if needed & LINE_COLUMNS and lineitem is not None:
        base = base.join(line_ratios(lineitem), "o_orderkey", "left")

    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    age = (18 + cust % 63).cast("int")
    work = cust % 20
    definitions = {
        "application_id": key,
        "customer_id": F.format_string("CUST_%06d", cust),
        "application_ts": F.col("o_orderdate").cast("timestamp"),
        "age": age,
        "annual_income": 25000 + F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 12,
        "credit_score": (300 + (key * 7919 + cust * 104729) % 551).cast("int"),
        "loan_amount": F.col("o_totalprice") / 4,
        "employment_length": (cust % 41) / F.lit(2.0),
        "debt_to_income": F.col("debt_to_income"),
        "credit_utilization": F.col("credit_utilization"),
        "delinquencies_2yrs": F.coalesce(F.col("returned"), F.lit(0)).cast("int"),
        "line_count": F.coalesce(F.col("line_count"), F.lit(0)).cast("int"),
        "inquiries_6mths": F.col("inquiries_6mths"),
        "open_accounts": F.col("open_accounts"),
        "total_accounts": F.col("total_accounts"),
        "credit_history_months": months_between(
            F.to_date("o_orderdate"), F.date_from_unix_date(F.col("first_day_no"))),
        "loan_purpose": _lookup(F.substring("o_orderpriority", 1, 1), PURPOSE_BY_PRIORITY),
        "home_ownership": _lookup(F.col("c_mktsegment"), OWNERSHIP_BY_SEGMENT),
        "employment_status": F.when(work < 14, "EMPLOYED").when(work < 17, "SELF_EMPLOYED")
        .when(work < 19, "UNEMPLOYED").otherwise("RETIRED"),
        "sex": (cust % 2).cast("string"),
        "age_group": F.concat((F.floor(age / 10) * 10).cast("string"), F.lit("s")),
        "ethnicity": F.col("r_name"),
        "marital_status": (F.col("c_nationkey") % 3).cast("string"),
    }
    inputs = [c for c in needed if c != "default_risk"]
    derived = base.select(*[definitions[c].alias(c) for c in inputs])
    if "default_risk" in needed:
        derived = derived.withColumn("default_risk", default_risk_proxy())
    return derived.select(*columns)


def applications(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The application view with the given columns (all of them by default)."""
    orders = read_table(spark, sf_dir, "orders")
    return derive_applications(
        orders,
        read_table(spark, sf_dir, "customer"),
        read_table(spark, sf_dir, "nation"),
        read_table(spark, sf_dir, "region"),
        read_table(spark, sf_dir, "lineitem"),
        account_history(orders),
        columns or ALL_COLUMNS,
    )


def audit_rows(events: DataFrame) -> DataFrame:
    """Audit rows from event records (batch or streaming)."""
    return events.select(
        F.col("event_id").alias("audit_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("user_id"),
        F.col("event_type").alias("activity"),
        F.when(F.col("event_type") == "error", "Failed").otherwise("Success").alias("status"),
        F.when(F.col("value") < 60, "Low").when(F.col("value") < 115, "Medium")
        .otherwise("High").alias("risk_level"),
        "value",
    )


def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_rows(read_table(spark, sf_dir, "events"))
