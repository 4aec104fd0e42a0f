"""Scoring, assessments, batch summary, result filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom import policy
from riskloom.functions import scalar, scorecard

ID = "application_id"


def score(df: DataFrame) -> DataFrame:
    """Append risk_score, risk_category and decision."""
    summed = df.withColumn("risk_score", scorecard.uncapped_score())
    return summed.withColumn("risk_score", scorecard.capped(F.col("risk_score"))).withColumns({
        "risk_category": scorecard.risk_category(F.col("risk_score")),
        "decision": scorecard.decision(F.col("risk_score")),
    })


def contributions_wide(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[term.alias(label) for label, term in scorecard.contributions()])


def contributions_long(df: DataFrame, id_column: str = ID) -> DataFrame:
    """One row per application and scorecard term."""
    return contributions_wide(df, [id_column]).unpivot(
        id_column, policy.SCORE_LABELS, "feature", "contribution")


def individual_decisions(df: DataFrame) -> DataFrame:
    """Decision labels of the single-application view plus the model risk level."""
    return df.withColumns({
        "individual_decision": scorecard.decision(
            F.col("risk_score"), policy.INDIVIDUAL_DECISIONS),
        "risk_level": scorecard.risk_level(F.col("risk_score")),
    })


def with_recommendations(df: DataFrame) -> DataFrame:
    return df.withColumn("recommendations", scorecard.recommendations(F.col("risk_score")))


def factor_breakdown(df: DataFrame, id_column: str = ID) -> DataFrame:
    """First three and remaining factors in scorecard order, and the largest one."""
    terms = scorecard.contributions()
    ordered = F.array(*[F.struct(F.lit(label).alias("feature"), term.alias("contribution"))
                        for label, term in terms])
    # The negative position breaks ties in favour of the earlier term.
    largest = F.array_max(F.array(*[
        F.struct(term.alias("contribution"), F.lit(-i).alias("position"),
                 F.lit(label).alias("feature")) for i, (label, term) in enumerate(terms)]))
    return df.select(
        id_column,
        F.slice(ordered, 1, 3).alias("leading"),
        F.slice(ordered, 4, len(terms) - 3).alias("remaining"),
        largest["feature"].alias("top_feature"),
        largest["contribution"].alias("top_contribution"),
    )


def assessment_documents(df: DataFrame, as_of: str, id_column: str = ID) -> DataFrame:
    """One JSON assessment per application; ``df`` must be scored."""
    inputs = [c for c in df.columns if c not in ("risk_score", "risk_category", "decision")]
    document = F.struct(
        F.lit(as_of).alias("timestamp"),
        F.struct(*inputs).alias("customer_data"),
        F.col("risk_score"),
        F.col("risk_category"),
        scorecard.contribution_struct().alias("feature_contributions"),
        scorecard.recommendations(F.col("risk_score")).alias("recommendations"),
        F.lit(policy.ANALYSIS_VERSION).alias("analysis_version"),
    )
    return df.select(
        id_column, F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def batch_summary(df: DataFrame) -> DataFrame:
    """Total, count and share per decision, mean score: one row, one pass."""
    counts = df.agg(
        F.count("*").alias("total_records"),
        *[F.count_if(F.col("decision") == d).alias(d.lower()) for d in policy.DECISIONS],
        F.avg("risk_score").alias("avg_risk_score"),
    )
    total = F.col("total_records")
    return counts.select(
        "total_records",
        *[d.lower() for d in policy.DECISIONS],
        *[scalar.share(F.col(d.lower()), total).alias(f"{d.lower()}_share")
          for d in policy.DECISIONS],
        "avg_risk_score",
    )


def evaluated_once(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` computed before any filter on them.

    A filter on a computed column is pushed below its projection, where the scorecard
    would be repeated for every mention, in code too long to be compiled. Filters are
    not pushed through a generator of these columns, while filters on the others are.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns)))).select(*df.columns)


def filter_results(df: DataFrame, decisions: list[str], low: float, high: float) -> DataFrame:
    """Results with one of the decisions and a score within [low, high]."""
    return evaluated_once(df, ["risk_score", "decision"]).filter(F.col("decision").isin(decisions) & F.col("risk_score").between(low, high))


def preview(df: DataFrame, n: int = 10, id_column: str = ID) -> DataFrame:
    return df.orderBy(id_column).limit(n)


def risk_distribution(df: DataFrame) -> DataFrame:
    """Applications and share per band; the share's window sees one row per band."""
    counts = df.groupBy("risk_category").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def impact_text(phi: Column) -> Column:
    return F.concat(scalar.impact_direction(phi), F.lit(" risk by "),
                    scalar.fixed(F.abs(phi), 3))
