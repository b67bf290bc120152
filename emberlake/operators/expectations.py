"""Row expectations: valid rows on one side, violations with a rule name on the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROVENANCE = ["official", "observed", "estimated", "unverified"]
INCIDENT_STATUS = ["reported", "active", "stabilized", "controlled", "extinguished", "archived"]


def unit_interval(col: Column) -> Column:
    return col.isNull() | col.between(0, 1)


def record_rules() -> dict[str, Column]:
    return {
        "confidence_in_unit_interval": unit_interval(F.col("confidence")),
        "provenance_known": F.col("provenance").isin(PROVENANCE),
    }


def forecast_rules() -> dict[str, Column]:
    return {
        "forecast_never_official": F.col("provenance") != "official",
        "forecast_has_model_execution": F.col("model_execution_id").isNotNull(),
        "risk_score_in_unit_interval": unit_interval(F.col("risk_score")),
    }


def broken_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks (an unknown outcome counts as broken)."""
    return F.filter(
        F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]),
        lambda n: n.isNotNull(),
    )


def split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, one dead-letter row per broken rule)."""
    checked = df.withColumn("_broken", broken_rules(rules))
    valid = checked.filter(F.size("_broken") == 0).drop("_broken")
    dead = checked.filter(F.size("_broken") > 0).withColumn("rule", F.explode("_broken")).drop("_broken")
    return valid, dead
