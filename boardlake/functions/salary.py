"""Pay estimates: disclosed, then a table by role and seniority band, then learned cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .money import disclosed
from .taxonomy import first_match

# The seniority bands of a pay table in order, that of each level, and that of an unstated one.
BANDS = ["0-2", "3-5", "6-10", "mgmt"]
LEVELS = {"intern": "0-2", "junior": "0-2", "mid": "3-5", "senior": "6-10", "staff": "6-10", "principal": "6-10", "lead": "mgmt", "manager": "mgmt"}
UNSTATED, NO_ESTIMATE = "3-5", ["director", "exec"]
# The greatest width of a range, in parts of its low end.
WIDEST = 1.0
# Roles that a text may make more exact, and those that it may make of them.
GENERIC_ROLES = ["backend", "fullstack", "frontend", "mobile_generic"]
TECHNOLOGIES = ["python", "go", "java", "cpp", "c_lang", "dotnet", "nodejs", "react", "angular", "kotlin", "scala", "php", "ios", "android", "embedded"]


def band_of(seniority: Column) -> Column:
    """The band of a level; UNSTATED where none is known, null for directors and executives."""
    known = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[seniority]
    return F.when(seniority.isin(NO_ESTIMATE), None).otherwise(F.coalesce(known, F.lit(UNSTATED)))


def role_of(title: Column, text: Column, roles: list[tuple[str, list[str]]]) -> Column:
    """The first role whose needles the title holds; a generic one gives way to the first technology of the text."""
    role = first_match(title, roles)
    told = first_match(text, [r for r in roles if r[0] in TECHNOLOGIES])
    return F.when(role.isin(GENERIC_ROLES), F.coalesce(told, role)).otherwise(role)


def table_estimate(jobs: DataFrame, pay: DataFrame, roles: list[tuple[str, list[str]]]) -> DataFrame:
    """jobs with est_low and est_high from pay(role, band, low, high): the own band, or else the nearest that the role has, the lower of two.

    Without a description column the title alone decides. A range above WIDEST or without a positive low end is not shown. Of a
    band's repeated rows the highest counts; rows of other bands or without both ends are not read. A job without title, role
    or band has no estimate.
    """
    cell = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), F.struct("low", "high"))
    cells = pay.groupBy(F.col("role").alias("_role")).agg(*[F.max(F.when(F.col("band") == b, cell)).alias(f"_of_{k}") for k, b in enumerate(BANDS)])
    text = F.col("description") if "description" in jobs.columns else F.lit(None).cast("string")
    own = jobs.withColumns({"_role_of": role_of(F.col("title"), text, roles), "_band": band_of(F.col("seniority"))})
    found = F.lit(None)
    for k, b in enumerate(BANDS):
        near = sorted(range(len(BANDS)), key=lambda i, k=k: abs(i - k))
        found = F.when(F.col("_band") == b, F.coalesce(*[F.col(f"_of_{i}") for i in near])).otherwise(found)
    both = own.join(cells, F.col("_role_of") == F.col("_role"), "left").withColumn("_e", found)
    shown = (F.col("_e.low") > 0) & ((F.col("_e.high") - F.col("_e.low")) / F.col("_e.low") <= WIDEST)
    both = both.withColumns({"est_low": F.when(shown, F.col("_e.low")), "est_high": F.when(shown, F.col("_e.high"))})
    return both.drop("_role", "_role_of", "_band", "_e", *[f"_of_{k}" for k in range(len(BANDS))])


def sourced(salary_text: Column, metro: Column, table_low: Column, learned_low: Column) -> Column:
    """Where a listing's pay comes from: disclosed, the table (in its own market), learned cells elsewhere, or nothing."""
    return F.when(disclosed(salary_text).isNotNull(), "disclosed").when((metro == "il") & table_low.isNotNull(), "table").when((metro != "il") & learned_low.isNotNull(), "estimated")


# The currencies of markets with learned cells; those of the United States have names of their own.
CURRENCIES = {"uk": "£", "ca": "CA$"}
DOLLAR_MARKETS, DOLLAR = "us-", "$"


def market_currency(metro: Column) -> Column:
    """The currency in which a market's pay is learned; null for markets without one, the home market (which has a pay table) among them."""
    known = F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv])[metro]
    return F.when(metro.startswith(DOLLAR_MARKETS), DOLLAR).otherwise(known)


def monthly_thousands(low: Column, high: Column, currency: Column) -> Column:
    """Annual ends as monthly thousands, '$8K - $11K', halves to even; one figure where both ends read alike."""
    one = lambda x: F.concat(currency, F.format_number(F.bround(x / 12 / 1000, 0), 0), F.lit("K"))
    return F.when(one(low) == one(high), one(low)).otherwise(F.concat(one(low), F.lit(" - "), one(high)))
