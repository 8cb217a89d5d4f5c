"""Role verdicts: tech, adjacent, non-tech or unknown, scored from title, team, skills and company.

The needles are parameters; precedence, weights and thresholds are the rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .taxonomy import category

TECH_SHARE = 0.15
# Categories that speak for and against tech; the weights and thresholds of `classify`.
TECH_CATEGORIES = ["Software Engineering", "Infrastructure", "Data & AI", "Security", "QA", "Product & Design"]
ADJACENT_CATEGORIES = ["Sales & Marketing", "Operations & Business", "Customer Success"]


@dataclass
class Families:
    """Needles (patterns) of title and team families, and hard skills. The defaults are a short list of our own."""

    strong: tuple[str, ...] = ("software", "developer", "devops", "data (?:scientist|engineer|analyst)", "machine learning", "security engineer", r"\bqa\b", "product manager", "firmware")
    tech: tuple[str, ...] = ("engineer", r"architect\b", "technical", "cloud", "database", "automation", "data")
    adjacent_strong: tuple[str, ...] = ("sales", "marketing", "recruit", "finance", "legal", "customer success", "account executive")
    adjacent: tuple[str, ...] = ("operations", "strategy", "analyst", "manager", "content")
    non_tech: tuple[str, ...] = ("nurse", "driver", "cashier", "teacher", "warehouse", r"cook\b", "mechanic", "construction", "security guard")
    software: tuple[str, ...] = ("software", "developer", "devops", "backend", "frontend", "data engineer")
    tech_team: tuple[str, ...] = ("engineering", r"r&d", "technology", r"\bit\b", "data", "security", "product")
    adjacent_team: tuple[str, ...] = ("sales", "marketing", "people", "finance", "legal", "operations")
    non_tech_team: tuple[str, ...] = ("retail", "clinical", "warehouse", "logistic", "kitchen", "manufacturing")
    hard_skills: tuple[str, ...] = ("python", "java", "sql", "spark", "kubernetes", "docker", "react", "c++", "linux", "terraform")


def _has(text: Column, needles: tuple[str, ...]) -> Column:
    return F.coalesce(text.rlike(r"(?i)(?<![a-z])(?:" + "|".join(needles) + ")"), F.lit(False))


def classify(title: Column, department: Column, skills: Column, share: Column, f: Families | None = None) -> Column:
    """struct(verdict, score, evidence). share: the company's software roles over its decided ones, or null.

    Of the title's families the first that speaks counts: strong tech, non-tech, strong adjacent, tech, adjacent, category.
    """
    f = f or Families()
    title, team = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(department, F.lit("")))
    strong, tech, adj, adj_strong, non = (_has(title, n) for n in (f.strong, f.tech, f.adjacent, f.adjacent_strong, f.non_tech))
    kind = category(F.lit(None).cast("string"), title)
    of_tech, of_adj = (F.coalesce(kind.isin(c), F.lit(False)) for c in (TECH_CATEGORIES, ADJACENT_CATEGORIES))
    by_title = F.when(strong & ~(non & ~tech), 0.7).when(non, -0.8).when(adj_strong, -0.45).when(tech, 0.5).when(adj, -0.45).when(of_tech, 0.45).when(of_adj, -0.3)
    said = F.when(strong & ~(non & ~tech), "title:tech").when(non, "title:non-tech").when(adj_strong, "title:adjacent").when(tech, "title:tech-loose").when(adj, "title:adjacent").when(of_tech | of_adj, F.concat(F.lit("category:"), kind))
    spoke = said.isNotNull()
    t_tech, t_adj, t_non = (_has(team, n) for n in (f.tech_team, f.adjacent_team, f.non_tech_team))
    team_kind = F.coalesce(category(team, F.lit(None).cast("string")).isin(TECH_CATEGORIES), F.lit(False))
    by_team = F.when(t_non & ~t_tech, F.when(strong, -0.05).when(spoke, -0.25).otherwise(-0.3)).when(t_adj & ~t_tech, F.when(spoke, -0.05).otherwise(-0.25)).when(t_tech | team_kind, F.when(spoke, 0.05).otherwise(0.2))
    said_team = F.when(t_non & ~t_tech, "team:non-tech").when(t_adj & ~t_tech, "team:adjacent").when(t_tech | team_kind, "team:tech")
    hard = F.array_sort(F.array_intersect(F.transform(F.coalesce(skills, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), F.array(*map(F.lit, f.hard_skills))))
    bump = F.when(F.size(hard) == 0, 0.0).when(F.size(hard) == 1, 0.05).when(F.size(hard) == 2, 0.12).otherwise(0.3)
    bump = F.when(non & ~strong, F.least(bump, F.lit(0.1))).otherwise(bump)
    said_skills = F.when(F.size(hard) > 0, F.concat(F.lit("skills:"), F.array_join(F.slice(hard, 1, 4), ",")))
    raw = F.coalesce(by_title, F.lit(0.0)) + F.coalesce(by_team, F.lit(0.0)) + bump + F.coalesce((share - 0.15) * 0.3, F.lit(0.0))
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))
    leaning = adj | of_adj | (t_adj & ~t_tech)
    verdict = F.when(non & ~strong & ~(tech & (score >= 0.5)), "non-tech").when(score >= 0.45, "tech").when(leaning, F.when(score <= 0.2, "adjacent").otherwise("unknown")).when(score <= -0.2, "non-tech").otherwise("unknown")
    raised = (verdict == "adjacent") & F.coalesce(share >= TECH_SHARE, F.lit(False))
    evidence = F.array_compact(F.array(said, said_team, said_skills, F.when(_has(title, f.software), "software"), F.concat(F.lit("company2:"), F.coalesce(F.format_number(share, 2), F.lit("na"))), F.when(raised, "company-tech")))
    return F.struct(F.when(raised, "tech").otherwise(verdict).alias("verdict"), F.round(score, 3).alias("score"), evidence.alias("evidence"))


def two_pass(jobs: DataFrame, f: Families | None = None, least: int = 3, least_software: int = 2) -> DataFrame:
    """jobs with role_class, role_score, role_evidence: all rows are judged, then again with their company's share.

    The share comes from the first pass's open rows that are decided; the second pass is a join, not a recursion.
    """
    first = jobs.withColumn("_r", classify(F.col("title"), F.col("department"), F.col("skills"), F.lit(None).cast("double"), f))
    decided = F.col("_r.verdict").isin("tech", "adjacent", "non-tech")
    shares = first.where(F.col("closed_at").isNull()).groupBy("company_domain").agg(F.count_if(decided).alias("d"), F.count_if(decided & F.array_contains("_r.evidence", "software")).alias("s"))
    shares = shares.where((F.col("d") >= least) & (F.col("s") >= least_software)).select("company_domain", (F.col("s") / F.col("d")).alias("_share"))
    both = first.drop("_r").join(shares, "company_domain", "left").withColumn("_r", classify(F.col("title"), F.col("department"), F.col("skills"), F.col("_share"), f))
    return both.withColumns({"role_class": F.col("_r.verdict"), "role_score": F.col("_r.score"), "role_evidence": F.col("_r.evidence")}).drop("_r", "_share")
