"""First-match taxonomies as ordered CASE chains."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: True: needles that hold a literal backslash stay inert, as in today's answers; False makes them word matches.
KEEP_INERT_NEEDLES = True

# Category needles, in order of precedence; those with \b are inert while KEEP_INERT_NEEDLES.
CATEGORY_RULES = [
    ("Security", ["security", "cyber", "soc analyst", "threat intel", "threat research", "incident response", "penetration test", "pentest", "red team", "blue team", r"\bgrc\b", "appsec", "application security", "infosec", "malware"]),
    ("Data & AI", ["data scientist", "data science", "data engineer", "machine learning", "ml engineer", "ml researcher", "artificial intelligence", "ai researcher", "ai engineer", r"\bai\b", "nlp", "computer vision", "data analyst", "business intelligence", r"\bbi\b analyst"]),
    ("Infrastructure", ["devops", r"\bsre\b", "site reliability", "platform engineer", "infrastructure", "cloud engineer", "network engineer", "systems engineer", "system administrator", "sysadmin", r"\bnoc\b", "help desk", "helpdesk", "it support", "it administrator"]),
    ("QA", ["quality assurance", r"\bqa\b", "test engineer", "test automation", r"\bsdet\b"]),
    ("Software Engineering", ["software engineer", "software development", "developer", "backend", "back-end", "back end", "frontend", "front-end", "front end", "full stack", "fullstack", "full-stack", "mobile engineer", "ios engineer", "android engineer", "embedded", "firmware", "web developer", "engineer", "engineering"]),
    ("Product & Design", ["product manager", "product owner", r"\bux\b", r"\bui\b", "user experience", "user research", "product design", "graphic design"]),
    ("Sales & Marketing", ["sales", "account executive", "business development", "marketing", "growth", "demand generation", r"\bseo\b", "content writer", "partnerships"]),
    ("Customer Success", ["customer success", "customer support", "technical support", "solutions engineer", "solution engineer", "support engineer", "customer experience"]),
    ("Operations & Business", ["operations", "finance", "accounting", "human resources", r"\bhr\b", "people team", "people partner", "legal", "office manager", "administrative", "procurement", "supply chain", "recruiter", "recruiting", "talent acquisition"]),
]

# Seniority needles, highest first.
SENIORITY_RULES = [
    ("exec", ["chief", "cto", "ceo", "cfo", "coo", "vp", "svp", "vice president"]),
    ("director", ["director", "head of"]),
    ("principal", ["principal"]),
    ("staff", ["staff"]),
    ("lead", ["lead", "leader", "tech lead", "team lead", "team leader", "group leader"]),
    ("manager", ["manager"]),
    ("senior", ["senior", "sr"]),
    ("mid", ["mid-level", "mid level", "midlevel"]),
    ("junior", ["junior", "jr", "entry level", "entry-level", "new grad", "graduate"]),
    ("intern", ["intern", "internship", "co-op", "coop"]),
]

# Workplace needles; remote wins over hybrid, hybrid over onsite.
WORKPLACE_RULES = [
    ("remote", ["remote", "work from home", "wfh"]),
    ("hybrid", ["hybrid"]),
    ("onsite", ["on-site", "onsite", "on site"]),
]

# Codes of structured fields by the kind of board.
LEVEL_CODES = {
    "smartrecruiters": {"internship": "intern", "entry_level": "junior", "associate": "junior", "mid_senior_level": "senior", "director": "director", "executive": "exec"},
    "comeet": {"junior": "junior", "intermediate": "mid", "senior": "senior", "management": "manager"},
}
WORKPLACE_CODES = {"remote": "remote", "hybrid": "hybrid", "onsite": "onsite", "on-site": "onsite", "on site": "onsite"}


def whole_words(needles: list[str]) -> str:
    """A pattern for any of the needles as whole words, whatever their case."""
    kept = [re.escape(n) for n in needles if "\\" not in n]
    if not KEEP_INERT_NEEDLES:
        kept += [n for n in needles if "\\" in n]
    return r"(?i)\b(?:" + "|".join(kept) + r")\b"


def first_match(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The label of the first rule with a needle in the text, else null."""
    out = F.lit(None).cast("string")
    for label, needles in reversed(rules):
        out = F.when(text.rlike(whole_words(needles)), label).otherwise(out)
    return out


def category(department: Column, title: Column) -> Column:
    return first_match(F.concat(F.coalesce(department, F.lit("")), F.lit(" "), F.coalesce(title, F.lit(""))), CATEGORY_RULES)


def seniority(title: Column) -> Column:
    return first_match(title, SENIORITY_RULES)


def workplace(location: Column) -> Column:
    return first_match(location, WORKPLACE_RULES)


def coded(value: Column, codes: dict[str, str]) -> Column:
    """The canonical value of a structured code, null for one that is not known."""
    return F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[F.lower(F.trim(value))]
