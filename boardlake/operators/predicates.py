"""Parameters of a listing question, validated and compiled to one Column.

Clauses are ANDed and written as plain comparisons of columns with literals, so they reach the scan.
Unknown or invalid values are dropped; a bad confidence, sort or number raises ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import days_between
from ..functions.places import names_israel
from ..functions.text import search_terms

MAX_IDS, MAX_SKILLS, MAX_COUNTRIES, MAX_CITIES, FRESH_DAYS = 200, 40, 20, 20, 365
#: parameter -> column of a comma list of values
IN_FILTERS = {"ats": "ats", "company": "company_domain", "department": "category", "seniority": "seniority", "location": "location", "workplace": "workplace_type"}
SEARCH_FIELDS = ["title", "company_domain", "location", "department", "description"]
TRUE = {"1", "true", "yes", "on"}


def flag(params: dict, name: str) -> bool:
    return str(params.get(name, "")).strip().lower() in TRUE


def listed(raw: str | None) -> list[str]:
    """The values of a comma list, trimmed, without empty ones."""
    return [v.strip() for v in (raw or "").split(",") if v.strip()]


def integer(params: dict, name: str, default: int | None = None, low: int | None = None, high: int | None = None) -> int | None:
    """An integer parameter within its bounds; ValueError for what is no integer."""
    raw = params.get(name)
    if raw in (None, ""):
        return default
    try:
        n = int(str(raw))
    except ValueError:
        raise ValueError(f"{name} must be an integer") from None
    n = n if low is None else max(low, n)
    return n if high is None else min(high, n)


def ids(params: dict) -> list[str]:
    return [x for x in listed(params.get("ids")) if re.fullmatch(r"[0-9a-f]{8,64}", x)][:MAX_IDS]


def skills(params: dict, vocabulary: Iterable[str] | None = None) -> list[str]:
    known = {v.lower() for v in vocabulary} if vocabulary is not None else None
    wanted = [x.lower() for x in listed(params.get("skills"))]
    return list(dict.fromkeys(x for x in wanted if known is None or x in known))[:MAX_SKILLS]


def countries(params: dict) -> list[str]:
    return list(dict.fromkeys(x.upper() for x in listed(params.get("country")) if re.fullmatch(r"[A-Za-z]{2}", x)))[:MAX_COUNTRIES]


def cities(params: dict) -> list[str]:
    return list(dict.fromkeys(x for x in listed(params.get("city")) if re.fullmatch(r"[\w .'\-]{1,60}", x)))[:MAX_CITIES]


def contains(column: Column, term: str) -> Column:
    """LIKE with the term in the middle, whatever the case; % and _ of the term keep their meaning, as they do today."""
    return F.lower(column).like(f"%{term.lower()}%")


def any_field(term: str, fields: Iterable[str]) -> Column:
    return reduce(or_, [F.coalesce(contains(F.col(f), term), F.lit(False)) for f in fields])


def fresh(as_of: datetime) -> Column:
    """No date, or one at most 365 days old."""
    return F.col("posted_at").isNull() | (F.col("posted_at") >= F.lit(as_of - timedelta(days=FRESH_DAYS)))


def lowered(labels: Column) -> Column:
    """The labels of an array in lower case."""
    return F.transform(labels, lambda x: F.lower(x))


def compile_filters(params: dict, as_of: datetime, vocabulary: Iterable[str] | None = None, drop: Iterable[str] = (), places: bool = True) -> Column:
    """One Column for all parameters but those in drop. places: whether the rows have countries; without, the location's words tell."""
    p = {k: v for k, v in params.items() if k not in set(drop)}
    parts: list[Column] = []
    if not flag(p, "include_closed"):
        parts.append(F.col("closed_at").isNull())
    confidence = p.get("confidence") or "verified"
    if confidence not in ("verified", "best_effort", "all"):
        raise ValueError("confidence must be verified, best_effort or all")
    if confidence != "all":
        parts.append(F.col("confidence") == confidence)
    for name, column in IN_FILTERS.items():
        if values := listed(p.get(name)):
            parts.append(F.col(column).isin(values))
    if p.get("roles") == "tech":
        parts.append(F.col("role_class") == "tech")
    if some := ids(p):
        parts.append(F.col("id").isin(some))
    if not flag(p, "include_outdated"):
        parts.append(fresh(as_of))
    if q := (p.get("q") or "").strip():
        parts.append(any_field(q, ["title", "company_domain", "location", "department"]))
    for some, column in ((skills(p, vocabulary), lowered(F.col("skills"))), (countries(p), F.col("country")), (cities(p), F.col("city"))):
        if some:
            parts.append(F.arrays_overlap(column, F.array(*map(F.lit, some))))
    terms, _ = search_terms(p.get("search"))
    if terms:
        parts.append(reduce(or_ if p.get("search_mode") == "any" else and_, [any_field(t, SEARCH_FIELDS) for t in terms]))
    for term in [t.strip() for t in (p.get("keywords") or "").split(";") if t.strip()]:
        parts.append(any_field(term, ["title", "description"]))
    if flag(p, "israel_only"):
        parts.append(F.array_contains("country", "IL") if places else names_israel(F.col("location")))
    age = days_between(F.lit(as_of), F.col("posted_at"))
    if (n := integer(p, "min_age_days")) is not None:
        parts.append(F.col("posted_at").isNotNull() & (age >= n))
    if (n := integer(p, "max_age_days")) is not None:
        parts.append(F.col("posted_at").isNotNull() & (age <= n))
    parts += pay_filters(p)
    return reduce(and_, parts, F.lit(True))


def pay_filters(p: dict, low: str = "salary_min_ils", high: str = "salary_max_ils") -> list[Column]:
    """Intervals that overlap the wanted one; unknown pay stays unless salary_known; a bound that is no number is dropped."""
    parts = []
    for name, column, cmp in (("salary_min", high, "ge"), ("salary_max", low, "le")):
        raw = str(p.get(name) or "")
        if raw.isdigit() and int(raw) > 0:
            side = F.col(column) >= int(raw) if cmp == "ge" else F.col(column) <= int(raw)
            parts.append(side | F.col(column).isNull())
    if flag(p, "salary_known"):
        parts.append(F.col(low).isNotNull())
    if flag(p, "salary_disclosed"):
        parts.append(F.col("salary_source") == "disclosed")
    return parts


def narrowing(params: dict) -> bool:
    """Whether anything but confidence and roles narrows the question."""
    ignored = {"confidence", "roles", "sort", "limit", "offset", "count", "order", "dir"}
    return any(str(v).strip() and not (k.startswith("include_") and not flag(params, k)) for k, v in params.items() if k not in ignored and v is not None)


def company_filters(params: dict) -> Column:
    """The company list's filters: resolved_only and ats."""
    parts = [F.col("ats").isNotNull()] if flag(params, "resolved_only") else []
    if values := listed(params.get("ats")):
        parts.append(F.col("ats").isin(values))
    return reduce(and_, parts, F.lit(True))


def profile_params(profile: dict) -> dict[str, str]:
    """A profile's wishes as parameters of a listing question."""
    out = {}
    for field, name in (("skills", "skills"), ("seniority", "seniority"), ("workplace", "workplace"), ("countries", "country"), ("cities", "city")):
        if profile.get(field):
            out[name] = ",".join(profile[field])
    if profile.get("israel_only"):
        out["israel_only"] = "1"
    return out


def whole_word(column: Column, term: str) -> Column:
    """A substring that no letter or digit touches."""
    return column.rlike(r"(?i)(?<![\p{L}\p{N}_])" + re.escape(term) + r"(?![\p{L}\p{N}_])")
