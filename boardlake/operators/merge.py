"""Current state from change fragments: latest wins, upsert by field rules, close, reopen, adopt, demote."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_shaped
from .ordered import ranked

# Boards whose dates are approximations, so that the first one seen stays.
FROZEN_DATES = ["workday", "comeet", "checkpoint"]
CREEPING_DATES = "comeet"
TAKE_NEW = ["title", "location", "department", "url", "seniority", "workplace_type", "country", "city"]
KEEP_OLD_WHEN_EMPTY = ["description", "description_sha", "skills"]
SALARY = ["salary_text", "salary_is_estimate", "salary_source"]
RESET_ON_RETITLE = ["role_class", "category"]


def latest(rows: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """One row for each key: that with the greatest order. One aggregate, no sort of a key's rows."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def empty(c: Column, kind: str) -> Column:
    if kind.startswith("array"):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull() | ((c.cast("string") == "") if kind == "string" else F.lit(False))


def salary_branch(t, n) -> Column:
    """Which rule decides a listing's pay, once for all its columns: new, none (withdrawn) or old.

    A disclosed figure counts always; an estimate with the listing's text at hand, one by the learned cells over any stored
    estimate, or the first figure at all. A stored estimate that a read with text no longer yields is withdrawn.
    """
    has = lambda c: c.isNotNull() & (c != "")
    guessed = lambda side: F.coalesce(side("salary_is_estimate").cast("boolean"), side("salary_source") != "disclosed", F.lit(False))
    stated, described = has(n("salary_text")), has(n("description"))
    takes = (stated & (~guessed(n) | described)) | (F.coalesce(n("salary_source") == "estimated", F.lit(False)) & guessed(t)) | (t("salary_text").isNull() & stated)
    return F.when(takes, "new").when(~stated & described & guessed(t), "none").otherwise("old")


def tracked_domains(companies: DataFrame, ats: str = CREEPING_DATES) -> DataFrame:
    """(company_domain) of companies that were on that kind of board before a run."""
    return companies.where(F.col("ats") == ats).select(F.col("domain").alias("company_domain")).distinct()


def upsert(stored: DataFrame, incoming: DataFrame, run: datetime, key: str = "id", tracked: DataFrame | None = None) -> DataFrame:
    """The stored table with incoming rows merged in by the rules of each field.

    Both have one row for a key. Rows that are only stored stay as they are; merged rows are open and seen now. tracked: the
    companies (company_domain) that were on a comeet board before this run. That board's dates move with every touch, so of these a
    listing that is new takes the run's time; all others keep the date that is told, the whole backlog of a new company too.
    """
    t, n = (lambda c: F.col(f"t.{c}")), (lambda c: F.col(f"n.{c}"))
    if tracked is not None:
        known = tracked.select(F.col("company_domain").alias("_known")).distinct()
        incoming = incoming.join(known, F.col("company_domain") == F.col("_known"), "left").withColumn("_tracked", F.col("_known").isNotNull()).drop("_known")
    both = stored.alias("t").join(incoming.alias("n"), F.col(f"t.{key}") == F.col(f"n.{key}"), "full_outer")
    old, new = t(key).isNotNull(), n(key).isNotNull()
    kind = dict(stored.dtypes)
    retitled = ~(t("title").eqNullSafe(n("title"))) | (~t("department").eqNullSafe(n("department")) if "department" in kind else F.lit(False))
    branch = salary_branch(t, n) if all(c in kind and c in incoming.columns for c in [*SALARY, "description"]) else None
    out = []
    for c in stored.columns:
        mine = n(c) if c in incoming.columns else F.lit(None).cast(kind[c])
        if c == key:
            value = F.coalesce(t(c), n(c))
        elif c == "first_seen":
            value = F.when(old, t(c)).otherwise(F.lit(run))
        elif c == "last_seen":
            value = F.when(new, F.lit(run)).otherwise(t(c))
        elif c == "closed_at":
            value = F.when(new, F.lit(None)).otherwise(t(c))
        elif c == "posted_at":
            keep = old & n("ats").isin(FROZEN_DATES) & t(c).isNotNull() if "ats" in kind else F.lit(False)
            if "ats" in kind and tracked is not None:
                mine = F.when(~old & (n("ats") == CREEPING_DATES) & n("_tracked"), F.lit(run)).otherwise(mine)
            value = F.when(new & ~keep, mine).otherwise(t(c))
        elif c == "description_chars":
            value = F.when(new & ~(old & ~F.coalesce(mine > 0, F.lit(False))), mine).otherwise(t(c))
        elif c in KEEP_OLD_WHEN_EMPTY:
            whole = "description" if c.startswith("description") else c
            value = F.when(new & ~(old & empty(n(whole) if whole in incoming.columns else F.lit(None), kind.get(whole, "string"))), mine).otherwise(t(c))
        elif c in SALARY and branch is not None:
            gone = F.lit(False) if c == "salary_is_estimate" else F.lit(None)
            value = F.when(~new, t(c)).when(~old, mine).when(branch == "new", mine).when(branch == "none", gone).otherwise(t(c))
        elif c in RESET_ON_RETITLE:
            value = F.when(old & new & retitled, F.lit(None)).when(old, t(c)).otherwise(mine)
        else:
            value = F.when(new, mine).otherwise(t(c))
        out.append(value.cast(kind[c]).alias(c))
    return both.select(*out)


def close_missing(stored: DataFrame, seen: DataFrame, complete: DataFrame, run: datetime, key: str = "id", board: str = "company_domain") -> DataFrame:
    """Open listings of boards that were read whole and that the read does not name are closed now.

    seen: keys; complete: boards read whole. A miss or a partial read closes nothing.
    """
    gone = stored.where("closed_at is null").join(complete.select(board).distinct(), board, "left_semi").join(seen.select(key).distinct(), key, "left_anti").select(F.col(key).alias("_gone"))
    return stored.join(gone, F.col(key) == F.col("_gone"), "left").withColumn("closed_at", F.when(F.col("_gone").isNotNull(), F.lit(run)).otherwise(F.col("closed_at"))).drop("_gone")


def company_states(stored: DataFrame, incoming: DataFrame, run: datetime) -> DataFrame:
    """Companies after a run: unchanged ones are only touched, inconclusive ones keep their board, hits and misses replace it."""
    n = incoming.select(*[F.col(c).alias(f"n_{c}") for c in incoming.columns])
    both = stored.join(n, F.col("domain") == F.col("n_domain"), "full_outer")
    unchanged = F.coalesce("n_unchanged", F.lit(False))
    open_question = F.col("n_ats").isNull() & F.coalesce("n_retryable", F.lit(False))
    keep = F.col("n_domain").isNull() | unchanged | open_question
    out = []
    for c in stored.columns:
        mine = F.col(f"n_{c}") if c in incoming.columns else F.col(c)
        if c == "domain":
            value = F.coalesce("domain", "n_domain")
        elif c == "last_checked":
            value = F.when(F.col("n_domain").isNotNull() & ~open_question, F.lit(run)).otherwise(F.col(c))
        elif c == "first_seen":
            value = F.coalesce(F.col(c), F.lit(run))
        elif c == "error":
            value = F.when(F.col("n_domain").isNotNull() & ~unchanged, mine).otherwise(F.col(c))
        else:
            value = F.when(keep, F.col(c)).otherwise(mine)
        out.append(value.alias(c))
    return both.select(*out)


def alias_owner(companies: DataFrame, board: list[str] | None = None) -> DataFrame:
    """Per board that several domains share: its owner. A domain shaped like the board's token loses; then the shortest, then the first wins."""
    board = board or ["ats", "token"]
    guess = token_shaped(F.col("domain"), F.col("token")) if "token" in companies.columns else F.lit(False)
    best = companies.groupBy(*board).agg(F.count_distinct("domain").alias("n"), F.min(F.struct(guess.alias("g"), F.length("domain").alias("l"), F.col("domain").alias("d"))).alias("b"))
    return best.where("n > 1").select(*board, F.col("b.d").alias("owner"), "n")


def adopt_ages(new: DataFrame, old: DataFrame, keys: list[str], first: str = "first_seen") -> DataFrame:
    """New rows with the earliest first sight of the old rows of the same posting, if that is earlier."""
    earliest = old.groupBy(*keys).agg(F.min(first).alias("_old"))
    return new.join(earliest, keys, "left").withColumn(first, F.least(first, F.coalesce("_old", first))).drop("_old")


def stale_companies(stored: DataFrame, tracked: DataFrame) -> DataFrame:
    return stored.join(tracked.select("domain").distinct(), "domain", "left_anti")


def empty_boards(companies: DataFrame, jobs: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Resolved companies without an open listing whose last one closed, or that were first seen, long ago."""
    per = jobs.groupBy(F.col("company_domain").alias("domain")).agg(F.count_if(F.col("closed_at").isNull()).alias("open"), F.max("closed_at").alias("last"))
    limit = F.lit(as_of - timedelta(days=days))
    return companies.where("ats is not null").join(per, "domain", "left").where((F.coalesce("open", F.lit(0)) == 0) & (F.coalesce("last", "first_seen") < limit)).select(*companies.columns)


def merge_partitions(parts: list[DataFrame], key: str = "domain", order: str = "last_checked") -> DataFrame:
    """The union of shards with whatever columns each has; the freshest copy of a key stays."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    return latest(both, key, [order])


def kept_meanwhile(live: DataFrame, baseline: DataFrame, resolved: DataFrame, excluded: DataFrame) -> DataFrame:
    """Live companies that were neither in the baseline, nor resolved in this run, nor excluded."""
    return live.join(baseline, "domain", "left_anti").join(resolved, "domain", "left_anti").join(excluded, "domain", "left_anti")


def orphans(index: DataFrame, jobs: DataFrame, key: str = "id") -> DataFrame:
    return index.join(jobs.select(key), key, "left_anti")


def due(state: DataFrame, as_of: datetime, cap: int = 900) -> DataFrame:
    """Boards to poll: those never seen first, then the most overdue."""
    return state.where(F.col("next_at").isNull() | (F.col("next_at") <= F.lit(as_of))).orderBy(F.col("next_at").asc_nulls_first(), "domain").limit(cap)


def prune(state: DataFrame, entries: DataFrame, most: float = 0.1) -> DataFrame:
    """The state without boards that are no longer listed; refused (ValueError) if more than a tenth would go."""
    left = state.join(entries.select("domain").distinct(), "domain", "left_semi")
    n, m = state.count(), left.count()
    if n and (n - m) / n > most:
        raise ValueError(f"pruning would drop {n - m} of {n} boards")
    return left


def hash_shard(c: Column, n: int) -> Column:
    return F.pmod(F.crc32(c.cast("binary")), F.lit(n))


def range_shard(rows: DataFrame, order: str, size: int = 50) -> DataFrame:
    """Shards of `size` rows in the order of a column, nulls first; ranges of it are ranked apart, and rows of equal values are told apart by the rest."""
    at = ranked(rows, [F.col(order).asc_nulls_first(), F.xxhash64(*rows.columns)], "_rank")
    return at.select(*rows.columns, F.floor(F.col("_rank") / size).alias("shard"))


def best_board(candidates: DataFrame, as_of: datetime, stale_days: int = 180) -> DataFrame:
    """Per domain the best candidate: fresh before stale before empty, then more jobs."""
    tier = F.when(F.col("job_count") == 0, 0).when(F.col("newest").isNull() | (F.col("newest") >= F.lit(as_of - timedelta(days=stale_days))), 2).otherwise(1)
    return latest(candidates.withColumn("tier", tier), "domain", ["tier", "job_count", "token"])
