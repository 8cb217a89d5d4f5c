"""Text search: a token table, phrases, relevance."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import index_safe, search_terms
from .predicates import SEARCH_FIELDS, any_field, contains

# Weights of the fields, of the phrase and of all terms in the title.
WEIGHTS = {"title": 10, "company_domain": 7, "location": 6, "department": 5, "description": 2}
PHRASE_BONUS, ALL_IN_TITLE_BONUS = 40, 30
_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def folded(c: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(c), *_ACCENTS)


def tokens(c: Column) -> Column:
    """The runs of letters and digits of a text, folded, in order."""
    return F.filter(F.split(folded(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def token_table(jobs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(id, field, pos, token) of the listings' texts; write it clustered by token for point lookups."""
    cols = [f for f in fields or SEARCH_FIELDS if f in jobs.columns]
    texts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in cols])).alias("x")
    return jobs.select("id", texts).select("id", "x.field", F.posexplode(tokens(F.col("x.text"))).alias("pos", "token"))


def write_index(table: DataFrame, path: str) -> DataFrame:
    """The token table as Parquet whose files hold ranges of (token, id), so that a word's question reads a few row groups and a frequent word is many tasks' work.

    For a large corpus take `postings`, whose rows are blocks.
    """
    rows = table.repartitionByRange("token", "id").sortWithinPartitions("token", "id")
    rows.write.mode("errorifexists").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def complete(table: DataFrame, jobs: DataFrame) -> bool:
    """Whether every listing with a text has tokens in the table; a search must not trust an index that lacks some."""
    some = reduce(Column.__or__, [F.size(tokens(F.coalesce(F.col(f), F.lit("")))) > 0 for f in SEARCH_FIELDS if f in jobs.columns])
    return jobs.where(some).select("id").join(table.select("id").distinct(), "id", "left_anti").isEmpty()


def rebuilt(jobs: DataFrame, path: str, version: int) -> DataFrame:
    """A new index of all listings in a folder of its own; readers move on once it is whole."""
    return write_index(token_table(jobs), f"{path}/v={version}")


def changed_tokens(table: DataFrame, jobs: DataFrame, changed: DataFrame) -> DataFrame:
    """The token table after the listings whose ids are in changed got new texts or went."""
    return table.join(changed, "id", "left_anti").unionByName(token_table(jobs.join(changed, "id", "left_semi")))


def matches(table: DataFrame, term: str, field: str | None = None) -> DataFrame:
    """Ids of listings with the term's tokens next to each other in one field."""
    words = [t for t in re.split(r"[^\w]+|_", term.lower()) if t]
    words = [w.translate(str.maketrans(*_ACCENTS)) for w in words]
    rows = table if field is None else table.where(F.col("field") == field)
    found = None
    for k, w in enumerate(words):
        here = rows.where(F.col("token") == w).select("id", "field", (F.col("pos") - k).alias("pos"))
        found = here if found is None else found.join(here, ["id", "field", "pos"], "left_semi")
    return (rows.limit(0) if found is None else found).select("id").distinct()


def search(jobs: DataFrame, table: DataFrame | None, raw: str, mode: str = "all") -> DataFrame:
    """Listings with all or any of the terms; terms that the tokens cannot answer are met as substrings, without a table all are."""
    terms, _ = search_terms(raw)
    if not terms:
        return jobs
    if table is None:
        parts = [any_field(t, [f for f in SEARCH_FIELDS if f in jobs.columns]) for t in terms]
        return jobs.where(reduce(Column.__or__ if mode == "any" else Column.__and__, parts))
    if mode == "any":
        ids = [matches(table, t) if index_safe(t) else jobs.where(any_field(t, [f for f in SEARCH_FIELDS if f in jobs.columns])).select("id") for t in terms]
        return jobs.join(reduce(DataFrame.union, ids).distinct(), "id", "left_semi")
    for t in terms:
        jobs = jobs.join(matches(table, t), "id", "left_semi") if index_safe(t) else jobs.where(any_field(t, [f for f in SEARCH_FIELDS if f in jobs.columns]))
    return jobs


def relevance(raw: str, fields: dict[str, int] | None = None, title: str = "title") -> Column:
    """The score of the terms by field; with several terms also for the phrase and for all of them in the title."""
    terms, _ = search_terms(raw)
    fields = fields or WEIGHTS
    has = lambda f, t: F.coalesce(contains(F.col(f), t), F.lit(False))
    score = reduce(Column.__add__, [F.when(has(f, t), w).otherwise(0) for t in terms for f, w in fields.items()], F.lit(0))
    if len(terms) > 1:
        phrase = reduce(Column.__or__, [has(f, " ".join(terms)) for f in fields])
        score = score + F.when(phrase, PHRASE_BONUS).otherwise(0)
        score = score + F.when(reduce(Column.__and__, [has(title, t) for t in terms]), ALL_IN_TITLE_BONUS).otherwise(0)
    return score
