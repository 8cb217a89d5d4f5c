"""Facets: counts by value, each without its own filter."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exact
from .images import first_of_shapes
from .predicates import compile_filters, flag

LIMIT, COUNTRIES, TREE_COUNTRIES, TREE_CITIES, COMPANIES, COMPANY_HITS = 60, 60, 40, 25, 500, 50
#: Logos that are looked at for each that is shown, where near copies are left out.
SPARE = 6
#: facet -> (column, parameter that it leaves out)
SCALAR = {"ats": ("ats", "ats"), "company": ("company_domain", "company"), "category": ("category", "department"), "seniority": ("seniority", "seniority"), "workplace": ("workplace_type", "workplace")}


def counted(rows: DataFrame, value: Column, limit: int = LIMIT) -> DataFrame:
    """(value, n) of values that are not blank, the most frequent first, ties by value."""
    return rows.select(value.alias("value")).where("trim(value) <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def place_tree(rows: DataFrame, countries: int = TREE_COUNTRIES, cities: int = TREE_CITIES, country: Column | None = None, city: Column | None = None) -> DataFrame:
    """(country, country_n, city, n): the leading cities of the leading countries, both exploded from the same row."""
    lands = rows.select(F.explode(country if country is not None else F.col("country")).alias("country"), (city if city is not None else F.col("city")).alias("_cities"))
    lands = lands.where("country <> ''")
    top = lands.groupBy("country").agg(F.count(F.lit(1)).alias("country_n")).orderBy(F.desc("country_n"), "country").limit(countries)
    pairs = lands.select("country", F.explode("_cities").alias("city")).where("city <> ''").groupBy("country", "city").agg(F.count(F.lit(1)).alias("n"))
    at = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("n"), "city"))
    return pairs.join(F.broadcast(top), "country").withColumn("_at", at).where(F.col("_at") <= cities).drop("_at")


def pay_bounds(rows: DataFrame, low: str = "salary_min_ils", high: str = "salary_max_ils") -> DataFrame:
    """Least and greatest pay, how many state one, the exact median of the midpoints."""
    known = F.col(low).isNotNull() & F.col(high).isNotNull()
    median = F.lit(exact.middle(rows, F.when(known, (F.col(low) + F.col(high)) / 2))).cast("double")
    return rows.agg(F.min(low).alias("low"), F.max(high).alias("high"), F.count_if(known).alias("known"), F.first(median).alias("median"))


def compute(jobs: DataFrame, params: dict, as_of: datetime) -> dict[str, DataFrame]:
    """Each facet as a table; every one is its own filter set, so each is one grouped scan of few columns."""
    out = {}
    for name, (column, own) in SCALAR.items():
        rows = jobs.where(compile_filters(params, as_of, drop=[own]))
        out[name] = counted(rows, F.col(column), COMPANIES if name == "company" else LIMIT)
    placed = jobs.where(compile_filters(params, as_of, drop=["country", "city", "location", "israel_only"]))
    out["country"] = counted(placed, F.explode("country"), COUNTRIES)
    out["places"] = place_tree(placed)
    out["pay"] = pay_bounds(jobs.where(compile_filters(params, as_of, drop=["salary_min", "salary_max", "salary_known", "salary_disclosed"])))
    out["disclosed"] = jobs.where(compile_filters(params, as_of, drop=["salary_disclosed"])).agg(F.count_if(F.col("salary_source") == "disclosed").alias("n"))
    return out


#: Facets by the parameters that each leaves out: its own filter must not narrow it.
_PLACES, _PAY = ["country", "city", "location", "israel_only"], ["salary_min", "salary_max", "salary_known", "salary_disclosed"]
OWN = {name: [own] for name, (_, own) in SCALAR.items()} | {"country": _PLACES, "places": _PLACES, "lands": _PLACES, "pay": _PAY, "disclosed": ["salary_disclosed"]}


def counts(jobs: DataFrame, asked: dict[str, dict], as_of: datetime) -> DataFrame:
    """(variant, facet, value, part, n, low, high) of all facets of several questions, from one scan and one aggregate.

    A row carries a mask of the filters that it fails, a bit for each different filter of all questions; it counts for a facet where it
    fails none that the facet heeds. value is the facet's value; part the city of a place, or the midpoint of a pay.
    """
    names = sorted({p for own in OWN.values() for p in own})
    filters: dict[str, Column] = {}  # each different filter once, whatever question it is of

    def bits(params: dict) -> dict[str, int]:
        """The bit of each parameter of a question, and that of all parameters that no facet leaves out."""
        found = {}
        rest = {k: v for k, v in params.items() if k not in names}
        for name, own in [("", rest), *[(p, {p: params[p]}) for p in names if p in params]]:
            # what a question asks without being told (open, verified, fresh) is in the rest; the others ask for it not at all
            alone = own if name == "" else own | {"include_closed": "1", "include_outdated": "1", "confidence": "all"}
            key = repr(sorted(alone.items()))
            filters.setdefault(key, compile_filters(alone, as_of))
            found[name] = list(filters).index(key)
        return found

    masks = {variant: bits(params) for variant, params in asked.items()}
    failed = F.lit(0).cast("long")
    for k, f in enumerate(filters.values()):
        failed = failed.bitwiseOR(F.when(F.coalesce(f, F.lit(False)), F.lit(0)).otherwise(F.lit(1 << k)).cast("long"))
    text = lambda c: F.col(c).cast("string")
    pair = lambda value, part: F.struct(value.alias("value"), part.alias("part"))
    none = F.lit(None).cast("string")
    low, high = (F.col(c).cast("double") for c in ("salary_min_ils", "salary_max_ils"))
    lands = F.filter("country", lambda x: x != "")
    values = {name: F.array(pair(text(column), none)) for name, (column, _) in SCALAR.items()}
    values |= {
        "country": F.transform("country", lambda x: pair(x, none)), "lands": F.transform(lands, lambda x: pair(x, none)),
        "places": F.flatten(F.transform(lands, lambda x: F.transform(F.filter("city", lambda y: y != ""), lambda y: pair(x, y)))),
        "pay": F.array(pair(F.when(low.isNotNull() & high.isNotNull(), "known"), ((low + high) / 2).cast("string"))), "disclosed": F.array(pair(F.when(F.col("salary_source") == "disclosed", "disclosed").otherwise("other"), none)),
    }
    nothing = F.array().cast("array<struct<variant:string,facet:string,value:string,part:string>>")
    told = []
    for variant, mine in masks.items():
        for facet, own in OWN.items():
            heeded = sum({1 << b for p, b in mine.items() if p not in own})
            told.append(F.when(F.col("_failed").bitwiseAND(F.lit(heeded)) == 0, _tagged(variant, facet, F.col(f"_{facet}"))).otherwise(nothing))
    rows = jobs.select(failed.alias("_failed"), low.alias("low"), high.alias("high"), *[F.coalesce(v, F.array().cast("array<struct<value:string,part:string>>")).alias(f"_{n}") for n, v in values.items()])
    each = rows.select("low", "high", F.explode(F.flatten(F.array(*told))).alias("x"))
    return each.groupBy("x.variant", "x.facet", "x.value", "x.part").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _tagged(variant: str, facet: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(variant).alias("variant"), F.lit(facet).alias("facet"), v["value"].alias("value"), v["part"].alias("part")))


def all_facets(jobs: DataFrame, asked: dict[str, dict], as_of: datetime) -> DataFrame:
    """(variant, name, rank, value, part, n, part_n, low, high): every facet of several questions as `compute` gives it, in one scan of the listings.

    Scalar facets and country: value and n. places: value and its n, part (a city) and part_n. pay: low, high, n (how many state both ends) and, as
    part, the median of the midpoints. disclosed: n. The counts are few rows beside the listings, so they are stored once and read for all.
    """
    from .versions import settled

    found = settled(counts(jobs, asked, as_of), "facets")
    plain = Window.partitionBy("variant", "facet").orderBy(F.desc("n"), "value")
    most = F.create_map(*[F.lit(x) for name in SCALAR for x in (name, COMPANIES if name == "company" else LIMIT)], F.lit("country"), F.lit(COUNTRIES), F.lit("lands"), F.lit(TREE_COUNTRIES))
    short = found.where(F.col("facet").isin(*SCALAR, "country", "lands") & (F.trim("value") != "")).withColumn("rank", F.row_number().over(plain)).where(F.col("rank") <= most[F.col("facet")])
    lands = short.where("facet = 'lands'").select(F.col("variant").alias("_v"), F.col("value").alias("_c"), F.col("n").alias("_n"))  # TREE_COUNTRIES rows a question at most
    cities = Window.partitionBy("variant", "value").orderBy(F.desc("n"), "part")
    places = found.where("facet = 'places'").join(F.broadcast(lands), (F.col("variant") == F.col("_v")) & (F.col("value") == F.col("_c"))).withColumn("rank", F.row_number().over(cities)).where(F.col("rank") <= TREE_CITIES)
    shown = lambda df, name, **c: df.select("variant", name.alias("name"), c.get("rank", F.lit(1)).alias("rank"), c.get("value", F.lit(None).cast("string")).alias("value"), c.get("part", F.lit(None).cast("string")).alias("part"), c.get("n", F.lit(None).cast("long")).alias("n"), c.get("part_n", F.lit(None).cast("long")).alias("part_n"), c.get("low", F.lit(None).cast("double")).alias("low"), c.get("high", F.lit(None).cast("double")).alias("high"))
    known = F.col("value") == "known"
    # the two middle places of the midpoints, among counts of different ones
    mids = exact.cumulative(found.where(F.col("facet") == "pay").where(known).select("variant", F.col("part").cast("double").alias("mid"), "n"), ["variant"], "mid", weight="n")
    middle = mids.groupBy("variant").agg(((exact.at(F.floor((F.col("n") - 1) / 2), "mid") + exact.at(F.floor(F.col("n") / 2), "mid")) / 2).alias("_median"))
    every = jobs.sparkSession.createDataFrame([(v,) for v in asked], "variant string")  # also those that no row answers
    pay = found.where("facet = 'pay'").groupBy("variant").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n"))
    pay = every.join(pay, "variant", "left").join(middle, "variant", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    stated = found.where("facet = 'disclosed'").groupBy("variant").agg(F.coalesce(F.sum(F.when(F.col("value") == "disclosed", F.col("n"))), F.lit(0)).alias("n"))
    stated = every.join(stated, "variant", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = lambda c: F.col(c)
    parts = [
        shown(short.where("facet <> 'lands'"), own("facet"), rank=own("rank"), value=own("value"), n=own("n")), shown(places, F.lit("places"), rank=own("rank"), value=own("value"), part=own("part"), n=own("_n"), part_n=own("n")),
        shown(pay, F.lit("pay"), part=own("_median").cast("string"), n=own("n"), low=own("low"), high=own("high")), shown(stated, F.lit("disclosed"), n=own("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def company_search(jobs: DataFrame, companies: DataFrame, needle: str, limit: int = COMPANY_HITS) -> DataFrame:
    """(domain, company_name, n) of open listings of companies whose domain or name holds the needle, of two characters at least."""
    needle = (needle or "").strip().lower()
    counts = jobs.where("closed_at is null").groupBy(F.col("company_domain").alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(companies.select("domain", "company_name"), "domain", "left")
    hit = F.lower("domain").contains(needle) | F.coalesce(F.lower("company_name").contains(needle), F.lit(False))
    return named.where(hit if len(needle) >= 2 else F.lit(False)).orderBy(F.desc("n"), "domain").limit(limit)


def logo_row(jobs: DataFrame, companies: DataFrame, curated: list[str], limit: int = 30) -> DataFrame:
    """Companies with a logo: hand-picked ones first, then the busiest; the first of an image stays.

    Where companies have a logo_shape (see `images.shape`), the first of near copies stays too.
    """
    counts = jobs.where("closed_at is null").groupBy(F.col("company_domain").alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    shaped = [F.col("logo_shape").alias("shape")] if "logo_shape" in companies.columns else []
    rows = counts.join(companies.select("domain", "company_name", "logo_url", *shaped), "domain").where("logo_url <> ''").withColumn("picked", F.col("domain").isin(curated))
    at = F.row_number().over(Window.partitionBy("logo_url").orderBy(F.desc("picked"), F.desc("n"), "domain"))
    order = [F.desc("picked"), F.desc("n"), F.col("domain")]
    kept = rows.withColumn("_at", at).where("_at = 1").drop("_at").orderBy(*order)
    if shaped:  # near copies of what is shown may take its place, so some more are looked at
        kept = first_of_shapes(kept.limit(limit * SPARE), order).drop("shape").orderBy(*order)
    return kept.limit(limit)


def precomputed_key(params: dict) -> str | None:
    """The name of the stored variant that answers the question exactly, or None."""
    from .predicates import narrowing

    israel = flag(params, "israel_only")
    if narrowing({k: v for k, v in params.items() if k != "israel_only"}):
        return None
    return ":".join([params.get("confidence") or "verified", *(["tech"] if params.get("roles") == "tech" else []), *(["IL"] if israel else [])])
