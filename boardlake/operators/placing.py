"""Countries and cities of location texts, by joins with a gazetteer.

A location is cut into places (at semicolons) and these into parts. Each part claims what it might be: a country's name, letters, a city, a
text that begins or ends with a city, a state, a word within it. Claims meet the gazetteer, a table of (kind, text, code, label), in one
equi-join, and of those that are met the first kind counts. Different locations are placed once, however many rows have them.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.places import CITIES, COUNTRIES, FALSE_FRIENDS, MAX_CITIES, MAX_COUNTRIES, STATES, names_israel, world

#: What a part may be, the first that is met counts.
KINDS = ["country", "code3", "code2", "city", "around a city", "letters", "state", "within"]
#: Words of a name within a part, at most.
LONGEST = 4
# Letters and words for two countries, and parts that are no city.
LETTERS = {"UK": "GB", "US": "US"}
WITHIN = {"us": "US", "usa": "US", "u.s": "US", "uk": "GB"}
NO_CITY = [
    "remote", "hybrid", "onsite", "on site", "office", "global", "worldwide", "distributed", "anywhere", "flexible", "various", "multiple locations", "location", "all", "emea", "apac", "amer", "latam", "europe", "asia",
    "north america", "south america", "latin america", "middle east", "africa",
]
_PARTS = r"[|/,\n()\[\]]+|\s+-\s+"


def _plain() -> tuple[str, str]:
    """Letters with marks and the letters that they are without them, by their decomposition."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    kept = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


_MARKED, _BARE = _plain()


def folded(c: Column) -> Column:
    """Without marks and apostrophes, hyphens as blanks, lower case, blanks collapsed."""
    c = F.regexp_replace(F.translate(c, _MARKED, _BARE), r"\p{M}+|['’]", "")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"[-_־‐‑–—]", " ")), r"\s+", " "))


def gazetteer(spark: SparkSession, countries: dict[str, str] | None = None, cities: dict[str, str] | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """(kind, text, code, label): what claims may meet. Without own countries all that the JVM knows count.

    A name that is a country's and a state's of the United States is the state's. aliases give cities one spelling.
    """
    names, three = world(spark) if countries is None else (countries, {})
    rows = [("code3", k, v, None) for k, v in three.items()] + [("code2", v.lower(), v, None) for v in {*names.values()}]
    rows += [("letters", k, v, None) for k, v in LETTERS.items()] + [("postal", k, "US", None) for k in STATES] + [("within", k, v, None) for k, v in WITHIN.items()] + [("no city", x, None, None) for x in NO_CITY]
    frame = spark.createDataFrame(rows, "kind string, text string, code string, label string")
    towns, lands, states = (spark.createDataFrame([(k, v) for k, v in x.items()], "name string, code string").select(folded(F.col("name")).alias("text"), "code", "name") for x in (cities or CITIES, {**COUNTRIES, **names} if countries is None else names, {v: "US" for v in STATES.values()}))
    lands = lands.join(states.select("text"), "text", "left_anti")
    kind = lambda df, *kinds: df.select(F.explode(F.array(*map(F.lit, kinds))).alias("kind"), "text", "code", F.initcap("name").alias("label"))
    frame = frame.unionByName(kind(towns, "city", "around a city")).unionByName(kind(lands, "country", "within")).unionByName(kind(states, "state", "within"))
    if aliases:
        frame = frame.unionByName(spark.createDataFrame(list(aliases.items()), "name string, label string").select(F.lit("alias").alias("kind"), folded(F.col("name")).alias("text"), F.lit(None).cast("string").alias("code"), "label"))
    return frame.dropDuplicates(["kind", "text"])


def _claim(kind: str, text: Column, order: Column | None = None) -> Column:
    rank = KINDS.index(kind) if kind in KINDS else len(KINDS)
    return F.struct(F.lit(rank).alias("rank"), (order if order is not None else F.lit(0)).alias("order"), F.lit(kind).alias("kind"), text.alias("text"))


def _inside(words: Column, kind: str, edges: bool) -> Column:
    """Claims of runs of a part's words: those at its ends, longer ones first; or all of up to LONGEST words, earlier ones first, then longer ones."""
    n = F.size(words)
    run = lambda i, k: F.array_join(F.slice(words, i, k), " ")
    none = F.array().cast("array<struct<rank:int,order:int,kind:string,text:string>>")
    if edges:
        ends = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array(_claim(kind, run(F.lit(1), k), -2 * k), _claim(kind, run(F.greatest(n - k + 1, F.lit(1)), k), 1 - 2 * k)))
        return F.when(n > 1, F.flatten(ends)).otherwise(none)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.lit(LONGEST), n - i + 1), F.lit(1))), lambda k: _claim(kind, run(i, k), i * 2 * LONGEST - k)))
    return F.when(n > 0, F.flatten(every)).otherwise(none)


def _words(low: Column) -> Column:
    return F.filter(F.transform(F.split(low, " "), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")


def _parts(locations: DataFrame, friends: list[str]) -> DataFrame:
    """(location, text, place, part, own, raw, low) of different locations; text is the location without the friends, names that only look like a place."""
    text = F.col("location")
    for name in friends:
        text = F.regexp_replace(text, f"(?i){name}", " ")
    places = locations.withColumn("text", text).select("location", "text", F.posexplode(F.split("text", ";")).alias("place", "_place"))
    parts = places.select("location", "text", "place", F.posexplode(F.split("_place", _PARTS)).alias("part", "_part")).where(F.trim("_part") != "")
    raw = F.trim(F.regexp_replace(F.trim(F.col("_part")), r"^\.+|\.+$", ""))
    return parts.select("location", "text", "place", "part", F.trim("_part").alias("own"), raw.alias("raw"), folded(raw).alias("low"))


def _met(claims: DataFrame, by: list[str], known: DataFrame) -> DataFrame:
    """(by, code, kind) of the first claim that the gazetteer has."""
    each = claims.select(*by, F.explode("claims").alias("c")).select(*by, "c.rank", "c.order", "c.kind", "c.text")
    return each.join(known, ["kind", "text"]).groupBy(*by).agg(F.min_by(F.struct("code", "kind", "label"), F.struct("rank", "order")).alias("m")).select(*by, "m.*")


def _placed(parts: DataFrame, known: DataFrame) -> DataFrame:
    """parts with the code and kind of what they are; postal letters of a state have kind `postal`."""
    raw, low = F.col("raw"), F.col("low")
    claims = F.concat(
        F.array(_claim("country", low), _claim("code3", F.when(raw.rlike("^[A-Z]{3}$"), raw)), _claim("code2", F.when(raw.rlike("^[a-z]{2}$"), raw)), _claim("city", low), _claim("letters", raw), _claim("state", low), _claim("postal", F.when(F.col("own").rlike("^[A-Z]{2}$"), F.col("own")))),
        _inside(F.split(low, " "), "around a city", True), _inside(_words(low), "within", False),
    )
    by = ["location", "place", "part"]
    return parts.join(_met(parts.withColumn("claims", claims), by, known), by, "left")


def countries(rows: DataFrame, known: DataFrame, column: str = "location", name: str = "country") -> DataFrame:
    """rows with the countries that their location names, in order, at most MAX_COUNTRIES; IL first where only its words show. Null and blank: none.

    A place in which no part is anything is in the United States if one is a state's two letters. A location of which no part is anything
    may still hold a name within it as a whole.
    """
    different = rows.select(F.col(column).alias("location")).where(F.trim(column) != "").distinct()
    placed = _placed(_parts(different, FALSE_FRIENDS), known)
    real = F.when(F.col("kind") != "postal", F.struct("part", "code"))
    of_place = placed.groupBy("location", "text", "place").agg(F.transform(F.array_sort(F.collect_list(real)), lambda x: x["code"]).alias("codes"), F.max(F.col("kind") == "postal").alias("postal"))
    codes = F.when((F.size("codes") == 0) & F.col("postal"), F.array(F.lit("US"))).otherwise(F.col("codes"))
    found = of_place.groupBy("location", "text").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", codes.alias("codes")))), lambda x: x["codes"]))).alias("found"))
    home = names_israel(F.col("text")) & ~F.array_contains("found", "IL")
    found = found.withColumn("found", F.when(home, F.concat(F.array(F.lit("IL")), "found")).otherwise(F.col("found")))
    whole = _met(found.where(F.size("found") == 0).withColumn("claims", _inside(_words(folded(F.col("text"))), "within", False)), ["location"], known).select("location", F.col("code").alias("_within"))
    told = found.join(whole, "location", "left").select(F.col("location").alias("_location"), F.slice(F.when(F.size("found") > 0, F.col("found")).when(F.col("_within").isNotNull(), F.array("_within")).otherwise(F.col("found")), 1, MAX_COUNTRIES).alias("_found"))
    none = F.array().cast("array<string>")
    return rows.join(told, F.col(column) == F.col("_location"), "left").select(*[rows[c] for c in rows.columns if c != name], F.coalesce("_found", none).alias(name))


def cities(rows: DataFrame, known: DataFrame, column: str = "location", name: str = "city") -> DataFrame:
    """rows with the cities of their location, each under one spelling, at most MAX_CITIES. Null and blank: none.

    Parts that are a country, a state, letters or a word for no city are left out; a known city has the gazetteer's spelling, and other parts
    of more than two characters their own.
    """
    different = rows.select(F.col(column).alias("location")).where(F.trim(column) != "").distinct()
    placed = _placed(_parts(different, []), known).withColumnsRenamed({"code": "_code", "kind": "_kind", "label": "_label"})
    spelled = known.where("kind in ('alias', 'no city')").select(F.col("text").alias("low"), "kind", F.col("label").alias("spelling"))
    both = placed.join(spelled.where("kind = 'alias'").select("low", "spelling"), "low", "left").join(spelled.where("kind = 'no city'").select("low", F.lit(True).alias("_none")), "low", "left")
    town = F.coalesce(F.col("_kind").isin("city", "around a city"), F.lit(False))
    own = F.when((F.length("low") > 2) & ~F.col("own").rlike("^[A-Z]{2,3}$"), F.col("own"))
    city = F.when(F.col("_none"), None).when(F.col("spelling").isNotNull(), F.col("spelling")).when(town, F.col("_label")).when(F.col("_kind").isNull() | (F.col("_kind") == "postal"), own)
    told = both.groupBy(F.col("location").alias("_location")).agg(F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(city.isNotNull(), F.struct("place", "part", city.alias("city"))))), lambda x: x["city"])), 1, MAX_CITIES).alias("_found"))
    none = F.array().cast("array<string>")
    return rows.join(told, F.col(column) == F.col("_location"), "left").select(*[rows[c] for c in rows.columns if c != name], F.coalesce("_found", none).alias(name))
