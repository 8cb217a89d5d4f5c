"""Countries and cities by a gazetteer: folding, precedence, duplicates, nulls, and letters that mean two things."""

import unicodedata

from pyspark.sql import functions as F

from boardlake.operators import placing


def told(spark, how, known, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, location string")
    return [r["y"] for r in how(df, known, name="y").orderBy("i").collect()]


def test_folding(spark):
    texts = ["São Paulo", "Ra'anana", "Tel-Aviv–Yafo", "  KÖLN\t x", "Łódź", "Z̈ürich", "", "Petah_Tikva’s"]
    plain = ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts]
    want = [" ".join("".join(" " if c in "-_–" else c for c in p if c not in "'’").lower().split()) for p in plain]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", placing.folded(F.col("t")).alias("f")).orderBy("i").collect()
    assert [r["f"] for r in got] == want


def test_countries_by_precedence(spark):
    known = placing.gazetteer(spark, cities={"Atlanta": "US", "Dublin": "IE", "Tbilisi": "GE", "Tel Aviv": "IL", "New York": "US", "York": "GB", "Zürich": "CH"})
    cases = {
        "Atlanta, Georgia": ["US"], "Tbilisi": ["GE"], "New York Office": ["US"], "Greater York": ["GB"], "Zurich, Switzerland, Brussels, Belgium, Tel-Aviv, Israel": ["CH", "BE", "IL"], "IL": ["US"], "Chicago, IL": ["US"], "il": ["IL"], "ISR": ["IL"], "isr": [],
        "UK": ["GB"], "Remote - France": ["FR"], "Our U.S. team": ["US"], "Kiryat Ono; Berlin, Germany": ["IL", "DE"], "Beth Israel Deaconess": [], "Lehi, Utah": ["US"], "Dublin.": ["IE"], "a; b; France": ["FR"], " ;, ": [], "": [], "All over Japan": ["JP"], "PT": [], "pt": ["PT"],
        "; ".join(["France", "Germany", "Spain", "Italy", "Japan", "India", "Peru", "Chile", "Israel"]): ["FR", "DE", "ES", "IT", "JP", "IN", "PE", "CL"],
    }
    assert told(spark, placing.countries, known, *cases, None) == [*cases.values(), []]


def test_cities_under_one_spelling(spark):
    known = placing.gazetteer(spark, cities={"Tel Aviv": "IL", "New York": "US", "Zürich": "CH"}, aliases={"NYC": "New York", "Tel Aviv-Yafo": "Tel Aviv", "münchen": "Munich"})
    cases = {"Tel-Aviv; tel aviv yafo, Israel": ["Tel Aviv"], "NYC / New York": ["New York"], "Greater New York": ["New York"], "MÜNCHEN, Germany": ["Munich"], "Remote, France": [], "Austin, TX": ["Austin"], "DEU": [], "ab": [], "One; Two; Three; Four; Five": ["One", "Two", "Three", "Four"], "zurich": ["Zürich"], "Ohio": []}
    assert told(spark, placing.cities, known, *cases, None, "") == [*cases.values(), [], []]


def test_rows_keep_their_columns_and_copies(spark):
    rows = spark.createDataFrame([(1, "France", "x"), (1, "France", "x"), (2, None, "y")], "country int, location string, text string")
    got = placing.countries(rows, placing.gazetteer(spark, {"France": "FR"})).collect()
    assert sorted((r["country"], r["text"]) for r in got) == [([], "y"), (["FR"], "x"), (["FR"], "x")]
    assert placing.cities(rows.limit(0), placing.gazetteer(spark, {"France": "FR"})).count() == 0
