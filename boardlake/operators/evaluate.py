"""Pay models and classifiers: cells, bands, errors, backtests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.places import metro
from ..functions.salary import market_currency, monthly_thousands
from . import exact
from .versions import settled

LEAST, LOW_PERCENT, HIGH_PERCENT, WIDEST = 5, 15, 85, 1.5
#: Cells of all levels together that go to every task; levels with more are met in an equi-join.
SENT_CELLS = 200_000


def quantile_exclusive(values: Column, percent: int) -> Column:
    """The percentile of a sorted array by (n + 1) positions, which may reach past the ends; null under two values."""
    n = F.size(values)
    m = n + 1
    j = F.greatest(F.least(F.floor(F.lit(percent) * m / 100).cast("int"), n - 1), F.lit(1))
    d = F.lit(percent) * m - j * 100
    return F.when(n >= 2, (F.get(values, j - 1) * (100 - d) + F.get(values, j) * d) / 100.0)


def band(values: Column) -> Column:
    """struct(low, high) of the 15th and 85th percentiles."""
    return F.struct(quantile_exclusive(values, LOW_PERCENT).alias("low"), quantile_exclusive(values, HIGH_PERCENT).alias("high"))


def _keys(levels: list[tuple[str, list[str]]]) -> Column:
    """An array of struct(order, level, key): a row's key at each level of which it has all parts."""
    out = []
    for i, (name, parts) in enumerate(levels):
        whole = reduce(Column.__and__, [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in parts], F.lit(True))
        out.append(F.when(whole, F.struct(F.lit(i).alias("order"), F.lit(name).alias("level"), F.concat_ws("|", *[F.col(k).cast("string") for k in parts]).alias("key"))))
    return F.array_compact(F.array(*out))


def _key_of(order: int) -> Column:
    """A row's key at one level, of its _keys."""
    return F.get(F.filter("_keys", lambda x: x["order"] == order), F.lit(0))["key"]


def cells(rows: DataFrame, levels: list[tuple[str, list[str]]], pay: str, least: int = LEAST, by: tuple[str, ...] = ()) -> DataFrame:
    """(level, key, n, least, most, low, high): for each level of a chain its keys with enough rows, their bounds and their band.

    A key with an empty part is none. The band is that of `band`, from the values at its four positions. by: further columns
    whose values have cells of their own, which come first.
    """
    parts = dict.fromkeys(k for _, keys in levels for k in keys)
    own = settled(rows.where(F.col(pay).isNotNull()).select(*by, *[F.col(k) for k in parts if k not in by], F.col(pay).alias("_pay")), "pays")
    return _cells(exact.ranged(own, "_pay"), levels, "_pay", least, by)


def _cells(rows: DataFrame, levels: list[tuple[str, list[str]]], pay: str, least: int, by: tuple[str, ...] = (), folds: int = 0) -> DataFrame:
    """`cells` of rows in ranges; folds: for each fold those of all others, without bounds."""
    dealt = ["_fold"] if folds else []
    each = rows.select(*by, *dealt, F.explode(_keys(levels)).alias("x"), F.col(pay).alias("pay"), "_cell").select(*by, *dealt, "x.level", "x.key", "pay", "_cell")
    first = lambda percent, n: F.greatest(F.least(F.floor(F.lit(percent) * (n + 1) / 100), n - 1), F.lit(1))
    positions = {}
    for s, percent in (("_low", LOW_PERCENT), ("_high", HIGH_PERCENT)):
        positions |= {f"a{s}": lambda n, percent=percent: first(percent, n) - 1, f"b{s}": lambda n, percent=percent: first(percent, n)}
    found = exact.picked(each, [*by, "level", "key"], "pay", positions, least, folds)
    n, ends = F.col("n"), []
    for s, percent in (("_low", LOW_PERCENT), ("_high", HIGH_PERCENT)):
        d = F.lit(percent) * (n + 1) - first(percent, n) * 100
        ends.append(F.when(n >= 2, (F.col(f"a{s}") * (100 - d) + F.col(f"b{s}") * d) / 100.0).alias(s[1:]))
    return found.select(*by, *dealt, "level", "key", "n", *([] if folds else ["least", "most"]), *ends)


def narrow(low: Column, high: Column, widest: float = WIDEST) -> Column:
    """Whether a range may be shown: its low end is positive, and it is no wider than so many times that."""
    return (low > 0) & ((high - low) / low <= widest)


def predict(rows: DataFrame, model: DataFrame, levels: list[tuple[str, list[str]]], widest: float = WIDEST, by: tuple[str, ...] = (), key: str = "id") -> DataFrame:
    """rows with level, low, high of the first level whose cell is not too wide; by as in `cells`. Rows are told apart by their key.

    Levels of few cells, SENT_CELLS together, are sent to the rows, which stay where they are. For the others a row asks for its cells of all of them at
    once: one join, whatever their number, and the answer of the first level stays.
    """
    own = [F.col(c).alias(f"_{c}") for c in by]
    told = settled(model.where(narrow(F.col("low"), F.col("high"), widest)).select(*own, "level", "key", "low", "high"), "bands")
    sizes = {r["level"]: r["n"] for r in told.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    sent, total = set(), 0
    for name in sorted((x for x, _ in levels if x in sizes), key=lambda x: sizes[x]):
        total += sizes[name]
        if total <= SENT_CELLS:
            sent.add(name)
    out, answers = rows.withColumn("_keys", _keys(levels)), []
    for i, (name, _) in enumerate(levels):
        if name in sent:
            few = told.where(F.col("level") == name).select(*[F.col(f"_{c}").alias(f"_{c}{i}") for c in by], F.col("key").alias(f"_key{i}"), F.struct(F.lit(i).alias("order"), "level", "low", "high").alias(f"_a{i}"))
            asked = _key_of(i)
            same = reduce(Column.__and__, [F.col(c) == F.col(f"_{c}{i}") for c in by], asked == F.col(f"_key{i}"))
            out = out.join(F.broadcast(few), same, "left").drop(f"_key{i}", *[f"_{c}{i}" for c in by])
            answers.append(F.col(f"_a{i}"))
    many = [x for x in sizes if x not in sent]
    if many:
        wanted = rows.select(F.col(key).alias("_id"), *own, F.explode(_keys(levels)).alias("a")).select("_id", *[f"_{c}" for c in by], "a.order", "a.level", "a.key").where(F.col("level").isin(many))
        best = wanted.join(told.where(F.col("level").isin(many)), [*[f"_{c}" for c in by], "level", "key"]).groupBy("_id").agg(F.min_by(F.struct("order", "level", "low", "high"), "order").alias("_many"))
        out = out.join(best, F.col(key) == F.col("_id"), "left")
        answers.append(F.col("_many"))
    none = F.lit(None).cast("struct<order:int,level:string,low:double,high:double>")
    out = out.withColumn("_a", F.least(none, none, *answers))
    return out.select(*rows.columns, "_a.level", "_a.low", "_a.high")


def leave_one_out(rows: DataFrame, key: str, pay: str, least: int = LEAST) -> DataFrame:
    """(covered, error, flat_error): the median error of the median of a key's other pays, and of one median of all covered rows.

    Leaving one out drops every equal pay of the key; a key with one pay only keeps it. The others' median is at two places of
    the key's order, shifted by the pay's own rows where it stands before them; a key needs few different places, as many as
    its pays have different counts, so they are a small map for each key.
    """
    known = exact.cumulative(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(pay).alias("p")), ["k"], "p").where(F.col("n") >= least)
    rest = F.when(F.col("n") > F.col("c"), F.col("n") - F.col("c")).otherwise(F.col("n"))
    place = lambda q: F.when((F.col("n") == F.col("c")) | (q < F.col("before")), q).otherwise(q + F.col("c"))
    known = known.withColumn("x", place(F.floor((rest - 1) / 2))).withColumn("y", place(F.floor(rest / 2))).persist()
    places = known.select("k", F.explode(F.array("x", "y")).alias("q")).distinct().groupBy("k").agg(F.collect_list("q").alias("places"))
    hit = known.join(places, "k").select("k", F.explode(F.filter("places", lambda q: (F.col("before") <= q) & (q < F.col("before") + F.col("c")))).alias("q"), "p")
    value_at = hit.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("q", "p"))).alias("at"))
    scored = known.join(value_at, "k").select("p", "c", (F.abs((F.col("at")[F.col("x")] + F.col("at")[F.col("y")]) / 2 - F.col("p")) / F.col("p")).alias("e")).persist()
    flat = exact.middle(scored, F.col("p"), F.col("c"))
    error, flat_error = (exact.middle(scored, e, F.col("c")) for e in (F.col("e"), F.abs(F.lit(flat).cast("double") - F.col("p")) / F.col("p")))
    covered = scored.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    scored.unpersist()
    known.unpersist()
    return rows.sparkSession.createDataFrame([(covered, error, flat_error)], "covered long, error double, flat_error double")


def fold(key: Column, folds: int) -> Column:
    """Which of the folds a key belongs to, by its md5."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(folds))


def backtested(rows: DataFrame, levels: list[tuple[str, list[str]]], pay: str, key: str, folds: int = 5, widest: float = WIDEST, flat: bool = True) -> DataFrame:
    """rows with level, low, high as the other folds' rows tell them, and, if asked for, flat, the median of all other folds; folds are by a hash of the key."""
    dealt = settled(rows.withColumn("_fold", fold(F.col(key), folds)), "folds")
    learned = exact.ranged(dealt.where(F.col(pay).isNotNull()), pay)
    found = predict(dealt, _cells(learned, levels, pay, LEAST, folds=folds), levels, widest, ("_fold",), key)
    if flat:
        ends = exact.picked(learned.select("_fold", "_cell", pay), [], pay, {"a": lambda n: F.floor((n - 1) / 2), "b": lambda n: F.floor(n / 2)}, folds=folds)
        middles = ends.select("_fold", ((F.col("a") + F.col("b")) / 2).alias("flat"))
        found = found.join(F.broadcast(middles), "_fold", "left")  # a row for each fold
    return found.drop("_fold")


def backtest(rows: DataFrame, levels: list[tuple[str, list[str]]], pay: str, key: str, folds: int = 5, widest: float = WIDEST) -> DataFrame:
    """(rows, coverage, error, flat_error, hit_rate, width) over folds by a hash of the key; each fold is predicted by the others.

    error is of the range's middle, flat_error of one median for all rows, width in parts of the range's low end.
    """
    both = backtested(rows, levels, pay, key, folds, widest).select(F.col(pay).alias("pay"), "low", "high", "flat").persist()
    mid, some = (F.col("low") + F.col("high")) / 2, F.col("low").isNotNull()
    error, width = exact.middle(both, F.abs(mid - F.col("pay")) / F.col("pay")), exact.middle(both, (F.col("high") - F.col("low")) / F.col("low"))
    flat = exact.middle(both, F.abs(F.col("flat") - F.col("pay")) / F.col("pay"))
    n, covered, hit = both.agg(F.count(F.lit(1)), F.count_if(some), F.avg(F.when(some, F.col("pay").between(F.col("low"), F.col("high")).cast("double")))).first()
    both.unpersist()
    return rows.sparkSession.createDataFrame([(n, covered / n if n else None, error, flat, hit, width)], "rows long, coverage double, error double, flat_error double, hit_rate double, width double")


def answered(found: DataFrame) -> DataFrame:
    """(level, n, share): which level's cells answered how many of the rows that have an answer."""
    n = found.where("level is not null").groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))  # a row for each level


def confusion(rows: DataFrame, truth: Column, verdict: Column, unknown: Column) -> DataFrame:
    """(tp, fp, fn, tn, precision, recall, unknown_share)."""
    tp, fp, fn, tn = (F.count_if(x) for x in (truth & verdict, ~truth & verdict, truth & ~verdict, ~truth & ~verdict))
    return rows.agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(F.count_if(unknown), F.count(F.lit(1))).alias("unknown_share"),
    )


#: The chain of an estimate by learned cells, the tightest first; a market stands for the location.
CHAIN = [
    ("company+metro+seniority", ["company_domain", "metro", "seniority"]), ("company+seniority", ["company_domain", "seniority"]), ("metro+dept+seniority", ["metro", "department", "seniority"]),
    ("metro+seniority", ["metro", "seniority"]), ("dept+seniority", ["department", "seniority"]), ("company+metro", ["company_domain", "metro"]), ("seniority", ["seniority"]),
]


def placed(rows: DataFrame) -> DataFrame:
    """rows with metro, the market of their location, which is sought once for each different location where those are few; a metro that they have already stays."""
    if "metro" in rows.columns:
        return rows
    known = settled(rows.where(F.col("location").isNotNull()).select(F.col("location").alias("_location")).distinct(), "locations")
    if known.count() > SENT_CELLS:
        return rows.withColumn("metro", metro(F.col("location")))
    markets = settled(known.withColumn("metro", metro(F.col("_location"))), "markets")
    return rows.join(F.broadcast(markets), F.col("location") == F.col("_location"), "left").drop("_location")


def learned_pay(jobs: DataFrame, told: DataFrame, key: str = "id") -> DataFrame:
    """jobs with learned_level, learned_low, learned_high, learned_currency, learned_text.

    told: listings with disclosed annual pay (currency, pay). Cells are of one currency each. A job asks those of its market's
    currency; one in no known market, or in the home market, has no answer. Frames that come from `placed` are not placed again.
    """
    model = cells(placed(told), CHAIN, "pay", by=("currency",))
    own = placed(jobs).withColumn("currency", market_currency(F.col("metro")))
    found = predict(own, model, CHAIN, by=("currency",), key=key)
    text = monthly_thousands(F.col("low"), F.col("high"), F.col("currency"))
    return found.select(*jobs.columns, F.col("level").alias("learned_level"), F.col("low").alias("learned_low"), F.col("high").alias("learned_high"), F.when(F.col("level").isNotNull(), F.col("currency")).alias("learned_currency"), F.when(F.col("level").isNotNull(), text).alias("learned_text"))
