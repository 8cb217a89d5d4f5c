"""Rules of single fields, case by case."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from boardlake.functions import places, roles, skills, text
from boardlake.operators import evaluate, exact, listing, merge, placing, predicates
from boardlake.session import shared_folder
from boardlake.streaming import fragments

from test_functions import placed, values

NOW = datetime(2024, 1, 31)
PAY = ["salary_text", "salary_is_estimate", "salary_source"]
#: (stored, incoming, description of the read, what is kept)
LADDER = [
    (("$1", True, "table"), ("$9", False, "disclosed"), None, ("$9", False, "disclosed")),
    (("$1", False, "disclosed"), ("$9", True, "table"), "body", ("$9", True, "table")),
    (("$2", True, "estimated"), ("$1", True, "estimated"), None, ("$1", True, "estimated")),
    (("$2", True, "table"), ("$1", True, "table"), "", ("$2", True, "table")),
    (("$2", False, "disclosed"), ("$1", True, "estimated"), None, ("$2", False, "disclosed")),
    ((None, None, None), ("$1", True, "table"), None, ("$1", True, "table")),
    (("$2", True, "table"), (None, None, None), "body", (None, False, None)),
    (("$2", True, "table"), ("", None, None), "body", (None, False, None)),
    (("$2", True, "table"), (None, None, None), "", ("$2", True, "table")),
    (("$2", False, "disclosed"), (None, None, None), "body", ("$2", False, "disclosed")),
]


def test_pay_ladder(spark):
    kind = "id int, company_domain string, title string, ats string, description string, posted_at timestamp, salary_text string, salary_is_estimate boolean, salary_source string"
    old = spark.createDataFrame([(i, "known", "t", "comeet", "d", NOW - timedelta(days=3), *s) for i, (s, _, _, _) in enumerate(LADDER)], kind)
    fresh = lambda i, c, ats: (i, c, "t", ats, None, NOW - timedelta(days=9), None, None, None)
    new = spark.createDataFrame([(i, "known", "t", "comeet", d, NOW - timedelta(days=1), *n) for i, (_, n, d, _) in enumerate(LADDER)] + [fresh(99, "known", "comeet"), fresh(98, "new", "comeet"), fresh(97, "known", "lever"), fresh(96, "moved", "comeet"), fresh(95, None, "comeet")], kind)
    companies = spark.createDataFrame([("known", "comeet"), ("moved", "lever")], "domain string, ats string")
    got = {r["id"]: r for r in merge.upsert(old, new, NOW, tracked=merge.tracked_domains(companies)).collect()}
    assert [tuple(got[i][c] for c in PAY) for i in range(len(LADDER))] == [w for _, _, _, w in LADDER]
    # a board whose dates creep: a new listing of a company that was on it takes the run's time, a new company's backlog keeps its dates, and a stored date stays
    assert got[99]["posted_at"] == NOW and got[0]["posted_at"] == NOW - timedelta(days=3)
    assert all(got[i]["posted_at"] == NOW - timedelta(days=9) for i in (95, 96, 97, 98)) and "_tracked" not in got[99]
    assert {r["posted_at"] for r in merge.upsert(old.limit(0), new, NOW).collect()} == {NOW - timedelta(days=1), NOW - timedelta(days=9)}


@pytest.mark.parametrize("few", [0, exact.FEW])
def test_middle(spark, monkeypatch, few):
    monkeypatch.setattr(exact, "FEW", few)
    for v in ([3.0], [1.0, 2.0], [5.0, 5.0, 1.0], [float(i * i % 101) for i in range(500)], [1e-300, 1e300, 0.0, -1e300], [7.0] * 9 + [8.0] * 9):
        s = sorted(v)
        assert exact.middle(spark.createDataFrame([(x,) for x in v], "x double"), F.col("x")) == (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
    weighted = spark.createDataFrame([(1.0, 5), (2.0, 0), (3.0, 4), (None, 9)], "x double, w int")
    assert exact.middle(weighted, F.col("x"), F.col("w")) == 1.0
    assert exact.middle(weighted.limit(0), F.col("x")) is None


def test_leave_one_out(spark):
    rows = [("a", float(x)) for x in (1, 2, 2, 2, 5, 9)] + [("b", 4.0)] * 5 + [("c", 1.0), (None, 3.0)] + [("d", float(x)) for x in range(1, 30)]
    got = evaluate.leave_one_out(spark.createDataFrame(rows, "k string, p double"), "k", "p").first()
    errors = []
    for key in "abd":
        own = sorted(p for k, p in rows if k == key)
        for p in own:
            rest = [x for x in own if x != p] or own
            errors.append(abs((rest[(len(rest) - 1) // 2] + rest[len(rest) // 2]) / 2 - p) / p)
    errors.sort()
    assert got["covered"] == len(errors) and got["error"] == pytest.approx((errors[(len(errors) - 1) // 2] + errors[len(errors) // 2]) / 2)


def test_skill_context(spark):
    of = lambda *t: values(spark, lambda c: skills.skills_udf()(c), *t)
    gap = "x " * 80
    assert of("Docker, R, SQL", f"Python. {gap} Docker, R, SQL", "Docker. R was here", "- Python\n- R\n- something of more than sixty characters that is no item of a list at all") == [
        ["Docker", "R", "SQL"], ["Python", "Docker", "R", "SQL"], ["Docker"], ["Python", "R"]]
    assert skills.normalize("so­ft ﻿R next a-\n  b (P Y T H O N), a b") == "soft R\nnext ab (PYTHON), a b"
    assert skills.normalize("\U0001f600 x\r\ny") == "� x\ny"
    table = spark.createDataFrame([("Rust", ["rust"], None, None, None, None), ("Zig", None, ["Zig"], True, None, r"the\s+$")], "label string, needles array<string>, exact array<string>, context boolean, not_after string, not_before string")
    assert skills.extractor(skills.rules_from(table))("RUST, Zig; the Zig") == ["Rust", "Zig"]


def test_skill_names_versions_and_implied_labels():
    rules = [skills.Rule("Kubernetes", ["kubernetes"]), skills.Rule("EKS", ["eks"], also=["Kubernetes", "AWS"]), skills.Rule("Swift", exact=["Swift"], context=True), skills.Rule("Canva", ["canva"], whole=True), skills.Rule("C++", ["c++"])]
    of = skills.extractor(rules)
    assert of("Taylor Swift") == of("Interests: Taylor Swift") == []
    assert of("Swift Chen, kubernetes") == ["Kubernetes"] and of("Taylor Swift\nkubernetes") == ["Kubernetes"]
    assert of("Senior Swift Engineer") == of("Skills: Swift") == of("Frontend: Swift") == ["Swift"]
    assert of("Native Swift; kubernetes") == ["Kubernetes"] and of("Native Swift, kubernetes") == ["Swift", "Kubernetes"]
    assert of("EKS") == ["Kubernetes", "EKS", "AWS"]  # one place: by the vocabulary's order
    assert of("kubernetes2, eks2, canva2, canvas, C++17") == ["Kubernetes", "C++"]  # a short spelling takes no version, a whole one nothing
    assert of("currently learning kubernetes. canva") == ["Canva"]
    assert of("* Swift\n\n* kubernetes") == ["Swift", "Kubernetes"] and of("* Swift is what this one longer line tells of\n* kubernetes") == ["Kubernetes"]
    assert skills.extractor([])("python") == of(None) == of("") == []


def test_places_by_every_rule(spark):
    got = placed(spark, placing.countries, "Austin, TX", "DEU", "Zurich, Switzerland", "Herzliya", "Ohio", "Beth Israel Deaconess", "All France (remote)", "US Remote", "Lyon, France; Yehud office", "New York Office")
    assert got == [["US"], ["DE"], ["CH"], ["IL"], ["US"], [], ["FR"], ["US"], ["IL", "FR"], ["US"]]
    assert values(spark, places.names_israel, "R&D, Kiryat Ono", "Beth Israel", None, "TLV") == [True, False, False, True]


def test_roles_read_the_team(spark):
    df = spark.createDataFrame([("Wizard", "Firmware"), ("Wizard", None)], "title string, team string")
    a, b = [r[0] for r in df.select(roles.classify(F.col("title"), F.col("team"), F.lit(None).cast("array<string>"), F.lit(0.5))).collect()]
    assert a["score"] == pytest.approx(b["score"] + 0.2) and "team:tech" in a["evidence"] and "company2:0.50" in a["evidence"]


def test_text_lines_and_logos(spark):
    assert values(spark, text.clean_text, "a \r\n b\r\n\r\n\r\nc\r\n") == ["a\nb\n\nc"]
    assert values(spark, text.real_logo, "https://x.parkingcrew.net/a.png", "https://acme.com/logo.png") == ["", "https://acme.com/logo.png"]


def test_directions_and_counts(spark):
    rows = spark.createDataFrame([(str(i), NOW - timedelta(days=i), f"t{i}", None, "verified") for i in range(3)], "id string, posted_at timestamp, title string, closed_at timestamp, confidence string")
    ids = lambda p: [r["id"] for r in rows.orderBy(*listing.order(p, NOW)).collect()]
    assert ids({"dir": "asc"}) == ids({}) == ["0", "1", "2"] and ids({"dir": "desc"}) == ids({"order": "asc"}) == ["2", "1", "0"]
    assert ids({"sort": "title", "dir": "desc"}) == ["2", "1", "0"]
    assert not predicates.narrowing({"dir": "asc"})
    there = spark.createDataFrame([("1", "Haifa"), ("2", "Beth Israel")], "id string, location string")
    f = predicates.compile_filters({"israel_only": "1", "include_closed": "1", "confidence": "all", "include_outdated": "1"}, NOW, places=False)
    assert [r["id"] for r in there.where(f).collect()] == ["1"]


def test_streams_merge_and_keep_bad_lines_aside(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"k": 1, "v": 5}\n{"k": 1, "v": 9}\nnot json\n{"k": 2, "v": 1}\n')
    (tmp_path / "log" / "b.json").write_text('{"k": 2, "v": 7}\n')
    stream = fragments.fragments(spark, str(tmp_path / "log"), "k long, v long, _corrupt string", files=1)
    good = stream.where("_corrupt is null").select("k", "v")
    assert sorted(map(tuple, fragments.latest_by_key(good, "t", "k", ["v"]).collect())) == [(1, 9), (2, 7)]
    fragments.run_once(stream, lambda b, n: fragments.corrupt(b.persist(), str(tmp_path / "bad"), n).write.mode("append").parquet(str(tmp_path / "good")), str(tmp_path / "cp")).awaitTermination()
    assert [r["_corrupt"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["not json"] and spark.read.parquet(str(tmp_path / "good")).count() == 4


def test_shared_folder_is_set_once(spark):
    assert shared_folder(spark) == shared_folder(spark)


def test_picked(spark):
    """Values at places, of all of a key's rows and of those in other folds, are those of a sort."""
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.randrange(3), float(rng.randrange(4000))) for _ in range(20_000)] + [("c", 0, 1.0), ("c", 1, 2.0), ("d", 0, None)]
    rows = exact.ranged(spark.createDataFrame(data, "k string, _fold int, v double"), "v")
    middle, last = (lambda n: F.floor(n / 2)), (lambda n: n - 1)
    whole = {r["k"]: r for r in exact.picked(rows, ["k"], "v", {"middle": middle, "last": last}).collect()}
    assert set(whole) == {"a", "b", "c"}
    for k, r in whole.items():
        s = sorted(v for a, _, v in data if a == k)
        assert (r["n"], r["least"], r["most"], r["middle"], r["last"]) == (len(s), s[0], s[-1], s[len(s) // 2], s[-1])
    dealt = {(r["k"], r["_fold"]): r for r in exact.picked(rows, ["k"], "v", {"middle": middle}, least=2, folds=3).collect()}
    assert set(dealt) == {*((k, f) for k in "ab" for f in range(3)), ("c", 2)}
    for (k, f), r in dealt.items():
        s = sorted(v for a, g, v in data if a == k and g != f)
        assert (r["n"], r["middle"]) == (len(s), s[len(s) // 2])


def _shuffled(df):
    """Rows written to shuffles by the executed plan of a frame, which adaptive execution made final."""
    df.collect()
    plan, found = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        p = plan.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            plan.append(p.plan())
        else:
            found += p.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
            plan += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_ranges_and_estimates_shuffle_few_rows(spark):
    """Places of a hot key shuffle far fewer rows than it has, and rows meet few cells without being shuffled at all."""
    rows = spark.range(60_000).selectExpr("cast(id as string) id", "cast(id % 3 as string) a", "cast((id * 7919) % 60000 as double) + 1 pay")
    ranged = exact.ranged(rows, "pay")
    assert _shuffled(exact.picked(ranged, ["a"], "pay", {"middle": lambda n: F.floor(n / 2)})) < 6_000
    levels = [("a", ["a"])]
    model = evaluate.cells(rows, levels, "pay")
    told = evaluate.predict(rows, model, levels, widest=1e9)
    assert _shuffled(told) == 0 and told.where("level = 'a'").count() == 60_000


def test_levels_of_many_cells_answer_alike(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("cast(id as string) id", "cast(id % 200 as string) a", "case when id % 4 > 0 then cast(id % 3 as string) end b", "cast(100 + id % 200 % 3 * (id % 17) as double) pay")
    levels = [("ab", ["a", "b"]), ("a", ["a"]), ("b", ["b"])]
    ask = lambda: sorted(map(tuple, evaluate.predict(rows, evaluate.cells(rows, levels, "pay"), levels, widest=0.1).collect()))
    sent = ask()
    for most in (0, 10):
        monkeypatch.setattr(evaluate, "SENT_CELLS", most)
        assert ask() == sent
    assert {r[4] for r in sent} == {"ab", "a", None}


@pytest.mark.parametrize("sent", [None, 2])
def test_markets_are_sought_by_location(spark, monkeypatch, sent):
    """The patterns of markets meet each different location once, unless those are many; null and unknown ones, and the same answers either way."""
    if sent:
        monkeypatch.setattr(evaluate, "SENT_CELLS", sent)
    at = ["London", "Toronto, ON", "Remote - US", "nowhere", "", None, "Haifa, Israel"]
    rows = [(str(i), at[i % len(at)], "c", "d", "s", 100.0 + i) for i in range(210)]
    df = evaluate.placed(spark.createDataFrame(rows, "id string, location string, company_domain string, department string, seniority string, pay double"))
    assert {(r["id"], r["metro"]) for r in df.collect()} == {(r[0], {"London": "uk", "Toronto, ON": "ca", "Remote - US": "us-remote", "Haifa, Israel": "il"}.get(r[1])) for r in rows}
    told = df.withColumn("currency", F.when(F.col("metro") == "uk", "£")).where("currency is not null")
    assert ("RLIKE" in told._jdf.queryExecution().optimizedPlan().toString()) == bool(sent)
    found = evaluate.learned_pay(df, told).where("learned_level is not null").collect()
    assert len(found) == 30 and {(r["location"], r["learned_currency"], r["learned_level"]) for r in found} == {("London", "£", "company+metro+seniority")}
