import itertools
import random

import pytest
from pyspark.sql import Window as W, functions as F

from trustdesk.operators import curate, documented_checks as extra, quality, skew
from trustdesk.operators import similarity
from trustdesk.operators.similarity import fuzzy_identity, near_names
from trustdesk.plans.queries import AS_OF, Data


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_percent_rank_equals_the_window(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([2, 2, 2, 3, 3, 7, 9, 9, 12])], "id int, c int")
    plain = df.withColumn("p", F.percent_rank().over(W.orderBy("c"))).select("id", "p")
    assert rows(quality.with_percent_rank(df, "c").select("id", F.col("pct_rank"))) == rows(plain)
    one = spark.createDataFrame([(1, 5)], "id int, c int")
    assert quality.with_percent_rank(one, "c").first().pct_rank == 0


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [2, 5, 1000])
def test_skew_joins_equal_the_plain_join(spark, how, hot_rows):
    left = spark.createDataFrame([(f"k{i % 4 if i % 3 else 0}", i) for i in range(60)] + [("k0", 0)] * 7 + [(None, 99)],
                                 "k string, v int")
    right = spark.createDataFrame([("k0", "a"), ("k1", "b"), ("k9", "c")], "k string, w string")
    plain = rows(left.join(right, "k", how).select("k", "v", "w"))
    assert rows(skew.hot_split_join(left, right, "k", how, hot_rows=hot_rows).select("k", "v", "w")) == plain
    distinct = left.distinct()
    assert (rows(skew.salted_join(distinct, right, "k", "v", how, hot_rows=hot_rows).select("k", "v", "w"))
            == rows(distinct.join(right, "k", how).select("k", "v", "w")))


def test_hot_values_give_the_same_checks(spark, sf_dir):
    d = Data(spark, sf_dir)
    assert rows(quality.duplicate_phones(d.source, hot_rows=2)) == rows(quality.duplicate_phones(d.source))
    assert rows(curate.issue_rows(d.silver, hot_rows=1)) == rows(curate.issue_rows(d.silver))
    for check in (extra.duplicate_emails, extra.duplicate_phones_by_count):
        assert rows(check(d.source, hot_rows=2)) == rows(check(d.source))
    for check in (extra.duplicate_identity, extra.weak_address, extra.same_coordinates):
        assert rows(check(d.silver, hot_rows=2)) == rows(check(d.silver))


def test_scores_sum_the_worst_penalty_per_check(spark):
    checks = spark.createDataFrame([
        (" a ", "x", 50, "shared by 3"), ("a", "x", 10, "shared by 2"), ("a", "y", 30, "no text"),
        ("b", "y", 30, "no text"), ("c", "x", 70, "p"), ("c", "y", 60, "q"), (None, "y", 5, "lost")],
        "unique_id string, check string, penalty_points int, issue_summary string")
    got = {r.facility_id: r for r in quality.quality_scores(checks, ["x", "y"]).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].quality_score, got["a"].quality_tier, got["a"].issues) == (
        20, "critical_issue", ["no text", "shared by 2", "shared by 3"])
    assert (got["b"].quality_score, got["b"].quality_tier) == (70, "needs_review")
    assert (got["c"].quality_score, got["c"].total_penalty_points) == (0, 130)


def test_a_check_that_cannot_run_is_skipped(spark, sf_dir):
    src = Data(spark, sf_dir).source.drop("websites", "phone_numbers")
    checks, names, skipped = quality.core_checks(src)
    assert set(skipped) == {"missing_phone", "missing_website", "duplicate_phones"}
    assert "missing_name" in names and quality.quality_scores(checks, names).count() > 0


def test_location_boundaries(spark):
    src = spark.createDataFrame(
        [("a", "6", "68", "India"), ("b", "5.9", "98", " in "), ("c", "38.1", "98.1", None), ("d", "north", "70", "Nepal"),
         ("e", None, "70", "India")], "unique_id string, latitude string, longitude string, address_country string")
    for c in ("name", "facilityTypeId"):
        src = src.withColumn(c, F.lit("x"))
    src = src.withColumn("address_city", F.lit("c")).withColumn("address_stateOrRegion", F.lit("s"))
    got = {r.unique_id: (r.location_issues, r.penalty_points) for r in quality.location_check(src).collect()}
    assert got == {"b": ("latitude_outside_india_range", 35),
                   "c": ("latitude_outside_india_range, longitude_outside_india_range", 70),
                   "d": ("unexpected_country", 30), "e": ("missing_coordinates", 5)}


def test_repeated_number_yields_two_rows(spark):
    src = spark.createDataFrame(
        [("a", '["980-0001","9800001"]'), ("b", '["9800001"]'), ("c", '["123456"]'), ("d", '["123456"]'), ("e", "[]")],
        "unique_id string, phone_numbers string")
    for c in ("name", "facilityTypeId", "address_city", "address_stateOrRegion", "address_country"):
        src = src.withColumn(c, F.lit("x"))
    got = quality.duplicate_phones(src)
    assert sorted(r.unique_id for r in got.collect()) == ["a", "a", "b"]
    assert got.first().issue_summary == "Phone number shared with 2 facilities" and got.first().penalty_points == 10


def distance(a, b):
    previous = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        current = [i]
        for j, y in enumerate(b, 1):
            current.append(min(previous[j] + 1, current[j - 1] + 1, previous[j - 1] + (x != y)))
        previous = current
    return previous[-1]


def test_similar_names_equal_brute_force(spark):
    names = ["lotus care clinic", "lotus care clinics", "lotus car clinic", "lotus heart centre", "lotus heart center",
             "lotus", "lotuz", "lotusa", "lotus aaaaaaaaaaaa", "lotus aaaaaaaaaaa", "lotu aaaaaaaaaaaa", "rose care clinic",
             "lotus dental unit 12", "lotus dental unit 21", "lotus dental unit 99", "Lotus  Dental-Unit 12", "kotus care clinic",
             "abcdefg", "abcdefgh", "bcdefgh", "x", "y", "", "...", "harbour mission home", "arbour mission homee"]
    places = ["A", "B"]
    data = [(f"{p}{i}", n, p) for p in places for i, n in enumerate(names) if (i + len(p)) % 5 or p == "A"]
    data += [("none", None, "A"), ("nowhere", "lotus care clinic", None)]
    df = spark.createDataFrame(data, "unique_id string, name string, address_state_or_region string")

    def norm(n):
        return " ".join("".join(c if c.isalnum() else " " for c in (n or "").lower()).split())

    for threshold, percent in ((0.85, 15), (0.7, 30), (1.0, 0)):
        expected = set()
        for (i, a, p), (j, b, q) in itertools.permutations(data, 2):
            a, b = norm(a), norm(b)
            if p is not None and p == q and a and b and a != b and distance(a, b) * 100 <= percent * max(len(a), len(b)):
                expected.add(i)
        assert {r.unique_id for r in fuzzy_identity(df, threshold).collect()} == expected
    with pytest.raises(ValueError):
        fuzzy_identity(df, threshold=0.5)


def test_random_names_equal_brute_force(spark):
    rng = random.Random(5)
    names = {"".join(rng.choice("ab c") for _ in range(rng.randint(4, 26))).strip() for _ in range(150)}
    names |= {n[:3] + "x" + n[4:] for n in list(names)[:40] if len(n) > 6} | {"x" + n for n in list(names)[:20]}
    df = spark.createDataFrame([("P", n) for n in names if n], "place string, norm string")
    got = {r.norm for r in near_names(df, 0.85).collect()}
    assert got == {a for a in names for b in names if a and b and a != b and distance(a, b) * 100 <= 15 * max(len(a), len(b))}


def test_near_names_at_other_thresholds_equal_brute_force(spark):
    rng = random.Random(6)
    names = {"".join(rng.choice("abcd") for _ in range(rng.randint(2, 18))) for _ in range(120)} | {"ha ha ha ha ha", "ha ha ha ha hb", "aaaaaaa",
                                                                                                 "aaaaaab", "bbbbbbb"}
    names |= {n[:3] + "x" + n[4:] for n in list(names)[:40] if len(n) > 6}
    df = spark.createDataFrame([("P", n) for n in names], "place string, norm string")
    for percent in (8, 20, 40):
        got = {r.norm for r in near_names(df, 1 - percent / 100).collect()}
        assert got == {a for a in names for b in names if a != b and distance(a, b) * 100 <= percent * max(len(a), len(b))}


def test_a_word_in_every_name_deals_no_pairs(spark):
    """Each name has as many rare runs as its edits could touch, so that no two of them meet at all."""
    rng = random.Random(7)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24)) + " health centre" for _ in range(2000)]
    df = spark.createDataFrame([(n, len(n)) for n in names], "norm string, size int")
    dealt = similarity.rare_runs(df, 15)
    assert dealt.where("run in ('hea', 'eal', 'alt', 'lth', 'th ', 'h c', ' ce', 'cen', 'ent', 'ntr', 'tre', ' he')").count() == 0
    pairs = dealt.groupBy("run").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    assert pairs < 2000 * 2000 / 2 / 50


def test_names_nearby_equal_brute_force(spark):
    """Spots across the date line, at the poles and at the edge of the distance."""
    rng = random.Random(9)
    words = ["lotus care hospital", "lotus cara hospital", "river side clinic", "river size clinic", "hill view pharmacy"]
    spots = {(rng.choice(words), round(rng.uniform(-90, 90), 1), round(rng.choice([-179.9, 179.8, 0.0, 45.0]) + rng.uniform(-0.1, 0.1), 2))
             for _ in range(150)}
    spots |= {(rng.choice(words), rng.choice([89.9, -89.95, 90.0, 0.0, 0.4]), rng.choice([-180.0, 180.0, 0.0, 90.0, 0.5])) for _ in range(60)}

    def km(a, b):
        import math

        la, oa, lb, ob = map(math.radians, (a[1], a[2], b[1], b[2]))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - oa) / 2) ** 2
        return 2 * similarity.EARTH_KM * math.asin(min(1, math.sqrt(h)))

    df = spark.createDataFrame(list(spots), "norm string, lat double, lon double")
    for reach in (30.0, 300.0, 5000.0):
        got = {tuple(r) for r in similarity.near_names_nearby(df, reach).collect()}
        assert got == {a for a in spots for b in spots if a[0] != b[0] and km(a, b) <= reach
                       and distance(a[0], b[0]) * 100 <= 15 * max(len(a[0]), len(b[0]))}


def test_checks_from_outside(spark, sf_dir):
    d = Data(spark, sf_dir)
    bad = ("no_frame", lambda src: src.select(F.col("missing")))
    checks, names, skipped = quality.core_checks(d.source, [
        quality.Rule("short", F.length("name") < 24, 7, "Name is short"), ("bare", lambda src: src.select("unique_id")), bad])
    assert "short" in names and skipped == ["bare", "no_frame"] and checks.where("check = 'short'").count() > 0


def test_gold_takes_the_best_copy_and_the_latest_correction(spark, sf_dir):
    d = Data(spark, sf_dir)
    one = d.silver.where("unique_id = 'c4ca4238-a0b9-2382-0dcc-509a6f75849b'").limit(1)
    poorer = one.withColumn("description", F.lit(None).cast("string")).withColumn("name", F.lit("Poorer"))
    bad = one.withColumn("unique_id", F.lit("bad-1"))
    log = spark.createDataFrame([
        ("c4ca4238-a0b9-2382-0dcc-509a6f75849b", "capacity", "20", "2024-01-01 00:00:00", 1),
        ("c4ca4238-a0b9-2382-0dcc-509a6f75849b", "capacity", "many", "2024-01-01 00:00:00", 2),
        ("c4ca4238-a0b9-2382-0dcc-509a6f75849b", "address_city", "Old", "2023-01-01 00:00:00", 3),
        ("c4ca4238-a0b9-2382-0dcc-509a6f75849b", "address_city", "New", "2024-01-01 00:00:00", 4),
        ("c4ca4238-a0b9-2382-0dcc-509a6f75849b", "email", None, "2024-01-01 00:00:00", 5),
        ("unknown", "name", "X", "2024-01-01 00:00:00", 6)],
        "facility_id string, field_name string, new_value string, updated_at string, seq int").withColumn(
        "updated_at", F.col("updated_at").cast("timestamp"))
    gold = curate.to_gold(one.unionByName(poorer).unionByName(bad), log).collect()
    assert len(gold) == 1
    kept, r = one.first(), gold[0]
    assert (r.name, r.address_city, r.capacity, r.email) == (kept.name, "New", kept.capacity, kept.email)
    assert r.overridden_fields == ["address_city", "capacity", "email"]
    assert d.gold.count() == d.gold.select("unique_id").distinct().count()


def test_dedupe_limits_groups_before_the_shuffle(spark, sf_dir):
    d = Data(spark, sf_dir)
    plan = curate.best_by_completeness(d.silver)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_scores_read_only_needed_columns(spark, sf_dir):
    from trustdesk.operators import trust
    d = Data(spark, sf_dir)
    plan = trust.facility_scores(d.gold, d.signals, d.quality_scores)._jdf.queryExecution().toString()
    assert "evidence_text" not in plan.split("== Physical Plan ==")[1].split("ReadSchema")[1]


def plan_by_shuffle(spark, build):
    """Physical plan of ``build()`` without broadcasts, as for tables of any size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return build()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_scores_move_no_text(spark, sf_dir):
    from trustdesk.operators import trust
    d = Data(spark, sf_dir)
    plan = plan_by_shuffle(spark, lambda: trust.facility_scores(d.gold, d.signals, d.quality_scores))
    assert plan.index("isnull(description") > plan.index("Exchange")  # below it: texts are not shuffled


def test_empty_fields_are_counted_once_per_record(spark):
    from trustdesk.operators import trust
    fields = ", ".join(f"{c} string" for c in ("unique_id", "name", "address_state_or_region", "facility_type_id", *trust.CHECKED_FIELDS))
    gold = spark.createDataFrame([("a", "A", None, None, *["x"] * 7), ("b", "B", None, None, *[None] * 7), (None, "C", None, None, *["x"] * 7)], fields)
    signals = spark.createDataFrame([(i, 0.5, False, str(n)) for i in "ab" for n in range(3)],
                                    "facility_id string, trust_score double, contradiction boolean, dimension string")
    scores = spark.createDataFrame([("a", 60)], "facility_id string, quality_score int")
    found = {r.facility_name: r.score for r in trust.facility_scores(gold, signals, scores).collect()}
    assert found == {"A": 0.4, "B": 0.29, "C": None}


def test_texts_of_records_are_joined_unsorted(spark, sf_dir):
    from trustdesk.sources import driver_views
    plan = plan_by_shuffle(spark, lambda: driver_views.source(spark, sf_dir).select("record_key", "description"))
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "ShuffledHashJoin" in joins[0] and "BuildLeft" in joins[0]


def test_signals_move_no_more_text_than_they_quote(spark, sf_dir):
    from trustdesk.sources import driver_views
    plan = plan_by_shuffle(spark, lambda: driver_views.signals(spark, sf_dir))
    assert "substr(text#" in plan[plan.index("Exchange"):]


def test_row_rules_scan_once(spark, sf_dir):
    d = Data(spark, sf_dir)
    plan = quality.row_checks(d.source, quality.missing_rules())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_year_rules_use_the_given_day(spark, sf_dir):
    checks = extra.field_conflicts(Data(spark, sf_dir).source, AS_OF)
    assert checks.where("check = 'year_in_future'").count() > 0


def test_names_in_one_stretch_are_near_names(spark):
    """Every name found by grouping is near, and most names of a list that differ in a number are found without pairs."""
    rng = random.Random(11)
    names = sorted({"".join(rng.choice("abc ") for _ in range(rng.randrange(1, 24))).strip() for _ in range(300)} - {""}
                   | {f"lotus {kind} {n}" for kind in ("care clinic", "nursing home") for n in rng.sample(range(1, 977), 60)})
    df = spark.createDataFrame([("p", n) for n in names], "place string, norm string")
    for percent in (10, 15, 30):
        near = {r.norm for r in near_names(df, 1 - percent / 100).collect()}
        found = {r.norm for r in similarity.in_one_stretch(df, ["place"], percent).collect()}
        assert found <= near
        if percent == 15:
            assert len([n for n in found if n.startswith("lotus")]) > 100


def test_points_of_a_small_cell_are_near(spark):
    rng = random.Random(12)
    for km in (1.0, 50.0, 900.0, 9000.0):
        spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)]
        step = km / 111
        spots = [(max(-90.0, min(90.0, a + rng.uniform(-step, step))), max(-180.0, min(180.0, b + rng.uniform(-step, step))))
                 for a, b in spots + [(0.0, 0.0), (89.9, 5.0), (-89.9, 5.0)] for _ in range(4)]
        df = spark.createDataFrame(spots, "lat double, lon double").withColumn("box", similarity.small_cell("lat", "lon", km))
        far = df.alias("l").join(df.alias("r"), "box").where(similarity.distance_km("l.lat", "l.lon", "r.lat", "r.lon") > km)
        assert far.isEmpty()
