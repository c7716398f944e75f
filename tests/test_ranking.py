import random
import re

import pytest
from pyspark.sql import Window as W, functions as F

from trustdesk.operators import ranking, search, starters, vector_index
from trustdesk.plans.layers import shared_folder
from trustdesk.plans.queries import Data


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(f"id{rng.randrange(10 ** 6):06}-{i}", rng.choice([None, 0.5, round(rng.random(), 2)]), rng.randrange(4))
                                  for i in range(3000)], "id string, score double, n int").repartition(7)


def test_ranks_equal_the_window(spark, scored):
    want = scored.withColumn("rank", F.rank().over(W.orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("n"))))
    for ranges in (1, 4, 64):
        assert rows(ranking.with_rank(scored, ("score", True), ("n", False), ranges=ranges)) == rows(want)
    assert ranking.with_rank(scored.where("false"), ("score", True)).count() == 0


def test_a_million_districts_without_a_single_partition(spark):
    many = spark.range(1_000_000).select(F.col("id").cast("string").alias("district"), (F.xxhash64("id") % 50_000 / 10.0).alias("burden"),
                                         (F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(50))).alias("n"))
    ranked = ranking.with_rank(many, ("burden", True), ("n", False))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "_range" in plan
    got = ranked.agg(F.min("rank"), F.max("rank"), F.count("*")).first()
    assert got[0] == 1 and 900_000 < got[1] <= 1_000_000 and got[2] == 1_000_000
    # a few ranks counted one by one
    for r in ranked.where("district % 250000 = 7").collect():
        ahead = many.where((F.col("burden") > r.burden) | (F.col("burden") == r.burden) & (F.col("n") < r.n)).count()
        assert r["rank"] == ahead + 1


@pytest.mark.parametrize("descending", [True, False])
def test_pages_equal_offset(spark, scored, descending):
    key = ranking.sort_key(("score", descending), ("id", False))
    order = F.desc_nulls_last("score") if descending else F.asc_nulls_last("score")
    for offset, size in ((0, 10), (1490, 25), (2990, 25), (5000, 5), (700, 900)):
        want = [r.id for r in scored.orderBy(order, "id").offset(offset).limit(size).collect()]
        got = ranking.page(scored, key, offset, size, shallow=5, ranges=16)
        assert [r.id for r in got.collect()] == want and got.columns == scored.columns
    assert ranking.page(scored.where("false"), key, 100, 5, shallow=5).count() == 0


def test_a_deep_page_sorts_the_ranges_it_touches(spark, scored):
    key = ranking.sort_key(("score", True), ("id", False))
    placed, n = ranking.dealt(scored, key, 32)
    sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
    assert n > 20 and max(sizes) < 3000 / 32 * 4
    got = ranking.page(scored, key, 2000, 10, shallow=5, ranges=32)
    skipped = int(re.search(r"Offset (\d+)", got._jdf.queryExecution().optimizedPlan().toString())[1])
    assert skipped < max(sizes)


def test_pages_by_cursor_walk_through_all_rows(spark, scored):
    key = ranking.sort_key(("score", True), ("id", False))
    want = [r.id for r in scored.orderBy(F.desc_nulls_last("score"), "id").collect()]
    first = ranking.page(scored, key, 0, 700).collect()
    seen, last = [r.id for r in first], first[-1]
    while True:
        got = ranking.after(scored, key, (None if last.score is None else -last.score, last.id), 700).collect()
        if not got:
            break
        seen, last = seen + [r.id for r in got], got[-1]
    assert seen == want


def test_stored_order_reads_the_folders_of_a_page(spark, scored, request):
    key = ranking.sort_key(("score", True), ("id", False))
    path = f"{shared_folder(spark)}/trustdesk-tests/{request.node.name}"
    kept = ranking.store_in_order(scored, key, path, range_rows=200)
    want = [r.id for r in scored.orderBy(F.desc_nulls_last("score"), "id").collect()]
    assert kept.rows == 3000 and len(kept.starts) > 8
    for offset, size in ((0, 10), (1995, 30), (2999, 5), (4000, 5)):
        got = kept.page(spark, offset, size)
        assert [r.id for r in got.collect()] == want[offset:offset + size]
    plan = kept.page(spark, 1000, 10)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_range", plan)
    assert kept.page(spark, 1000, 10).count() == 10


def test_search_pages_agree(spark, sf_dir):
    d = Data(spark, sf_dir)
    plain = search.search(d.gold, d.signals, d.quality_scores, page=2, limit=20).collect()
    assert search.search(d.gold, d.signals, d.quality_scores, page=2, limit=20, shallow=1).collect() == plain
    first = search.search(d.gold, d.signals, d.quality_scores, page=1, limit=20).collect()[-1]
    cursor = (first.overall_trust_score, first.facility_id)
    assert search.search_after(d.gold, d.signals, d.quality_scores, cursor, 20).collect() == plain
    by_name = search.search(d.gold, d.signals, d.quality_scores, page=2, limit=20, sort="name").collect()
    last = search.search(d.gold, d.signals, d.quality_scores, page=1, limit=20, sort="name").collect()[-1]
    assert search.search_after(d.gold, d.signals, d.quality_scores, (last.facility_name, last.facility_id), 20, sort="name").collect() == by_name


# nearest vectors -----------------------------------------------------------------------------------------------------


def clustered(spark, n=3000, groups=30, size=16):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(groups)]
    made = [(i, [c + rng.gauss(0, 0.1) for c in centres[i % groups]]) for i in range(n)]
    made += [(n, None), (n + 1, [0.0] * size), (n + 2, made[5][1]), (n + 3, [2 * x for x in made[5][1]])]
    return spark.createDataFrame(made, "vec_id long, embedding array<double>")


def test_index_finds_what_comparing_all_finds_with_fewer_comparisons(spark, request):
    df = clustered(spark)
    path = f"{shared_folder(spark)}/trustdesk-tests/{request.node.name}"
    index = vector_index.build(df, path)
    asked = df.where("vec_id % 50 = 0")
    want = starters.cosine_topk(df, starters.query_vectors(asked, "vec_id", "embedding"), k=4)
    got = vector_index.search(index, asked, k=4)
    columns = ["query_id", "match_id", "similarity", "rank"]
    assert rows(got.select(columns)) == rows(want.select(columns))
    compared = got.select("query_id", "compared").distinct().agg(F.sum("compared")).first()[0]
    assert compared < 0.5 * asked.where("embedding is not null").count() * 3002
    assert sum(len(r.ids) // 8 for r in index.blocks().collect()) == 3002


@pytest.mark.parametrize("cells", [1, 7, 500])
def test_index_is_exact_whatever_the_centroids(spark, sf_dir, cells):
    df = Data(spark, sf_dir).table("embeddings")
    index = vector_index.build(df, f"{shared_folder(spark)}/trustdesk-tests/exact-{cells}", cells=cells)
    asked = df.where("vec_id % 10 = 0")
    want = starters.cosine_topk(df, starters.query_vectors(asked, "vec_id", "embedding"))
    columns = ["query_id", "match_id", "similarity", "rank"]
    assert rows(vector_index.search(index, asked).select(columns)) == rows(want.select(columns))


def test_index_of_nothing(spark, request):
    df = clustered(spark).where("false")
    index = vector_index.build(df, f"{shared_folder(spark)}/trustdesk-tests/{request.node.name}")
    assert vector_index.search(index, clustered(spark).limit(5)).count() == 0


def test_parts_follow_the_stored_vectors():
    assert starters.parts_for(10) == starters.LEAST_PARTS
    assert starters.parts_for(10 ** 9) == 10 ** 9 // starters.PART_ROWS
