import math
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trustdesk.functions.text import contains_pattern
from trustdesk.operators import enrich, score_store, search, text_index, vector_index
from trustdesk.plans.layers import shared_folder
from trustdesk.plans.queries import Data


@pytest.fixture
def folder(spark, request, tmp_path):
    return f"{shared_folder(spark)}/trustdesk-tests/{tmp_path.name}-{re.sub('[^a-z0-9]+', '-', request.node.name.lower())}"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# substring search ----------------------------------------------------------------------------------------------------


def test_index_gives_the_rows_of_the_scan(spark, folder):
    rng = random.Random(2)
    words = ["care", "Clinic", "CAFÉ", "a%b", "x_y", "naïve", "aaa", "aaaa", "ca", "", "ab", "日本語テキスト", "care care"]
    made = [(f"id{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 5))) if i % 7 else None, rng.choice(words))
            for i in range(400)] + [(None, "care", "care")]
    df = spark.createDataFrame(made, "unique_id string, name string, more string")
    index = text_index.build(df, folder, ["name", "more"])
    known = df.where("unique_id IS NOT NULL")
    for k, term in enumerate(("CARE", "are c", "ca%e", "aaa", "%", "a", "afé", "本語テ", "zzz", "%%care__", "care%clin")):
        for columns in ((["name"], ["name", "more"])[k % 2],):
            want = rows(text_index.matching_by_scan(known, term, columns).select("unique_id"))
            assert rows(text_index.matching(known, index, term, columns).select("unique_id")) == want, term
    assert text_index.pattern_triples("Ab%cdef_gh") == ["cde", "def"]


def test_a_search_reads_the_index_only(spark, sf_dir, folder):
    d = Data(spark, sf_dir)
    index = text_index.build(d.gold, folder, search.SEARCH_COLUMNS)
    plan = text_index.matching_ids(index, "riverside", search.SEARCH_COLUMNS)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"Location: \S+ \[?(\S+)", plan)
    assert scans and all("trustdesk-tests" in s for s in scans)
    assert re.search(r"PartitionFilters: \[[^\]]*slot", plan) and re.search(r"PushedFilters: \[[^\]]*In\(triple", plan)
    got = rows(text_index.matching(d.gold, index, "riverside", search.SEARCH_COLUMNS).select("unique_id"))
    assert got == rows(search.matching(d.gold, "riverside").select("unique_id")) and got


# scores in buckets ---------------------------------------------------------------------------------------------------


def test_a_run_reads_and_rewrites_touched_buckets_only(spark, folder):
    gold = spark.createDataFrame([(f"id{i}", i) for i in range(500)], "unique_id string, v int")
    score = lambda g: g.select(F.col("unique_id").alias("facility_id"), (F.col("v") * 2).alias("score"))
    first = score(gold)
    score_store.store(first, folder)
    assert rows(score_store.read(spark, folder, first.schema)) == rows(first)
    before = score_store.current(spark, folder)
    newer = gold.withColumn("v", F.col("v") + 1000)
    changed = spark.createDataFrame([("id3",), ("id77",), ("id77",), ("gone",)], "facility_id string")
    touched = score_store.rescore(folder, newer, changed, score, first.schema)
    assert 1 <= len(touched) <= 3
    after = score_store.current(spark, folder)
    assert {b for b in after if after[b] != before[b]} == set(touched)
    want = rows(first.where("facility_id NOT IN ('id3', 'id77')").unionByName(score(newer).where("facility_id IN ('id3', 'id77')")))
    assert rows(score_store.read(spark, folder, first.schema)) == want
    files = score_store.read(spark, folder, first.schema, touched).inputFiles()
    assert files and {int(f.split("_bucket=")[1].split("/")[0]) for f in files} <= set(touched)
    assert score_store.rescore(folder, newer, changed.where("false"), score, first.schema) == []


def test_a_run_that_fails_changes_nothing(spark, folder):
    first = spark.createDataFrame([(f"id{i}", i) for i in range(50)], "facility_id string, score int")
    score_store.store(first, folder)

    def broken(gold):
        return gold.select(F.col("unique_id").alias("facility_id"), F.raise_error(F.lit("lost")).cast("int").alias("score"))

    gold = first.withColumnRenamed("facility_id", "unique_id")
    with pytest.raises(Exception, match="lost"):
        score_store.rescore(folder, gold, first.select("facility_id").limit(3), broken, first.schema)
    assert rows(score_store.read(spark, folder, first.schema)) == rows(first)


def test_a_bucket_that_loses_all_rows(spark, folder):
    first = spark.createDataFrame([("a", 1), ("b", 2)], "facility_id string, score int")
    score_store.store(first, folder)
    gold = first.withColumnRenamed("facility_id", "unique_id").where("unique_id = 'b'")
    score = lambda g: g.select(F.col("unique_id").alias("facility_id"), "score")
    score_store.rescore(folder, gold, first.select("facility_id").where("facility_id = 'a'"), score, first.schema)
    assert rows(score_store.read(spark, folder, first.schema)) == [("b", 2)]


# polygons ------------------------------------------------------------------------------------------------------------


def even_odd(rings, x, y):
    inside = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
    return inside


def star(n, cx, cy, size, seed):
    rng = random.Random(seed)
    return [(cx + size * (0.6 + 0.4 * rng.random()) * math.cos(2 * math.pi * i / n), cy + size * (0.6 + 0.4 * rng.random()) * math.sin(
        2 * math.pi * i / n)) for i in range(n)]


def test_rings_and_holes_equal_the_even_odd_rule(spark):
    rng = random.Random(6)
    shapes = {"star": [star(3000, 75, 20, 8, 1), star(400, 75, 20, 3, 2)], "parts": [star(5, 60, 10, 2, 3), star(40, 66, 10, 3, 4)],
              "square": [[(80.0, 0.0), (84.0, 0.0), (84.0, 4.0), (80.0, 4.0)], [(81.0, 1.0), (81.0, 2.0), (82.0, 2.0), (82.0, 1.0)]],
              "line": [[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]]}
    points = [(rng.uniform(58, 86), rng.uniform(-1, 30)) for _ in range(3000)]
    points += [(float(x), float(y)) for x in range(79, 86) for y in range(-1, 6)] + [(81.5, 1.5), (0.5, 0.0)]
    points += [rng.choice(shapes["star"][0]) for _ in range(50)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, longitude double, latitude double")
    table = spark.createDataFrame([(n, [[{"x": x, "y": y} for x, y in r] for r in rings]) for n, rings in shapes.items()],
                                  "district string, rings array<array<struct<x: double, y: double>>>")
    for hot in (None, 50):
        got = sorted((r.id, r.district) for r in enrich.point_in_polygon(df, table, rings="rings", hot_rows=hot).collect())
        assert got == sorted((i, n) for i, (x, y) in enumerate(points) for n, rings in shapes.items() if even_odd(rings, x, y))


def coast(n, cx, cy, size, seed):
    """A ragged outline whose corners lie close together, as a border is drawn."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = 2 * math.pi * i / n
        r = size * (0.7 + 0.2 * math.sin(3 * t) + 0.05 * math.cos(17 * t) + 4 / n * rng.random())
        out.append((cx + r * math.cos(t), cy + r * math.sin(t)))
    return out


def test_a_country_of_very_many_corners(spark):
    """Inner cells need no edge, border cells carry the edges of their band, no row the whole ring."""
    ring = coast(100_000, 78, 20, 12, 9)
    table = spark.createDataFrame([("c", [{"x": x, "y": y} for x, y in ring])], "district string, ring array<struct<x: double, y: double>>")
    edges = enrich.polygon_edges(table.withColumn("r", F.array("ring")), "r")
    _, cells = enrich.polygon_cells(edges)
    found = cells.agg(F.count_if("inner"), F.count_if(~F.col("inner")), F.max(F.size("edges"))).first()
    assert found[0] > 20_000 and 2000 < found[1] < found[0] and found[2] < 5_000
    rng = random.Random(1)
    points = [(rng.uniform(65, 91), rng.uniform(7, 33)) for _ in range(60)] + [ring[17], ring[60_000]]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, longitude double, latitude double")
    got = sorted(r.id for r in enrich.point_in_polygon(df, table).collect())
    assert got == [i for i, (x, y) in enumerate(points) if even_odd([ring], x, y)]


# the work of building ------------------------------------------------------------------------------------------------


def test_triples_of_a_long_text_take_one_pass(spark):
    """A text of very many letters: counting each triple's place from the start took minutes."""
    text = "".join(random.Random(5).choice("abcdé日") for _ in range(400_000))
    long = spark.createDataFrame([(text,), ("ab",), ("",), ("a\nb😀c",)], "t string")
    got = [r[0] for r in long.select(text_index.triples_of(F.col("t"))).collect()]
    assert set(got[0]) == {text[i:i + 3] for i in range(len(text) - 2)} and len(got[0]) == len(set(got[0]))
    assert got[1:3] == [[], []] and {"a\nb", "\nb😀", "b😀c"} <= set(got[3])


def test_postings_are_narrow(spark, folder):
    """A posting leads back by a hash; ids and field names are not repeated for every triple."""
    df = spark.createDataFrame([("id1", "care home"), ("id2", "day care")], "unique_id string, name string")
    index = text_index.build(df, folder, ["name"])
    assert "id" not in index.postings().columns and dict(index.postings().dtypes)["at"] == "int"
    assert rows(text_index.matching_ids(index, "e ho", ["name"])) == [("id1",)]


def some_texts(rng, n):
    words = ["care", "Clinic", "CAFÉ", "日本語テキスト", "a\nb", "x\0yz", "😀c😀d", "", "ab", "naïve", "l", "side c"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))) for _ in range(n)]


def stored_fields(texts, parts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(parts, pa.int32()), pa.array(range(len(texts)), pa.int32())],
                                      ["text", "part", "at"])


@pytest.mark.parametrize("step", [1, 2, 7, 1 << 16])
def test_blocks_hold_the_triples_of_their_texts(monkeypatch, step):
    """Whatever the block and however few letters are sorted at once, each pair of triple and field comes once."""
    monkeypatch.setattr(text_index, "STEP", step)
    monkeypatch.setattr(text_index, "BLOCK", 64)
    texts = some_texts(random.Random(step), 300) + ["", "ab", "x" * 500]
    parts = [i // 70 for i in range(len(texts))]
    batches = [stored_fields(texts, parts).slice(a, 60) for a in range(0, len(texts), 60)]
    got = []
    for batch in text_index._packed(iter(batches)):
        at, counts = text_index.list_fields(batch["ats"], batch["base"].to_numpy())
        rows = np.repeat(np.arange(batch.num_rows), counts)
        assert {parts[a] for a in at} <= set(batch["part"].to_pylist())
        got += [(batch["triple"][r].as_py(), a) for r, a in zip(rows, at)]
    assert len(got) == len(set(got)) and set(got) == {(t[i:i + 3], a) for a, t in enumerate(texts) for i in range(len(t) - 2)}


def test_blocks_of_all_letters():
    """Triples and fields that do not fit one number."""
    rng = random.Random(8)
    letters = np.array(rng.sample([c for c in range(text_index.LETTERS) if not 0xD800 <= c < 0xE000], 100_000) * 2, dtype="<u4")
    counts = np.array([100_000, 0, 2, 99_998])
    known, triples, begins, field = text_index.block_postings(letters, counts, np.array([0, 9, 900, 70_000]))
    assert len(known) ** 3 << 17 > 1 << 64 and len(triples) == len(begins)
    size = len(known)
    spelled = np.stack([known[(triples // d % np.uint64(size)).astype(int)] for d in (size * size, size, 1)], axis=1)
    got = set(map(tuple, np.concatenate([spelled.repeat(np.diff(begins, append=len(field)), axis=0), field[:, None]], axis=1).tolist()))
    want = {(*letters[i:i + 3].tolist(), at) for a, b, at in ((0, 100_000, 0), (100_002, 200_000, 70_000)) for i in range(a, b - 2)}
    assert got == want and len(field) == len(want)


def test_packed_numbers_come_back():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**31 - 1, 5], "int64")
    data, ends = text_index.pack(numbers)
    back, at = text_index.unpack(data)
    assert (back == numbers).all() and (at == ends).all() and len(data) == 1 + 1 + 1 + 2 + 2 + 3 + 3 + 4 + 5 + 5 + 1
    assert len(text_index.pack(numbers[:0])[0]) == len(text_index.unpack(data[:0])[0]) == 0


def test_postings_are_stored_as_lists(spark, folder):
    """A triple of many fields is one short row, not a row for each of them."""
    df = spark.range(4000).selectExpr("CAST(id AS STRING) AS unique_id", "'Riverside care ' || id % 10 AS name").coalesce(1)
    index = text_index.build(df, folder, ["name"])
    stored = index.lists().agg(F.count(F.lit(1)), F.sum(F.length("ats"))).first()
    assert index.postings().count() == 4000 * 14 and stored[0] == 13 + 10 and stored[1] < 4000 * 14 * 1.1
    assert text_index.matching_ids(index, "side%_re 7", ["name"]).count() == 400


def test_odd_records_in_the_index(spark, folder):
    """Repeated ids, texts of one letter or none, bytes that are no text, no records at all."""
    texts = some_texts(random.Random(3), 80)
    df = spark.createDataFrame([(f"id{i % 50}", t, None) for i, t in enumerate(texts)] + [(None, "care", "care")],
                               "unique_id string, name string, none string")
    df = df.unionByName(spark.sql("SELECT 'bad' AS unique_id, CAST(X'63617265FF80E0A063617265' AS STRING) AS name, CAST(NULL AS STRING) AS none"))
    for source, where in ((df, "all"), (df.where("false"), "nothing"), (df.where("length(name) < 3"), "short")):
        index = text_index.build(source, f"{folder}/{where}", ["name", "none"])
        for term in ("care", "日本語", "x\0y", "😀c", "a\nb", "l%side_c", "ab", "", "care%care", "é"):
            scan = text_index.matching_by_scan(source.where("unique_id IS NOT NULL"), term, ["name", "none"])
            assert rows(text_index.matching_ids(index, term, ["name", "none"])) == rows(scan.select("unique_id").distinct()), (where, term)


def test_only_candidates_are_compared(spark, folder):
    """The pattern is not moved to the scan of all stored texts."""
    df = spark.createDataFrame([("id1", "Lakeside Care"), ("id2", "day care")], "unique_id string, name string")
    found = text_index.matching_ids(text_index.build(df, folder, ["name"]), "l%side_c", ["name"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    compared, joined, scanned = (next(i for i, line in enumerate(plan.splitlines()) if re.search(s, line)) for s in (
        "LIKE|side.*c", "Join", "Relation .*text"))
    assert compared <= joined < scanned and "side" not in "".join(plan.splitlines()[joined + 1:])
    assert rows(found) == [("id1",)]


def test_a_long_text_is_compared_in_one_pass(spark, folder):
    """Seeking the second part anew behind every place of the first took a time that grew with the square of the text."""
    long = "l " * 500_000 + "side d, desideratum"
    df = spark.createDataFrame([(f"id{i}", long + end) for i, end in enumerate(["", " lakeside c", "side"])], "unique_id string, name string")
    index = text_index.build(df, folder, ["name"])
    start = time.monotonic()
    assert rows(text_index.matching_ids(index, "l%side_c", ["name"])) == [("id1",)]
    assert rows(text_index.matching_ids(index, "l%l%d,%_c", ["name"])) == [("id1",)]
    assert time.monotonic() - start < 60


def test_patterns_mean_what_like_means(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab.\nÉ%_\\😀") for _ in range(rng.randrange(0, 9))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    terms = ["", "%", "_", "a%b", "a_b", "%%a_%_b%", ".", "a.", "\n", "É%a", "😀", "_😀_", "(?", "[a", "a$", "E\\\\Q", "\\%", "\\_a"]
    terms += ["".join(rng.choice("ab%_.") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    for term in terms:
        got = df.select(text_index.contains(F.col("t"), term), F.col("t").like(contains_pattern(term))).collect()
        assert all(a == b for a, b in got), term


def test_memory_of_a_batch_does_not_follow_the_cells():
    rng = np.random.default_rng(5)
    units, centroids = (vector_index.unit_rows(rng.normal(size=(n, 16))) for n in (6000, 1024))
    tracemalloc.start()
    cell, angle = vector_index.nearest_cells(units, centroids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6  # 6000 x 1024 angles are 49 MB
    away = vector_index.angles(units, centroids)
    assert (cell == away.argmin(axis=1)).all() and np.allclose(angle, away.min(axis=1))


def test_more_queries_than_a_step_find_what_brute_force_finds(spark, folder):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1300, 4))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    index = vector_index.build(df, folder)
    got = {(r.query_id, r["rank"]): r.similarity for r in vector_index.search(index, df, k=3).collect()}
    units = vector_index.unit_rows(x)
    want = -np.sort(-np.round(units @ units.T, vector_index.DIGITS), axis=1)[:, :3]
    assert len(got) == want.size and all(abs(got[i, k + 1] - want[i, k]) < 1e-8 for i in range(len(x)) for k in range(3))
