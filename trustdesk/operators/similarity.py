"""Names that are nearly the same in one place or near each other, without comparing all pairs.

Two names match when their edit distance is at most (1 - threshold) of the longer name. An edit touches at most Q of a name's
runs of Q letters, so that of two names E edits apart the rarest run that both have is among the Q * E + 1 rarest of either,
whatever the order of rarity, as long as both use the same. Pairs are therefore dealt by rare runs alone: a word that
stands in every name deals none where names have rarer parts, and names without such parts are near each other, where a
semi-join stops at the first.

Before that, names that differ in one stretch only are found by grouping: what is left of a name without a stretch as long as its
edits is a key, and two names with one key are near whatever they have in the stretch. Only names without such a partner look
for one among the pairs.
"""

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trustdesk.functions.text import matching_key

#: A run that more than one in RARE names holds is common; at most RARE times the runs of an average name are.
RARE = 1_000
EARTH_KM = 6371.0088
#: Places of a name, less one, at which a stretch is left out.
STRETCHES = 4


def _percent(threshold: float) -> int:
    percent = 100 - round(threshold * 100)
    if not 0 <= percent < 50:
        raise ValueError("threshold lies above 0.5 and up to 1")
    return percent


def run_length(percent: int) -> int:
    """Longest run of which a match is sure to leave one whole: at most half the letters per edit."""
    return 3 if percent <= 16 else 2 if percent <= 25 else 1


def _edits(longest: Column, percent: int) -> Column:
    """Edit budget of a pair whose longer name has ``longest`` letters; exact in integers."""
    return F.floor(longest * percent / 100).cast("int")


def rare_runs(names: DataFrame, percent: int) -> DataFrame:
    """The rarest different runs of each distinct name, as many as no near name can lack, with their ``rank``.

    Rarity is the number of names with the run if that is common, and a hash of the run otherwise: common runs are few, so
    that their counts are a small table. A name that repeats itself may have no more runs than its edits can touch; all
    such names also meet under one run of their own, the empty one.
    """
    q = run_length(percent)
    size = F.col("size")
    own = _edits(F.floor(size * 100 / (100 - percent)).cast("int"), percent)
    able = names.withColumn("most", own * q + 1).where((own > 0) & (size >= q))
    letters = F.array_distinct(F.transform(F.sequence(F.lit(1), size - q + 1), lambda i: F.substring("norm", i, q)))
    cut = able.select("norm", "size", "most", letters.alias("letters")).select(
        "norm", "size", "most", F.explode(F.when(F.size("letters") < F.col("most"), F.concat("letters", F.array(F.lit(""))))
                                          .otherwise(F.col("letters"))).alias("run"))
    least = F.greatest(F.lit(1), F.floor(able.select(F.count("*")).scalar() / RARE))
    common = cut.groupBy("run").agg(F.count("*").alias("held")).where(F.col("held") > least)
    order = W.partitionBy("norm").orderBy(F.col("run") == "", F.coalesce("held", F.lit(0)), F.xxhash64("run"), "run")
    ranked = cut.join(common, "run", "left").withColumn("rank", F.row_number().over(order))
    first = F.when(F.col("run") == "", 0).otherwise(F.col("rank"))
    return ranked.where(first <= F.col("most")).select("norm", "size", "run", first.alias("rank"))


def near_pair(percent: int) -> Column:
    """Whether the names of rows l and r that share a run differ by no more edits than the longer one allows.

    A run that is not among the rarest for just these edits deals no pair.
    """
    edits = _edits(F.greatest("l.size", "r.size"), percent)
    least = edits * run_length(percent) + 1
    return ((F.abs(F.col("l.size") - F.col("r.size")) <= edits) & (F.col("l.rank") <= least) & (F.col("r.rank") <= least)
            & (F.col("l.norm") != F.col("r.norm")) & (F.call_function("levenshtein", "l.norm", "r.norm", edits) >= 0))


def in_one_stretch(names: DataFrame, by, percent: int) -> DataFrame:
    """Those of the distinct ``names`` (norm and other columns) that differ in one stretch from another name with equal ``by``.

    A name of n letters and e edits keeps n - e letters, or one more, the first and the last ones around the stretch. Names that
    keep the same letters around the same place differ by at most what the longer one left out, which are its edits or
    less. Not all near names are found, but all found are near.
    """
    size = F.length("norm")
    edits = _edits(size, percent)

    def around(head, left_out):
        return F.struct(head.alias("head"), F.concat(F.substring("norm", 1, head), F.substring(
            F.col("norm"), head + left_out + 1, size - left_out - head)).alias("letters"))

    keys = [around(F.floor((size - out) * i / STRETCHES).cast("int"), out) for out in (edits, edits - 1) for i in range(STRETCHES + 1)]
    cut = names.where(edits > 0).select(*names.columns, F.explode(F.array_distinct(F.array(*keys))).alias("around"))
    shared = cut.groupBy(*by, "around").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where(
        F.col("low") != F.col("high")).select(*by, "around")
    return cut.join(shared, [*by, "around"], "left_semi").select(*names.columns).distinct()


def near_names(names: DataFrame, threshold=0.85) -> DataFrame:
    """Those of the distinct ``names`` (place, norm) that have a near but different name in their place."""
    percent = _percent(threshold)
    sure = in_one_stretch(names, ["place"], percent).select("place", "norm")
    rare = rare_runs(names.select("norm").distinct().withColumn("size", F.length("norm")), percent)
    dealt = names.join(rare, "norm").select("place", "norm", "size", "run", "rank")
    open_names = names.join(sure, ["place", "norm"], "left_anti").join(rare, "norm")
    found = open_names.alias("l").join(dealt.alias("r"), (F.col("l.place") == F.col("r.place")) & (F.col("l.run") == F.col("r.run"))
                                       & near_pair(percent), "left_semi")
    return sure.unionByName(found.select("place", "norm").distinct())


def fuzzy_identity(df: DataFrame, threshold=0.85, name="name", place="address_state_or_region", id_col="unique_id") -> DataFrame:
    """Records whose name is close to a different name in the same place, as quality-check rows."""
    keyed = (df.select(F.col(id_col).alias("unique_id"), matching_key(name).alias("norm"), F.col(place).alias("place"))
             .where((F.col("norm") != "") & F.col("place").isNotNull()))
    near = near_names(keyed.select("place", "norm").distinct(), threshold)
    return keyed.join(near, ["place", "norm"], "left_semi").select("unique_id", *_finding(
        "similar_identity", "Name is close to another record in the same area"))


def _finding(check, issue):
    return (F.lit(check).alias("check"), F.lit("medium").alias("severity"), F.lit(15).alias("penalty_points"), F.lit(issue).alias("issue_summary"))


# --- nearby ------------------------------------------------------------------------------------------

def distance_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance."""
    a, b, c, d = (F.radians(F.col(x)) for x in (lat1, lon1, lat2, lon2))
    half = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.sqrt(half), F.lit(1.0)))


def _band_height(km: float) -> float:
    return math.degrees(km / EARTH_KM)


def _cells_around(band: Column, km: float):
    """Cells of a latitude band, and their width in degrees: points of this and the next bands within ``km`` of each other
    differ in longitude by at most that width."""
    height, half = _band_height(km), math.sin(km / EARTH_KM / 2)
    edge = F.least(F.lit(90.0), F.greatest(F.abs(band - 1), F.abs(band + 2)) * height)
    reach = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.lit(half) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-9)))))
    count = F.greatest(F.lit(1), F.floor(360 / (reach * (1 + 1e-9)))).cast("int")
    return count, 360 / count


def cell(lat, lon, km: float, steps=(0,)) -> Column:
    """Cells of a point, or with ``steps`` of -1, 0 and 1 also those of all points within ``km``, as an array of structs."""
    wide = F.pmod(F.col(lon) + 180, F.lit(360.0))
    found = []
    for up in steps:
        band = F.floor(F.col(lat) / _band_height(km)) + up
        count, width = _cells_around(band, km)
        at = F.floor(wide / width).cast("int")
        found += [F.struct(band.cast("int").alias("band"), F.pmod(at + side, count).alias("column")) for side in steps]
    return F.array_distinct(F.array(*found))


def small_cell(lat, lon, km: float) -> Column:
    """A cell whose points all lie within ``km`` of each other: no way along its sides is longer, with room for rounding."""
    height = _band_height(km) * 0.49
    band = F.floor(F.col(lat) / height)
    # a band is widest at its edge towards the equator
    edge = F.least(F.lit(90.0), F.least(F.abs(band), F.abs(band + 1)) * height)
    width = F.lit(height) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-9))
    return F.struct(band.alias("band"), F.floor(F.col(lon) / width).alias("column"))


def near_names_nearby(spots: DataFrame, km: float, threshold=0.85) -> DataFrame:
    """Those of the distinct ``spots`` (norm, lat, lon) that have a near but different name within ``km``.

    The earth is cut into bands of ``km`` and each band into cells that are as wide as two points within ``km`` can differ; a
    spot lies in one cell and looks into the nine around it. Rows meet by cell and rare run.
    """
    percent = _percent(threshold)
    columns = ["norm", "lat", "lon"]
    sure = in_one_stretch(spots.select(*columns, small_cell("lat", "lon", km).alias("box")), ["box"], percent).select(*columns)
    rare = rare_runs(spots.select("norm").distinct().withColumn("size", F.length("norm")), percent)
    lies = spots.join(rare, "norm").withColumn("cell", F.explode(cell("lat", "lon", km)))
    looks = spots.join(sure, columns, "left_anti").join(rare, "norm").withColumn(
        "cell", F.explode(cell("lat", "lon", km, (-1, 0, 1))))
    close = distance_km("l.lat", "l.lon", "r.lat", "r.lon") <= km
    found = looks.alias("l").join(lies.alias("r"), (F.col("l.cell.band") == F.col("r.cell.band")) & (
        F.col("l.cell.column") == F.col("r.cell.column")) & (F.col("l.run") == F.col("r.run")) & close & near_pair(percent), "left_semi")
    return sure.unionByName(found.select(*columns).distinct())


def fuzzy_nearby(df: DataFrame, km=25.0, threshold=0.85, name="name", lat="latitude", lon="longitude", id_col="unique_id") -> DataFrame:
    """Records whose name is close to a different name within ``km``, as quality-check rows.

    Records without a name or a point on the earth have no row.
    """
    keyed = df.select(F.col(id_col).alias("unique_id"), matching_key(name).alias("norm"), F.col(lat).cast("double").alias("lat"),
                      F.col(lon).cast("double").alias("lon")).where(
        (F.col("norm") != "") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    near = near_names_nearby(keyed.select("norm", "lat", "lon").distinct(), km, threshold)
    return keyed.join(near, ["norm", "lat", "lon"], "left_semi").select("unique_id", *_finding(
        "similar_nearby", "Name is close to another record nearby"))
