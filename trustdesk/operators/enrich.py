"""Geography: postal codes, district indicators, point in polygon, district ranking."""

from pyspark.sql import DataFrame, functions as F

from trustdesk.functions.text import matching_key
from trustdesk.operators.ranking import with_rank
from trustdesk.operators.skew import hot_split_join, salted_join


def one_row_per_pin(offices: DataFrame) -> DataFrame:
    """Many offices share a code; a code over several districts or states is marked, not guessed."""
    def number(c):
        return F.avg(F.trim(c).try_cast("double"))

    grouped = offices.groupBy(F.trim("pincode").alias("pincode")).agg(
        F.count(F.lit(1)).alias("office_count"), F.count_distinct("district", "statename").alias("_places"),
        F.min("district").alias("_district"), F.min("statename").alias("_state"),
        F.round(number("latitude"), 6).alias("pin_latitude"), F.round(number("longitude"), 6).alias("pin_longitude"))
    clear = F.col("_places") == 1
    return grouped.select("pincode", "office_count", (F.col("_places") > 1).alias("is_ambiguous"),
                          F.when(clear, F.col("_district")).alias("pin_district"),
                          F.when(clear, F.col("_state")).alias("pin_state"), "pin_latitude", "pin_longitude")


def enrich_postal(records: DataFrame, offices: DataFrame, pin="address_zip_or_postcode") -> DataFrame:
    """Records with district and state of their postal code; row count unchanged.

    One row a code on the right: adaptive execution sends a small list to all tasks and splits a code of very many
    records, or the records without one, when it is not small.
    """
    return records.join(one_row_per_pin(offices).withColumnRenamed("pincode", pin), pin, "left")


def clean_indicators(indicators: DataFrame, cols, district="district_name") -> DataFrame:
    """Text figures to numbers: ``*`` is NULL, ``(29.5)`` is a number marked as low-sample."""
    out = indicators.withColumn("district_key", matching_key(district))
    for c in cols:
        raw = F.trim(c)
        out = (out.withColumn(f"{c}_low_sample", F.coalesce(raw.rlike(r"^\(.*\)$"), F.lit(False)))
               .withColumn(c, F.regexp_replace(raw, r"[()]", "").try_cast("double")))
    return out


def enrich_indicators(records: DataFrame, indicators: DataFrame, cols, district="address_city",
                      name="district_name") -> DataFrame:
    """Records with the figures of their district, matched on normalised names."""
    figures = clean_indicators(indicators, cols, name).drop(name)
    return records.withColumn("district_key", matching_key(district)).join(figures, "district_key", "left")


def unmatched_districts(records: DataFrame, indicators: DataFrame, district="address_city",
                        name="district_name") -> DataFrame:
    """District names without figures and how many records carry them."""
    counts = (records.where(F.col(district).isNotNull()).groupBy(matching_key(district).alias("district_key"))
              .agg(F.count(F.lit(1)).alias("records")))
    return counts.join(indicators.select(matching_key(name).alias("district_key")), "district_key", "left_anti")


def district_rank(records: DataFrame, indicators: DataFrame, burden="burden", district="address_city",
                  name="district_name") -> DataFrame:
    """Districts by burden (high first), then by record count (few first): the underserved come first.

    Records are counted per district before the join, so the ranked table has one row per district. Ranks come from counts of
    ranges, so that no task sees all districts.
    """
    counts = records.groupBy(matching_key(district).alias("district_key")).agg(F.count(F.lit(1)).alias("facilities"))
    figures = clean_indicators(indicators, [burden], name).select("district_key", burden, f"{burden}_low_sample")
    ranked = figures.join(counts, "district_key", "left").withColumn(
        "facilities", F.coalesce("facilities", F.lit(0)))
    return with_rank(ranked, (burden, True), ("facilities", False))


#: Edges that a band of a polygon should meet, and bands and columns of one polygon at most.
BAND_EDGES, MOST_BANDS, MOST_COLUMNS = 64, 2048, 64


def grid_cells(low, high, size):
    """Cell numbers a closed interval touches."""
    return F.sequence(F.floor(low / size), F.floor(high / size))


def crossings(edges, x, y):
    """How many edges a ray to the right of a point crosses."""
    def crosses(e):
        at = (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]
        return ((e["ay"] > y) != (e["by"] > y)) & (x < at)

    return F.size(F.filter(edges, crosses))


def polygon_edges(polygons: DataFrame, rings: str) -> DataFrame:
    """One row per edge of each ring; a polygon is named by a hash of its district and corners."""
    ring = F.col("_ring")
    shapes = polygons.select(F.xxhash64("district", rings).alias("polygon"), "district", F.col(rings).alias("rings")).dropDuplicates(["polygon"])
    corners = shapes.select("polygon", "district", F.explode("rings").alias("_ring"))
    after = F.transform(ring, lambda p, i: F.struct(p["x"].cast("double").alias("ax"), p["y"].cast("double").alias("ay"),
                                                    F.get(ring, (i + 1) % F.size(ring))["x"].cast("double").alias("bx"),
                                                    F.get(ring, (i + 1) % F.size(ring))["y"].cast("double").alias("by")))
    return corners.select("polygon", "district", F.inline(after))


def polygon_cells(edges: DataFrame):
    """Frames of the polygons, and their cells: inner ones, where no edge passes, and border ones with the edges to test.

    A polygon is cut into bands, more of them the more corners it has, and each band into columns. An edge meets the
    bands between its ends and in each the columns that it passes, with one more on either side for the rounding of
    numbers. All other cells of a band lie inside or outside as a whole, which a ray from their middle tells.
    """
    frames = edges.groupBy("polygon", "district").agg(
        F.count(F.lit(1)).alias("n"), F.min("ax").alias("x0"), F.max("ax").alias("x1"), F.min("ay").alias("y0"), F.max("ay").alias("y1"))
    bands = F.least(F.lit(MOST_BANDS), F.greatest(F.lit(1), F.floor(F.col("n") / (BAND_EDGES / 4)))).cast("int")
    frames = frames.withColumn("bands", bands).withColumn("columns", F.least("bands", F.lit(MOST_COLUMNS))).withColumns({
        "height": F.greatest((F.col("y1") - F.col("y0")) / F.col("bands"), F.lit(1e-12)),
        "width": F.greatest((F.col("x1") - F.col("x0")) / F.col("columns"), F.lit(1e-12))}).drop("n")

    def band_of(y):
        return F.floor((y - F.col("y0")) / F.col("height")).cast("int")

    def column_of(x):
        return F.floor((x - F.col("x0")) / F.col("width")).cast("int")

    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    met = edges.join(frames.drop("district"), "polygon").withColumn("band", F.explode(F.sequence(band_of(low), band_of(high))))
    # where the edge enters and leaves the band
    bottom = F.greatest(low, F.col("y0") + F.col("band") * F.col("height"))
    top = F.least(high, F.col("y0") + (F.col("band") + 1) * F.col("height"))

    def at(y):
        return F.when(F.col("ay") == F.col("by"), F.col("ax")).otherwise(
            (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax"))

    flat = F.col("ay") == F.col("by")
    left = F.when(flat, F.least("ax", "bx")).otherwise(F.least(at(bottom), at(top)))
    right = F.when(flat, F.greatest("ax", "bx")).otherwise(F.greatest(at(bottom), at(top)))
    edge = F.struct("ax", "ay", "bx", "by")
    rows = met.groupBy("polygon", "band").agg(
        F.collect_list(edge).alias("edges"), F.array_distinct(F.flatten(F.collect_list(F.sequence(
            column_of(left) - 1, column_of(right) + 1)))).alias("border"))
    placed = rows.join(frames, "polygon").withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns"))))
    is_border = F.array_contains("border", F.col("column"))
    middle_x = F.col("x0") + (F.col("column") + 0.5) * F.col("width")
    middle_y = F.col("y0") + (F.col("band") + 0.5) * F.col("height")
    inner = ~is_border & (crossings(F.col("edges"), middle_x, middle_y) % 2 == 1)
    kept = placed.withColumn("inner", inner).where(is_border | F.col("inner"))
    own = F.when(~F.col("inner"), F.filter("edges", lambda e: F.greatest(e["ax"], e["bx"]) >= F.col("x0") + (F.col("column") - 1) * F.col("width")))
    return frames, kept.select("polygon", "band", "column", "inner", own.alias("edges"))


def point_in_polygon(points: DataFrame, polygons: DataFrame, x="longitude", y="latitude", cell=1.0, rings=None,
                     hot_rows=None) -> DataFrame:
    """Points with the polygon (``district``) they lie in; points outside all polygons are left out.

    A polygon is one ``ring`` or, under the column named by ``rings``, several: parts and holes, inside by the even-odd rule.
    Points at the same coordinates are located once. They meet polygons whose box touches their coarse cell, rows of a
    few numbers, and then one cell of the polygon's own grid: inner cells need no test, border cells test the edges of their
    band. No row carries a whole ring.
    """
    shapes = polygons.withColumn("_rings", F.col(rings) if rings else F.array(F.col("ring")))
    edges = polygon_edges(shapes, "_rings")
    frames, cells = polygon_cells(edges)
    boxes = (frames.withColumn("cx", F.explode(grid_cells(F.col("x0"), F.col("x1"), cell)))
             .withColumn("cy", F.explode(grid_cells(F.col("y0"), F.col("y1"), cell))))
    spots = (points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
             .groupBy(x, y).agg(F.count(F.lit(1)).alias("n")))
    located = spots.select(x, y, F.floor(F.col(x) / cell).alias("cx"), F.floor(F.col(y) / cell).alias("cy"))
    near = (salted_join(located, boxes, ["cx", "cy"], spread_on=[x, y], hot_rows=hot_rows)
            .where(F.col(x).between(F.col("x0"), F.col("x1")) & F.col(y).between(F.col("y0"), F.col("y1")))
            .select(x, y, "polygon", "district", F.floor((F.col(y) - F.col("y0")) / F.col("height")).cast("int").alias("band"),
                    F.floor((F.col(x) - F.col("x0")) / F.col("width")).cast("int").alias("column")))
    found = (salted_join(near, cells, ["polygon", "band", "column"], spread_on=[x, y], hot_rows=hot_rows)
             .where(F.col("inner") | (crossings(F.col("edges"), F.col(x), F.col(y)) % 2 == 1)).select(x, y, "district"))
    return hot_split_join(points, found, [x, y], counts=spots, hot_rows=hot_rows)
