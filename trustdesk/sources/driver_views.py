"""Record, log and geography views derived from the driver's TPC-H-like tables.

The test tables hold no contact records, so each view is fixed arithmetic over a driver table and
grows with it: one record per customer, one override per order, one action per event, and so on.
Expressions are written in the subset of SQL that Spark and DuckDB read the same way, which lets
the oracle start from the same rows.
"""

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(expr):
    return f"CAST({expr} AS STRING)"


def pick(key, *branches, default="NULL"):
    """CASE over ``key % m = r`` branches given as (m, r, expression)."""
    whens = " ".join(f"WHEN {key} % {m} = {r} THEN {e}" for m, r, e in branches)
    return f"CASE {whens} ELSE {default} END"


def cycle(key, *values):
    n = len(values)
    return pick(key, *[(n, i, v) for i, v in enumerate(values[:-1])], default=values[-1])


def uuid_of(key):
    """Every 50th record repeats the id before it, so some ids occur twice."""
    h = f"md5({text(f'CASE WHEN {key} % 50 = 3 THEN {key} - 1 ELSE {key} END')})"
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return "(" + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in cuts) + ")"


# uneven group sizes: small groups are rare, large ones common
SKEWED = "CAST(floor(sqrt(CAST((k * 97) % 90000 AS DOUBLE))) AS BIGINT)"
SKEWED_EMAIL = "CAST(floor(sqrt(CAST((k * 31) % 40000 AS DOUBLE))) AS BIGINT)"

NAME_FIRST = ["Lotus", "Sunrise", "Riverside", "Greenfield", "Hillview", "Lakeside", "Harbour"]
NAME_SECOND = ["Care", "Medical", "Family", "Community", "District", "Central", "United", "Public",
               "Mission", "Unity", "Relief"]
NAME_LAST = ["Hospital", "Clinic", "Health Centre", "Nursing Home", "Pharmacy"]


def quoted(words):
    return [f"'{w}'" for w in words]


# some records repeat the name, street and city of the record before them under another id
PLACE_KEY = "(CASE WHEN k % 50 = 7 THEN k - 1 ELSE k END)"
BASE_NAME = (
    f"({cycle(PLACE_KEY, *quoted(NAME_FIRST))}) || ' ' || ({cycle(f'({PLACE_KEY} * 3)', *quoted(NAME_SECOND))})"
    f" || ' ' || ({cycle(f'({PLACE_KEY} * 7)', *quoted(NAME_LAST))}) || ' ' || {text(f'{PLACE_KEY} % 977')}"
)
LANDLINE = f"'0' || {text('2200000 + k % 997')}"
MOBILE = f"'+91 ' || {text('9800000 + ' + SKEWED)}"

# record columns over: k (record key), nation_key, state_name, region_name, segment, doc_text
SOURCE_EXPRESSIONS = {
    "record_key": "k",
    "unique_id": pick("k", (101, 13, "NULL"), (89, 7, f"'bad-' || {text('k')}"),
                      (97, 11, f"'  ' || {uuid_of('k')} || ' '"), default=uuid_of("k")),
    "name": pick("k", (40, 5, "NULL"), (40, 6, "'null'"), (40, 7, "' n/a '"),
                 (40, 8, f"chr(7) || ' ' || {BASE_NAME} || '�'"),
                 (17, 4, f"{BASE_NAME} || 's'"), default=BASE_NAME),
    "organization_type": cycle("k", "' facility '", "'NGO'", "'unknown'", "'facility'"),
    "content_table_id": f"' ct-' || {text('k % 1000')} || ' '",
    "officialPhone": pick("k", (19, 0, "NULL"), (19, 1, "'null'"), (19, 2, "'N/A'"), (19, 3, "'12345'"),
                          (19, 4, "'9999999999'"), (19, 5, "'call us'"), default=MOBILE),
    "email": pick("k", (23, 0, "NULL"), (23, 1, "'not-an-email'"), (23, 2, "'two@x.org, three@x.org'"),
                  (23, 3, "'test@example.com'"), (23, 5, "'a b@c.org'"), (23, 6, "' null '"),
                  default=f"'  Desk' || {text(SKEWED_EMAIL)} || '@' || segment || '.ORG '"),
    "officialWebsite": cycle("k", "NULL", "' none '", "'null'", f"'HTTPS://WWW.Site' || {text('k')} || '.ORG '"),
    "yearEstablished": pick("k", (13, 0, "'abc'"), (13, 1, "NULL"), (13, 2, "'1998.0'"), (13, 3, "''"),
                            default=text("1790 + (k * 7) % 260")),
    "acceptsVolunteers": cycle("k", "'true'", "'YES'", "'1'", "'on'", "''", "' False '"),
    "facebookLink": pick("k", (5, 0, "'NA'"), default=f"' fb.com/' || {text('k')}"),
    "address_line1": pick("k", (37, 0, "chr(7) || chr(7)"), (37, 1, "'India'"), (37, 2, "'NA'"), (37, 3, "NULL"),
                          default=f"{text(f'{PLACE_KEY} % 211')} || ' Market Road' || chr(7)"),
    "address_line2": pick("k", (4, 0, "NULL"), default=f"'Block ' || {text('k % 12')}"),
    "address_line3": pick("k", (2, 0, "'Unknown'"), default=f"'Near gate ' || {text('k % 5')}"),
    "address_city": pick("k", (31, 0, "NULL"), (31, 1, "' '"), (31, 2, "'n/a'"), (31, 3, "' none '"),
                         default=f"'City ' || {text(f'{PLACE_KEY} % 60')}"),
    "address_stateOrRegion": pick("k", (41, 0, "NULL"), (41, 1, "'NA'"), default="state_name"),
    "address_zipOrPostcode": pick("k", (43, 0, "'unknown'"), default=text("560000 + k % 120")),
    "address_country": "CASE WHEN k % 47 = 0 THEN NULL WHEN region_name = 'EUROPE' THEN 'Nepal' "
                       "WHEN region_name = 'ASIA' THEN ' in ' ELSE 'India' END",
    "address_countryCode": "CASE WHEN k % 47 = 1 THEN NULL WHEN k % 53 = 2 THEN 'null' "
                           "WHEN region_name = 'EUROPE' THEN 'np' WHEN region_name = 'ASIA' THEN ' in ' ELSE 'IN' END",
    "countries": pick("k", (3, 0, "'none'"), default="' India '"),
    "facilityTypeId": "CASE WHEN k % 59 = 0 THEN NULL WHEN k % 59 = 1 THEN 'Clinic ' WHEN k % 59 = 2 THEN 'lab' "
                      "WHEN k % 59 = 3 THEN 'null' WHEN k % 59 = 4 THEN 'Hospital' "
                      "WHEN segment = 'MACHINERY' THEN 'hospital' WHEN segment = 'BUILDING' THEN 'clinic' "
                      "WHEN segment = 'AUTOMOBILE' THEN 'dentist' WHEN segment = 'HOUSEHOLD' THEN 'pharmacy' "
                      "ELSE 'nursing_home' END",
    "operatorTypeId": cycle("k", "'Private'", "' PUBLIC '"),
    "affiliationTypeIds": cycle("k", """'["a","a",null," "]'""", "'[]'", "'null'", "''", """'["broken"'""", "NULL",
                                f"""'["net-' || {text('k % 5')} || '"," x "]'"""),
    "description": pick("k", (33, 4, "' unknown '"), (33, 5, "chr(7) || 'null' || chr(7)"), (33, 6, "NULL"),
                        (33, 7, "'Short text' || '�'"), (33, 8, "'Trusted care for the whole family, open all day.'"),
                        (33, 9, "'!!! ### !!! ??? !!!'"), default="doc_text"),
    "capability": pick("k", (10, 0, "NULL"), (10, 1, """'["X-ray","Dialysis"]'"""), (10, 2, "'[]'"),
                       (10, 3, """'["ICU"]'"""), (10, 4, "'null'"),
                       default=f"'General ' || lower(segment) || ' care with ' || {text('k % 90')} || ' inpatient beds and an outpatient desk'"),
    "procedure": pick("k", (12, 0, "NULL"), default="'Minor surgery and ' || (" +
                      cycle("k", "'dialysis'", "'x-ray imaging'", "'dental filling'", "'vaccination'") + ")"),
    "equipment": pick("k", (4, 0, "NULL"), default=f"'Ultrasound unit ' || {text('k % 25')} || ' and pharmacy counter'"),
    "area": pick("k", (3, 0, "NULL"), default=text("100 + k % 900")),
    "numberDoctors": pick("k", (5, 0, "NULL"), (5, 1, "'many'"), default=f"' ' || {text('k % 40')}"),
    "capacity": pick("k", (20, 0, "'0'"), (44, 4, "'many'"), (4, 0, text("k % 300")), default="NULL"),
    "recency_of_page_update": cycle("k", "'2024-01-05'", "'2030-01-01'", "'2024'", "'2024-1-5'",
                                    "'2023-12-31T10:00:00'", "'junk'", "NULL"),
    "distinct_social_media_presence_count": pick("k", (3, 1, "'two'"), default=text("k % 4")),
    "affiliated_staff_presence": cycle("k", "'true'", "'no'", "NULL"),
    "custom_logo_presence": cycle("k", "'1'", "'0'", "'maybe'"),
    "number_of_facts_about_the_organization": text("k % 30"),
    "post_metrics_most_recent_social_media_post_date": cycle("k", "' 2022-05-06 '", "NULL", "'2031-02-03'"),
    "post_metrics_post_count": f"' ' || {text('k % 500')} || ' '",
    "engagement_metrics_n_followers": text("k * 3000000"),
    "engagement_metrics_n_likes": pick("k", (6, 0, "'n/a'"), default=text("k * 11")),
    "engagement_metrics_n_engagements": pick("k", (7, 0, "NULL"), default=text("k * 5")),
    "source": cycle("k", "' web '", "'NA'", "'registry'"),
    "latitude": pick("k", (27, 0, "NULL"), (27, 1, "'north'"), default=f"{text('k % 45')} || '.5'"),
    "longitude": pick("k", (27, 2, "NULL"), default=f"{text('60 + (k * 7) % 45')} || '.25'"),
    "phone_numbers": pick("k", (19, 5, "NULL"), (19, 6, "'null'"), (19, 7, "'[]'"), (19, 8, """'["98"'"""),
                          (19, 9, f"""'["' || {MOBILE} || '","' || {MOBILE} || '"]'"""),
                          (19, 10, """'["123456"]'"""),
                          (3, 0, f"""'["' || {MOBILE} || '","' || {LANDLINE} || '"]'"""),
                          default=f"""'["' || {MOBILE} || '"]'"""),
    "websites": cycle("k", "'[]'", "'null'", "NULL", f"""'["site' || {text('k')} || '.org"]'"""),
    "specialties": """'["' || lower(segment) || '"]'""",
    "balance": "balance",
}


def _entities(spark, sf_dir, doc_text="text"):
    customer = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS k", "c_nationkey AS nation_key", "c_mktsegment AS segment", "c_acctbal AS balance")
    nation = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS nation_key", "n_name AS state_name", "n_regionkey AS region_key")
    region = table(spark, sf_dir, "region").selectExpr("r_regionkey AS region_key", "r_name AS region_name")
    documents = table(spark, sf_dir, "documents").selectExpr("doc_id AS k", f"{doc_text} AS doc_text")
    people = customer.join(nation, "nation_key").join(region, "region_key")
    # the short rows are looked up by hash, so that texts pass by unsorted
    return people.hint("shuffle_hash").join(documents, "k", "left")


def _project(df, expressions):
    return df.selectExpr(*(f"{e} AS {name}" for name, e in expressions.items()))


def source(spark, sf_dir, doc_text="text") -> DataFrame:
    return _project(_entities(spark, sf_dir, doc_text), SOURCE_EXPRESSIONS)


# --- one row per (record, dimension): signal columns over source columns plus d and dim ------------
N = "((k * 7 + d * 13) % 101)"
SCORED = "(d < 3 AND (k + d) % 9 <> 0)"
CONTRADICTS = "((k + d) % 17 = 0)"
QUOTED = 12  # characters that a signal takes of a description
FIELD_TEXT = "CASE d WHEN 0 THEN capability WHEN 1 THEN equipment WHEN 2 THEN procedure END"
SIGNAL_EXPRESSIONS = {
    "facility_id": "trim(unique_id)",
    "dimension": "dim",
    "trust_score": f"CASE WHEN {SCORED} THEN CAST({N} AS DOUBLE) / 100 END",
    "confidence_tier": f"CASE WHEN NOT {SCORED} THEN 'insufficient_data' WHEN {N} >= 70 THEN 'high' "
                       f"WHEN {N} >= 40 THEN 'medium' ELSE 'low' END",
    "evidence_text": f"CASE WHEN (k + d) % 5 = 0 THEN 'Sentence from somewhere else' WHEN (k + d) % 5 = 1 THEN NULL "
                     f"WHEN (k + d) % 5 = 2 THEN ({FIELD_TEXT}) ELSE substr({FIELD_TEXT}, 1, 20) END",
    "source_field": "CASE WHEN d < 3 THEN dim WHEN k % 2 = 0 THEN 'capacity' WHEN k % 7 = 1 THEN 'year_established' END",
    "contradiction": CONTRADICTS,
    "contradiction_detail": f"CASE WHEN NOT {CONTRADICTS} OR k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN "
                            f"'Says \"' || substr(description, 1, {QUOTED}) || '\" elsewhere' "
                            "ELSE 'No ''beds'' listed although inpatients are claimed' END",
    "extraction_model": "'rules'",
    "extracted_day": "k % 28",
}
# records in debit have not been assessed yet
SIGNALS_FROM = "balance >= 0 AND unique_id IS NOT NULL"
DIMENSION_ROWS = [(0, "capability"), (1, "equipment"), (2, "procedure"), (3, "completeness")]


def signals(spark, sf_dir) -> DataFrame:
    # no more of a document than a signal quotes moves to its record
    quoted = source(spark, sf_dir, f"substr(text, 1, {QUOTED})")
    per_dimension = quoted.withColumnRenamed("record_key", "k").where(SIGNALS_FROM).selectExpr(
        "*", "inline(array(" + ", ".join(f"struct({d} AS d, '{dim}' AS dim)" for d, dim in DIMENSION_ROWS) + "))")
    return _project(per_dimension, SIGNAL_EXPRESSIONS).selectExpr(
        "* except (extracted_day)",
        "timestampadd(DAY, CAST(extracted_day AS INT), TIMESTAMP '2024-02-01 00:00:00') AS extracted_at")


# --- model answers as JSON text, some of them broken ------------------------------------------------
def _json_string(expr):
    quote = "'\"'"
    return f"coalesce({quote} || replace({expr}, {quote}, chr(92) || {quote}) || {quote}, 'null')"


def _answer_item(d, dim):
    n = f"((k * 7 + {d} * 13) % 101)"
    evidence = ["capability", "equipment", "procedure", "CAST(NULL AS STRING)"][d]
    score = f"CASE WHEN {d} = 3 OR (k + {d}) % 9 = 0 THEN 'null' WHEN {n} = 100 THEN '1.0' " \
            f"ELSE '0.' || lpad({text(n)}, 2, '0') END"
    tier = f"CASE WHEN {d} = 3 OR (k + {d}) % 9 = 0 THEN 'insufficient_data' WHEN {n} >= 70 THEN 'high' " \
           f"WHEN {n} >= 40 THEN 'medium' ELSE 'low' END"
    name = f"CASE WHEN k % 71 = 3 AND {d} = 1 THEN 'staffing' ELSE '{dim}' END"
    return (
        f"'{{\"dimension\": \"' || ({name}) || '\", \"trust_score\": ' || "
        f"(CASE WHEN k % 71 = 8 AND {d} = 2 THEN '\"high\"' ELSE ({score}) END) || "
        f"(CASE WHEN k % 71 = 6 AND {d} = 0 THEN '' ELSE ', \"confidence_tier\": \"' || ({tier}) || '\"' END) || "
        f"', \"evidence_text\": ' || {_json_string(evidence)} || ', \"source_field\": \"{dim}\"' || "
        f"(CASE WHEN k % 71 = 4 THEN '' ELSE ', \"contradiction\": ' || "
        f"(CASE WHEN (k + {d}) % 17 = 0 THEN 'true' ELSE 'false' END) END) || ', \"contradiction_detail\": null}}'"
    )


ANSWER = ("'{\"dimensions\": [' || " + " || ', ' || ".join(_answer_item(d, dim) for d, dim in DIMENSION_ROWS)
          + " || ']}'")
RESPONSE_EXPRESSIONS = {
    "facility_id": "trim(unique_id)",
    "raw_response": f"CASE WHEN k % 71 = 1 THEN 'not json' WHEN k % 71 = 2 THEN '{{\"dims\": []}}' "
                    f"WHEN k % 71 = 5 THEN NULL WHEN k % 71 = 7 THEN substr({ANSWER}, 1, 60) "
                    f"WHEN k % 71 = 9 THEN {ANSWER} || chr(10) || ' ' WHEN k % 71 = 10 THEN '{{\"dimensions\": []}}' "
                    f"WHEN k % 71 = 11 THEN '{{\"dimensions\": [{{\"dimension\": \"staffing\", \"confidence_tier\": "
                    f"\"low\"}}]}}' ELSE {ANSWER} END",
    "extraction_model": "'rules'",
}


def responses(spark, sf_dir) -> DataFrame:
    df = source(spark, sf_dir).withColumnRenamed("record_key", "k").where(SIGNALS_FROM)
    # answers are long to write and to parse but small as stored: sizes alone would leave them to very few tasks
    df = df.repartition(spark.sparkContext.defaultParallelism * 4, "k")
    return _project(df, RESPONSE_EXPRESSIONS).selectExpr(
        "*", "CAST(NULL AS STRING) AS error_message", "TIMESTAMP '2024-02-01 00:00:00' AS responded_at")


# --- append-only logs --------------------------------------------------------------------------------
OVERRIDE_EXPRESSIONS = {
    "facility_id": f"CASE WHEN o_orderkey % 113 = 5 THEN 'unknown-' || {text('o_orderkey')} ELSE {uuid_of('o_custkey')} END",
    "field_name": cycle("o_orderkey", "'name'", "'capacity'", "'official_phone'", "'latitude'", "'address_city'",
                        "'year_established'"),
    "new_value": "CASE WHEN o_orderkey % 29 = 3 THEN NULL ELSE (" + cycle(
        "o_orderkey", f"'Renamed ' || {text('o_orderkey % 500')}",
        f"CASE WHEN o_orderkey % 4 = 1 THEN 'many' ELSE {text('o_orderkey % 400')} END",
        f"'080-' || {text('2000000 + o_orderkey % 9000')}", f"{text('o_orderkey % 40')} || '.25'",
        f"'City ' || {text('o_orderkey % 60')}", text("1900 + o_orderkey % 120")) + ") END",
    "analyst_id": f"'analyst-' || {text('o_orderkey % 7')}",
    "reason": "o_orderpriority",
    "updated_at": "o_orderdate",
    "seq": "o_orderkey",
}


def overrides(spark, sf_dir) -> DataFrame:
    return _project(table(spark, sf_dir, "orders"), OVERRIDE_EXPRESSIONS)


ACTION_EXPRESSIONS = {
    "action_id": f"'act-' || {text('event_id')}",
    "facility_id": uuid_of("user_id"),
    "analyst_id": f"'analyst-' || {text('event_id % 5')}",
    "action_type": "CASE event_type WHEN 'click' THEN 'shortlist' WHEN 'error' THEN 'flag' "
                   "WHEN 'purchase' THEN 'override' ELSE 'note' END",
    "dimension": "CASE WHEN event_type = 'purchase' THEN (" +
                 cycle("event_id", "'capability'", "'equipment'", "'procedure'", "'completeness'") + ") END",
    "content": f"CASE event_type WHEN 'click' THEN ({cycle('event_id', chr(39) + 'added' + chr(39), chr(39) + 'removed' + chr(39), chr(39) + 'added' + chr(39))}) "
               f"WHEN 'error' THEN (CASE WHEN event_id % 4 = 0 THEN 'cleared' WHEN event_id % 4 = 1 THEN ' ' ELSE 'flagged' END) "
               f"WHEN 'purchase' THEN (CASE WHEN event_id % 6 = 0 THEN '  ' ELSE 'checked by phone' END) "
               f"WHEN 'view' THEN 'note ' || {text('event_id')} ELSE NULL END",
    "override_score": "CASE WHEN event_type = 'purchase' THEN CAST(event_id % 120 AS DOUBLE) END",
    "updated_at": "ts",
    "seq": "event_id",
}


def actions(spark, sf_dir) -> DataFrame:
    return _project(table(spark, sf_dir, "events"), ACTION_EXPRESSIONS)


REVIEW_EXPRESSIONS = {
    "facility_id": uuid_of("o_custkey"),
    "status": "CASE o_orderstatus WHEN 'F' THEN 'validation_complete' WHEN 'P' THEN (CASE WHEN o_orderkey % 3 = 0 THEN "
              "'called' ELSE 'parked' END) ELSE (CASE WHEN o_orderkey % 5 = 0 THEN 'archived' WHEN o_orderkey % 5 < 3 "
              "THEN 'in_progress' ELSE 'email_sent' END) END",
    "parked_reason": "CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 <> 1 THEN 'Waiting for a call back' END",
    "assigned_to": f"'analyst-' || {text('o_orderkey % 5')}",
    "notes": f"CASE WHEN o_orderkey % 2 = 0 THEN 'visit ' || {text('o_orderkey')} END",
    "updated_by": f"'analyst-' || {text('o_orderkey % 3')}",
    "updated_at": "o_orderdate",
    "seq": "o_orderkey",
}


def review_log(spark, sf_dir) -> DataFrame:
    return _project(table(spark, sf_dir, "orders"), REVIEW_EXPRESSIONS)


# --- cleanup suggestions a reviewer accepted, one per order line ----------------
SUGGESTION_EXPRESSIONS = {
    "facility_id": uuid_of("l_orderkey"),
    "field_name": cycle("l_linenumber", "'name'", "'address_city'", "'official_phone'"),
    "current_value": f"'old ' || {text('l_partkey')}",
    "suggested_value": f"'new ' || {text('l_partkey')}",
    "reason": "'written as ' || l_linestatus",
    "confidence": "CASE WHEN l_quantity > 25 THEN 'high' ELSE 'low' END",
}


def suggestions(spark, sf_dir) -> DataFrame:
    return _project(table(spark, sf_dir, "lineitem"), SUGGESTION_EXPRESSIONS)


# --- geography ---------------------------------------------------------------------------------------
POSTAL_EXPRESSIONS = {
    "officename": f"p_name || ' ' || {text('p_partkey')}",
    "pincode": text("560000 + p_partkey % 110"),
    "officetype": "CASE WHEN p_size < 5 THEN 'HO' WHEN p_size < 20 THEN 'PO' ELSE 'BO' END",
    "district": f"CASE WHEN p_partkey % 110 % 9 = 0 AND p_partkey % 4 = 0 THEN 'Other District' "
                f"ELSE 'City ' || {text('p_partkey % 110 % 60')} END",
    "statename": f"'NATION_' || {text('p_partkey % 110 % 25')}",
    "latitude": f"CASE WHEN p_partkey % 13 = 0 THEN 'NA' ELSE {text('p_partkey % 38')} || '.5' END",
    "longitude": f"CASE WHEN p_partkey % 13 = 0 THEN 'NA' ELSE {text('70 + p_partkey % 25')} || '.5' END",
}


def postal_directory(spark, sf_dir) -> DataFrame:
    return _project(table(spark, sf_dir, "part"), POSTAL_EXPRESSIONS)


# one row per district: the first supplier of each district number reports its figures
INDICATOR_EXPRESSIONS = {
    "district_name": f"' CITY-' || {text('g')} || ' '",
    "burden": f"CASE WHEN g % 7 = 3 THEN '*' WHEN g % 5 = 2 THEN '(' || {text('10 + (g * 37) % 80')} || '.5)' "
              f"ELSE {text('10 + (g * 37) % 80')} || '.0' END",
    "suppliers": "suppliers",
}


def district_indicators(spark, sf_dir) -> DataFrame:
    grouped = (table(spark, sf_dir, "supplier").selectExpr("s_suppkey % 50 AS g")
               .groupBy("g").count().withColumnRenamed("count", "suppliers"))
    return _project(grouped, INDICATOR_EXPRESSIONS)


# one concave polygon per nation on a 9-degree grid; corners as (x, y) pairs
X0, Y0 = "(60 + 9 * (n_nationkey % 5))", "(9 * CAST(floor(n_nationkey / 5) AS INT))"
CORNERS = [("0", "0"), ("9", "0"), ("9", "9"), ("4.6", "4.7"), ("0", "9")]


def corner(i):
    dx, dy = CORNERS[i % len(CORNERS)]
    return f"CAST({X0} + {dx} AS DOUBLE)", f"CAST({Y0} + {dy} AS DOUBLE)"


def polygons(spark, sf_dir) -> DataFrame:
    ring = ", ".join(f"struct({x} AS x, {y} AS y)" for x, y in map(corner, range(len(CORNERS))))
    return table(spark, sf_dir, "nation").selectExpr("n_name AS district", f"array({ring}) AS ring")
