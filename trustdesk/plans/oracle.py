"""The registered queries as DuckDB SQL over the same tables, written independently of the operators."""

from trustdesk.sources import driver_views as v

UUID = "'^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$'"
EMAIL = r"'^[^@\s]+@[^@\s]+\.[^@\s]+$'"
CONTROL = r"'[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFD}]'"
WORDS = "('', 'null', 'na', 'n/a', 'unknown', 'none')"
TYPES = "('hospital', 'clinic', 'dentist', 'pharmacy', 'farmacy', 'doctor', 'nursing_home')"
TODAY = "DATE '2024-06-30'"


def select(expressions, rows):
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in expressions.items()) + f" FROM {rows}"


# --- named building blocks; a query lists those it reads and gets their WITH clause -------------------

PARTS = {}


def part(name, sql, *needs):
    PARTS[name] = (needs, sql)


def with_parts(sql, *needs, recursive=False):
    order = []

    def visit(name):
        for dep in PARTS[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return sql
    ctes = ", ".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in order)
    # a query that opens with a comma goes on with parts of its own
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {sql}"


ORACLES = {}


def oracle(name, sql, *needs):
    ORACLES[name] = with_parts(sql, *needs)


part("entities", """
SELECT c_custkey AS k, c_nationkey AS nation_key, n_name AS state_name, r_name AS region_name,
       c_mktsegment AS segment, c_acctbal AS balance, d.text AS doc_text
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
LEFT JOIN documents d ON d.doc_id = c_custkey""")
part("src", select(v.SOURCE_EXPRESSIONS, "entities"), "entities")
part("assessed", f"SELECT *, record_key AS k FROM src WHERE {v.SIGNALS_FROM}", "src")
part("signals", select(v.SIGNAL_EXPRESSIONS, "assessed CROSS JOIN (VALUES " + ", ".join(
    str(r) for r in v.DIMENSION_ROWS) + ") dims(d, dim)"), "assessed")
part("responses", select(v.RESPONSE_EXPRESSIONS, "assessed"), "assessed")
part("overrides", select(v.OVERRIDE_EXPRESSIONS, "orders"))
part("actions", select(v.ACTION_EXPRESSIONS, "events"))
part("review_log", select(v.REVIEW_EXPRESSIONS, "orders"))
part("suggestions", select(v.SUGGESTION_EXPRESSIONS, "lineitem"))
part("postal", select(v.POSTAL_EXPRESSIONS, "part"))
part("indicators", select(v.INDICATOR_EXPRESSIONS,
                          "(SELECT s_suppkey % 50 AS g, count(*) AS suppliers FROM supplier GROUP BY 1)"))

# --- cleaning -----------------------------------------------------------------------------------------


def sane(c):
    return f"regexp_replace({c}, {CONTROL}, '', 'g')"


def cleaned(value, tested=None, fold=None):
    out = f"trim({value})"
    return f"CASE WHEN lower(trim({tested or value})) NOT IN {WORDS} THEN {fold}({out}) ELSE NULL END" if fold else \
        f"CASE WHEN lower(trim({tested or value})) NOT IN {WORDS} THEN {out} ELSE NULL END"


def as_int(c, kind="INTEGER"):
    return f"CASE WHEN regexp_matches(trim({c}), '^[+-]?[0-9]+$') THEN TRY_CAST(trim({c}) AS {kind}) END"


def as_double(c):
    return rf"CASE WHEN regexp_matches(trim({c}), '^[+-]?[0-9]+(\.[0-9]+)?$') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def as_bool(c):
    return (f"CASE WHEN lower(trim({c})) IN ('t', 'true', 'y', 'yes', '1') THEN true "
            f"WHEN lower(trim({c})) IN ('f', 'false', 'n', 'no', '0') THEN false END")


def as_date(c):
    return rf"""CASE WHEN regexp_matches(trim({c}), '^[0-9]{{4}}$') THEN TRY_CAST(trim({c}) || '-01-01' AS DATE)
      WHEN regexp_matches(trim({c}), '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}([ T].*)?$')
      THEN TRY_CAST(regexp_extract(trim({c}), '^[0-9]+-[0-9]+-[0-9]+') AS DATE) END"""


def past(c):
    return f"CASE WHEN {as_date(c)} <= {TODAY} THEN {as_date(c)} END"


def json_list(c):
    return (f"CASE WHEN json_valid({c}) AND json_type(CASE WHEN json_valid({c}) THEN {c} END) = 'ARRAY' "
            f"THEN from_json(CASE WHEN json_valid({c}) THEN {c} END, '[\"VARCHAR\"]') END")


YEAR = as_int("yearEstablished")
SILVER = {
    "unique_id": "trim(unique_id)", "name": cleaned(sane("name")), "organization_type": cleaned("organization_type"),
    "content_table_id": "trim(content_table_id)", "official_phone": cleaned("officialPhone"),
    "email": f"CASE WHEN regexp_matches(lower(trim(email)), {EMAIL}) THEN lower(trim(email)) END",
    "official_website": cleaned("officialWebsite", fold="lower"),
    "year_established": f"CASE WHEN {YEAR} BETWEEN 1800 AND 2024 THEN {YEAR} END",
    "accepts_volunteers": as_bool("acceptsVolunteers"), "facebook_link": cleaned("facebookLink"),
    **{f"address_line{i}": cleaned(sane(f"address_line{i}"), f"address_line{i}") for i in (1, 2, 3)},
    "address_city": cleaned("address_city"), "address_state_or_region": cleaned("address_stateOrRegion"),
    "address_zip_or_postcode": cleaned("address_zipOrPostcode"), "address_country": cleaned("address_country"),
    "address_country_code": cleaned("address_countryCode", fold="upper"), "countries": cleaned("countries"),
    "facility_type_id": cleaned("facilityTypeId", fold="lower"),
    "operator_type_id": cleaned("operatorTypeId", fold="lower"),
    "affiliation_type_ids": "array_to_string(list_sort(list_distinct(list_filter("
                            + json_list("affiliationTypeIds") + ", lambda x: x IS NOT NULL AND trim(x) <> ''))), '|')",
    **{c: cleaned(sane(c)) for c in ("description", "capability", "procedure", "equipment")},
    "area": as_int("area"), "number_doctors": as_int("numberDoctors"), "capacity": as_int("capacity"),
    "recency_of_page_update": past("recency_of_page_update"),
    "distinct_social_media_presence_count": as_int("distinct_social_media_presence_count"),
    "affiliated_staff_presence": as_bool("affiliated_staff_presence"),
    "custom_logo_presence": as_bool("custom_logo_presence"),
    "number_of_facts_about_the_organization": as_int("number_of_facts_about_the_organization"),
    "post_metrics_most_recent_social_media_post_date": past("post_metrics_most_recent_social_media_post_date"),
    "post_metrics_post_count": as_int("post_metrics_post_count"),
    **{f"engagement_metrics_n_{c}": as_int(f"engagement_metrics_n_{c}", "BIGINT")
       for c in ("followers", "likes", "engagements")},
    "source": cleaned("source"), "latitude": as_double("latitude"), "longitude": as_double("longitude"),
}
part("silver", select(SILVER, "src"), "src")

POINTS = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in [
    *(f"{c} IS NOT NULL" for c in ("name", "official_phone", "email", "official_website", "address_city",
                                   "address_state_or_region", "description", "capability", "procedure", "equipment")),
    "address_country_code = 'IN'", f"facility_type_id IN {TYPES}"])
part("latest_overrides", """
SELECT * FROM overrides QUALIFY row_number() OVER (
  PARTITION BY facility_id, field_name ORDER BY updated_at DESC, seq DESC) = 1""", "overrides")
OVERRIDDEN = {"name": "VARCHAR", "capacity": "INTEGER", "official_phone": "VARCHAR", "latitude": "DOUBLE",
              "address_city": "VARCHAR", "year_established": "INTEGER"}
part("ov", "SELECT facility_id, string_agg(field_name, '|' ORDER BY field_name) AS overridden_fields, " + ", ".join(
    f"max(CASE WHEN field_name = '{f}' THEN new_value END) AS {f}_ov" for f in OVERRIDDEN)
     + " FROM latest_overrides GROUP BY 1", "latest_overrides")


def corrected(f):
    value = {"INTEGER": as_int, "DOUBLE": as_double}.get(OVERRIDDEN[f], lambda c: c)(f"{f}_ov")
    return f"coalesce({value}, b.{f})"


GOLD = {c: corrected(c) if c in OVERRIDDEN else f"b.{c}" for c in SILVER}
part("best", f"""
SELECT * FROM silver WHERE regexp_matches(unique_id, {UUID})
QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY {POINTS} DESC, name ASC NULLS LAST,
  official_phone ASC NULLS LAST, email ASC NULLS LAST, official_website ASC NULLS LAST,
  address_line1 ASC NULLS LAST, description ASC NULLS LAST) = 1""", "silver")
part("gold", select({**GOLD, "overridden_fields": "coalesce(overridden_fields, '')"},
                    "best b LEFT JOIN ov ON b.unique_id = ov.facility_id"), "best", "ov")

SOURCE_COLUMNS = [c for c in v.SOURCE_EXPRESSIONS
                  if c not in ("record_key", "balance", "phone_numbers", "websites", "specialties")]
oracle("bronze_landed", f"SELECT {', '.join(SOURCE_COLUMNS)} FROM src", "src")
oracle("raw_subset", """
SELECT unique_id AS facility_id, name AS facility_name, organization_type AS facility_type,
  address_stateOrRegion AS state, address_city AS district, description, capability, procedure, equipment, capacity,
  yearEstablished AS year_established, latitude, longitude, specialties FROM src""", "src")
oracle("silver_clean", "SELECT * FROM silver", "silver")
oracle("gold_merge", "SELECT * FROM gold", "gold")
oracle("override_latest", "SELECT facility_id, field_name, new_value, seq FROM latest_overrides", "latest_overrides")
VALID = f"regexp_matches(unique_id, {UUID})"
oracle("issue_rows", f"""
, counted AS (SELECT *, count(*) OVER (PARTITION BY unique_id) AS copies FROM silver)
SELECT unique_id AS facility_id, 'unique_id' AS field_name, 'invalid_facility_id' AS issue_type,
  'critical' AS severity, unique_id AS raw_value, CAST(NULL AS VARCHAR) AS suggested_value,
  'unique_id_uuid_validation' AS rule_name FROM counted WHERE NOT {VALID}
UNION ALL SELECT unique_id, 'unique_id', 'duplicate_facility_id', 'medium', unique_id,
  'Deduped in facilities_gold by completeness score', 'unique_id_duplicate_detection'
  FROM counted WHERE {VALID} AND copies > 1
UNION ALL SELECT unique_id, 'name', 'missing_facility_name', 'high', name, NULL, 'name_required_for_identity'
  FROM counted WHERE {VALID} AND name IS NULL
UNION ALL SELECT unique_id, 'facility_type_id', 'invalid_facility_type', 'medium', facility_type_id, NULL,
  'facility_type_allowlist' FROM counted
  WHERE {VALID} AND (facility_type_id IS NULL OR facility_type_id NOT IN {TYPES})
UNION ALL SELECT unique_id, 'address_country_code', 'unexpected_country_code', 'medium', address_country_code, 'IN',
  'india_dataset_country_code_check' FROM counted WHERE {VALID} AND address_country_code <> 'IN'""", "silver")

# --- quality checks -----------------------------------------------------------------------------------


def missing(c, *extra):
    return f"({c} IS NULL OR trim({c}) IN ({', '.join(repr(x) for x in ('', 'null', *extra))}))"


part("phones", f"""
SELECT * EXCLUDE (listed), regexp_replace(raw_phone, '[^0-9]', '', 'g') AS phone_normalized FROM (
  SELECT unique_id, name, facilityTypeId, address_city, address_stateOrRegion, address_country, listed,
    unnest(listed) AS raw_phone
  FROM (SELECT *, {json_list('phone_numbers')} AS listed FROM src
        WHERE phone_numbers IS NOT NULL AND phone_numbers <> 'null' AND phone_numbers <> '[]'))""", "src")
part("dup_phones", """
SELECT p.*, r.duplicate_count, r.pct_rank,
  CASE WHEN pct_rank >= 0.90 THEN 'critical' WHEN pct_rank >= 0.60 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN pct_rank >= 0.90 THEN 50 WHEN pct_rank >= 0.60 THEN 30 ELSE 10 END AS penalty_points,
  'Phone number shared with ' || r.duplicate_count || ' facilities' AS issue_summary
FROM phones p JOIN (
  SELECT phone_normalized, duplicate_count, percent_rank() OVER (ORDER BY duplicate_count) AS pct_rank FROM (
    SELECT phone_normalized, count(DISTINCT unique_id) AS duplicate_count FROM phones
    WHERE length(phone_normalized) >= 7 GROUP BY 1 HAVING count(DISTINCT unique_id) > 1)) r
ON p.phone_normalized = r.phone_normalized""", "phones")
oracle("dup_phones", "SELECT * EXCLUDE (pct_rank), round(pct_rank, 6) AS pct_rank FROM dup_phones", "dup_phones")

MISSING = [
    ("missing_name", missing("name"), 60, "Facility name is missing"),
    ("missing_description", missing("description"), 30, "Description is missing"),
    ("invalid_type", f"(facilityTypeId IS NULL OR facilityTypeId NOT IN {TYPES})", 20,
     "Facility type is missing or invalid"),
    ("missing_phone", missing("officialPhone") + " AND " + missing("phone_numbers", "[]"), 10,
     "No phone number on record"),
    ("missing_email", missing("email"), 10, "No email address on record"),
    ("missing_website", missing("officialWebsite") + " AND " + missing("websites", "[]"), 5, "No website on record"),
]


def rule_rows(rules, rows, id_col="unique_id", severity=False):
    grades = {50: "critical", 30: "high", 15: "medium", 5: "low"}
    return " UNION ALL ".join(
        f"SELECT {id_col} AS unique_id, '{name}' AS \"check\", {points} AS penalty_points, '{issue}' AS issue_summary"
        + (f", '{grades[points]}' AS severity" if severity else "") + f" FROM {rows} WHERE {cond}"
        for name, cond, points, issue in rules)


part("missing_rows", rule_rows(MISSING, "src"), "src")
oracle("missing_checks", "SELECT * FROM missing_rows", "missing_rows")


def bad_place(c):
    return f"({c} IS NULL OR trim({c}) = '' OR lower(trim({c})) IN ('na', 'n/a', 'unknown'))"


LOCATION = [
    ("bad_city", "City missing or invalid", 10, bad_place("address_city")),
    ("bad_state_or_region", "State/region missing or invalid", 25, bad_place("address_stateOrRegion")),
    ("unexpected_country", "Country is not India", 30, "lower(trim(address_country)) NOT IN ('india', 'in')"),
    ("missing_coordinates", "Coordinates missing", 5, "(latitude IS NULL OR longitude IS NULL)"),
    ("latitude_outside_india_range", "Latitude outside India", 35, "(lat < 6 OR lat > 38)"),
    ("longitude_outside_india_range", "Longitude outside India", 35, "(lon < 68 OR lon > 98)"),
]
part("location", f"""
SELECT unique_id, name, facilityTypeId, address_city, address_stateOrRegion, address_country, latitude, longitude,
  concat_ws(', ', {', '.join(f"CASE WHEN {c} THEN '{code}' END" for code, _, _, c in LOCATION)}) AS location_issues,
  {' + '.join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for _, _, p, c in LOCATION)} AS penalty_points,
  concat_ws('; ', {', '.join(f"CASE WHEN {c} THEN '{text}' END" for _, text, _, c in LOCATION)}) AS issue_summary
FROM (SELECT *, {as_double('latitude')} AS lat, {as_double('longitude')} AS lon FROM src)
WHERE {' OR '.join(c for *_, c in LOCATION)}""", "src")
oracle("location_check", "SELECT * FROM location", "location")

part("checks", """
SELECT trim(unique_id) AS facility_id, "check", penalty_points, issue_summary FROM missing_rows WHERE unique_id IS NOT NULL
UNION ALL SELECT trim(unique_id), 'location', penalty_points, issue_summary FROM location WHERE unique_id IS NOT NULL
UNION ALL SELECT trim(unique_id), 'duplicate_phones', penalty_points, issue_summary FROM dup_phones
  WHERE unique_id IS NOT NULL""", "missing_rows", "location", "dup_phones")
part("totals", """
SELECT facility_id, CAST(sum(worst) AS INTEGER) AS total_penalty_points FROM (
  SELECT facility_id, "check", max(penalty_points) AS worst FROM checks GROUP BY 1, 2) GROUP BY 1""", "checks")
part("scores", """
SELECT t.facility_id, greatest(0, 100 - total_penalty_points) AS quality_score,
  CASE WHEN 100 - total_penalty_points >= 85 THEN 'high_quality' WHEN 100 - total_penalty_points >= 65 THEN 'needs_review'
       WHEN 100 - total_penalty_points >= 40 THEN 'low_quality' ELSE 'critical_issue' END AS quality_tier,
  total_penalty_points, issues
FROM totals t JOIN (SELECT facility_id, string_agg(issue_summary, '|' ORDER BY issue_summary) AS issues
  FROM (SELECT DISTINCT facility_id, issue_summary FROM checks) GROUP BY 1) i ON i.facility_id = t.facility_id""",
     "totals", "checks")
oracle("quality_scores", "SELECT * FROM scores", "scores")
oracle("worst_100", f"""
, worst AS (SELECT * FROM scores ORDER BY quality_score, total_penalty_points DESC, facility_id LIMIT 100)
SELECT w.*, {', '.join(f"(SELECT count(DISTINCT issue_summary) FROM checks c WHERE c.facility_id = w.facility_id AND {cond}) AS {n}_issues" for n, cond in (("critical", "penalty_points >= 40"), ("high", "penalty_points BETWEEN 20 AND 39"), ("medium", "penalty_points BETWEEN 10 AND 19"), ("low", "penalty_points < 10")))},
  g.name AS facility_name, g.facility_type_id AS facility_type, g.address_city AS city,
  g.address_state_or_region AS state
FROM worst w LEFT JOIN gold g ON g.unique_id = w.facility_id""", "scores", "checks", "gold")

# documented checks
POINTS_OF = "CASE severity WHEN 'critical' THEN 50 WHEN 'high' THEN 30 WHEN 'medium' THEN 15 WHEN 'low' THEN 5 ELSE 0 END"
BY_COUNT = "CASE WHEN duplicate_count >= 6 THEN 'critical' ELSE 'high' END"


def graded(inner, columns):
    return f"SELECT {columns}, severity, CAST({POINTS_OF} AS INTEGER) AS penalty_points FROM ({inner})"


oracle("dup_emails", """
, e AS (SELECT DISTINCT unique_id, lower(trim(email)) AS email FROM src WHERE regexp_matches(lower(trim(email)), """ + EMAIL + """)),
c AS (SELECT email, count(DISTINCT unique_id) AS duplicate_count, email IN ('test@example.com', 'abc@xyz.com') AS fake
      FROM e GROUP BY 1)
""" + graded(f"""SELECT unique_id, e.email, duplicate_count, 'duplicate_email' AS "check",
  CASE WHEN fake THEN 'critical' ELSE {BY_COUNT} END AS severity,
  CASE WHEN fake THEN 'Placeholder email address'
       ELSE 'This email appears on ' || duplicate_count || ' facility records' END AS issue_summary
  FROM e JOIN c ON e.email = c.email WHERE duplicate_count > 1 OR fake""",
             'unique_id, email, duplicate_count, "check", issue_summary'), "src")
NATIONAL = r"regexp_replace(regexp_replace(regexp_replace(trim(p), '^(\+91|0091)', ''), '[^0-9]', '', 'g'), '^0+', '')"
oracle("dup_phones_by_count", f"""
, n AS (SELECT unique_id, unnest(list_distinct(list_transform(list_concat(coalesce({json_list('phone_numbers')}, []), [officialPhone]),
      lambda p: {NATIONAL}))) AS phone FROM (SELECT rowid_ AS r, * FROM (SELECT row_number() OVER () AS rowid_, * FROM src))),
used AS (SELECT DISTINCT unique_id, phone FROM n WHERE phone <> ''),
c AS (SELECT phone, count(DISTINCT unique_id) AS duplicate_count, length(phone) < 7 AS short FROM used GROUP BY 1)
""" + graded(f"""SELECT unique_id, used.phone, duplicate_count, 'duplicate_phone_count' AS "check",
  CASE WHEN short THEN 'high' ELSE {BY_COUNT} END AS severity,
  CASE WHEN short THEN 'Phone number has too few digits'
       ELSE 'This phone number appears on ' || duplicate_count || ' facility records' END AS issue_summary
  FROM used JOIN c ON used.phone = c.phone WHERE duplicate_count > 1 OR short""",
             'unique_id, phone, duplicate_count, "check", issue_summary'), "src")


def key(c):
    return rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


oracle("dup_identity", f"""
, named AS (SELECT unique_id, {key('name')} AS n, {key('address_line1')} AS a, {key('address_city')} AS c,
  {key('address_state_or_region')} AS s FROM silver),
keyed AS (SELECT DISTINCT unique_id, 'address' AS match, n || '|' || a AS value FROM named WHERE n <> '' AND a <> ''
  UNION SELECT unique_id, 'place', n || '|' || c || '|' || s FROM named
  WHERE n <> '' AND c IS NOT NULL AND s IS NOT NULL),
counted AS (SELECT match, value, count(DISTINCT unique_id) AS duplicate_count FROM keyed GROUP BY 1, 2)
""" + graded("""SELECT unique_id, k.match, k.value, duplicate_count, 'duplicate_identity' AS "check",
  CASE WHEN k.match = 'address' THEN 'critical' ELSE 'high' END AS severity,
  CASE WHEN k.match = 'address' THEN 'Same name and address as another record'
       ELSE 'Same name, city and state as another record' END AS issue_summary
  FROM keyed k JOIN counted c ON k.match = c.match AND k.value = c.value WHERE duplicate_count > 1""",
             'unique_id, match, value, duplicate_count, "check", issue_summary'), "silver")
oracle("fuzzy_identity", f"""
, named AS (SELECT unique_id, {key('name')} AS norm, address_state_or_region AS place FROM silver),
placed AS (SELECT * FROM named WHERE norm <> '' AND place IS NOT NULL),
names AS (SELECT DISTINCT place, norm FROM placed),
near AS (SELECT DISTINCT a.place, a.norm FROM names a JOIN names b ON a.place = b.place AND a.norm <> b.norm
  AND levenshtein(a.norm, b.norm) * 100 <= 15 * greatest(length(a.norm), length(b.norm)))
SELECT unique_id, 'similar_identity' AS "check", 'medium' AS severity, 15 AS penalty_points,
  'Name is close to another record in the same area' AS issue_summary
FROM placed JOIN near ON placed.place = near.place AND placed.norm = near.norm""", "silver")
KM = """2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"""
oracle("fuzzy_nearby", f"""
, named AS (SELECT unique_id, {key('name')} AS norm, latitude AS lat, longitude AS lon FROM silver),
placed AS (SELECT * FROM named WHERE norm <> '' AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180),
spots AS (SELECT DISTINCT lat, lon FROM placed),
near_spots AS (SELECT a.lat AS lat, a.lon AS lon, b.lat AS lat2, b.lon AS lon2 FROM spots a, spots b WHERE {KM} <= 900),
names AS (SELECT DISTINCT norm, lat, lon FROM placed),
near AS (SELECT DISTINCT a.norm, a.lat, a.lon FROM names a JOIN near_spots s ON s.lat = a.lat AND s.lon = a.lon
  JOIN names b ON b.lat = s.lat2 AND b.lon = s.lon2 AND a.norm <> b.norm
  AND levenshtein(a.norm, b.norm) * 100 <= 15 * greatest(length(a.norm), length(b.norm)))
SELECT unique_id, 'similar_nearby' AS "check", 'medium' AS severity, 15 AS penalty_points,
  'Name is close to another record nearby' AS issue_summary
FROM placed p JOIN near n ON p.norm = n.norm AND p.lat = n.lat AND p.lon = n.lon""", "silver")
oracle("missing_core", rule_rows([
    ("core_name", missing("name"), 50, "Facility name is missing"),
    ("core_state", missing("address_stateOrRegion"), 30, "State or region is missing"),
    ("core_type", missing("facilityTypeId"), 15, "Facility type is missing"),
    ("core_contact", " AND ".join(missing(c, "[]") for c in (
        "officialPhone", "phone_numbers", "email", "officialWebsite", "websites")), 15, "No contact field is filled in"),
    ("core_text", " AND ".join(missing(c, "[]") for c in ("description", "capability", "procedure", "equipment")), 30,
     "No descriptive text is filled in")], "src", severity=True), "src")
MAIL, PHONE = "lower(trim(email))", "regexp_replace(officialPhone, '[^0-9]', '', 'g')"
ATS = f"(length({MAIL}) - length(replace({MAIL}, '@', '')))"
oracle("contact_formats", rule_rows([
    ("email_no_at", f"NOT {missing('email')} AND {ATS} = 0 AND {MAIL} NOT IN {WORDS}", 15, "Email has no @"),
    ("email_no_domain", rf"NOT {missing('email')} AND {ATS} = 1 AND NOT regexp_matches({MAIL}, '@[^@\s]+\.[^@\s]+$')", 15,
     "Email has no domain"),
    ("email_several", f"NOT {missing('email')} AND {ATS} > 1", 15, "Several emails in one field"),
    ("email_placeholder", f"NOT {missing('email')} AND ({MAIL} IN ('test@example.com', 'abc@xyz.com') OR {MAIL} IN {WORDS})",
     30, "Placeholder email"),
    ("phone_not_a_number", f"NOT {missing('officialPhone')} AND {PHONE} = ''", 15, "Phone is not a number"),
    ("phone_short", f"NOT {missing('officialPhone')} AND length({PHONE}) BETWEEN 1 AND 6", 15,
     "Phone number has too few digits"),
    ("phone_repeated", f"NOT {missing('officialPhone')} AND length({PHONE}) >= 2 AND "
                       f"replace({PHONE}, substr({PHONE}, 1, 1), '') = ''", 30, "Phone repeats one digit"),
], "src", severity=True), "src")


def has_word(words, *columns):
    text = " || ' ' || ".join(f"coalesce({key(c)}, '')" for c in columns)
    return "(" + " OR ".join(f"contains(' ' || {text} || ' ', ' {w} ')" for w in words) + ")"


BEDS = as_int("capacity")
oracle("field_conflicts", rule_rows([
    ("hospital_without_beds", f"lower(trim(facilityTypeId)) = 'hospital' AND {BEDS} = 0", 15, "Hospital with capacity 0"),
    ("year_in_future", f"{YEAR} > 2024", 30, "Year established is in the future"),
    ("year_too_old", f"{YEAR} < 1800", 15, "Year established is implausibly old"),
    ("inpatients_without_beds", has_word(["inpatient", "icu", "ward"], "description", "capability")
     + f" AND coalesce({BEDS}, 0) = 0", 15, "Inpatient services claimed without bed capacity"),
], "src", severity=True), "src")


def low_cov(field, invalid, future):
    return f"""SELECT unique_id, '{field}' AS field, CASE WHEN {missing(field)} THEN 'missing' WHEN {future} THEN 'future'
      WHEN {invalid} THEN 'invalid' END AS state,
      (SELECT avg(CASE WHEN trim({field}) <> '' THEN 1.0 ELSE 0.0 END) FROM src) < 0.5 AS low FROM src"""


oracle("low_coverage", f"""
, found AS ({low_cov('capacity', f'({BEDS} IS NULL OR {BEDS} <= 0)', 'false')}
  UNION ALL {low_cov('yearEstablished', f'({YEAR} IS NULL OR {YEAR} < 1800)', f'{YEAR} > 2024')})
""" + graded("""SELECT *, 'low_coverage' AS "check",
  CASE WHEN state = 'future' THEN 'high' WHEN state = 'invalid' THEN 'medium' WHEN low THEN 'warning' ELSE 'low' END AS severity,
  CASE WHEN state <> 'missing' THEN field || ' is present but not valid' WHEN low THEN
    field || ' is missing (low dataset coverage)' ELSE field || ' is missing' END AS issue_summary
  FROM found WHERE state IS NOT NULL""", 'unique_id, field, "check", issue_summary'), "src")
ONLY_COUNTRY = "lower(trim(address_line1)) IN ('india', 'in')"
FULL = "concat_ws('|', " + ", ".join(key(c) for c in (
    "address_line1", "address_line2", "address_city", "address_state_or_region")) + ")"


def shared_rows(rows, check, what, value="value", id_col="unique_id"):
    return f"""SELECT s.unique_id, '{check}' AS "check", 15 AS penalty_points,
      'This {what} appears on ' || duplicate_count || ' facility records' AS issue_summary, 'medium' AS severity
      FROM {rows} s JOIN (SELECT {value}, count(DISTINCT unique_id) AS duplicate_count FROM {rows} GROUP BY ALL
        HAVING count(DISTINCT unique_id) > 1) c USING ({value})"""


oracle("weak_address", f", keyed AS (SELECT DISTINCT unique_id, {FULL} AS value FROM silver WHERE {key('address_line1')} <> '') "
       + rule_rows([
           ("address_missing", "(address_line1 IS NULL OR trim(address_line1) = '')", 5, "Address is missing"),
           ("address_country_only", ONLY_COUNTRY, 15, "Address is only a country"),
           ("address_short", f"length(trim(address_line1)) < 10 AND trim(address_line1) <> '' AND NOT {ONLY_COUNTRY}", 5,
            "Address is very short")], "silver", severity=True)
       + " UNION ALL " + shared_rows("keyed", "address_shared", "address"), "silver")
oracle("same_coords", """
, spots AS (SELECT DISTINCT unique_id, latitude, longitude FROM silver WHERE latitude IS NOT NULL AND longitude IS NOT NULL)
SELECT s.unique_id, s.latitude, s.longitude, duplicate_count, 'same_coordinates' AS "check", 'medium' AS severity,
  15 AS penalty_points, 'This point appears on ' || duplicate_count || ' facility records' AS issue_summary
FROM spots s JOIN (SELECT latitude, longitude, count(DISTINCT unique_id) AS duplicate_count FROM spots GROUP BY 1, 2) c
ON s.latitude = c.latitude AND s.longitude = c.longitude WHERE duplicate_count > 1""", "silver")
TYPE_WORDS = {"hospital": ["hospital"], "clinic": ["clinic"], "dentist": ["dentist", "dental"],
              "pharmacy": ["pharmacy", "pharmacist"], "nursing_home": ["nursing"]}
TEXTS = ("description", "capability", "procedure", "equipment")
oracle("type_vs_text", rule_rows([
    (f"type_{a}_{b}", f"facility_type_id = '{a}' AND says_{b} AND NOT says_{a}", 15, f"Type is {a} but the text names {b}")
    for a in TYPE_WORDS for b in TYPE_WORDS if a != b],
    "(SELECT unique_id, facility_type_id, " + ", ".join(
        f"{has_word(w, *TEXTS)} AS says_{t}" for t, w in TYPE_WORDS.items()) + " FROM silver)", severity=True), "silver")


def text_rules(c, others):
    length = f"length({c})"
    punctuation = rf"length(regexp_replace({c}, '[\p{{L}}\p{{N}}\s]', '', 'g'))"
    rules = [
        ("text_short", f"{length} > 0 AND length(trim({c})) < 40", 5, "Text is too short to support a claim"),
        ("text_garbled", f"{length} > 0 AND ({length} - length({sane(c)})) / {length} > 0.01", 15,
         "Text holds unreadable characters"),
        ("text_punctuation", f"{length} > 0 AND {punctuation} / {length} > 0.3", 5, "Text is mostly punctuation"),
    ]
    if others:
        rules.append(("text_copied_field", f"{length} > 0 AND {key(c)} <> '' AND (" + " OR ".join(
            f"{key(c)} = {key(o)}" for o in others) + ")", 15, "Text repeats another field"))
    return rules


oracle("text_quality", f", keyed AS (SELECT DISTINCT unique_id, {key('description')} AS value FROM silver WHERE {key('description')} <> '') "
       + rule_rows(text_rules("description", ["capability", "procedure", "equipment"]), "silver", severity=True)
       + " UNION ALL " + shared_rows("keyed", "text_boilerplate", "text"), "silver")
ORACLES["document_text_quality"] = (
    f"WITH keyed AS (SELECT DISTINCT doc_id AS unique_id, {key('text')} AS value FROM documents WHERE {key('text')} <> '') "
    + rule_rows(text_rules("text", []), "documents", "doc_id", severity=True)
    + " UNION ALL " + shared_rows("keyed", "text_boilerplate", "text"))

# --- trust score --------------------------------------------------------------------------------------

EMPTY = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in (
    "official_phone", "email", "official_website", "year_established", "capacity", "number_doctors", "description"))


def blended(gold):
    """Score rows of a gold relation: the fan-out join, grouped by record."""
    return f"""
SELECT unique_id AS facility_id, g.name AS facility_name, g.address_state_or_region AS state,
  g.facility_type_id AS facility_type,
  round(CASE WHEN count(t.trust_score) = 0 THEN NULL ELSE least(greatest(0, least(1,
    avg(t.trust_score) - greatest(0, 3 - count(t.trust_score)) * 0.10 - max({EMPTY}) * 0.03
    - (100 - coalesce(max(q.quality_score), 100)) / 400.0)), 0.90) END, 6) AS score,
  max(CASE WHEN t.contradiction THEN 1 ELSE 0 END) AS has_contradiction, CAST(count(t.dimension) AS INTEGER) AS signal_count
FROM {gold} g LEFT JOIN signals t ON g.unique_id = t.facility_id LEFT JOIN scores q ON q.facility_id = g.unique_id
GROUP BY 1, 2, 3, 4"""


part("fs", blended("gold"), "gold", "signals", "scores")
oracle("facility_scores", "SELECT * FROM fs", "fs")
oracle("trust_quality_matrix", """
SELECT f.facility_id, score, coalesce(q.quality_score, 100) AS quality_score, CASE WHEN score IS NULL THEN 'no_trust_score'
  WHEN score >= 0.7 THEN CASE WHEN coalesce(q.quality_score, 100) >= 65 THEN 'reliable' ELSE 'manual_review' END
  WHEN coalesce(q.quality_score, 100) >= 65 THEN 'claims_unproven' ELSE 'risky' END AS verdict
FROM fs f LEFT JOIN scores q ON q.facility_id = f.facility_id""", "fs", "scores")
oracle("dash_summary", """SELECT CAST(count(*) AS INTEGER) AS total, CAST(coalesce(sum(has_contradiction), 0) AS INTEGER)
  AS contradiction_count, CAST(round(avg(score) * 100) AS INTEGER) AS avg_score FROM fs""", "fs")
BUCKETS = """(VALUES (1, '0-29', 0, 29, 'low'), (2, '30-39', 30, 39, 'low'), (3, '40-49', 40, 49, 'med'),
  (4, '50-59', 50, 59, 'med'), (5, '60-69', 60, 69, 'med'), (6, '70-79', 70, 79, 'high'), (7, '80-89', 80, 89, 'high'),
  (8, '90-100', 90, 100, 'high')) b(position, label, low, high, tier)"""
oracle("dash_histogram", f"""SELECT position, label, CAST(count(f.facility_id) AS INTEGER) AS count, tier FROM {BUCKETS}
  LEFT JOIN fs f ON score IS NOT NULL AND CAST(round(score * 100) AS INTEGER) BETWEEN low AND high
  GROUP BY position, label, tier""", "fs")
TIER_COUNTS = ", ".join(f"CAST(count(CASE WHEN {c} THEN 1 END) AS INTEGER) AS {n}_count" for n, c in (
    ("high", "score >= 0.7"), ("med", "score >= 0.4 AND score < 0.7"), ("low", "score < 0.4"), ("insuff", "score IS NULL")))
oracle("dash_tiers", f"SELECT {TIER_COUNTS}, CAST(count(*) AS INTEGER) AS total FROM fs", "fs")
oracle("dash_dims", """SELECT position, d.dim, avg FROM (VALUES (1, 'capability'), (2, 'equipment'), (3, 'procedure'),
  (4, 'completeness')) d(position, dim) LEFT JOIN (SELECT dimension AS dim, CAST(round(round(avg(trust_score), 9) * 100) AS INTEGER) AS avg
  FROM signals WHERE trust_score IS NOT NULL GROUP BY 1) m ON m.dim = d.dim""", "signals")
oracle("dash_types", """SELECT facility_type AS type, CAST(count(*) AS INTEGER) AS count,
  CAST(sum(has_contradiction) AS INTEGER) AS contradictions FROM fs WHERE facility_type IS NOT NULL GROUP BY 1
  ORDER BY count DESC, type LIMIT 8""", "fs")
oracle("dash_top_bottom", """
, top AS (SELECT *, 'top' AS "end" FROM fs WHERE score IS NOT NULL
    ORDER BY score DESC, facility_name NULLS FIRST, facility_id LIMIT 3),
bottom AS (SELECT *, 'bottom' AS "end" FROM fs WHERE score IS NOT NULL
    ORDER BY score, facility_name NULLS FIRST, facility_id LIMIT 3)
SELECT *, CAST(round(score * 100) AS INTEGER) AS points FROM (SELECT * FROM top UNION ALL SELECT * FROM bottom)""", "fs")

INT_SCORE = "CAST(round(CASE WHEN trust_score <= 1 THEN trust_score * 100 ELSE trust_score END) AS INTEGER)"
part("usable", f"""SELECT *, {INT_SCORE} AS points FROM signals
  WHERE confidence_tier <> 'insufficient_data' AND trust_score IS NOT NULL""", "signals")
part("simple", "SELECT facility_id, CAST(round(avg(points)) AS INTEGER) AS score FROM usable GROUP BY 1", "usable")
part("plain_rows", """SELECT f.facility_id, facility_name, facility_type, has_contradiction, s.score AS points
  FROM fs f LEFT JOIN simple s ON s.facility_id = f.facility_id""", "fs", "simple")
oracle("simple_scores", "SELECT * FROM simple", "simple")
oracle("dash_signal_summary", """SELECT CAST(count(*) AS INTEGER) AS total,
  CAST(count(CASE WHEN has_contradiction = 1 THEN 1 END) AS INTEGER) AS contradiction_count,
  CAST(count(CASE WHEN points >= 70 THEN 1 END) AS INTEGER) AS high_count,
  CAST(count(CASE WHEN points >= 40 AND points < 70 THEN 1 END) AS INTEGER) AS med_count,
  CAST(count(CASE WHEN points < 40 THEN 1 END) AS INTEGER) AS low_count,
  CAST(count(CASE WHEN points IS NULL THEN 1 END) AS INTEGER) AS insuff_count,
  (SELECT CAST(round(avg(points)) AS INTEGER) FROM usable) AS avg_score FROM plain_rows""", "plain_rows", "usable")
oracle("dash_signal_histogram", f"""SELECT position, label, CAST(count(f.facility_id) AS INTEGER) AS count, tier
  FROM {BUCKETS} LEFT JOIN plain_rows f ON points BETWEEN low AND high GROUP BY position, label, tier""", "plain_rows")
oracle("dash_signal_dims", """SELECT position, d.dim, avg FROM (VALUES (1, 'capability'), (2, 'equipment'), (3, 'procedure'),
  (4, 'completeness')) d(position, dim) LEFT JOIN (SELECT dimension AS dim, CAST(round(avg(points)) AS INTEGER) AS avg
  FROM usable GROUP BY 1) m ON m.dim = d.dim""", "usable")
oracle("dash_signal_types", """SELECT facility_type AS type, CAST(count(*) AS INTEGER) AS count,
  CAST(count(CASE WHEN has_contradiction = 1 THEN 1 END) AS INTEGER) AS contradictions FROM plain_rows
  WHERE facility_type IS NOT NULL GROUP BY 1""", "plain_rows")
oracle("dash_signal_top", """SELECT * FROM plain_rows WHERE points IS NOT NULL ORDER BY points DESC, facility_id LIMIT 3""",
       "plain_rows")
oracle("dash_signal_bottom", """SELECT * FROM plain_rows WHERE points IS NOT NULL ORDER BY points, facility_id DESC LIMIT 3""",
       "plain_rows")
oracle("stats_totals", """SELECT CAST(count(DISTINCT g.unique_id) AS INTEGER) AS total_facilities,
  CAST(count(DISTINCT CASE WHEN t.contradiction THEN g.unique_id END) AS INTEGER) AS contradiction_count
  FROM gold g LEFT JOIN signals t ON g.unique_id = t.facility_id""", "gold", "signals")
oracle("stats_tiers", f"""SELECT {', '.join(f"CAST(round({n}_count * 100.0 / greatest(total, 1)) AS INTEGER) AS {a}" for n, a in (
    ('high', 'high_trust_pct'), ('med', 'med_trust_pct'), ('low', 'low_trust_pct'), ('insuff', 'insuff_pct')))}
  FROM (SELECT {TIER_COUNTS}, count(*) AS total FROM fs)""", "fs")
part("dim_means", """SELECT dimension, round(round(avg(trust_score), 9) * 100, 1) AS avg_score FROM signals
  WHERE trust_score IS NOT NULL GROUP BY 1""", "signals")
oracle("stats_dims", "SELECT * FROM dim_means", "dim_means")
oracle("stats_dim_range", """SELECT (SELECT dimension FROM dim_means ORDER BY avg_score DESC, dimension LIMIT 1) AS top_dimension,
  (SELECT dimension FROM dim_means ORDER BY avg_score, dimension DESC LIMIT 1) AS bottom_dimension""", "dim_means")
oracle("stats_top_type", """SELECT facility_type_id AS facility_type, CAST(count(DISTINCT unique_id) AS INTEGER) AS total,
  CAST(count(DISTINCT CASE WHEN t.contradiction THEN unique_id END) AS INTEGER) AS contradictions
  FROM gold g LEFT JOIN signals t ON g.unique_id = t.facility_id WHERE facility_type_id IS NOT NULL GROUP BY 1
  HAVING count(DISTINCT unique_id) > 2 ORDER BY contradictions / total DESC, facility_type LIMIT 1""", "gold", "signals")

# --- search -------------------------------------------------------------------------------------------
oracle("filter_options", """SELECT DISTINCT 'state' AS kind, address_state_or_region AS value FROM gold
  WHERE address_state_or_region IS NOT NULL
  UNION ALL SELECT DISTINCT 'type', facility_type_id FROM gold WHERE facility_type_id IS NOT NULL""", "gold")
FOUND = "facility_id, facility_name, state, facility_type, score AS overall_trust_score, has_contradiction, signal_count"
oracle("search", f"SELECT {FOUND} FROM fs ORDER BY score DESC NULLS LAST, facility_id LIMIT 25", "fs")
oracle("search_filtered", f"""SELECT {FOUND} FROM fs JOIN gold ON unique_id = facility_id
  WHERE (lower(facility_name) LIKE '%care%' OR lower(description) LIKE '%care%' OR lower(state) LIKE '%care%'
         OR lower(capability) LIKE '%care%')
  AND facility_type = 'clinic' AND coalesce(score, 0) >= 0.05 ORDER BY facility_name NULLS LAST, facility_id LIMIT 50""",
       "fs", "gold")
oracle("search_contradictions", f"""SELECT {FOUND}, {POINTS} AS completeness FROM fs JOIN gold ON unique_id = facility_id
  WHERE state = 'NATION_1' AND has_contradiction = 1 AND score < 0.4
  ORDER BY completeness DESC, facility_id LIMIT 25""", "fs", "gold")
HAS = "(" + " OR ".join(f"lower({c}) LIKE '%l%side_c%'" for c in ("name", "description", "address_state_or_region", "capability")) + ")"
oracle("search_indexed", f"""SELECT 'wild' AS term, unique_id, name FROM gold WHERE {HAS}
  UNION ALL SELECT 'short', unique_id, name FROM gold WHERE lower(name) LIKE '%_9%'""", "gold")
oracle("search_deep", f"SELECT {FOUND} FROM fs ORDER BY score DESC NULLS LAST, facility_id LIMIT 20 OFFSET 40", "fs")
oracle("search_after", f"""SELECT {FOUND} FROM fs WHERE score IS NULL OR score < 0.6
  OR score = 0.6 AND facility_id > '80000000-0000-0000-0000-000000000000'
  ORDER BY score DESC NULLS LAST, facility_id LIMIT 25""", "fs")
oracle("search_stored_order", """SELECT facility_id, facility_name, score AS overall_trust_score FROM fs
  ORDER BY facility_name NULLS LAST, facility_id LIMIT 30 OFFSET (SELECT count(*) // 2 FROM fs)""", "fs")
oracle("search_bound_sql", "SELECT unique_id, name FROM gold WHERE address_state_or_region = 'NATION_3'", "gold")
SAMPLE_ID = "'c4ca4238-a0b9-2382-0dcc-509a6f75849b'"
oracle("detail", f"""SELECT {FOUND}, address_city AS district, description, capability, procedure, equipment, capacity,
  year_established, number_doctors, official_phone, email, official_website, address_line1, overridden_fields
  FROM fs JOIN gold ON unique_id = facility_id WHERE facility_id = {SAMPLE_ID}""", "fs", "gold")
oracle("detail_signals", f"SELECT * EXCLUDE (extracted_day) FROM signals WHERE facility_id = {SAMPLE_ID}", "signals")

# --- signals ------------------------------------------------------------------------------------------
part("raw", """SELECT unique_id AS facility_id, name AS facility_name, organization_type AS facility_type,
  address_stateOrRegion AS state, description, capability, procedure, equipment, capacity,
  yearEstablished AS year_established FROM src WHERE unique_id IS NOT NULL""", "src")
oracle("worklist", """SELECT facility_id, facility_name FROM raw
  WHERE facility_id NOT IN (SELECT DISTINCT facility_id FROM signals)""", "raw", "signals")
oracle("prompt", """SELECT facility_id, 'Judge how well the texts of this record support what it claims, for the dimensions '
  || 'capability, equipment, procedure, completeness. Quote evidence word for word. Answer with one JSON object '
  || '{"dimensions": [...]} whose items have the keys dimension, trust_score, confidence_tier, evidence_text, '
  || 'source_field, contradiction, contradiction_detail.' || """ + " || ".join(
    [f"chr(10) || '{c}: ' || coalesce({c}, 'N/A')" for c in ("facility_id", "facility_type", "state")]
    + [f"chr(10) || '{c}: ' || coalesce({c}, 'NOT PROVIDED')" for c in ("capacity", "year_established")]
    + [f"chr(10) || '{c}: ' || coalesce({c}, '')" for c in ("description", "capability", "procedure", "equipment")])
    + " AS prompt FROM raw", "raw")


def ruled(c):
    clash = f"(contains(lower({c}), 'surgery') AND coalesce(facility_type, '') = 'NGO')"
    return f"""SELECT facility_id, '{c}' AS dimension, CASE WHEN {c} IS NOT NULL THEN CAST(least(length({c}), 100) AS DOUBLE) / 100 END AS trust_score,
      CASE WHEN {c} IS NULL THEN 'insufficient_data' WHEN length({c}) >= 70 THEN 'high' WHEN length({c}) >= 40 THEN 'medium'
        ELSE 'low' END AS confidence_tier, {c} AS evidence_text,
      CASE WHEN {c} IS NOT NULL THEN '{c}' END AS source_field, coalesce({clash}, false) AS contradiction,
      CASE WHEN {clash} THEN 'surgery is not expected here' END AS contradiction_detail, 'primary' AS extraction_model
      FROM raw"""


oracle("model_score", " UNION ALL ".join(ruled(c) for c in ("capability", "equipment", "procedure"))
       + """ UNION ALL SELECT facility_id, 'completeness', NULL, 'insufficient_data', NULL, NULL, false, NULL, 'primary'
       FROM raw""", "raw")
part("judged", """SELECT *, CASE WHEN raw_response IS NULL THEN 'no response'
    WHEN items IS NULL THEN 'response has no dimensions'
    WHEN len(list_filter(items, lambda i: i->>'dimension' IS NULL OR i->>'confidence_tier' IS NULL)) > 0
      THEN 'dimension or confidence_tier is missing'
    WHEN len(list_filter(items, lambda i: i->>'trust_score' IS NOT NULL AND TRY_CAST(i->>'trust_score' AS DOUBLE) IS NULL)) > 0
      THEN 'trust_score is not a number'
    WHEN len(list_filter(items, lambda i: i->>'dimension' IN ('capability', 'equipment', 'procedure', 'completeness'))) = 0
      THEN 'no usable dimension' END AS problem
  FROM (SELECT *, CASE WHEN json_valid(raw_response) AND json_exists(CASE WHEN json_valid(raw_response) THEN raw_response END, '$.dimensions')
    THEN CAST(json_extract(CASE WHEN json_valid(raw_response) THEN raw_response END, '$.dimensions') AS JSON[]) END AS items
  FROM responses)""", "responses")
oracle("signals_errors", """SELECT facility_id, problem AS error_message, coalesce(raw_response, '') AS raw_response
  FROM judged WHERE problem IS NOT NULL""", "judged")
oracle("signals_parse", """SELECT facility_id, i->>'dimension' AS dimension, CAST(i->>'trust_score' AS DOUBLE) AS trust_score,
  i->>'confidence_tier' AS confidence_tier, i->>'evidence_text' AS evidence_text, i->>'source_field' AS source_field,
  coalesce(i->>'contradiction' = 'true', false) AS contradiction, i->>'contradiction_detail' AS contradiction_detail,
  extraction_model
  FROM (SELECT facility_id, extraction_model, unnest(items) AS i FROM judged WHERE problem IS NULL)
  WHERE i->>'dimension' IN ('capability', 'equipment', 'procedure', 'completeness')""", "judged")
part("latest", """SELECT * FROM signals QUALIFY row_number() OVER (PARTITION BY facility_id, dimension
  ORDER BY extracted_day DESC, trust_score DESC NULLS LAST, evidence_text ASC NULLS LAST) = 1""", "signals")
oracle("signals_latest", "SELECT facility_id, dimension, trust_score, confidence_tier, evidence_text FROM latest", "latest")
COVERED = ["description", "capability", "procedure", "equipment", "year_established", "capacity", "number_doctors", "email"]
part("cover", " UNION ALL ".join(
    f"SELECT '{c}' AS field, round(avg(CASE WHEN trim(CAST({c} AS VARCHAR)) <> '' THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM silver"
    for c in COVERED), "silver")
oracle("coverage", "SELECT * FROM cover", "cover")
oracle("coverage_guard", """SELECT facility_id, dimension, CASE WHEN field IS NULL THEN trust_score END AS trust_score,
  CASE WHEN field IS NULL THEN confidence_tier ELSE 'insufficient_data' END AS confidence_tier,
  CASE WHEN field IS NULL THEN evidence_text ELSE 'Only ' || CAST(round(coverage * 100) AS INTEGER)
    || '% of the records fill in ' || field || '; too few to rest on' END AS evidence_text,
  source_field, contradiction, contradiction_detail, extraction_model
  FROM signals LEFT JOIN cover ON field = source_field AND coverage < 0.5""", "signals", "cover")
NAMED_FIELD = "CASE source_field " + " ".join(f"WHEN '{c}' THEN CAST({c} AS VARCHAR)" for c in (
    "description", "capability", "procedure", "equipment", "capacity", "year_established")) + " END"
part("grounding", f"""SELECT *, grounding = 'grounded' AS grounded FROM (SELECT facility_id, dimension, source_field, evidence_text,
    contradiction, contradiction_detail, CASE WHEN evidence_text IS NULL THEN 'no_evidence' WHEN source_field IS NULL
    THEN 'no_field' WHEN {NAMED_FIELD} IS NULL THEN 'field_empty' WHEN contains({NAMED_FIELD}, evidence_text) THEN 'grounded'
    ELSE 'not_in_field' END AS grounding FROM signals JOIN gold ON unique_id = facility_id)""", "signals", "gold")
oracle("evidence_grounding", """SELECT facility_id, dimension, source_field, evidence_text, grounding, grounded
  FROM grounding""", "grounding")
oracle("contradiction_severity", """SELECT facility_id, dimension, contradiction_detail, CASE WHEN contradiction_detail IS NULL
  THEN 'LOW' WHEN grounded THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM grounding WHERE contradiction""", "grounding")
part("newest", """SELECT * FROM signals QUALIFY row_number() OVER (PARTITION BY facility_id, dimension
  ORDER BY extracted_day DESC, coalesce(trust_score, -1) DESC, trust_score DESC NULLS LAST, confidence_tier DESC) = 1""", "signals")
DIMS = "(VALUES ('capability'), ('equipment'), ('procedure'), ('completeness'))"
oracle("score_bands", f"""SELECT r.facility_id, d.dimension, {INT_SCORE} AS score,
  coalesce(confidence_tier, 'insufficient_data') AS confidence_tier
  FROM (SELECT DISTINCT facility_id FROM signals) r CROSS JOIN {DIMS} d(dimension)
  LEFT JOIN newest n ON n.facility_id = r.facility_id AND n.dimension = d.dimension""", "newest", "signals")
part("quotes", """SELECT facility_id, max(CASE WHEN dimension = 'capability' THEN evidence_text END) AS capability_quote,
  max(CASE WHEN dimension = 'equipment' THEN evidence_text END) AS equipment_quote,
  max(CASE WHEN dimension = 'procedure' THEN evidence_text END) AS procedure_quote
  FROM (SELECT * FROM signals QUALIFY row_number() OVER (PARTITION BY facility_id, dimension ORDER BY extracted_day DESC,
    coalesce(trust_score, -1) DESC, evidence_text DESC NULLS LAST) = 1) GROUP BY 1""", "signals")


def shown(c):
    items = f"list_filter(list_transform({json_list(c)}, lambda x: coalesce(x, 'null')), lambda x: x <> '')"
    return f"""coalesce(CASE WHEN starts_with(ltrim({c}), '[') AND json_valid({c}) THEN
      CASE WHEN len({items}) > 0 THEN array_to_string({items}, ', ') END WHEN {c} <> '' THEN {c} END, {c}_quote)"""


part("shown", f"""SELECT g.* EXCLUDE (capability, equipment, procedure, capacity), g.unique_id AS facility_id,
  {shown('capability')} AS capability, {shown('equipment')} AS equipment, {shown('procedure')} AS procedure, g.capacity
  FROM gold g LEFT JOIN quotes q ON q.facility_id = g.unique_id""", "gold", "quotes")
PROFILE = [
    ("Facility Name", "name", "Identity"), ("City", "address_city", "Identity"),
    ("State", "address_state_or_region", "Identity"), ("Facility Type", "facility_type_id", "Identity"),
    ("Phone", "official_phone", "Identity"), ("Email", "email", "Identity"), ("Website", "official_website", "Identity"),
    ("Address", "address_line1", "Identity"), ("Description", "description", "Identity"),
    ("Capability", "capability", "Clinical"), ("Equipment", "equipment", "Clinical"),
    ("Procedure", "procedure", "Clinical"), ("Bed Capacity", "capacity", "Capacity"),
    ("Doctors", "number_doctors", "Capacity"), ("Year Established", "year_established", "Capacity")]
oracle("field_profile", " UNION ALL ".join(
    f"SELECT facility_id, {n} AS position, '{label}' AS label, '{c}' AS field_name, '{category}' AS category, "
    f"CAST({c} AS VARCHAR) AS value, {c + ' IS NULL' if category == 'Capacity' else 'false'} AS missing FROM shown"
    for n, (label, c, category) in enumerate(PROFILE, 1)), "shown")
part("marks", f"""
SELECT facility_id, dimension, source_field AS field_name,
  CASE WHEN confidence_tier = 'insufficient_data' THEN 'insufficient' WHEN contradiction THEN 'contradiction' ELSE 'evidence' END AS type,
  value AS text, CASE WHEN contains(value, quote) THEN quote ELSE value END AS match,
  CASE WHEN confidence_tier <> 'insufficient_data' AND contradiction THEN coalesce(contradiction_detail, quote) ELSE quote END AS bubble,
  CASE WHEN confidence_tier <> 'insufficient_data' AND NOT contradiction THEN {INT_SCORE} END AS score
FROM (SELECT s.*, v.value, coalesce(evidence_text, v.value) AS quote FROM signals s JOIN (
    SELECT facility_id, 'capability' AS field, capability AS value FROM shown UNION ALL
    SELECT facility_id, 'equipment', equipment FROM shown UNION ALL SELECT facility_id, 'procedure', procedure FROM shown
    UNION ALL SELECT facility_id, 'capacity', CAST(capacity AS VARCHAR) FROM shown) v
  ON v.facility_id = s.facility_id AND v.field = s.source_field WHERE v.value <> '')
UNION ALL
SELECT facility_id, dimension, 'description', 'contradiction', description,
  CASE WHEN contains(description, quote) THEN quote ELSE description END, contradiction_detail, NULL
FROM (SELECT s.*, description, CASE WHEN regexp_extract(contradiction_detail, '"([^"]+)"', 1) <> ''
    THEN regexp_extract(contradiction_detail, '"([^"]+)"', 1)
    WHEN regexp_extract(contradiction_detail, '''([^'']+)''', 1) <> ''
    THEN regexp_extract(contradiction_detail, '''([^'']+)''', 1) END AS quote
  FROM signals s JOIN gold ON unique_id = facility_id
  WHERE contradiction AND contradiction_detail <> '' AND description <> '')""", "signals", "shown", "gold")
oracle("highlights", "SELECT * FROM marks", "marks")
# walk the matches of a field from left to right; the end of the last kept match decides what is skipped
ORACLES["segments"] = with_parts("""
, spots AS (SELECT facility_id, field_name, text, instr(text, match) AS pos, length(match) AS size,
    row_number() OVER (PARTITION BY facility_id, field_name ORDER BY instr(text, match), length(match) DESC) AS n
  FROM (SELECT DISTINCT facility_id, field_name, text, match FROM marks WHERE match <> '') WHERE instr(text, match) > 0),
walk AS (
  SELECT facility_id, field_name, text, n, pos, size, true AS kept, pos + size AS reach, 1 AS before FROM spots WHERE n = 1
  UNION ALL
  SELECT s.facility_id, s.field_name, s.text, s.n, s.pos, s.size, s.pos >= w.reach,
    CASE WHEN s.pos >= w.reach THEN s.pos + s.size ELSE w.reach END, w.reach
  FROM walk w JOIN spots s ON s.facility_id = w.facility_id AND s.field_name = w.field_name AND s.n = w.n + 1),
pieces AS (
  SELECT facility_id, field_name, before AS pos, 'plain' AS kind, substr(text, before, pos - before) AS text
    FROM walk WHERE kept AND pos > before
  UNION ALL SELECT facility_id, field_name, pos, 'highlight', substr(text, pos, size) FROM walk WHERE kept
  UNION ALL SELECT facility_id, field_name, max(reach), 'plain', substr(any_value(text), max(reach)) FROM walk
    GROUP BY 1, 2 HAVING max(reach) <= length(any_value(text)))
SELECT facility_id, field_name, CAST(row_number() OVER (PARTITION BY facility_id, field_name ORDER BY pos) AS INTEGER)
  AS position, kind, text FROM pieces""", "marks", recursive=True)
oracle("lowest_tier", """SELECT facility_id, ['high', 'medium', 'low', 'insufficient_data'][CAST(max(CASE confidence_tier WHEN 'high' THEN 1
  WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'insufficient_data' THEN 4 END) AS INTEGER)] AS lowest_tier FROM signals GROUP BY 1""",
       "signals")
oracle("extraction_report", """SELECT records, covered, round(covered * 100.0 / greatest(records, 1), 1) AS coverage_pct,
  signal_rows, errors, contradictions, insufficient, covered > records * 0.95 AS passed
  FROM (SELECT (SELECT count(*) FROM raw) AS records, (SELECT count(DISTINCT facility_id) FROM signals) AS covered,
    (SELECT count(*) FROM signals) AS signal_rows, (SELECT count(*) FROM judged WHERE problem IS NOT NULL) AS errors,
    (SELECT count(*) FROM signals WHERE contradiction) AS contradictions,
    (SELECT count(*) FROM signals WHERE confidence_tier = 'insufficient_data') AS insufficient)""", "raw", "signals", "judged")
oracle("report_dimensions", """SELECT dimension, round(avg(round(trust_score * 100)), 6) AS avg_score FROM signals
  WHERE trust_score IS NOT NULL GROUP BY 1""", "signals")
oracle("contradiction_sample", """SELECT facility_id, dimension, contradiction_detail FROM signals WHERE contradiction
  ORDER BY facility_id, dimension, contradiction_detail NULLS FIRST LIMIT 5""", "signals")
oracle("missing_signals", """SELECT facility_id FROM raw r WHERE NOT EXISTS (
  SELECT 1 FROM signals s WHERE s.facility_id = r.facility_id)""", "raw", "signals")

# --- analyst state ------------------------------------------------------------------------------------


def newest_actions(keys, rows="actions"):
    return f"""SELECT * FROM (SELECT * REPLACE (coalesce(dimension, '') AS dimension) FROM {rows})
      QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY updated_at DESC, seq DESC) = 1"""


part("acted", newest_actions("facility_id, analyst_id, action_type, dimension"), "actions")
oracle("latest_actions", "SELECT facility_id, analyst_id, action_type, dimension, content, override_score, seq FROM acted",
       "acted")
oracle("stream_latest", """SELECT facility_id, analyst_id, action_type, content, seq FROM actions
  QUALIFY row_number() OVER (PARTITION BY facility_id, analyst_id, action_type ORDER BY updated_at DESC, seq DESC) = 1""", "actions")
for _name, _flag in (("action_counts", "content = 'flagged'"), ("action_counts_any_reason", "trim(content) <> ''")):
    oracle(_name, f"""SELECT CAST(count(DISTINCT CASE WHEN action_type = 'shortlist' AND content = 'added' THEN facility_id END)
        AS INTEGER) AS shortlisted_count,
      CAST(count(DISTINCT CASE WHEN action_type = 'flag' AND {_flag} THEN facility_id END) AS INTEGER) AS flagged_count
      FROM ({newest_actions("facility_id, action_type, dimension")})""", "actions")
part("state", """SELECT facility_id, analyst_id,
  coalesce(bool_or(action_type = 'shortlist' AND content = 'added'), false) AS shortlisted,
  coalesce(bool_or(action_type = 'flag' AND content = 'flagged'), false) AS flagged,
  max(CASE WHEN action_type = 'note' THEN content END) AS note FROM acted GROUP BY 1, 2""", "acted")
oracle("review_queue", """SELECT analyst_id, list, s.facility_id, facility_name, state, facility_type, score, note, has_contradiction
  FROM (SELECT *, 'flagged' AS list FROM state WHERE flagged UNION ALL SELECT *, 'shortlisted' FROM state WHERE shortlisted) s
  JOIN fs ON fs.facility_id = s.facility_id""", "state", "fs")
oracle("search_state", """SELECT fs.facility_id, coalesce(bool_or(shortlisted), false) AS shortlisted,
  coalesce(bool_or(flagged), false) AS flagged, coalesce(bool_or(note IS NOT NULL), false) AS has_note
  FROM fs LEFT JOIN state s ON s.facility_id = fs.facility_id GROUP BY 1""", "fs", "state")
STATUSES = "('not_started', 'in_progress', 'email_sent', 'called', 'parked', 'validation_complete')"
MOVE_ERROR = f"""CASE WHEN status IS NULL OR status NOT IN {STATUSES} THEN 'unknown status'
  WHEN status = 'parked' AND trim(coalesce(parked_reason, '')) = '' THEN 'parked needs a reason' END"""
oracle("move_validation", f"SELECT seq, status, parked_reason, {MOVE_ERROR} AS error FROM review_log", "review_log")
part("review", f"""SELECT * FROM review_log WHERE ({MOVE_ERROR}) IS NULL
  QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY updated_at DESC, seq DESC) = 1""", "review_log")
part("cards", """SELECT r.facility_id, coalesce(g.name, r.facility_id) AS facility_name, facility_type_id AS facility_type,
  address_state_or_region AS state, status, parked_reason, assigned_to, notes, updated_by
  FROM review r LEFT JOIN gold g ON g.unique_id = r.facility_id""", "review", "gold")
part("waiting", "SELECT * FROM gold WHERE unique_id NOT IN (SELECT facility_id FROM review)", "gold", "review")
oracle("board_columns", """SELECT * FROM cards UNION ALL SELECT unique_id, name, facility_type_id, address_state_or_region,
  'not_started', NULL, NULL, NULL, NULL FROM waiting""", "cards", "waiting")
oracle("board_unstarted_all", """SELECT unique_id AS facility_id, name AS facility_name, 'not_started' AS status FROM gold""", "gold")
oracle("board_assignee", "SELECT * FROM cards WHERE status = 'parked' AND assigned_to = 'analyst-2'", "cards")
oracle("board_counts", """SELECT position, s.status, CASE WHEN s.status = 'not_started' THEN (SELECT count(*) FROM waiting)
    + (SELECT count(*) FROM review r WHERE r.status = s.status)
    ELSE (SELECT count(*) FROM review r WHERE r.status = s.status) END AS cards
  FROM (VALUES (1, 'not_started'), (2, 'in_progress'), (3, 'email_sent'), (4, 'called'), (5, 'parked'),
    (6, 'validation_complete')) s(position, status)""", "review", "waiting")
ACTION_ERROR = """CASE WHEN action_type IS NULL OR action_type NOT IN ('note', 'override', 'shortlist', 'flag') THEN 'unknown action type'
  WHEN action_type = 'override' AND trim(coalesce(content, '')) = '' THEN 'override needs a reason'
  WHEN action_type = 'override' AND (override_score IS NULL OR override_score < 0 OR override_score > 100)
    THEN 'override score must be 0 to 100'
  WHEN action_type = 'flag' AND trim(coalesce(content, '')) = '' THEN 'flag needs a reason' END"""
oracle("action_validation", f"SELECT action_id, action_type, content, override_score, {ACTION_ERROR} AS error FROM actions",
       "actions")
oracle("suggestions_apply", """SELECT facility_id, field_name, suggested_value AS new_value, 'analyst-1' AS analyst_id,
  'LLM cleanup from bronze: ' || reason AS reason FROM suggestions""", "suggestions")
oracle("changed_ids", "SELECT DISTINCT facility_id FROM overrides WHERE updated_at > TIMESTAMP '2001-01-01'", "overrides")
# recomputing the changed records from the full log gives the scores over the full log
oracle("rescore", "SELECT * FROM fs", "fs")
oracle("rescore_stored", "SELECT * FROM fs", "fs")
oracle("score_overrides", f"""
, fixes AS ({newest_actions("facility_id, dimension", f"(SELECT * FROM actions WHERE action_type = 'override' AND ({ACTION_ERROR}) IS NULL)")})
SELECT s.facility_id, s.dimension, coalesce(f.override_score / 100, s.trust_score) AS trust_score,
  f.override_score IS NOT NULL AS overridden, confidence_tier, evidence_text
FROM signals s LEFT JOIN fixes f ON f.facility_id = s.facility_id AND f.dimension = s.dimension""", "signals", "actions")

# --- outreach -----------------------------------------------------------------------------------------
part("reachable", f"""SELECT b.*, q.quality_score, q.issues FROM (SELECT unique_id, name, address_city, address_stateOrRegion,
    lower(trim(email)) AS email FROM src WHERE NOT {missing('email')} AND regexp_matches(lower(trim(email)), {EMAIL})) b
  LEFT JOIN scores q ON q.facility_id = trim(b.unique_id)""", "src", "scores")


part("rollup", """SELECT r.email, count(DISTINCT unique_id) AS facility_count, min(name) AS first_name,
  min(nullif(address_stateOrRegion, '')) AS first_state, count(DISTINCT unique_id) > 1 AS is_shared,
  min(quality_score) AS min_quality_score, CAST(round(avg(quality_score)) AS INTEGER) AS avg_quality_score,
  coalesce(any_value(i.issues), '') AS issues
  FROM reachable r LEFT JOIN (SELECT email, string_agg(DISTINCT issue, '|' ORDER BY issue) AS issues
    FROM (SELECT email, unnest(string_split(issues, '|')) AS issue FROM reachable) GROUP BY 1) i ON i.email = r.email
  GROUP BY 1""", "reachable")
oracle("outreach_rollup", "SELECT * FROM rollup", "rollup")
oracle("outreach_lists", " UNION ".join(
    f"SELECT email, '{name}' AS list, {c} AS value FROM reachable WHERE {c} IS NOT NULL" for name, c in (
        ("facility_ids", "unique_id"), ("facility_names", "name"), ("states", "address_stateOrRegion"), ("cities", "address_city")))
    + """ UNION SELECT email, 'issues', issue FROM (SELECT email, unnest(string_split(issues, '|')) AS issue FROM reachable)
  WHERE issue IS NOT NULL""", "reachable")
oracle("outreach_draft", """
SELECT email, 'Hello,' || chr(10) || chr(10) || 'my name is Maya and I help the directory team keep its directory of health facilities correct.'
  || chr(10) || chr(10) || 'This address is listed for ' || CASE WHEN first_name IS NULL THEN 'your facility' WHEN facility_count <= 1
    THEN first_name ELSE facility_count || ' facilities including ' || first_name END
  || coalesce(' in ' || first_state, '')
  || '. Could you confirm or correct a few details?' || CASE WHEN issues = '' THEN '' ELSE chr(10) || chr(10)
    || 'These points need a look:' || chr(10) || '  - ' || replace(issues, '|', chr(10) || '  - ') END
  || chr(10) || chr(10) || 'A short reply is enough. Thank you for your help.' || chr(10) || chr(10) || 'Kind regards,' || chr(10)
  || 'Maya' || chr(10) || 'the directory team' AS draft FROM rollup""", "rollup")

# --- geography ----------------------------------------------------------------------------------------
oracle("pin_enrich", f"""
, pins AS (SELECT pincode, count(*) AS office_count, count(DISTINCT district || '/' || statename) AS places, min(district) AS d,
  min(statename) AS s, round(avg({as_double('latitude')}), 6) AS pin_latitude,
  round(avg({as_double('longitude')}), 6) AS pin_longitude FROM postal GROUP BY 1)
SELECT unique_id, address_zip_or_postcode, office_count, places > 1 AS is_ambiguous, CASE WHEN places = 1 THEN d END AS pin_district,
  CASE WHEN places = 1 THEN s END AS pin_state, pin_latitude, pin_longitude
FROM gold LEFT JOIN pins ON pincode = address_zip_or_postcode""", "gold", "postal")
part("figures", f"""SELECT {key('district_name')} AS district_key, CAST(nullif(regexp_replace(trim(burden), '[()]', '', 'g'), '*') AS DOUBLE) AS burden,
  starts_with(trim(burden), '(') AS burden_low_sample, suppliers FROM indicators""", "indicators")
oracle("indicator_join", f"""SELECT unique_id, address_city, {key('address_city')} AS district_key, burden, burden_low_sample, suppliers
  FROM gold LEFT JOIN figures f ON f.district_key = {key('address_city')}""", "gold", "figures")
oracle("unmatched_districts", f"""SELECT {key('address_city')} AS district_key, count(*) AS records FROM gold
  WHERE address_city IS NOT NULL AND {key('address_city')} NOT IN (SELECT district_key FROM figures) GROUP BY 1""",
       "gold", "figures")
oracle("district_rank", f"""
, counted AS (SELECT {key('address_city')} AS k, count(*) AS n FROM gold GROUP BY 1)
SELECT district_key, burden, burden_low_sample, coalesce(n, 0) AS facilities,
  CAST(rank() OVER (ORDER BY burden DESC NULLS LAST, coalesce(n, 0)) AS INTEGER) AS rank
FROM figures LEFT JOIN counted ON k = district_key""", "figures", "gold")
EDGES = " UNION ALL ".join(
    "SELECT n_name AS district, {0} AS x1, {1} AS y1, {2} AS x2, {3} AS y2 FROM nation".format(*v.corner(i), *v.corner(i + 1))
    for i in range(len(v.CORNERS)))
oracle("point_in_polygon", f"""
, edges AS ({EDGES}), points AS (SELECT DISTINCT latitude, longitude FROM gold),
hits AS (SELECT p.latitude, p.longitude, district FROM points p, edges
  WHERE (y1 > p.latitude) <> (y2 > p.latitude) AND p.longitude < (x2 - x1) * (p.latitude - y1) / (y2 - y1) + x1
  GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)
SELECT unique_id, g.latitude, g.longitude, district FROM gold g JOIN hits h ON h.latitude = g.latitude AND h.longitude = g.longitude""",
       "gold")

SCALED = [("0", "0", "1"), ("4", "1", "0.25"), ("4", "7", "0.125")]
HOLED = " UNION ALL ".join(
    "SELECT n_name AS district, " + ", ".join(
        f"CAST({v.X0 if axis == 0 else v.Y0} + {v.CORNERS[(i + k) % len(v.CORNERS)][axis]} * {size} + {(dx, dy)[axis]} AS DOUBLE) AS {name}"
        for k, axis, name in ((0, 0, "x1"), (0, 1, "y1"), (1, 0, "x2"), (1, 1, "y2"))) + " FROM nation"
    for dx, dy, size in SCALED for i in range(len(v.CORNERS)))
oracle("point_in_holes", f"""
, edges AS ({HOLED}), points AS (SELECT DISTINCT latitude, longitude FROM gold),
hits AS (SELECT p.latitude, p.longitude, district FROM points p, edges
  WHERE (y1 > p.latitude) <> (y2 > p.latitude) AND p.longitude < (x2 - x1) * (p.latitude - y1) / (y2 - y1) + x1
  GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)
SELECT unique_id, g.latitude, g.longitude, district FROM gold g JOIN hits h ON h.latitude = g.latitude AND h.longitude = g.longitude""",
       "gold")

# --- operators of the starter texts -------------------------------------------------------------------
part("history", """SELECT user_id, ts, event_id, value, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete'
  ELSE 'update' END AS op FROM events""")
oracle("cdc_current", """SELECT user_id, event_id, value, op FROM (SELECT * FROM history QUALIFY row_number() OVER (
  PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE op <> 'delete'""", "history")
oracle("scd2", """SELECT user_id, event_id, CAST(ts AS VARCHAR) AS valid_from,
  CAST(lead(ts) OVER w AS VARCHAR) AS valid_to, lead(true) OVER w IS NULL AS is_current
  FROM (SELECT * REPLACE (CASE WHEN event_id % 97 = 5 THEN NULL ELSE user_id END AS user_id,
    CASE WHEN event_id % 101 = 7 THEN NULL ELSE ts END AS ts) FROM history)
  WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id)""", "history")
TOPK = """
SELECT query_id, match_id, round(similarity, 5) AS similarity, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, match_id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id AS match_id,
      round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS similarity
    FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0))
WHERE rank <= 5"""
oracle("cosine_topk", TOPK)
oracle("cosine_topk_by_id", TOPK)
oracle("chunk_paragraphs", """
SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS chunk, unnest(parts) AS paragraph FROM (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda p: trim(p)), lambda p: p <> '') AS parts
  FROM documents)""".replace("\\\\", "\\"))
part("daily", """SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS units FROM lineitem GROUP BY 1, 2""")
part("speed", """SELECT l_suppkey, day, sum(units) OVER (PARTITION BY l_suppkey ORDER BY day
  RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) / 30 AS velocity FROM daily""", "daily")
oracle("velocity", "SELECT l_suppkey, CAST(day AS VARCHAR) AS day, round(velocity, 6) AS velocity FROM speed", "speed")
oracle("moving_avg", """SELECT l_suppkey, CAST(day AS VARCHAR) AS day, round((units * 0.5 + coalesce(b * 0.3, 0) + coalesce(c * 0.2, 0))
  / (0.5 + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END), 6) AS forecast
  FROM (SELECT *, lag(units, 1) OVER w AS b, lag(units, 2) OVER w AS c FROM daily WINDOW w AS (PARTITION BY l_suppkey ORDER BY day))""",
       "daily")
oracle("low_stock", """
, now AS (SELECT * FROM speed QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY day DESC) = 1)
SELECT l_suppkey, round(s_acctbal / 100, 6) AS on_hand, round(s_acctbal / 100 / nullif(velocity, 0), 4) AS days_left
FROM supplier JOIN now ON l_suppkey = s_suppkey WHERE s_acctbal / 100 / nullif(velocity, 0) < 14""", "speed")
oracle("moderation_metrics", """SELECT source, count(*) AS submissions, round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS approval_rate,
  round(avg(quality), 6) AS avg_score FROM documents JOIN labels ON labels.doc_id = documents.doc_id GROUP BY 1""")

# --- checks registered from outside, and tables written and read back ------------------------------------
part("outer_checks", """SELECT trim(unique_id) AS facility_id, 'short_name' AS "check", 7 AS points FROM src
    WHERE unique_id IS NOT NULL AND length(name) < 24
  UNION ALL SELECT trim(unique_id), 'same_name', 3 FROM src WHERE unique_id IS NOT NULL AND name IN (
    SELECT name FROM src WHERE name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT unique_id) > 1)""", "src")
oracle("registered_checks", """
, extra AS (SELECT facility_id, sum(points) AS points FROM (SELECT facility_id, "check", max(points) AS points FROM outer_checks GROUP BY 1, 2)
  GROUP BY 1)
SELECT coalesce(s.facility_id, e.facility_id) AS facility_id,
  CAST(coalesce(s.total_penalty_points, 0) + coalesce(e.points, 0) AS INTEGER) AS total_penalty_points,
  'no_such_column, name_as_number, year_as_number, lost_column' AS skipped
FROM scores s FULL JOIN extra e ON s.facility_id = e.facility_id""", "src", "scores", "outer_checks")
oracle("staged_checks", """
, every AS (SELECT facility_id, "check", penalty_points AS points FROM checks UNION ALL SELECT * FROM outer_checks),
worst AS (SELECT facility_id, "check", max(points) AS points FROM every GROUP BY 1, 2)
SELECT "check", count(*) AS records, CAST(sum(points) AS BIGINT) AS points, NULL AS failed FROM worst GROUP BY 1
UNION ALL SELECT * FROM (VALUES ('no_such_column', 0, 0, 'plan UNRESOLVED_COLUMN.WITH_SUGGESTION'),
  ('lost_column', 0, 0, 'plan UNRESOLVED_COLUMN.WITH_SUGGESTION'), ('name_as_number', 0, 0, 'run CAST_INVALID_INPUT'),
  ('year_as_number', 0, 0, 'run CAST_INVALID_INPUT'))""", "checks", "outer_checks")
oracle("signals_append", """SELECT facility_id, dimension, CAST(i->>'trust_score' AS DOUBLE) AS trust_score, i->>'confidence_tier' AS confidence_tier
  FROM (SELECT facility_id, i->>'dimension' AS dimension, i FROM (SELECT facility_id, unnest(items) AS i FROM judged WHERE problem IS NULL))
  WHERE dimension IN ('capability', 'equipment', 'procedure', 'completeness')""", "judged")
oracle("errors_append", "SELECT facility_id, problem AS error_message FROM judged WHERE problem IS NOT NULL", "judged")
oracle("publish_snapshot", "SELECT facility_id, quality_score FROM scores", "scores")
oracle("publish_again", "SELECT facility_id, quality_score, true AS kept_old FROM scores WHERE quality_score >= 50", "scores")
oracle("csv_scan", "SELECT doc_id, text, lang, source, n_chars FROM documents")
oracle("unit_forecast", """SELECT l_suppkey, round(sum(units * CASE CAST(floor(age / 30) AS INTEGER) WHEN 0 THEN 0.5 WHEN 1 THEN 0.3
    WHEN 2 THEN 0.2 ELSE 0 END), 6) AS forecast
  FROM (SELECT l_suppkey, units, (SELECT max(day) FROM daily) - day AS age FROM daily) GROUP BY 1""", "daily")
oracle("field_items", " UNION ALL ".join(
    f"""SELECT facility_id, '{c}' AS field_name, CAST(generate_subscripts(items, 1) - 1 AS INTEGER) AS position, unnest(items) AS item
  FROM (SELECT unique_id AS facility_id, list_filter(list_transform({json_list(c)}, lambda x: coalesce(x, 'null')), lambda x: x <> '') AS items
    FROM gold WHERE starts_with(ltrim({c}), '['))""" for c in ("capability", "equipment", "procedure")), "gold")
