from datetime import date

import pytest
from pyspark.sql import functions as F

from trustdesk.functions import score, text
from trustdesk.operators import clean
from trustdesk.schemas import SOURCE_COLUMNS

AS_OF = "2024-06-30"


def silver(spark, **values):
    """Cleaned record of one source row; columns not given are NULL."""
    row = [values.get(c) for c in SOURCE_COLUMNS]
    src = spark.createDataFrame([row], ", ".join(f"`{c}` string" for c in SOURCE_COLUMNS))
    return clean.to_silver(clean.to_bronze(src, "2024-06-30 12:00:00"), AS_OF).first()


def test_placeholders_and_trim(spark):
    r = silver(spark, name="  n/a ", organization_type=" Unknown", source=" web ", officialWebsite=" HTTP://A ",
               address_countryCode=" in ", facilityTypeId="Clinic ", countries="\tnone")
    assert (r.name, r.organization_type, r.source) == (None, None, "web")
    assert (r.official_website, r.address_country_code, r.facility_type_id) == ("http://a", "IN", "clinic")
    assert r.countries == "\tnone"  # only blanks are trimmed


def test_control_characters(spark):
    r = silver(spark, name="A\x00b�\tc\n", description="\x07null\x07", address_line1="\x07\x07", address_line2="NA")
    assert r.name == "Ab\tc\n" and r.description is None
    assert r.address_line1 == "" and r.address_line2 is None


@pytest.mark.parametrize("value, kept", [("1998", 1998), ("1998.0", None), ("abc", None), ("1799", None), ("1800", 1800),
                                         ("2024", 2024), ("2025", None)])
def test_year(spark, value, kept):
    assert silver(spark, yearEstablished=value).year_established == kept


@pytest.mark.parametrize("value, kept", [("true", True), ("YES", True), ("1", True), ("on", None), ("", None), ("no", False)])
def test_boolean(spark, value, kept):
    assert silver(spark, acceptsVolunteers=value).accepts_volunteers is kept


@pytest.mark.parametrize("value, kept", [
    ("2024-01-05", date(2024, 1, 5)), ("2024-1-5", date(2024, 1, 5)), ("2024", date(2024, 1, 1)),
    ("2023-12-31T10:00:00", date(2023, 12, 31)), ("2030-01-01", None), ("junk", None)])
def test_dates(spark, value, kept):
    assert silver(spark, recency_of_page_update=value).recency_of_page_update == kept


@pytest.mark.parametrize("value, kept", [
    (" Info@Space.ORG ", "info@space.org"), ("no-at.org", None), ("a@nodot", None), ("a b@c.org", None)])
def test_email(spark, value, kept):
    assert silver(spark, email=value).email == kept


@pytest.mark.parametrize("value, kept", [
    ('["a","a",null," "]', ["a"]), ("[]", []), ("null", None), ("", None), ('["broken"', None), ('[" x "]', [" x "])])
def test_json_list(spark, value, kept):
    assert silver(spark, affiliationTypeIds=value).affiliation_type_ids == kept


def test_cleaning_keeps_rows_and_is_idempotent(spark, sf_dir):
    from trustdesk.sources import driver_views
    src = driver_views.source(spark, sf_dir)
    once = clean.to_silver(clean.to_bronze(src, AS_OF), AS_OF)
    assert once.count() == src.count()
    texts = ["name", "description", "capability", "address_city", "organization_type"]
    again = once.select(*(text.clean_text(text.sanitize(c)).alias(c) for c in texts))
    assert once.select(texts).exceptAll(again).isEmpty()


def test_raw_needs_rows(spark):
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in set(clean.RAW_NAMES.values())))
    with pytest.raises(ValueError):
        clean.require_rows(clean.to_raw(empty))


def test_score_functions(spark):
    rows = spark.createDataFrame([(0.695,), (0.005,), (1.0,), (72.4,), (None,)], "s double").select(
        score.score_to_int("s").alias("i"), score.trust_label(score.score_to_int("s")).alias("label"),
        score.trust_tier("s").alias("tier")).collect()
    assert [r.i for r in rows] == [70, 1, 100, 72, None]
    assert [r.label for r in rows] == ["HIGH", "LOW", "HIGH", "HIGH", "—"]
    assert [r.tier for r in rows][:2] == ["med", "low"] and rows[4].tier == "insuff"


@pytest.mark.parametrize("raw, shown", [
    ('["X-ray","CT"]', "X-ray, CT"), ('["ICU"]', "ICU"), ("[]", None), ("[broken", "[broken"), ("", None), ("plain", "plain")])
def test_display_text(spark, raw, shown):
    assert spark.createDataFrame([(raw,)], "c string").select(text.display_text("c")).first()[0] == shown


@pytest.mark.parametrize("raw, number", [("+91 98-001", "98001"), ("0091 98001", "98001"), ("080-123", "80123"), ("call", "")])
def test_national_number(spark, raw, number):
    assert spark.createDataFrame([(raw,)], "c string").select(text.national_number("c")).first()[0] == number
