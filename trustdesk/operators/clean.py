"""Landing and cleaning layers. One narrow projection each: no row is dropped, nothing shuffles."""

from pyspark.sql import DataFrame, functions as F

from trustdesk.functions.text import clean_text, json_list, sanitize, valid_email
from trustdesk.schemas import SOURCE_COLUMNS


def to_bronze(src: DataFrame, loaded_at) -> DataFrame:
    """Source columns as they are plus the load time."""
    return src.select(*SOURCE_COLUMNS, F.lit(loaded_at).cast("timestamp").alias("_bronze_loaded_at"))


RAW_NAMES = {
    "facility_id": "unique_id", "facility_name": "name", "facility_type": "organization_type",
    "state": "address_stateOrRegion", "district": "address_city", "description": "description",
    "capability": "capability", "procedure": "procedure", "equipment": "equipment",
    "capacity": "capacity", "year_established": "yearEstablished", "latitude": "latitude",
    "longitude": "longitude", "specialties": "specialties",
}


def to_raw(src: DataFrame) -> DataFrame:
    """The renamed subset that signal extraction works on."""
    return src.select(*(F.col(old).alias(new) for new, old in RAW_NAMES.items()))


def require_rows(df: DataFrame) -> DataFrame:
    """Fail on an empty input. Reads at most one row instead of counting the table."""
    if df.isEmpty():
        raise ValueError("the source has no rows")
    return df


def to_silver(bronze: DataFrame, as_of, processed_at=None) -> DataFrame:
    """Typed and cleaned records. ``as_of`` stands in for today's date."""
    as_of = F.lit(as_of).cast("date")
    trimmed = lambda c: F.trim(F.col(c))
    number = lambda c, kind="int": trimmed(c).try_cast(kind)
    flag = lambda c: F.lower(trimmed(c)).try_cast("boolean")

    # sanitised first as columns of their own, so that each long text is scanned once
    texts = ("name", "description", "capability", "procedure", "equipment")
    bronze = bronze.withColumns({c: sanitize(c) for c in texts})

    def address(c):
        # the placeholder test sees the raw text, so a line of control characters becomes ''
        return clean_text(sanitize(c), tested=c)

    def past(c):
        day = trimmed(c).try_cast("date")
        return F.when(day <= as_of, day)

    year = number("yearEstablished")
    columns = {
        "unique_id": trimmed("unique_id"),
        "name": clean_text("name"),
        "organization_type": clean_text("organization_type"),
        "content_table_id": trimmed("content_table_id"),
        "official_phone": clean_text("officialPhone"),
        "email": valid_email("email"),
        "official_website": clean_text("officialWebsite", fold=F.lower),
        "year_established": F.when(year.between(1800, F.year(as_of)), year),
        "accepts_volunteers": flag("acceptsVolunteers"),
        "facebook_link": clean_text("facebookLink"),
        "address_line1": address("address_line1"),
        "address_line2": address("address_line2"),
        "address_line3": address("address_line3"),
        "address_city": clean_text("address_city"),
        "address_state_or_region": clean_text("address_stateOrRegion"),
        "address_zip_or_postcode": clean_text("address_zipOrPostcode"),
        "address_country": clean_text("address_country"),
        "address_country_code": clean_text("address_countryCode", fold=F.upper),
        "countries": clean_text("countries"),
        "facility_type_id": clean_text("facilityTypeId", fold=F.lower),
        "operator_type_id": clean_text("operatorTypeId", fold=F.lower),
        "affiliation_type_ids": json_list("affiliationTypeIds"),
        "description": clean_text("description"),
        "capability": clean_text("capability"),
        "procedure": clean_text("procedure"),
        "equipment": clean_text("equipment"),
        "area": number("area"),
        "number_doctors": number("numberDoctors"),
        "capacity": number("capacity"),
        "recency_of_page_update": past("recency_of_page_update"),
        "distinct_social_media_presence_count": number("distinct_social_media_presence_count"),
        "affiliated_staff_presence": flag("affiliated_staff_presence"),
        "custom_logo_presence": flag("custom_logo_presence"),
        "number_of_facts_about_the_organization": number("number_of_facts_about_the_organization"),
        "post_metrics_most_recent_social_media_post_date":
            past("post_metrics_most_recent_social_media_post_date"),
        "post_metrics_post_count": number("post_metrics_post_count"),
        "engagement_metrics_n_followers": number("engagement_metrics_n_followers", "bigint"),
        "engagement_metrics_n_likes": number("engagement_metrics_n_likes", "bigint"),
        "engagement_metrics_n_engagements": number("engagement_metrics_n_engagements", "bigint"),
        "source": clean_text("source"),
        "latitude": number("latitude", "double"),
        "longitude": number("longitude", "double"),
        "_silver_processed_at": F.lit(processed_at).cast("timestamp")
        if processed_at is not None else F.col("_bronze_loaded_at"),
    }
    return bronze.select(*(c.alias(n) for n, c in columns.items()))
