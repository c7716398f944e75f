"""Contact-level rollup and outreach drafts."""

import re

from pyspark.sql import DataFrame, functions as F

from trustdesk.functions.text import email_key, is_email, is_missing

# --- fixed values: lists of an address and the contact columns they come from ------------------------
LISTS = {"facility_ids": "unique_id", "facility_names": "name", "states": "address_stateOrRegion", "cities": "address_city"}
# ----------------------------------------------------------------------------------------------------


def contacts(src: DataFrame, scores: DataFrame) -> DataFrame:
    """Source records with a valid address, with their quality score and issues if flagged.

    Scores have one row per record, so the join is one to one; adaptive execution splits a skewed one.
    """
    base = (src.where(~is_missing("email"))
            .select("unique_id", "name", "address_city", "address_stateOrRegion", email_key("email").alias("email"),
                    F.trim("unique_id").alias("facility_id"))
            .where(is_email("email")))
    return base.join(scores.select("facility_id", "quality_score", "issues"), "facility_id", "left")


def outreach(reached: DataFrame, computed_at=None) -> DataFrame:
    """One row per address of ``contacts``: record count, shared flag, scores, first name and state, issue texts.

    Unflagged records add nothing to the scores. Every figure is a sum, a minimum or a distinct count with partial
    results in each task, so an address of very many records is one row like any other. Issues are rule texts and few;
    ids, names and places are values of ``outreach_lists``.
    """
    records = (reached.groupBy("email", "unique_id")
               .agg(F.sum("quality_score").alias("points"), F.count("quality_score").alias("scored"),
                    F.min("quality_score").alias("least"), F.min("name").alias("name"),
                    F.min(F.nullif("address_stateOrRegion", F.lit(""))).alias("state")))
    figures = records.groupBy("email").agg(
        F.count("unique_id").alias("facility_count"), F.min("name").alias("first_name"), F.min("state").alias("first_state"),
        F.min("least").alias("min_quality_score"), (F.sum("points") / F.sum("scored")).alias("_avg"))
    issues = (reached.select("email", F.explode("issues").alias("issue")).groupBy("email")
              .agg(F.sort_array(F.collect_set("issue")).alias("issues")))
    out = figures.join(issues, "email", "left").select(
        "email", "facility_count", "first_name", "first_state", (F.col("facility_count") > 1).alias("is_shared"),
        "min_quality_score", F.round("_avg").cast("int").alias("avg_quality_score"),
        F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))
    return out if computed_at is None else out.withColumn("computed_at", F.lit(computed_at).cast("timestamp"))


def outreach_lists(reached: DataFrame) -> DataFrame:
    """(email, list, value): every distinct id, name, state, city and issue of an address, one row per value."""
    values = F.concat(
        F.array(*(F.struct(F.lit(k).alias("list"), F.col(c).alias("value")) for k, c in LISTS.items())),
        F.transform(F.coalesce("issues", F.array().cast("array<string>")),
                    lambda i: F.struct(F.lit("issues").alias("list"), i.alias("value"))))
    return reached.select("email", F.inline(values)).where(F.col("value").isNotNull()).distinct()


# Letter wording. {user} {programme} {records} {place} {items} are filled in per row.
LETTER = {
    "opening": "Hello,\n\nmy name is {user} and I help {programme} keep its directory of health facilities correct.\n\n"
               "This address is listed for {records}{place}. Could you confirm or correct a few details?",
    "items": "\n\nThese points need a look:\n{items}",
    "closing": "\n\nA short reply is enough. Thank you for your help.\n\nKind regards,\n{user}\n{programme}",
}


def filled(template: str, values: dict):
    """The template with its placeholders replaced; braces inside a value stay what they are."""
    pieces = re.split(r"\{(" + "|".join(values) + r")\}", template)
    return F.concat(*(values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)))


def outreach_draft(rollup: DataFrame, user, programme="the directory team", letter=LETTER) -> DataFrame:
    """One letter per address: its one name or a count with the first name, first known state, issue bullets."""
    first = F.col("first_name")
    records = (F.when(first.isNull(), F.lit("your facility")).when(F.col("facility_count") <= 1, first)
               .otherwise(F.concat(F.col("facility_count").cast("string"), F.lit(" facilities including "), first)))
    place = F.when(F.col("first_state").isNotNull(), F.concat(F.lit(" in "), F.col("first_state"))).otherwise("")
    bullets = F.array_join(F.transform("issues", lambda i: F.concat(F.lit("  - "), i)), "\n")
    values = {"user": F.lit(user), "programme": F.lit(programme), "records": records, "place": place, "items": bullets}
    listed = F.when(F.size("issues") > 0, filled(letter["items"], values)).otherwise("")
    return rollup.select("email", F.concat(filled(letter["opening"], values), listed, filled(letter["closing"], values)).alias("draft"))
