"""Trust signals: work list, prompt, scoring, parsing, guards, evidence grounding and highlights."""

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from trustdesk.functions.score import confidence_rank, score_to_int
from trustdesk.functions.text import display_items, display_text
from trustdesk.operators.curate import first_by
from trustdesk.schemas import CONFIDENCE_TIERS, DIMENSIONS, MODEL_ANSWER

# --- work list and prompt ---------------------------------------------------------------------------


def worklist(raw: DataFrame, signals: DataFrame, errors: DataFrame = None, attempts=3, n=None) -> DataFrame:
    """Records without signals that have failed fewer than ``attempts`` times; all of them, unsorted, by default.

    ``n`` asks for the first so many, those with most text first; such a top list passes through one task.
    """
    todo = raw.join(signals.select("facility_id"), "facility_id", "left_anti")
    if errors is not None:
        given_up = errors.groupBy("facility_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= attempts)
        todo = todo.join(given_up.select("facility_id"), "facility_id", "left_anti")
    if n is None:
        return todo
    points = sum(F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("description", "capability"))
    return todo.orderBy(points.desc(), "facility_id").limit(n)


# --- fixed values: fields shown to the model ---------------------------------------------------------
PROMPT_FIELDS = ["facility_id", "facility_type", "state"]
PROMPT_WEAK_FIELDS = ["capacity", "year_established"]
PROMPT_TEXTS = ["description", "capability", "procedure", "equipment"]
ANSWER_KEYS = ["dimension", "trust_score", "confidence_tier", "evidence_text", "source_field", "contradiction",
               "contradiction_detail"]
# ----------------------------------------------------------------------------------------------------

INSTRUCTIONS = (
    "Judge how well the texts of this record support what it claims, for the dimensions "
    + ", ".join(DIMENSIONS) + ". Quote evidence word for word. Answer with one JSON object "
    '{"dimensions": [...]} whose items have the keys ' + ", ".join(ANSWER_KEYS) + "."
)


def render_prompt(records: DataFrame, instructions=INSTRUCTIONS, texts=PROMPT_TEXTS) -> DataFrame:
    """Adds ``prompt``: instructions plus the record with its whole texts; a missing text renders as empty."""
    def line(name, value, default=""):
        return F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit(default)))

    lines = [F.lit(instructions)]
    lines += [line(c, F.col(c), "N/A") for c in PROMPT_FIELDS]
    lines += [line(c, F.col(c), "NOT PROVIDED") for c in PROMPT_WEAK_FIELDS]
    lines += [line(c, F.col(c)) for c in texts]
    return records.withColumn("prompt", F.concat_ws("\n", *lines))


# --- scoring ----------------------------------------------------------------------------------------

RESPONSE_SCHEMA = T.StructType([
    T.StructField("facility_id", T.StringType()), T.StructField("raw_response", T.StringType()),
    T.StructField("extraction_model", T.StringType()), T.StructField("error_message", T.StringType()),
])


def _usable(answer):
    try:
        items = json.loads(answer)["dimensions"]
        return (all(i["dimension"] is not None and i["confidence_tier"] is not None for i in items)
                and any(i["dimension"] in DIMENSIONS for i in items))
    except (TypeError, KeyError, ValueError):
        return False


def _call(scorer, batch):
    """(answer, error) of each record; a batch that fails is halved until the failing record stands alone."""
    try:
        return [(answer, None) for answer in scorer(batch)]
    except Exception as e:  # a scorer may fail in any way; the record then goes to the fallback
        if len(batch) <= 1:
            return [(None, f"{type(e).__name__}: {e}")] * len(batch)
        middle = len(batch) // 2
        parts = batch.iloc[:middle], batch.iloc[middle:]
        return [x for part in parts for x in _call(scorer, part.reset_index(drop=True))]


def score(records: DataFrame, scorer, fallback=None, names=("primary", "fallback")) -> DataFrame:
    """One JSON answer per record from ``scorer``, a callable from a pandas batch to a list of texts.

    Records whose answer is unusable, or for which the scorer raised, go to ``fallback`` once. What still fails
    keeps its last raw answer and an error message. Write the result before using it twice, so that the
    scorer runs once per record.
    """
    def run(batches):
        for batch in batches:
            batch = batch.reset_index(drop=True)
            answers = _call(scorer, batch)
            out = pd.DataFrame({"facility_id": batch["facility_id"], "raw_response": [a for a, _ in answers],
                                "extraction_model": names[0], "error_message": [e for _, e in answers]}, dtype="object")
            bad = ~out["raw_response"].map(_usable)
            if fallback is not None and bad.any():
                retried = _call(fallback, batch[bad].reset_index(drop=True))
                out.loc[bad, "raw_response"] = [a for a, _ in retried]
                out.loc[bad, "extraction_model"] = names[1]
                out.loc[bad, "error_message"] = [e for _, e in retried]
            yield out

    return records.mapInPandas(run, RESPONSE_SCHEMA)


def rule_scorer(batch: pd.DataFrame):
    """Deterministic stand-in for a model: longer texts score higher and are quoted whole."""
    answers = []
    for row in batch[["capability", "equipment", "procedure", "facility_type"]].to_dict("records"):
        items = []
        for dimension in ("capability", "equipment", "procedure"):
            text = row[dimension] if isinstance(row[dimension], str) and row[dimension] else None
            points = min(len(text), 100) if text else None
            tier = ("insufficient_data" if points is None else "high" if points >= 70
                    else "medium" if points >= 40 else "low")
            clash = text is not None and "surgery" in text.lower() and row["facility_type"] == "NGO"
            items.append({
                "dimension": dimension, "trust_score": None if points is None else points / 100,
                "confidence_tier": tier, "evidence_text": text, "source_field": dimension if text else None,
                "contradiction": clash, "contradiction_detail": "surgery is not expected here" if clash else None})
        items.append({"dimension": "completeness", "trust_score": None, "confidence_tier": "insufficient_data",
                      "evidence_text": None, "source_field": None, "contradiction": False,
                      "contradiction_detail": None})
        answers.append(json.dumps({"dimensions": items}))
    return answers


# --- parsing ----------------------------------------------------------------------------------------

def parsed_responses(responses: DataFrame) -> DataFrame:
    """Adds ``_items`` (the answer's dimensions) and ``_error`` (why the record cannot be used)."""
    answer = F.from_json("raw_response", MODEL_ANSWER)
    with_items = responses.withColumn("_items", answer["dimensions"])
    items = F.col("_items")
    number = lambda i: i["trust_score"].try_cast("double")
    incomplete = F.exists(items, lambda i: i["dimension"].isNull() | i["confidence_tier"].isNull())
    not_a_number = F.exists(items, lambda i: i["trust_score"].isNotNull() & number(i).isNull())
    closed = F.col("raw_response").rlike(r"\}\s*\z")
    useless = ~F.exists(items, lambda i: F.coalesce(i["dimension"].isin(DIMENSIONS), F.lit(False)))
    error = (F.when(F.col("error_message").isNotNull(), F.col("error_message"))
             .when(F.col("raw_response").isNull(), "no response")
             .when(items.isNull() | ~closed, "response has no dimensions")
             .when(incomplete, "dimension or confidence_tier is missing")
             .when(not_a_number, "trust_score is not a number")
             .when(useless, "no usable dimension"))
    return with_items.withColumn("_error", error)


def parse_signals(responses: DataFrame):
    """(signals, errors): one row per answered dimension, and one row per unusable response."""
    parsed = parsed_responses(responses)
    item = F.col("_item")
    good = (parsed.where(F.col("_error").isNull())
            .select("facility_id", "extraction_model", "responded_at", F.explode("_items").alias("_item"))
            .select("facility_id", item["dimension"].alias("dimension"),
                    item["trust_score"].try_cast("double").alias("trust_score"),
                    item["confidence_tier"].alias("confidence_tier"), item["evidence_text"].alias("evidence_text"),
                    item["source_field"].alias("source_field"),
                    F.coalesce(~item["contradiction"].isin("false", "0", ""), F.lit(False)).alias("contradiction"),
                    item["contradiction_detail"].alias("contradiction_detail"), "extraction_model",
                    F.col("responded_at").cast("timestamp").alias("extracted_at")))
    errors = (parsed.where(F.col("_error").isNotNull())
              .select("facility_id", F.col("_error").alias("error_message"),
                      F.coalesce("raw_response", F.lit("")).alias("raw_response"),
                      F.col("responded_at").cast("timestamp").alias("failed_at")))
    return good, errors


def valid_dimensions(signals: DataFrame, observation: Observation = None) -> DataFrame:
    """Rows of the known dimensions; ``observation`` receives ``dropped`` without an extra job."""
    known = F.col("dimension").isin(DIMENSIONS)
    if observation is not None:
        signals = signals.observe(observation, F.sum(F.when(known, 0).otherwise(1)).alias("dropped"))
    return signals.where(known)


def latest_signals(signals: DataFrame) -> DataFrame:
    """One row per (record, dimension): the latest. For tables that were appended to by reruns."""
    order = [F.desc("extracted_at"), F.desc_nulls_last("trust_score"), F.asc_nulls_last("evidence_text")]
    return first_by(signals, ["facility_id", "dimension"], order)


# --- guards -----------------------------------------------------------------------------------------

def coverage(df: DataFrame, cols) -> DataFrame:
    """Share of non-blank values per column as rows (field, coverage). One pass, one row per column."""
    shares = [F.avg(F.when(F.trim(F.col(c).cast("string")) != "", 1.0).otherwise(0.0)).alias(c) for c in cols]
    pairs = F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.round(F.col(c), 6).alias("coverage"))
                               for c in cols)))
    return df.agg(*shares).select(pairs)


def coverage_guard(signals: DataFrame, coverage: DataFrame, threshold=0.5) -> DataFrame:
    """Signals resting on a field that is mostly empty become ``insufficient_data`` without a score.

    ``coverage`` holds one row per column of the record schema, so broadcasting it is safe at any scale.
    """
    low = coverage.where(F.col("coverage") < threshold).select(
        F.col("field").alias("source_field"), "coverage")
    joined = signals.join(F.broadcast(low), "source_field", "left")
    guarded = F.col("coverage").isNotNull()
    percent = F.round(F.col("coverage") * 100).cast("int").cast("string")
    note = F.concat(F.lit("Only "), percent, F.lit("% of the records fill in "), F.col("source_field"),
                    F.lit("; too few to rest on"))
    changed = {
        "confidence_tier": F.when(guarded, "insufficient_data").otherwise(F.col("confidence_tier")),
        "trust_score": F.when(~guarded, F.col("trust_score")),
        "evidence_text": F.when(guarded, note).otherwise(F.col("evidence_text")),
    }
    return joined.select(*(changed.get(c, F.col(c)).alias(c) for c in signals.columns))


EVIDENCE_FIELDS = ["description", "capability", "procedure", "equipment", "capacity", "year_established"]


def field_value(field, fields=EVIDENCE_FIELDS) -> Column:
    """Value of the record column named by ``field``."""
    return F.coalesce(*(F.when(F.col(field) == c, F.col(c).cast("string")) for c in fields))


def with_records(signals: DataFrame, records: DataFrame, cols) -> DataFrame:
    return signals.join(records.select(F.col("unique_id").alias("facility_id"), *cols), "facility_id")


def ground_evidence(signals: DataFrame, records: DataFrame) -> DataFrame:
    """Whether each quote occurs word for word in the field it names."""
    source = field_value("source_field")
    status = (F.when(F.col("evidence_text").isNull(), "no_evidence")
              .when(F.col("source_field").isNull(), "no_field")
              .when(source.isNull(), "field_empty")
              .when(source.contains(F.col("evidence_text")), "grounded").otherwise("not_in_field"))
    return (with_records(signals, records, EVIDENCE_FIELDS)
            .select(*signals.columns, status.alias("grounding"))
            .withColumn("grounded", F.col("grounding") == "grounded"))


def contradiction_severity(grounded: DataFrame) -> DataFrame:
    """HIGH with an explained and grounded conflict, MEDIUM when ungrounded, LOW without explanation."""
    return grounded.where("contradiction").withColumn(
        "severity", F.when(F.col("contradiction_detail").isNull(), "LOW").when(F.col("grounded"), "HIGH")
        .otherwise("MEDIUM"))


def lowest_tier(signals: DataFrame) -> DataFrame:
    """Worst confidence tier per record, by rank rather than by spelling."""
    worst = F.max(confidence_rank("confidence_tier"))
    names = F.array(*(F.lit(t) for t in CONFIDENCE_TIERS))
    return signals.groupBy("facility_id").agg(worst.alias("_rank")).select(
        "facility_id", F.get(names, F.col("_rank")).alias("lowest_tier"))


def _per_dimension(signals: DataFrame, *values) -> DataFrame:
    """Latest signal of each dimension, one row per record; map-side combined."""
    version = F.struct("extracted_at", F.coalesce("trust_score", F.lit(-1.0)).alias("_s"), *values)
    latest = {d: F.max(F.when(F.col("dimension") == d, version)) for d in DIMENSIONS}
    return signals.groupBy("facility_id").agg(*(v.alias(d) for d, v in latest.items()))


def score_bands(signals: DataFrame) -> DataFrame:
    """One row per (record, dimension) with integer score and tier; unanswered ones are insufficient."""
    wide = _per_dimension(signals, "trust_score", "confidence_tier")
    bands = F.inline(F.array(*(F.struct(
        F.lit(d).alias("dimension"), score_to_int(F.col(d)["trust_score"]).alias("score"),
        F.coalesce(F.col(d)["confidence_tier"], F.lit("insufficient_data")).alias("confidence_tier"))
        for d in DIMENSIONS)))
    return wide.select("facility_id", bands)


# --- field profile, highlights and segments ---------------------------------------------------------

# --- fixed values: label, column, category of the fields on a record page ---
PROFILE_FIELDS = [
    ("Facility Name", "name", "Identity"), ("City", "address_city", "Identity"),
    ("State", "address_state_or_region", "Identity"), ("Facility Type", "facility_type_id", "Identity"),
    ("Phone", "official_phone", "Identity"), ("Email", "email", "Identity"),
    ("Website", "official_website", "Identity"), ("Address", "address_line1", "Identity"),
    ("Description", "description", "Identity"), ("Capability", "capability", "Clinical"),
    ("Equipment", "equipment", "Clinical"), ("Procedure", "procedure", "Clinical"),
    ("Bed Capacity", "capacity", "Capacity"), ("Doctors", "number_doctors", "Capacity"),
    ("Year Established", "year_established", "Capacity"),
]
# ---------------------------------------------------------------------------
CLINICAL = ["capability", "equipment", "procedure"]


def _evidence_by_dimension(signals):
    wide = _per_dimension(signals, "evidence_text")
    return wide.select("facility_id", *(F.col(d)["evidence_text"].alias(f"_{d}_evidence") for d in CLINICAL))


def _display(c):
    """Shown text of a column; clinical texts fall back to the evidence of their signal."""
    if c in CLINICAL:
        return F.coalesce(display_text(c), F.col(f"_{c}_evidence"))
    return F.col(c).cast("string")


def field_profile(records: DataFrame, signals: DataFrame) -> DataFrame:
    """Fifteen labelled fields per record in long form."""
    rows = F.inline(F.array(*(F.struct(
        F.lit(n).alias("position"), F.lit(label).alias("label"), F.lit(c).alias("field_name"),
        F.lit(category).alias("category"), _display(c).alias("value"),
        (F.lit(category == "Capacity") & F.col(c).isNull()).alias("missing"))
        for n, (label, c, category) in enumerate(PROFILE_FIELDS, 1))))
    wide = records.select(F.col("unique_id").alias("facility_id"), *(c for _, c, _ in PROFILE_FIELDS))
    return wide.join(_evidence_by_dimension(signals), "facility_id", "left").select("facility_id", rows)


def field_items(records: DataFrame) -> DataFrame:
    """Items of the clinical fields that hold a JSON list, one row per item in order; plain text has none."""
    lists = F.inline(F.array(*(F.struct(F.lit(c).alias("field_name"), display_items(c).alias("items")) for c in CLINICAL)))
    return (records.select(F.col("unique_id").alias("facility_id"), lists)
            .select("facility_id", "field_name", F.posexplode("items").alias("position", "item")))


def highlights(records: DataFrame, signals: DataFrame) -> DataFrame:
    """What to mark in which field for every signal: (record, field, dimension, type, match, bubble, score)."""
    shown = records.select(
        F.col("unique_id").alias("facility_id"), "description", "capacity", *CLINICAL,
    ).join(_evidence_by_dimension(signals), "facility_id", "left")
    texts = shown.select(
        "facility_id", *(_display(c).alias(c) for c in [*CLINICAL, "capacity", "description"]))
    both = signals.join(texts, "facility_id")

    value = field_value("source_field", [*CLINICAL, "capacity"])
    quote = F.coalesce("evidence_text", value)
    insufficient = F.col("confidence_tier") == "insufficient_data"
    kind = F.when(insufficient, "insufficient").when(F.col("contradiction"), "contradiction").otherwise("evidence")
    by_field = F.when(value != "", F.struct(
        F.col("source_field").alias("field_name"), kind.alias("type"), value.alias("text"),
        F.when(value.contains(quote), quote).otherwise(value).alias("match"),
        F.when(~insufficient & F.col("contradiction"), F.coalesce("contradiction_detail", quote)).otherwise(quote)
        .alias("bubble"),
        F.when(kind == "evidence", score_to_int("trust_score")).alias("score")))

    detail, text = F.col("contradiction_detail"), F.col("description")
    double, single = F.regexp_extract(detail, '"([^"]+)"', 1), F.regexp_extract(detail, "'([^']+)'", 1)
    quoted = F.when(double != "", double).when(single != "", single)
    in_description = F.when(F.col("contradiction") & (detail != "") & (text != ""), F.struct(
        F.lit("description").alias("field_name"), F.lit("contradiction").alias("type"), text.alias("text"),
        F.when(text.contains(quoted), quoted).otherwise(text).alias("match"), detail.alias("bubble"),
        F.lit(None).cast("int").alias("score")))

    found = F.array_compact(F.array(by_field, in_description))
    return both.select("facility_id", "dimension", F.inline(found))


def segments(marks: DataFrame) -> DataFrame:
    """Cuts each marked text into plain and highlighted spans by first position of every match.

    A match that starts inside an earlier one is skipped. Equal matches are merged first, so the list kept
    per field is bounded by the distinct quotes in that field.
    """
    spots = marks.withColumn("at", F.expr("locate(match, text)")).where((F.col("match") != "") & (F.col("at") > 0))
    ordered = spots.groupBy("facility_id", "field_name").agg(
        F.first("text").alias("text"),
        F.sort_array(F.collect_set(F.struct(
            F.col("at"), (-F.length("match")).alias("order"), F.length("match").alias("size")))).alias("spots"))
    kept = F.expr("""
        aggregate(spots, named_struct('end', 1, 'spans', CAST(array() AS array<struct<at:int, size:int>>)),
          (acc, s) -> IF(s.at < acc.end, acc, named_struct(
            'end', s.at + s.size, 'spans', array_append(acc.spans, named_struct('at', s.at, 'size', s.size)))))
    """)
    cut = F.expr("""
        filter(flatten(array(
          flatten(transform(kept.spans, (s, i) -> array(
            named_struct('kind', 'plain', 'text', substring(text,
               IF(i = 0, 1, kept.spans[i - 1].at + kept.spans[i - 1].size),
               s.at - IF(i = 0, 1, kept.spans[i - 1].at + kept.spans[i - 1].size))),
            named_struct('kind', 'highlight', 'text', substring(text, s.at, s.size))))),
          array(named_struct('kind', 'plain', 'text', substring(text, kept.end))))), x -> x.text <> '')
    """)
    return (ordered.withColumn("kept", kept)
            .select("facility_id", "field_name", F.posexplode(cut).alias("position", "span"))
            .select("facility_id", "field_name", (F.col("position") + 1).alias("position"),
                    F.col("span.kind").alias("kind"), F.col("span.text").alias("text")))


# --- report -----------------------------------------------------------------------------------------

def extraction_report(raw: DataFrame, signals: DataFrame, errors: DataFrame, minimum=0.95) -> DataFrame:
    """Run figures in one row: coverage, rows, errors, contradictions, insufficient, pass or fail.

    Signals are reduced to one row per record before they meet the records, so nothing fans out.
    """
    per_record = signals.groupBy("facility_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("contradiction"), 1)).alias("contradictions"),
        F.count(F.when(F.col("confidence_tier") == "insufficient_data", 1)).alias("insufficient"))
    totals = per_record.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("signal_rows"), F.count(F.lit(1)).alias("covered"),
        F.coalesce(F.sum("contradictions"), F.lit(0)).alias("contradictions"),
        F.coalesce(F.sum("insufficient"), F.lit(0)).alias("insufficient"))
    figures = raw.agg(F.count(F.lit(1)).alias("records"))
    failures = errors.agg(F.count(F.lit(1)).alias("errors"))
    one = [df.withColumn("_one", F.lit(1)) for df in (figures, totals, failures)]
    row = reduce(lambda a, b: a.join(b, "_one"), one).drop("_one")
    return row.select(
        "records", "covered", F.round(F.col("covered") * 100 / F.greatest("records", F.lit(1)), 1).alias("coverage_pct"),
        "signal_rows", "errors", "contradictions", "insufficient",
        (F.col("covered") > F.col("records") * minimum).alias("passed"))


def report_dimensions(signals: DataFrame) -> DataFrame:
    """Mean rounded score per dimension."""
    return (signals.where(F.col("trust_score").isNotNull()).groupBy("dimension")
            .agg(F.round(F.avg(F.round(F.col("trust_score") * 100)), 6).alias("avg_score")))


def contradiction_sample(signals: DataFrame, n=5) -> DataFrame:
    """A few contradictions to look at."""
    return (signals.where("contradiction").select("facility_id", "dimension", "contradiction_detail")
            .orderBy("facility_id", "dimension", "contradiction_detail").limit(n))


def missing_signals(raw: DataFrame, signals: DataFrame) -> DataFrame:
    """Ids that still lack signals."""
    return raw.select("facility_id").join(signals.select("facility_id"), "facility_id", "left_anti")
