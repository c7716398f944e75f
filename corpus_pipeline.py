"""A corpus pipeline over ``documents``: language, near-duplicates, repeated passages, test data, token ids."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from trustdesk.llm import decontam, langid, simhash, spm_bpe, suffix_dedup
from trustdesk.llm.common import column, stored, table

#: Predictions of lower score are rejected; 0 shares no n-gram with any language.
LEAST_SCORE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are text in a language of the corpus, learned from the folds that are not held out.

    Rejected are documents without a letter and those whose n-grams no profile has.
    """
    profiles = langid.train(docs.where(langid.fold() != 0))
    # the prediction gets names of its own, so that input columns of those names stay
    found = langid.predict(docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), column("text").alias("text")),
                           profiles, keep=["row"])
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprints of four-word shingles at four bits or fewer connect."""
    return simhash.keep_one(docs)


def apart(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` beside the other columns in one, so that names of results replace none of them."""
    rest = F.struct(*[column(c) for c in docs.columns if c != "text"])
    return docs.select(rest.alias("row"), column("doc_id").alias("doc_id"), column("text").alias("text"))


def with_text(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """The columns of ``docs`` with the text of ``cut`` and its length; documents that were emptied go."""
    changed = cut.where(~F.col("_cut") | (F.trim("text") != ""))
    length = F.when(F.col("_cut"), F.char_length("text").cast("long")).otherwise(F.col("row").getField("n_chars"))
    made = {"text": F.col("text"), "n_chars": length}
    return changed.select(*[(made[c] if c in made else F.col("row").getField(c)).alias(c) for c in docs.columns])


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes and more that also start earlier."""
    found = suffix_dedup.find(apart(docs))
    return with_text(docs, suffix_dedup.cut_text(found.withColumn("_cut", F.size("spans") > 0)))


def test_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that runs of ten words share with ``benchmark``."""
    found = decontam.find(apart(docs), table(spark, sf_dir, "benchmark"))
    return with_text(docs, decontam.cut(found.withColumn("_cut", F.size("spans") > 0)))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and whether they decode to the ``text``."""
    ranks = spm_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    made = spm_bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source", "text"], back=True)
    same = F.col("decoded") == F.coalesce(column("text").cast("binary"), F.lit(b""))
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       same.alias("round_trip"), F.sha2(F.col("decoded"), 256).alias("text_sha256"))


STAGES = [("language id", language), ("simhash near-dedup", near_copies), ("suffix-array dedup", passages),
          ("benchmark decontamination", test_data), ("byte-level bpe", token_ids)]
#: SQL can express neither language profiles nor xxHash shingles; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i}")
    return docs
