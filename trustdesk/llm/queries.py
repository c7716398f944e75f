"""Registered queries of the operators, over whole tables with production parameters, and their SQL."""

import public_tokenizers
from pyspark.sql import functions as F

from trustdesk.llm import (crf_extract, decontam, imatch, langid, quality_rules, simhash, spm_bpe, suffix_dedup, token_align,
                           token_file, turn_repair, url_rules, warc)
from trustdesk.llm.common import table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def wrap(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build
    return wrap


@query("op1_simhash")
def op1(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op2_language_id")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profiles = langid.train(docs.where(langid.fold() != 0))
    found = langid.predict(docs, profiles, keep=["doc_id"])
    return found.select("doc_id", (langid.fold() == 0).alias("held_out"), "lang_pred", "score")


@query("op3_warc_derivatives")
def op3(spark, sf_dir):
    made = warc.derive(warc.responses(table(spark, sf_dir, "pages"), "2024-06-30T12:00:00Z"))
    return made.select("record_id", "record_type", F.col("headers")[warc.REFERS].alias("refers_to"), "target_uri", "date",
                       "content_type", F.length("block").cast("long").alias("content_length"),
                       F.col("headers")[warc.BLOCK_DIGEST].alias("block_digest"),
                       F.col("headers")["WARC-Source-Payload-Digest"].alias("source_digest"),
                       F.col("block").cast("string").alias("block"))


@query("op4_byte_bpe")
def op4(spark, sf_dir):
    ranks = spm_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    back = spm_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep=["doc_id"], back=True)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_decontamination", decontam.ORACLE)
def op5(spark, sf_dir):
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


@query("op6_suffix_dedup")
def op6(spark, sf_dir):
    found = suffix_dedup.find(table(spark, sf_dir, "documents"), keep=["doc_id", "text"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return suffix_dedup.cut(found).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_token_shards")
def op7(spark, sf_dir):
    found = token_file.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return found.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.crc32("ids").alias("ids_crc32"))


@query("op8_imatch")
def op8(spark, sf_dir):
    found = imatch.against_edits(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                        "edited_fingerprint", "near_edited", "near_next")


@query("op9_url_rules", url_rules.oracle())
def op9(spark, sf_dir):
    return url_rules.judge(table(spark, sf_dir, "pages"), keep=["page_id"])


@query("op10_crf_extract")
def op10(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return crf_extract.extract(pages, crf_extract.fit(pages), keep=["page_id", "url"])


@query("op11_quality_rules")
def op11(spark, sf_dir):
    found = quality_rules.judge(table(spark, sf_dir, "documents"), keep=["doc_id", "lang"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        "lang", "bits", "perplexity", "lower", "upper")


@query("op12_token_align")
def op12(spark, sf_dir):
    found = token_align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                              public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                        F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))


@query("op13_turn_repair")
def op13(spark, sf_dir):
    return turn_repair.repair(table(spark, sf_dir, "conversations"))
