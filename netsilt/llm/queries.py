"""The registered queries of the llm operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsilt.llm import (
    chat, collocations, decontaminate, kneser_ney, language_id, manifest, packing, repeats, simhash, topk, url_reputation, warc)
from netsilt.llm import toxicity as tox
from netsilt.llm.common import crc_mod

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 3) == 1
    scored = tox.toxicity(docs, table(spark, sf_dir, "labels"), learn_from=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op3_packing(spark, sf_dir):
    return packing.packed_documents(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op5_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_repeats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.trim(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[ \t\n\x0B\f\r]+", " "))
    return repeats.without_repeats(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


@query
def op6_decontaminate(spark, sf_dir):
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "words", "same_words",
                        (F.col("same_words") / F.col("words")).alias("similarity"))


@query
def op4_kneser_ney(spark, sf_dir):
    held_out = crc_mod("doc_id", 10) == 0
    scored = kneser_ney.language_model_scores(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op8_language_id(spark, sf_dir):
    held_out = crc_mod("doc_id", 4) == 2
    found = language_id.language_of_documents(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op7_chat(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    control = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(control).alias("text"))
    formatted = chat.format_conversations(chat.events_of(given.unionByName(extra)))
    read = formatted.select("conv_id", "formatted", chat.parsed().alias("turns"), chat.under_loss().alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256
               ).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


@query
def op1_topk(spark, sf_dir):
    return topk.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op10_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    # the table has no time stamps: a second per page from the start of 2025
    captured_at = F.timestamp_seconds(F.lit(1735689600) + F.pmod(F.col("page_id"), F.lit(31536000)))
    history, folder = warc.archive(pages, captured_at)
    return warc.read_archives(history, folder).drop("payload")


@query
def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


#: The rules of the query, (verdict, host and path).
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query
def op12_url_reputation(spark, sf_dir):
    # pages have no labels of their own: a label with the page's number counts as its outcome
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("toxic").alias("bad"))
    judged = url_reputation.url_verdicts(table(spark, sf_dir, "pages"), outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op13_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*manifest.COLUMNS)
    return manifest.proofs(docs, crc_mod("doc_id", 5) == 0, {"text": manifest.lower_case(F.col("text"))})
