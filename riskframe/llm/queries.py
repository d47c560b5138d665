"""One query per training-data operator: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import (bpe, bytebpe, chat, decontam, embedjoin, langid, linededup, lm,
                           ngramjoin, periodic, shards, urlfilter, veccode)
from riskframe.llm.common import remainder
from riskframe.sources.tables import table

#: Fixed values of the URL query: (rule, verdict).
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"),
             ("org/fr/", "allow")]
#: Fixed values of the chat query: the conversation added to the table.
ADDED_ID, ADDED_TEXT = -7, "</s>[INST] ok [/INST]"


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learnt from the documents not held out."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    protos = langid.prototypes(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"),
                           protos).drop("text")


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items held by documents."""
    return decontam.overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"),
                             ["doc_id"])


def op3_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the formatted conversations, read back from the output."""
    added = spark.range(1).select(F.lit(ADDED_ID).cast("long").alias("conv_id"), F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")),
        F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("t")
    ).select("conv_id", "t.turn", "t.role", F.lit(ADDED_TEXT).alias("text"))
    convs = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    back = chat.read_back(chat.format_conversations(convs.unionByName(added)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op4_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    """Unigram and model scores of every document, learnt from the documents
    not held out."""
    held_out = remainder(F.col("doc_id"), 10) == 0
    docs = table(spark, sf, "documents").select("doc_id", held_out.alias("held_out"), "text")
    return lm.score(docs, ~F.col("held_out"))


def op5_embedding_join(spark: SparkSession, sf: str) -> DataFrame:
    """Links and components of all embeddings."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    return embedjoin.range_join(vectors).select("vec_id", "n_links", "component_id", "kept")


def op6_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate groups and links of all documents."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return ngramjoin.near_duplicates(docs).select("doc_id", "class_id", "n_links", "kept")


def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without the lines that spread over many sites."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return linededup.remove_boilerplate(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op8_token_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest of the documents' token shards, written while it is read."""
    manifest, _ = shards.write_shards(table(spark, sf, "documents"))
    return manifest.withColumn("doc_id", F.col("first_key").cast("long")).drop("first_key")


def op9_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to."""
    coded = bpe.encode(table(spark, sf, "documents").select("doc_id", "text"),
                       decoded="decoded", keep=["doc_id"])
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict of the URL rules on every page."""
    rules = spark.sql("select * from values " + ", ".join(
        f"('{r}', '{v}')" for r, v in URL_RULES) + " as t(rule, verdict)")
    pages = table(spark, sf, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, rules).drop("url")


def op11_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every document's byte-level token ids and of their bytes."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = bytebpe.encode(docs, decoded="decoded", keep=["doc_id"])
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes, errors and errors by label of all embeddings."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    coded, books = veccode.compress(vectors, parts=4, entries=256, rounds=4)
    return veccode.with_group_error(coded, "label").select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; where h = crc32(doc_id) is divisible by 10 and
    there are n > 0 words, word i >= a becomes word a + (i - a) % p, with
    g = floor(h / 10), a = g % n and p = 1 + floor((n - a) / (3 + g % 8))."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    n, a, p = F.col("n"), F.col("a"), F.col("p")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", g.alias("g"), (h % 10 == 0).alias("chosen"))
    cut = (chosen.withColumn("w", F.when(F.col("chosen"), words))
           .withColumn("n", F.size("w").cast("long"))
           .withColumn("a", F.expr("if(n > 0, g % n, 0)"))
           .withColumn("p", 1 + F.floor((n - a) / (3 + F.col("g") % 8))))
    period = F.slice("w", (a + 1).cast("int"), p.cast("int"))
    times = F.ceil((n - a) / p).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(period, times)), 1, (n - a).cast("int"))
    text = F.array_join(F.concat(F.slice("w", 1, a.cast("int")), repeated), " ")
    return cut.select("doc_id", F.when(F.col("chosen") & (n > 0), text).otherwise(
        F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Periodic runs of every document's words, with some planted."""
    docs = planted_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    found = periodic.runs(docs, keep=["doc_id"])
    # a quotient of numbers below 2^26 rounds to the same double only if it is the same
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        (r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("q"),
        r["length"].alias("length"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.q")).alias("period"),
        F.expr("(1000 * best.length) div (-best.q)").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_decontamination, op3_chat_format,
                            op4_lm_score, op5_embedding_join, op6_ngram_join, op7_line_dedup,
                            op8_token_shards, op9_bpe, op10_url_filter, op11_byte_bpe,
                            op12_vector_codes, op13_periodic_runs)}
