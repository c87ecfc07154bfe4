"""Registered queries: every operator over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavelake.llm import (
    bpe, chat_format, decontaminate, importance, license_scan, line_dedup, periodic_runs, quality_rules, simhash_dedup, source_mix,
    suffix_dedup, url_filter, warc,
)
from stavelake.llm.common import WORD, read, scratch


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffix_dedup.deduplicated(read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    return chat_format.digest(chat_format.formatted(turns.unionByName(extra)))


#: The rules of the query: (action, host, path).
URL_RULES = tuple(
    url_filter.Rule(*r)
    for r in (
        ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
        ("block", "net", "/es/"), ("block", "net", "/fr/"),
    )
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filtered(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash_dedup.classes(read(spark, sf_dir, "documents"))
    return made.select("doc_id", simhash_dedup.hexadecimal(F.col("fp")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.cleaned(read(spark, sf_dir, "documents"))
    return made.select("doc_id", "text", F.col("ld_lines").alias("n_lines"), F.col("ld_removed").alias("n_removed"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", quality_rules.verdict(docs["text"]).alias("v")).select("doc_id", "v.*")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = source_mix.decisions(read(spark, sf_dir, "documents"))
    rows = made.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.matches(read(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.shared(spark, public_tokenizers.path("word_bpe_49k.json"))
    made = bpe.recoded(read(spark, sf_dir, "documents"), vocabulary, ["doc_id"])
    return made.select(
        "doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the ids' checksums make a tenth of the texts repeat a stretch of their words to the end."""
    h = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce(docs["text"], F.lit("")), F.lit(WORD), F.lit(0))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    g = F.floor(F.col("h") / 10)
    sized = chosen.select("*", g.alias("g"), F.size("words").alias("n")).select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int").alias("a"))
    rest = F.col("n") - F.col("a")
    ready = sized.select("*", rest.alias("rest"), (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int").alias("p"))
    cycle = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), int(ceil(rest / p)))), 1, rest)")
    made = F.array_join(F.concat(F.expr("slice(words, 1, a)"), cycle), " ")
    return ready.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted_periods(read(spark, sf_dir, "documents"))
    made = docs.select("doc_id", periodic_runs.searched(docs["text"]).alias("found"))
    made = made.select("doc_id", "found.collapsed", periodic_runs.zipped(F.col("found")).alias("runs"))
    made = made.select("*", periodic_runs.strongest(F.col("runs")).alias("best"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return made.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = importance.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return made.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_chat_format": op3_chat_format,
    "op4_url_filter": op4_url_filter,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_warc": op6_warc,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_source_mix": op9_source_mix,
    "op10_license_scan": op10_license_scan,
    "op11_bpe": op11_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_importance_resampling": op13_importance_resampling,
}
