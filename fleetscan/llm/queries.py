"""The registered query of each operator: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, html_text, langid, ledger, license_scan, packing, pii, quality, simhash, token_store, trie, warc
from .common import fresh, in_fold, read_table, work_path


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "capacity", "step_id")


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = in_fold("doc_id", 4, 2)
    model = langid.train(docs, ~held_out)
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "tokens")
    token_store.write_tokens(read_table(spark, sf_dir, "documents"), path)
    rows = token_store.id_digests(spark, path)
    return token_store.with_starts(rows, token_store.file_offsets(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = in_fold("doc_id", 5, 0)
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    return quality.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def _count(found: str, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = fresh(docs, "pii")
    out = pii.pseudonymize(docs, found=found)
    return out.select("doc_id", "text", F.size(found).cast("long").alias("n_found"), *(_count(found, k).alias(f"n_{k}") for k in pii.KINDS))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_bundles(read_table(spark, sf_dir, "pages"), work_path(spark, "warc"))
    return warc.read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ledger.ledger(read_table(spark, sf_dir, "documents"))
    return entries.select("doc_id", *ledger.MEASURES, "failures", (~ledger.passes("v1")).alias("base_failed"), ledger.passes("v3").alias("kept"))


def ledger_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ablations(ledger.ledger(read_table(spark, sf_dir, "documents")), "v3")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_candidates", F.size("notices").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("notices.license")), ",").alias("licenses"), "notices")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    turns, who = trie.rebuilt(read_table(spark, sf_dir, "conversations"), conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6)
    return trie.prefix_trie(turns, who)


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(read_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


QUERIES = {"op1_packing": op1_packing, "op2_decontam": op2_decontam, "op3_langid": op3_langid, "op4_token_store": op4_token_store, "op5_simhash": op5_simhash, "op6_quality": op6_quality, "op7_pii": op7_pii, "op8_warc": op8_warc, "op9_ledger": op9_ledger, "ledger_ablations": ledger_ablations, "op10_licenses": op10_licenses, "op11_trie": op11_trie, "op12_html_text": op12_html_text, "op13_collocations": op13_collocations}
from .oracle import ORACLE_SQL  # noqa: E402

__all__ = ["ORACLE_SQL", "QUERIES"]
