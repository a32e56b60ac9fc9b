"""Registered queries of the training-data operators: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.llm import collocations, conversations, digest, licences, mixing, packing, pii, pitman_yor, quality, recompression, simhash, urlfilter, warc
from lociforge.llm.oracles import ORACLES  # noqa: F401
from lociforge.llm.store import ship

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: 150 % of all words, sources weighing 3, 1, 2 in turn, each at most twice."""
    found, _ = mixing.mix(_table(spark, sf_dir, "documents"), share=1.5, repeats=2)
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: what stands plainly, and what is disguised."""
    found = _table(spark, sf_dir, "documents").select("doc_id", pii.find(F.col("text")).alias("_found"))
    names = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")
    return found.select("doc_id", *[F.col("_found")[n].alias(n) for n in names])


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of at most 4096 tokens."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens"
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a WARC package and read back."""
    records = warc.round_trip(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdict of the production policy for every document."""
    row = F.col("_ledger")
    held = quality.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base_failed = ~quality.passes(row["bits"], "base")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return held.select(
        "doc_id", *[row[n].alias(n) for n in names], base_failed.alias("base_failed"),
        (~base_failed & quality.passes(row["bits"], quality.PRODUCTION)).alias("kept"), row["bits"].alias("failure_bits"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print(F.col("print")).alias("fingerprint"), "component_id")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness to each other and to the next text's."""
    return digest.compare_with_next(_table(spark, sf_dir, "documents"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as captures spread over a year; the table has no dates of its own."""
    day = F.expr("date_add(date'2024-01-01', cast((page_id * 7) % 366 as int))")
    return _table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_on"))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated entries about the hosts of the pages: a host, or for every fourth the domain above it, is
    added to one of three lists, taken off it later and in every other case added again."""
    host = urlfilter.host_of(F.col("url"))
    hosts = _table(spark, sf_dir, "pages").select(host.alias("host")).filter("host != ''").distinct()
    h = hosts.withColumn("h", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long"))
    domain = F.expr("if(h % 4 = 0 and host like '%.%.%', substring(host, instr(host, '.') + 1), host)")
    at = lambda days: f"date_add(date'2024-01-01', cast({days} as int))"
    rows = F.expr(
        f"array(struct({at('h % 150')} as day, true as added), struct({at('h % 150 + 30 + h % 101')} as day, false as added), "
        f"struct({at('h % 150 + 170 + h % 67')} as day, h % 2 = 0 as added))"
    )
    named = h.select(F.expr("element_at(array('spam', 'adult', 'allow'), cast(h % 3 + 1 as int))").alias("list"), domain.alias("domain"), rows.alias("rows"))
    return named.select("list", "domain", F.inline("rows"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture judged by the list entries valid when it was fetched."""
    found = urlfilter.verdicts(captures(spark, sf_dir), list_entries(spark, sf_dir))
    return found.select("page_id", "fetched_on", "host", "blocked", "domain", "lists")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once repeated 20-word windows are removed."""
    left = recompression.remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every text."""
    found = _table(spark, sf_dir, "documents").select("doc_id", licences.scan(F.col("text")).alias("_found"))
    return found.select("doc_id", *[F.col("_found")[n].alias(n) for n in licences.FIELDS])


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every text, under single words and under the model; every fifth document is held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return pitman_yor.score(_table(spark, sf_dir, "documents"), ~held_out)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language by the score of their lowest cut."""
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all conversations."""
    return conversations.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_pii, op3_packing, op4_warc, op5_quality_rules, op6_simhash, op7_fingerprints, op8_url_filters,
        op9_substring_dedup, op10_licences, op11_language_model, op12_collocations, op13_conversations,
    )
}
