"""One registered query per operator, with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, centroid_clustering, embedding_dedup, fingerprints, html_text, language_id, lexical_search, license_scan, ngram_scoring, packing, simhash, toxicity, url_rules
from tallyloom.llm import oracle
from tallyloom.llm.common import remainder, table

#: host, path, verdict
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer_file(name: str) -> str:
    """Where the installed public tokenizers have a file; every executor has them at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_ngram_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_scoring.scored(table(spark, sf_dir, "documents"))


def toxicity_network(spark: SparkSession, sf_dir: str) -> toxicity.Network | None:
    """Learned from the labelled documents whose remainder by 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where(remainder(F.col("doc_id"), 4) != 2)
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 4) != 2)
    return toxicity.learn(docs, labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = toxicity.judge(table(spark, sf_dir, "documents"), toxicity_network(spark, sf_dir))
    return told.withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)


def language_models(spark: SparkSession, sf_dir: str) -> language_id.Models | None:
    """Learned from the documents whose remainder by 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    return language_id.learn(docs.where(remainder(F.col("doc_id"), 5) != 0))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = language_id.identify(table(spark, sf_dir, "documents"), language_models(spark, sf_dir))
    return told.withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    urls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    return url_rules.judge(urls, rules).withColumnRenamed("id", "page_id")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.clustered(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_embedding_dedup, op2_ngram_scoring, op3_toxicity, op4_language_id, op5_packing, op6_bpe, op7_simhash, op8_html_text, op9_url_rules, op10_fingerprints, op11_license_scan, op12_lexical_search, op13_centroid_clustering)
}

ORACLES: dict[str, str] = {
    "op9_url_rules": """
        with parts as (
            select page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path
            from pages),
        rules(rule_host, rule_path, rule_verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fits as (
            select parts.*, rule_host || rule_path as rule, rule_verdict,
                   row_number() over (partition by page_id, host, path order by length(rule_host || rule_path) desc, length(rule_host) desc) as place
            from parts left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
        select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict from fits where place = 1""",
    "op11_license_scan": oracle.license_scan(),
    "op12_lexical_search": oracle.lexical_search(),
    "op13_centroid_clustering": oracle.centroid_clustering(),
}
