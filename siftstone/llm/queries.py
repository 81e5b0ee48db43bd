"""The registered queries of this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from . import languages, mixing, near, neighbours, phrases, pieces, repeats, secrets, toxicity, tries, urls, warc, winnowing


def op1_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.edited_fingerprints(table(spark, folder, "documents"))


def op2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.span_digest(secrets.find_secrets(table(spark, folder, "documents")))


#: The model file whose pieces op6 and the pipeline use.
MODEL_FILE = os.environ.get("SIFTSTONE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def vocabulary(path: str = MODEL_FILE) -> pieces.Segmenter:
    names, kinds = pieces.read_vocabulary(path)
    return pieces.Segmenter(names, kinds, pieces.rank_scores(kinds))


URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), URL_RULES)


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, folder, "documents"))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    encoded = pieces.encode_documents(table(spark, folder, "documents"), vocabulary())
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


def op7_hyperminhash(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(table(spark, folder, "documents"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_words(table(spark, folder, "documents"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_languages(spark: SparkSession, folder: str) -> DataFrame:
    return languages.language_id(table(spark, folder, "documents"))


def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return tries.prefix_trie(table(spark, folder, "conversations"))


QUERIES = {f.__name__: f for f in (op1_winnowing, op2_neighbours, op3_secrets, op4_url_filter, op5_suffix_dedup, op6_sentencepiece, op7_hyperminhash, op8_warc, op9_mixing, op10_toxicity, op11_languages, op12_phrases, op13_prefix_trie)}
