"""The queries ``opN_<name>`` and ``pipeline``, with SQL where it can say them."""

from __future__ import annotations

import importlib
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Where vocabulary files of public tokenizers lie; a parameter of the operators.
def tokenizer(name: str) -> str:
    folder = os.environ.get("LODEGRAPH_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import encode_documents

    return encode_documents(spark, table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(table(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(spark, table(spark, sf_dir, "pages")).drop("url")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(spark, table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1, window=2048)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import detect

    return detect(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search_every

    return search_every(spark, table(spark, sf_dir, "embeddings"), step=100, k=10)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in sys.path:
        sys.path.insert(0, root)
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_store, op2_quality_rules, op3_simhash_dedup, op4_warc, op5_bpe, op6_packing, op7_pii, op8_ann, op9_quality_classifier, op10_license_scan, pipeline)
}


def oracles() -> dict[str, str]:
    from . import quality_rules, warc

    return {"op2_quality_rules": quality_rules.oracle(), "op4_warc": warc.ORACLE}
