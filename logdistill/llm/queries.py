"""The registered corpus queries, each over its whole table, and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logdistill.llm import (
    alignment,
    ann,
    decontaminate,
    language,
    licenses,
    line_dedup,
    mixing,
    ngram_join,
    page_text,
    prefix_trie,
    secrets,
    sharding,
    warc,
)
from logdistill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


QUERIES: dict[str, Query] = {
    "op1_licenses": _over("documents", licenses.licensed_documents),
    "op2_ann": _over("embeddings", ann.nearest_hundredth),
    "op3_decontamination": _leaks,
    "op4_ngram_join": _over("documents", ngram_join.classified),
    "op5_warc": _over("pages", warc.archived_pages),
    "op6_page_text": _over("pages", page_text.main_texts),
    "op7_mixing": _over("documents", mixing.mixed_sizes),
    "op8_secrets": _over("documents", secrets.secret_documents),
    "op9_language": _over("documents", language.languages),
    "op10_line_dedup": _over("documents", line_dedup.lean_documents),
    "op11_alignment": _over("documents", alignment.alignment_report),
    "op12_sharding": _over("documents", sharding.shard_documents),
    "op13_prefix_trie": _over("conversations", prefix_trie.prefix_nodes),
}
ORACLES: dict[str, str] = {
    "op3_decontamination": decontaminate.ORACLE,
    "op5_warc": warc.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
