"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import chat, fingerprint, langid, mixing, neardup, ngram_join, packing, periodic, prefixes, quality, sharding, toxicity, warc
from .common import table

QUERIES = {
    "op1_mix_sources": lambda spark, sf_dir: mixing.op1(table(spark, sf_dir, "documents")),
    "op2_shard_bytes": lambda spark, sf_dir: sharding.op2(table(spark, sf_dir, "documents")),
    "op3_fingerprints": lambda spark, sf_dir: fingerprint.op3(table(spark, sf_dir, "documents")),
    "op4_warc": lambda spark, sf_dir: warc.op4(table(spark, sf_dir, "pages")),
    "op5_near_duplicates": lambda spark, sf_dir: neardup.op5(table(spark, sf_dir, "documents")),
    "op6_chat_format": lambda spark, sf_dir: chat.op6(table(spark, sf_dir, "conversations")),
    "op7_language": lambda spark, sf_dir: langid.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")),
    "op8_toxicity": lambda spark, sf_dir: toxicity.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op9_quality_rules": lambda spark, sf_dir: quality.op9(table(spark, sf_dir, "documents")),
    "op10_pack": lambda spark, sf_dir: packing.op10(table(spark, sf_dir, "documents")),
    "op11_prefix_trie": lambda spark, sf_dir: prefixes.op11(table(spark, sf_dir, "conversations")),
    "op12_ngram_join": lambda spark, sf_dir: ngram_join.op12(table(spark, sf_dir, "documents")),
    "op13_periodic_runs": lambda spark, sf_dir: periodic.op13(table(spark, sf_dir, "documents")),
}

ORACLES = {
    "op1_mix_sources": mixing.ORACLE_SQL,
    "op4_warc": warc.ORACLE_SQL,
    "op5_near_duplicates": neardup.ORACLE_SQL,
    "op6_chat_format": chat.ORACLE_SQL,
    "op11_prefix_trie": prefixes.ORACLE_SQL,
    "op12_ngram_join": ngram_join.ORACLE_SQL,
}
