"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, decontamination, licenses, mixing, neardup, quality, sharding, substrings, toxicity, urls
from .common import table


def _over(name: str, f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


def queries() -> dict:
    return {
        "op1_extendible_sharding": _over("documents", sharding.op1),
        "op2_pareto_mixing": _over("documents", mixing.op2),
        "op3_bloom_url_filter": _over("pages", urls.op3),
        "op4_ordinal_toxicity": lambda spark, sf_dir: toxicity.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op5_chat_formatting": _over("conversations", chat.op5),
        "op6_minhash_near_dedup": _over("documents", neardup.op6),
        "op7_latent_decontamination": lambda spark, sf_dir: decontamination.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op8_rlz_substring_dedup": _over("documents", substrings.op8),
        "op9_quality_cascade": _over("documents", quality.op9),
        "op10_license_templates": _over("documents", licenses.op10),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_extendible_sharding": sharding.OP1_SQL,
        "op2_pareto_mixing": mixing.OP2_SQL,
        "op3_bloom_url_filter": urls.OP3_SQL,
        "op5_chat_formatting": chat.OP5_SQL,
        "op9_quality_cascade": quality.OP9_SQL,
    }
