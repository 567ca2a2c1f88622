"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, collocations, decontaminate, licenses, line_dedup, mixing, ngram_join, order_minhash, packing, periodic, privacy, quality, sstable


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_disclosure": privacy.op2_disclosure,
        "op3_sstable": sstable.op3_sstable,
        "op4_order_minhash": order_minhash.op4_order_minhash,
        "op5_spaced_seed": decontaminate.op5_spaced_seed,
        "op6_subword_quality": quality.op6_subword_quality,
        "op7_systematic_mix": mixing.op7_systematic_mix,
        "op8_reply_trees": chat.op8_reply_trees,
        "op9_ngram_jaccard": ngram_join.op9_ngram_jaccard,
        "op10_license_families": licenses.op10_license_families,
        "op11_collocations": collocations.op11_collocations,
        "op12_packing": packing.op12_packing,
        "op13_periodic_runs": periodic.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE,
        "op7_systematic_mix": mixing.ORACLE,
        "op8_reply_trees": chat.ORACLE,
        "op11_collocations": collocations.ORACLE,
    }
