"""Queries of the pipeline operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colinear.llm import audio, bpe, decontaminate, infill, langid, linededup, mixing, neardup, periods, sharding, topk, urlfilter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": urlfilter.op1_url_filter,
        "op2_mixing": mixing.op2_mixing,
        "op3_media_audio": audio.op3_media_audio,
        "op4_warc": warc.op4_warc,
        "op5_langid": langid.op5_langid,
        "op6_bpe": bpe.op6_bpe,
        "op7_near_duplicates": neardup.op7_near_duplicates,
        "op8_sharding": sharding.op8_sharding,
        "op9_line_dedup": linededup.op9_line_dedup,
        "op10_exact_topk": topk.op10_exact_topk,
        "op11_infill": infill.op11_infill,
        "op12_periodic_runs": periods.op12_periodic_runs,
        "op13_decontaminate": decontaminate.op13_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return urlfilter.ORACLE | warc.ORACLE | topk.ORACLE | infill.ORACLE | decontaminate.ORACLE
