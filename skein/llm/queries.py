"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, langid, licenses, lines, media, mixing, packing, quality, simhash, suffix
from .common import table


def queries() -> dict:
    return {
        "op1_license_scan": lambda spark, d: licenses.op1(table(spark, d, "documents")),
        "op2_media_columns": lambda spark, d: media.op2(table(spark, d, "documents")),
        "op3_language_id": lambda spark, d: langid.op3(table(spark, d, "documents")),
        "op4_simhash_dedup": lambda spark, d: simhash.op4(table(spark, d, "documents")),
        "op5_quality": lambda spark, d: quality.op5(table(spark, d, "documents"), table(spark, d, "labels")),
        "op6_suffix_dedup": lambda spark, d: suffix.op6(table(spark, d, "documents")),
        "op7_nearest": lambda spark, d: ann.op7(table(spark, d, "embeddings")),
        "op8_packing": lambda spark, d: packing.op8(table(spark, d, "documents")),
        "op9_line_dedup": lambda spark, d: lines.op9(table(spark, d, "documents")),
        "pack_conversations": lambda spark, d: packing.pack_conversations(table(spark, d, "conversations")),
        "op10_mixing": lambda spark, d: mixing.op10(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.oracle(), "op6_suffix_dedup": suffix.oracle(), "op7_nearest": ann.oracle(), "op9_line_dedup": lines.oracle(), "op10_mixing": mixing.oracle()}
