"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chains import op7_chained_passages
from .decontaminate import op10_template_windows
from .licenses import OP5_SQL, op5_license_bands
from .media import op3_media_shards
from .packing import op9_pack_islands
from .quality import op8_quality_gam
from .repeats import OP4_SQL, op4_suffix_repeats
from .rollup import OP6_SQL, op6_token_rollup
from .simhash import op1_simhash_pigeonhole
from .token_files import op2_token_planes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_pigeonhole": op1_simhash_pigeonhole,
    "op2_token_planes": op2_token_planes,
    "op3_media_shards": op3_media_shards,
    "op4_suffix_repeats": op4_suffix_repeats,
    "op5_license_bands": op5_license_bands,
    "op6_token_rollup": op6_token_rollup,
    "op7_chained_passages": op7_chained_passages,
    "op8_quality_gam": op8_quality_gam,
    "op9_pack_islands": op9_pack_islands,
    "op10_template_windows": op10_template_windows,
}

ORACLE_SQL: dict[str, str] = {
    "op4_suffix_repeats": OP4_SQL,
    "op5_license_bands": OP5_SQL,
    "op6_token_rollup": OP6_SQL,
}
