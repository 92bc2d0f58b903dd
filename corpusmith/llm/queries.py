"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmith.llm import conversation_repair, divergence, minhash_dedup
from corpusmith.llm.bpe import op8_bpe
from corpusmith.llm.conversation_repair import op11_conversation_repair
from corpusmith.llm.divergence import op12_source_divergence
from corpusmith.llm.hilbert_ann import op2_hilbert_ann
from corpusmith.llm.license_scan import op1_license_scan
from corpusmith.llm.line_dedup import op6_line_dedup
from corpusmith.llm.minhash_dedup import op13_minhash_dedup
from corpusmith.llm.packing import op10_best_fit_packing
from corpusmith.llm.pii import op7_pii
from corpusmith.llm.quality import op4_quality_rules
from corpusmith.llm.simhash import op5_simhash
from corpusmith.llm.token_files import op9_token_files
from corpusmith.llm.toxicity import op3_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_hilbert_ann,
        op3_toxicity,
        op4_quality_rules,
        op5_simhash,
        op6_line_dedup,
        op7_pii,
        op8_bpe,
        op9_token_files,
        op10_best_fit_packing,
        op11_conversation_repair,
        op12_source_divergence,
        op13_minhash_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op11_conversation_repair": conversation_repair.ORACLE_SQL,
    "op12_source_divergence": divergence.ORACLE_SQL,
    "op13_minhash_dedup": minhash_dedup.ORACLE_SQL,
}
