"""The queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from agora.llm.bpe import op10_bpe
from agora.llm.decontamination import OP6_SQL, op6_decontamination
from agora.llm.embeddings import OP8_SQL, op8_embeddings
from agora.llm.extraction import op1_extraction
from agora.llm.language import op2_language
from agora.llm.negatives import OP12_SQL, op12_negatives
from agora.llm.personal import op11_personal
from agora.llm.quality import op4_quality
from agora.llm.records import op7_records
from agora.llm.shipping import ship
from agora.llm.simhash import op9_simhash
from agora.llm.spelling import op13_spelling
from agora.llm.suffix_dedup import op5_suffix_dedup
from agora.llm.toxicity import op3_toxicity


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


OPERATORS = (
    op1_extraction,
    op2_language,
    op3_toxicity,
    op4_quality,
    op5_suffix_dedup,
    op6_decontamination,
    op7_records,
    op8_embeddings,
    op9_simhash,
    op10_bpe,
    op11_personal,
    op12_negatives,
    op13_spelling,
)

QUERIES = {f.__name__: _shipped(f) for f in OPERATORS}
QUERIES["pipeline"] = _shipped(corpus_pipeline.run)

ORACLE: dict[str, str] = {"op6_decontamination": OP6_SQL, "op8_embeddings": OP8_SQL, "op12_negatives": OP12_SQL}
