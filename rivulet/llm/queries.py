"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm.decontaminate import op8_decontaminate
from rivulet.llm.dedup_exact import OP4_SQL, op4_exact_dedup
from rivulet.llm.html_text import op10_html
from rivulet.llm.language import op5_language
from rivulet.llm.license_scan import op3_license
from rivulet.llm.merkle import OP11_SQL, op11_merkle
from rivulet.llm.packing import op6_packing
from rivulet.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from rivulet.llm.quality import op12_quality
from rivulet.llm.simhash import op2_simhash
from rivulet.llm.suffix_dedup import op7_suffix_dedup
from rivulet.llm.toxicity import op1_toxicity
from rivulet.llm.url_filter import OP9_SQL, op9_url_filter


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline.py``, which stands beside ``__spark_entry__.py``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_license": op3_license,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_language": op5_language,
    "op6_packing": op6_packing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_url_filter": op9_url_filter,
    "op10_html": op10_html,
    "op11_merkle": op11_merkle,
    "op12_quality": op12_quality,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": pipeline,
}
ORACLES = {"op4_exact_dedup": OP4_SQL, "op9_url_filter": OP9_SQL, "op11_merkle": OP11_SQL, "op13_prefix_trie": OP13_SQL}
