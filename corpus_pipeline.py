"""The corpus pipeline: five text operators one after the other over the table `documents`.

Every stage works on all that its predecessor kept. Its result is written as Parquet in the shared
checkpoint folder and read again, so a lost executor never sends the work back beyond one stage.
All but the last stage return the columns of `documents`; the last one returns the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from playtrail.llm.common import shipped, table, workspace
from playtrail.llm.decontaminate import stage_decontaminate
from playtrail.llm.jaccard import stage_jaccard_join
from playtrail.llm.passages import stage_substring_dedup
from playtrail.llm.quality_rules import stage_quality_rules
from playtrail.llm.sampling import stage_piece_encoding

STAGES = [
    ("quality rules", shipped(stage_quality_rules)),
    ("n-gram Jaccard join", shipped(stage_jaccard_join)),
    ("substring dedup", shipped(stage_substring_dedup)),
    ("benchmark decontamination", shipped(stage_decontaminate)),
    ("piece encoding", shipped(stage_piece_encoding)),
]

# The learned rules and the sampled ids have no form in SQL; tests/llm holds a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `<sf_dir>/documents.parquet`."""
    path = workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{number}")
        docs = spark.read.parquet(f"{path}/{number}")
    return docs
