"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage is written as Parquet and read again as the next one's documents; what a stage
wrote on the way is removed then.

Defined results: null, empty and wordless texts go with the quality rules, which need ten
words; very long texts are read whole by every stage; a null doc_id is a document of its
own and a null source a source; of near copies (ties in similarity included) the smallest
doc_id stays; repeated rows of one doc_id are one document to near-dedup, so all of them
stay or go, and each is mixed and sharded alone; all other columns are kept, whatever
their names, but ``shard`` and ``slot``, which the last stage adds, replace columns called
so; without documents there are no rows, without a benchmark nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import decontamination, mixing, near_dedup, quality, sharding
from matchloom.session import discard, finished

STAGES = [
    ("quality_rules", quality.stage),
    ("near_dedup", near_dedup.stage),
    ("decontamination", decontamination.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]

#: Random rounding of copies can't be stated in SQL; tests hold each stage's rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        before = docs
        docs = finished(lambda: step(spark, before, sf_dir), name)  # noqa: B023  called at once
        if k:
            discard(before)
    return docs
