"""The catalogue of table pairs: discovery, ground truth, column texts, external score files."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known relations by lower-case spelling; fixed values.
RELATIONS = {
    "joinable": "Joinable", "semantically-joinable": "Semantically-Joinable", "unionable": "Unionable",
    "view-unionable": "View-Unionable", "view -unionable": "View-Unionable",
}
OTHER_RELATION = "Entity-Matching"
PAIR_SCHEMA = (
    "pair_id string, dataset string, relation_type string, category string, source_csv string, target_csv string, "
    "mapping_json string, source_table_name string, target_table_name string"
)


def relation_type(c: Column) -> Column:
    key = normalize_name(c)
    out = F.lit(OTHER_RELATION)
    for k, v in RELATIONS.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def _files(spark: SparkSession, root: str) -> list[str]:
    """Paths of all files below ``root``, on any file system that Hadoop reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    listed, out = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while listed.hasNext():
        out.append(listed.next().getPath().toString())
    return out


def discover_pairs(spark: SparkSession, root: str) -> DataFrame:
    """One row for each folder that holds a ``*_mapping.json`` with exactly one source and one target CSV."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    files = spark.createDataFrame([(f,) for f in _files(spark, root)], "path string")  # one row for each file of the catalogue
    place = F.regexp_extract("path", "^(.*)/([^/]*)$", 1)
    name = F.regexp_extract("path", "^(.*)/([^/]*)$", 2)
    kind = F.regexp_extract(name, r"^(.*)_(source[.]csv|target[.]csv|mapping[.]json)$", 2)
    own = lambda k: F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("path"))))
    folders = files.select("path", place.alias("folder"), kind.alias("kind")).where("kind <> ''").groupBy("folder").agg(
        own("source.csv").alias("s"), own("target.csv").alias("t"), own("mapping.json").alias("m")
    )
    whole = folders.where((F.size("s") == 1) & (F.size("t") == 1) & (F.size("m") > 0))
    below = F.filter(F.split(F.replace(F.concat("folder", F.lit("/")), F.lit(base), F.lit("")), "/"), lambda x: x != "")
    stem = lambda c: F.regexp_extract(c, r"([^/]*)_(source|target)[.]csv$", 1)
    first = F.coalesce(F.get("parts", F.lit(0)), F.lit(""))
    return whole.select(F.explode("m").alias("mapping_json"), F.get("s", F.lit(0)).alias("source_csv"), F.get("t", F.lit(0)).alias("target_csv"), below.alias("parts")).select(
        F.array_join("parts", "__").alias("pair_id"), first.alias("dataset"), relation_type(F.coalesce(F.get("parts", F.lit(1)), F.lit(""))).alias("relation_type"),
        first.alias("category"), "source_csv", "target_csv", "mapping_json", stem(F.col("source_csv")).alias("source_table_name"), stem(F.col("target_csv")).alias("target_table_name"),
    ).orderBy("mapping_json")


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(source_table, source_column, target_table, target_column) of a mapping file.

    An object with ``matches`` or a bare list; items that are no objects or lack a
    column are left out, anything else gives no rows.
    """
    text = spark.read.text(path, wholetext=True)
    item = "struct<source_table:string,source_column:string,target_table:string,target_column:string>"
    bare = F.from_json("value", "array<string>")
    inside = F.from_json(F.get_json_object("value", "$.matches"), "array<string>")
    one = text.select(F.explode(F.coalesce(inside, bare)).alias("x")).select(F.from_json("x", item).alias("m")).select("m.*")
    name = lambda c: F.coalesce(F.when(F.col(f"{c}_table") != "", F.col(f"{c}_table")), F.lit(c)).alias(f"{c}_table")
    return one.where("source_column <> '' and target_column <> ''").select(name("source"), "source_column", name("target"), "target_column")


def normalize_name(c: Column) -> Column:
    """White space off both ends, then lower case."""
    return F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""))


def ground_truth(mapping: DataFrame, pair_id: Column) -> DataFrame:
    return mapping.select(
        pair_id.alias("pair_id"), normalize_name(F.col("source_column")).alias("source_col_norm"), normalize_name(F.col("target_column")).alias("target_col_norm")
    ).distinct()


def pair_manifest(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The requested pairs that are known, in order, for an external matcher."""
    one = wanted.select("pair_id").distinct()
    return pairs.join(one, "pair_id", "left_semi").orderBy("pair_id")


# Baselines

#: Matchers that a plug-in may provide, and those that hand over score files; fixed names.
EXTERNAL_BASELINES = (
    "ISResMat", "LLMATCH", "Magneto_ft_gpt", "Magneto_ft_no_gpt", "Magneto_no_ft_gpt", "Magneto_no_ft_no_gpt", "coma", "coma_pp",
    "coma_inst", "cupid_ext", "similarity_flooding_ext", "distribution_based_ext", "SMUTF",
)
#: External names under which an in-process matcher is asked for; fixed values.
ALIASES = {
    "coma": "coma_schema", "coma_pp": "coma_instance", "coma_inst": "coma_instance", "cupid_ext": "cupid",
    "similarity_flooding_ext": "similarity_flooding", "distribution_based_ext": "distribution_based",
}
IN_PROCESS_BASELINES = ("Coma", "ComaInst", "Cupid", "DistributionBased", "SimilarityFlooding")


def load_config(path: str) -> dict:
    """A YAML file's mapping, which always has an ``external`` mapping."""
    import yaml

    text = Path(path).read_text(encoding="utf-8") if os.path.exists(path) else ""
    config = yaml.safe_load(text) or {}
    if not isinstance(config.get("external"), dict):
        config["external"] = {}
    return config


def run_external(test: DataFrame, method: str, config: dict, environment: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """Scores of ``test`` rows from an external matcher's file, and a status.

    ``config[external][method]`` names ``required_env`` and ``predictions`` (a path that
    may hold {NAME} of the environment). Commands are not run here: the file has to be
    there. ok, missing_env, missing_backend or missing_predictions; unless ok all scores are 0.
    """
    from matchloom.sources.tables import adapt_scores, exists, left_join_scores, read_table

    environment = dict(os.environ if environment is None else environment)
    entry = config.get("external", {}).get(method)
    nothing = test.drop("score").withColumn("score", F.lit(0.0))
    if not entry:
        return nothing, "missing_backend"
    if any(not environment.get(k) for k in entry.get("required_env", ())):
        return nothing, "missing_env"
    path = re.sub(r"\{(\w+)\}", lambda m: environment.get(m[1], ""), entry.get("predictions", ""))
    if not path or not exists(test.sparkSession, path):
        return nothing, "missing_predictions"
    return left_join_scores(test, adapt_scores(read_table(test.sparkSession, path))), "ok"


def resolve(method: str, plugins: dict, config: dict) -> str:
    """How ``method`` is run: ``plugin:NAME`` (its own name or its alias), ``external``, or ``unknown``."""
    for name in (method, ALIASES.get(method)):
        if name in plugins:
            return f"plugin:{name}"
    return "external" if method in config.get("external", {}) or method in EXTERNAL_BASELINES else "unknown"


def run_matcher(candidates: DataFrame, matcher, names: tuple[str, str] = ("source_text", "target_text")) -> DataFrame:
    """Scores by a plug-in ``matcher(source, target) -> float``; a failure scores 0 and is reported in ``failure``."""
    import pandas as pd

    @F.pandas_udf("score double, failure string")
    def score(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            try:
                rows.append((float(matcher(x, y)), None))
            except Exception as e:  # noqa: BLE001  a plug-in may raise anything
                rows.append((0.0, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["score", "failure"])

    return candidates.withColumn("__s", score(*names)).select("*", "__s.score", "__s.failure").drop("__s")
