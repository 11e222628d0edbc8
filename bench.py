"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``candidates_per_second``: the feature families over a pair of some 700 candidates, each
written alone, and the reduced set of ten against all 79 features.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "flagship", "profile_column_text", "candidate_features_reduced", "candidate_features_wide", "candidate_features_full", "syn_levenshtein",
    "syn_ngram_cosine", "syn_jaro_winkler", "cls_euclidean", "cls_spearman", "spc_pair", "tda_h0", "tda_h1", "tda_h2", "tda_diagram_distances",
    "tda_overlap", "threshold_sweep", "pr_curve_threshold_aligned", "roc_auc", "winrate_long", "score_against_best", "stratified_folds",
    "nearest_representative", "mutual_information", "runtime_allocation", "rf_evaluate",
)


def noop(make) -> float:
    """Seconds of planning, of what ``make`` runs eagerly, and of the result."""
    start = time.time()
    make().write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def families(spark, sf_dir: str) -> dict[str, float]:
    from matchloom.operators import candidates as c
    from matchloom.plans.queries import wide_candidates
    from matchloom.session import materialize

    rows = materialize(wide_candidates(spark, sf_dir, 2), "bench-candidates")
    n = rows.count()
    sets = {k: [f for f in c.ALL_FEATURES if f.startswith(f"{k}_")] for k in ("syn", "cls", "spc", "tda")}
    sets |= {"reduced": list(c.REDUCED_FEATURES), "full": list(c.ALL_FEATURES)}
    # shuffled once more, so that the few large rows are dealt over all cores
    return {k: round(n / noop(lambda v=v: c.with_features(rows.repartition(32), v)), 1) for k, v in sets.items()} | {"candidates": n}


def main() -> None:
    from matchloom.catalogue import QUERIES
    from matchloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cpus=os.environ.get("BENCH_CPUS", "4"), memory=os.environ.get("BENCH_MEMORY", "4g"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {name: noop(lambda name=name: QUERIES[name](spark, sf_dir)) for name in HEADLINE}
    rates = families(spark, sf_dir)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "candidates_per_second": rates}))


if __name__ == "__main__":
    main()
