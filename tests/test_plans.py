"""Plans stay what they were designed to be."""

from __future__ import annotations

import os
import re
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import oracle
from reviewlens.operators import enrich, similarity
from reviewlens.operators.dedup import dedup_by_key
from reviewlens.operators.sampling import take_sample
from reviewlens.plans import reports as R
from reviewlens.sources.sample_tables import books, reviews, table

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [f"q{i:02d}" for i in range(1, 26)] + ["ai_prompt", "ai_report", "sample_percent", "tx01", "pr05"])
def test_native_without_cartesian_products(spark, name):
    plan = plan_of(oracle.entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "InPandas" not in plan


def test_reviews_fold_before_they_meet_the_catalogue(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(R.problematic_books(books(spark, SF), reviews(spark, SF)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan.index("Join [title_std")
    assert "partial_count(sentimento" in plan[join:]
    assert "TakeOrderedAndProject" in plan


def test_top_k_is_cut_before_the_shuffle(spark):
    for df in (R.top_reviews(reviews(spark, SF, text=True)), dedup_by_key(books(spark, SF), ["categories_std"])[0]):
        plan = plan_of(df)
        assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")
        shuffle = plan.index("Exchange hashpartitioning")
        assert "Partial" in plan[shuffle:]


def test_texts_of_a_report_move_once(spark):
    """No text is shuffled again once the shown ones of a title and label are gathered."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = [x for x in plan_of(oracle.entry.queries()["ai_report"](spark, SF)).splitlines() if re.match(r"[ :]*[+:]- ", x)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = [re.search(r"\w", x).start() for x in lines]
    gathered = [i for i, x in enumerate(lines) if "collect_list" in x]
    assert gathered
    for i in gathered:
        above, level = [], depth[i]
        for j in range(i, -1, -1):
            if depth[j] < level:
                above, level = [*above, lines[j]], depth[j]
        assert not any("Exchange" in x for x in above), above


@pytest.mark.parametrize("name", ["ai_prompt", "ai_report"])
def test_prompts_are_ranked_by_key_and_only_shown_heads_move(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = [x for x in plan_of(oracle.entry.queries()[name](spark, SF)).splitlines() if re.match(r"[ :]*[+:]- ", x)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = [re.search(r"\w", x).start() for x in lines]

    def above(i):
        found, level = [], depth[i]
        for j in range(i, -1, -1):
            if depth[j] < level:
                found, level = [*found, lines[j]], depth[j]
        return found

    # Documents leave their scan as the first 200 characters or not at all.
    scans = [i for i, x in enumerate(lines) if "FileScan" in x and re.search(r"[\[,]text#", x)]
    assert scans
    for i in scans:
        shuffle = next(j for j, x in enumerate(above(i)) if "Exchange" in x)
        assert any("substring(text" in x or "Aggregate" in x for x in above(i)[:shuffle]), above(i)
    # Order lines move as numbers to be ranked, and as shown keys to their texts; the texts move once.
    scans = [i for i, x in enumerate(lines) if "FileScan" in x and "l_orderkey#" in x]  # totals of titles need no order
    assert scans
    for i in scans:
        path = above(i)
        rank = next(j for j, x in enumerate(path) if "row_number" in x and "Window [" in x)
        met = next(j for j, x in enumerate(path) if "SortMergeJoin [text_key" in x)
        assert rank < met
        assert sum("Exchange hash" in x for x in path[:rank]) == 1
        assert sum("Exchange hash" in x for x in path[rank:met]) == 1
        assert sum("Exchange hash" in x for x in path[met:]) == 1


def test_a_text_is_cut_into_words_once_per_pass(spark):
    plan = plan_of(oracle.entry.queries()["tfidf_vectors"](spark, SF))
    assert "regexp_extract_all" in plan
    assert max(line.count("regexp_extract_all") for line in plan.splitlines()) == 1


def test_sampling_moves_no_row(spark):
    docs = table(spark, SF, "documents")
    plan = plan_of(take_sample(docs, 10, ["doc_id"]))
    assert "Exchange" not in plan and "Sort" not in plan and "Subquery" not in plan
    assert plan.count("FileScan") == 1


def test_a_sample_takes_three_scans_at_most(spark):
    rows = table(spark, SF, "documents")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sample", "sample")
    try:
        take_sample(rows, None, ["doc_id"], fraction=0.1).collect()
        jobs = list(tracker.getJobIdsForGroup("sample"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Counts, the range of the cut-off and the filter; adaptive plans run an aggregation as two jobs.
    assert len(jobs) <= 6


def test_interview_list_keeps_users_without_a_book(spark):
    plan = plan_of(R.users_for_interview(books(spark, SF), reviews(spark, SF, user=True)))
    assert "LeftOuter" in plan


def test_scan_reads_only_what_is_used_and_pushes_filters(spark):
    plan = plan_of(table(spark, SF, "documents").where(F.col("lang") == "en").select("doc_id"))
    assert "EqualTo(lang,en)" in plan and "text:string" not in plan
    plan = plan_of(R.best_books(books(spark, SF), reviews(spark, SF)))
    assert "l_shipdate" not in plan and "l_extendedprice" not in plan


def test_worker_functions_need_no_package_on_the_executors(tmp_path):
    payload = tmp_path / "fn.pkl"
    payload.write_bytes(cloudpickle.dumps((enrich._ratio, similarity._dense)))
    code = f"import pickle; f, _ = pickle.loads(open({str(payload)!r}, 'rb').read()); print(f('abcd', 'bcde'))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=60)
    assert done.stdout.strip() == "0.75", done.stderr


@pytest.mark.parametrize("name", ["en03_edit", "en04", "en04_edit", "en06", "en06_fill_only", "en07_summary", "en07_edit", "pr10", "pr11",
                                  "pr12_examples", "pr12_strategies"])
def test_enrichment_gathers_no_catalogue_in_the_driver(spark, name):
    """Files of a catalogue are small beside its rows, so only bounded tables may be broadcast: frequent
    keys, examples, one row per column."""
    joins = [line for line in plan_of(oracle.entry.queries()[name](spark, SF)).splitlines() if "BroadcastHashJoin" in line]
    assert all(re.search(r"_hot#|\[column#", line) or name == "pr12_examples" and "BuildRight" in line for line in joins), joins
