from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from entry_queries.reports_q import FOLDED
from reviewlens.plans import review_fold as V
from reviewlens.sources.sample_tables import books, reviews

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fold(spark, tmp_path_factory):
    rows, path = reviews(spark, SF), str(tmp_path_factory.mktemp("fold"))
    first = F.crc32("review_id") % 4 > 0
    V.add_reviews(rows.where(first), path, "a")
    V.add_reviews(rows.where(~first), path, "b")
    V.add_reviews(rows, path, "b")  # the batch is there already
    return path


@pytest.mark.parametrize("name", list(FOLDED))
def test_reports_from_the_fold_equal_those_from_the_reviews(spark, fold, name):
    report = FOLDED[name](books(spark, SF), V.read_fold(spark, fold))
    assert "lineitem" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert report.collect() == FOLDED[name](books(spark, SF), reviews(spark, SF)).collect()


def test_batches_and_compaction(spark, fold, tmp_path):
    whole = V.read_fold(spark, fold)
    total = reviews(spark, SF).where("sentimento IS NOT NULL AND title IS NOT NULL").count()
    assert whole.agg(F.sum("n")).first()[0] == total
    assert V.read_fold(spark, fold, ["a"]).agg(F.sum("n")).first()[0] < total
    V.compact(spark, fold, str(tmp_path))
    merged = V.read_fold(spark, str(tmp_path))
    assert merged.count() == merged.select("title").distinct().count() == whole.select("title").distinct().count()
    assert merged.agg(F.sum("n"), F.sum("polarity_sum")).first() == whole.agg(F.sum("n"), F.sum("polarity_sum")).first()


def test_a_batch_that_was_cut_off_is_written_again(spark, fold, tmp_path):
    rows = reviews(spark, SF)
    V.add_reviews(rows, str(tmp_path), "x")
    (tmp_path / "batch=x" / "_SUCCESS").unlink()
    V.add_reviews(rows.limit(0), str(tmp_path), "x")
    assert V.read_fold(spark, str(tmp_path)).count() == 0
