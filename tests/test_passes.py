"""Merging whole images in a task, against joins of all strings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chordgrid.operators import string_passes, strings
from tests.test_tree import started

DEALT = [
    string_passes.Limits(),
    string_passes.Limits(share=50),  # images in parts
    string_passes.Limits(most=30),  # the larger image is found too large on the way
    string_passes.Limits(whole=3),  # none fits a task
]


def summed(tree):
    places = F.col("lf_y") + 2 * F.col("lf_x") + 3 * F.col("rt_y") + 5 * F.col("rt_x")
    return tree.groupBy("imgid", "round").agg(F.count("*"), F.sum(F.size("ancestors")), F.count_if(F.col("dev") > 0), F.count_if(F.col("dev") < 0), F.sum(places))


@pytest.fixture(scope="module")
def first(spark):
    return strings.stored(started(spark), "strings")


@pytest.mark.parametrize("limits", DEALT)
def test_sums_are_those_of_the_whole_tree(spark, first, limits):
    want = sorted(map(tuple, summed(strings.merge_forest(first, (0.5, 1.0, 1.5))).collect()))
    found = strings.forest_sums(first, limits=limits)
    assert sorted(map(tuple, found.collect())) == want and len(want) == 8


def test_sums_with_other_bounds_and_sides(first):
    options = dict(inclusive=False, corrected=True, coincident=1.2)
    want = sorted(map(tuple, summed(strings.merge_forest(first, (0.5, 1.5), **options)).collect()))
    assert sorted(map(tuple, strings.forest_sums(first, (0.5, 1.5), **options).collect())) == want


def test_sums_of_images_with_many_roots(spark):
    """A block of 8 by 8 has 210 strings, more than a word of roots; 1.5 million pairs meet in its second round."""
    from chordgrid.operators.neighbours import EIGHT, neighbours

    lit = spark.range(128).select(F.expr("id div 64").alias("imgid"), F.col("id").alias("oid"), F.expr("id % 64 div 8").alias("y"), (F.col("id") % 8).alias("x"), F.lit(1.0).alias("n_y"), F.lit(0.0).alias("n_x"))
    first = strings.initial_strings(lit.where("imgid = 0 or oid % 2 = 0"), neighbours(lit.where("imgid = 0 or oid % 2 = 0"), EIGHT))
    want = sorted(map(tuple, summed(strings.merge_forest(first, (0.5, 0.7))).collect()))
    assert sorted(map(tuple, strings.forest_sums(first, (0.5, 0.7), limits=string_passes.Limits(share=20_000)).collect())) == want and len(want) == 6


def test_sums_of_nothing(first):
    assert strings.forest_sums(first.limit(0)).count() == 0


def rows(table):
    return sorted((r.imgid, r.sid, *(round(r[c], 9) + 0.0 for c in strings.STRING)) for r in table.collect())


@pytest.mark.parametrize("limits", DEALT[:3])
@pytest.mark.parametrize("options", [{}, dict(inclusive=False, corrected=True, coincident=1.2)])
def test_scored_rounds_are_those_of_joins(first, limits, options):
    want = rows(strings.merge_rounds(first, limits=DEALT[3], **options))
    assert rows(strings.merge_rounds(first, limits=limits, **options)) == want and len({r[0] for r in want}) == 2


def test_scored_rounds_write_no_pairs_of_images_that_fit_a_task(first):
    """Strings of these images meet in a task: the plan of the result has no join of their ends."""
    plan = strings.merge_rounds(first)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "floor" not in plan.lower()


def test_scored_rounds_of_nothing(first):
    assert strings.merge_rounds(first.limit(0)).count() == 0
    one = strings.stored(first.orderBy("imgid", "sid").limit(1), "strings")
    assert rows(strings.merge_rounds(one)) == rows(strings.merge_rounds(one, limits=DEALT[3]))
