"""Choice of k takes every row unless a fraction is asked for."""

from ridelens.operators import segment


def test_evaluation_takes_all_rows(spark):
    x = spark.range(6000)
    assert segment.sample_for_evaluation(x).count() == 6000
    assert segment.sample_for_evaluation(x, 1.0).count() == 6000
    assert 0 < segment.sample_for_evaluation(x, 0.1).count() < 1200
