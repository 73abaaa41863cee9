"""First ratings of a document's dimensions in one aggregate."""

import random

from scorewright.operators import scoring as S
from scorewright.plans import ratings as R


def test_first_ratings_pivoted_at_once_are_those_of_two_steps(spark, tmp_path):
    rng = random.Random(5)
    some = lambda *of: rng.choice(of)
    # orders are unique in a document, or null
    rows = [(rng.randrange(60) if i % 50 else None, some("D1", "D2", "D3", "X", None), some(1, 2, 3, 4, 5, None), i if i % 9 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "document_id long, dimension_code string, raw_score int, row_ord int")
    codes = ["D1", "D2", "D3", "D4"]
    got = S.first_pivoted(df, codes, "row_ord")
    want = S.pivoted(S.first_values(df, ["document_id", "dimension_code"], "row_ord", "raw_score"), codes)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # one shuffle, and no row for each dimension
    spark.createDataFrame([(1, 1)], "l_orderkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert R.wide(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_documents_are_dealt_out_before_they_are_aggregated(spark, tmp_path):
    spark.createDataFrame([(i // 4, 1 + i % 4) for i in range(400)], "l_orderkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    wide = R.wide(spark, str(tmp_path))
    assert wide.count() == 100
    plan = wide._jdf.queryExecution().executedPlan().toString()
    # no aggregate below the only shuffle
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange") :]
