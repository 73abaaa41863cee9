"""Names in any case: letters outside of English fold as they do in the SQL."""

import duckdb

from scorewright.plans.texts import QUERIES, SQL

TEXTS = [("src3", "the ſch der q"), ("src11", "the CIÓNES q"), ("src0", "x ſthnd the"), ("src0", "x Kthnd the"), ("src5", "x TİON the"), ("src0", "x tİon the"), ("src4", "x THıNG the"), ("src4", "x THİNG the"), ("src0", "the İdiot thnd"), ("src9", "THİNG thıng"), ("src7", "DE LA the"), ("src0", None), (None, "the thnd"), ("src0", "the\nthnd\n")]


def test_relevance_of_odd_letters(spark, tmp_path):
    rows = [(i, s, t and t + " " + "z " * 150) for i, (s, t) in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("relevance_decision_list", "relevance_mode_summary"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(SQL[name]).fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name
