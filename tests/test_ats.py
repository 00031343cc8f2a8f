"""Counts of CVs: lines move once, and odd rows count as in SQL."""

from postlake import queries

KIND = "o_custkey long, o_orderpriority string, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string"
LINES = [(1, "high", 5, 7, 1, "A", "F"), (1, "high", 5, 8, 2, "A", "O"), (1, None, None, 8, 3, "N", None), (None, "low", 5, 7, 4, "A", "F"), (2, None, None, None, None, None, None)]


def test_counts_with_one_move_of_the_lines(spark):
    df = queries.activity(spark.createDataFrame(LINES, KIND))
    names = ["cv_id", "n_tech", "n_skills", "n_roles", "n_keywords", "n_education", "n_certificates", "keyword_chars"]
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == [(1, 1, 3, 1, 2, 2, 2, 6), (2, 0, 1, 0, 0, 0, 0, None), (None, 1, 1, 1, 1, 1, 1, 4)]
    assert "Expand" not in df._jdf.queryExecution().optimizedPlan().toString()
