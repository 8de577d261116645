"""Plans of loops do not grow with turns."""

from weftline.operators import forest, parsing


def _scans(df):
    return df._jdf.queryExecution().analyzed().toString().count("Relation [")


def test_plans_of_loops(spark):
    """A chart and a forest read one table each, however many lengths of spans there are."""
    clauses = spark.createDataFrame([("LEFT-WALL", "A+", 0.0), ("x", "A- & A+", 0.0), ("z", "A-", 0.0)], "classname string, disjunct string, cost double")
    rows = [(0, 0, "LEFT-WALL"), *((0, i, "x") for i in range(1, 5)), (0, 5, "z")]
    words = spark.createDataFrame(rows, "k int, w int, classname string")
    c = parsing.sentence_clauses(words, ["k"], clauses)
    assert _scans(parsing.charted(c, ["k"], parsing.counted(), 0).spans) == 1
    assert [r["n_parses"] for r in parsing.parse_counts(c, ["k"]).collect()] == [1]
    f = forest.forest(c, ["k"])
    assert [len(r["links"]) for r in forest.drawn(f, 2, 1).collect()] == [5, 5]


def test_charts_are_not_broadcast(spark):
    """However small their files are, no table of a chart goes whole through the driver."""
    clauses = spark.createDataFrame([("LEFT-WALL", "A+", 0.0), ("z", "A-", 0.0)], "classname string, disjunct string, cost double")
    words = spark.createDataFrame([(0, 0, "LEFT-WALL"), (0, 1, "z")], "k int, w int, classname string")
    made = parsing.charted(parsing.sentence_clauses(words, ["k"], clauses), ["k"], parsing.counted(), 0)
    for df in (made.whole(["k"]), parsing.links(made.spans, made.pairs, made.sizes, ["k"])):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert made.whole(["k"]).count() == 1
