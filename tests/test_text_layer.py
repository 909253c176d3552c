from quire.operators import layout

ITEMS = "page int, items array<struct<text:string,x:double,y:double,width:double,size:double>>"


def test_runs_reach_the_helper_in_flat_columns(spark):
    rows = [
        (1, [("b", 40.0, 700.0, 8.0, 12.0), (None, 0.0, 700.0, 8.0, 12.0), (" 　", 0.0, 690.0, 8.0, 12.0), ("a", 0.0, 700.0, 8.0, None)]),
        (2, []), (3, None), (4, [("x" * 90, 0.0, 700.0, 720.0, 12.0), None]),
    ]
    out = layout.text_layer_pages(spark.createDataFrame(rows, ITEMS).repartition(1), ["page"])
    assert "lambdafunction" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["page"]: (r["markdown"], r["method"], r["status"]) for r in out.collect()}
    assert got == {1: ("a b", "text", "review"), 2: ("", "empty", "review"), 3: ("", "empty", "review"), 4: ("x" * 90, "text", "good")}
