import random

import pytest
from pyspark.sql import functions as F

from skarn.functions import blobs, cameras, ids, options
from skarn.functions import geometry as g
from skarn.plans.figure import draw, init_figure, with_figure
from skarn.sources.schema import MAX_ID, TRAIN_LABELS, collect_names, columns


def test_pair_ids(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(MAX_ID), rng.randrange(MAX_ID)) for _ in range(500)] + [(0, 0), (MAX_ID - 1, MAX_ID - 1), (MAX_ID - 1, 0), (MAX_ID - 1, MAX_ID - 2)]
    df = spark.createDataFrame(pairs, "a long, b long").withColumns({"p": ids.pair_id("a", "b"), "q": ids.pair_id("b", "a")})
    for r in df.select("*", ids.first_of("p").alias("x"), ids.second_of("p").alias("y")).collect():
        assert r["p"] == r["q"] == min(r["a"], r["b"]) * MAX_ID + max(r["a"], r["b"])
        assert (r["x"], r["y"]) == (min(r["a"], r["b"]), max(r["a"], r["b"]))


def test_pair_ids_beyond_the_range_of_images(spark):
    pairs = [(MAX_ID + d, MAX_ID - e) for d in (0, 1, 5, 2_000_000) for e in (-2_000_000, -1, 0, 1, 20_000)] + [(0, MAX_ID), (7, MAX_ID + 7), (MAX_ID - 1, 2 * MAX_ID - 1)]
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("p", ids.pair_id("a", "b"))
    for r in df.select("*", ids.first_of("p").alias("x"), ids.second_of("p").alias("y")).collect():
        assert (r["x"], r["y"]) == (min(r["a"], r["b"]), max(r["a"], r["b"]))


def test_prefix_range_is_pushed(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(a * MAX_ID + b,) for a in range(5) for b in range(a, 9)], "pair_id long").write.parquet(path)
    df = spark.read.parquet(path).where(ids.pairs_with_first(3))
    assert sorted(r[0] % MAX_ID for r in df.collect()) == [3, 4, 5, 6, 7, 8]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(pair_id" in plan


def test_unsigned(spark):
    df = spark.createDataFrame([(3.9,), (300.0,), (-1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(ids.uint8(F.col("x"))).collect()] == [3, 44, 255, None]
    assert [r[0] for r in df.select(ids.uint32(F.col("x"))).collect()] == [3, 300, 2**32 - 1, None]


def test_blobs(spark):
    df = spark.createDataFrame([([1.5, -2.0, 3.0, 4.0],), (None,), ([],)], "v array<double>")
    got = df.select(blobs.from_blob(blobs.to_blob(F.col("v"), "<f8"), "<f8").alias("a"), blobs.from_blob(blobs.to_blob(F.col("v"), "<f4"), "<f4", 2).alias("b"), blobs.to_blob(F.col("v"), "<f4").alias("c")).collect()
    assert got[0]["a"] == [1.5, -2.0, 3.0, 4.0] and got[0]["b"] == [[1.5, -2.0], [3.0, 4.0]] and len(got[0]["c"]) == 16
    assert got[1]["a"] is None and got[2]["a"] == []


def test_cameras(spark):
    df = spark.createDataFrame([(100, 50, 70), (100, 50, None), (40, 80, 0)], "w int, h int, f int")
    f = cameras.focal(F.col("w"), F.col("h"), F.col("f"))
    assert [r[0] for r in df.select(f).collect()] == [200.0, 120.0, 0.0]
    one = df.limit(1)
    want = {0: [200.0, 50.0, 25.0], 1: [200.0, 200.0, 50.0, 25.0], 2: [200.0, 50.0, 25.0, 0.1], 4: [200.0, 200.0, 50.0, 25.0, 0.0, 0.0, 0.0, 0.0]}
    for model, params in want.items():
        assert one.select(cameras.params(F.lit(model), f, F.col("w"), F.col("h"))).first()[0] == params
    with pytest.raises(Exception, match="unknown camera model"):
        one.select(cameras.params(F.lit(3), f, F.col("w"), F.col("h"))).collect()
    with pytest.raises(Exception, match="no focal length"):
        df.select(cameras.focal(F.col("w"), F.col("h"), F.col("f"), strict=True)).collect()


def test_geometry(spark):
    one = spark.range(1)
    r, t = F.array(*map(F.lit, [0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0])), F.array(*map(F.lit, [1.0, 2.0, 3.0]))
    assert tuple(one.select(g.camera_center(r, t)).first()[0]) == (2.0, -1.0, -3.0)
    p, o = g.point(F.lit(3.0), F.lit(4.0), F.lit(0.0)), g.point(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    assert tuple(one.select(g.unit(p, o)).first()[0]) == (0.6, 0.8, 0.0)
    assert tuple(one.select(g.unit(p, p)).first()[0]) == (None, None, None)


def test_options(spark):
    given = {"x:a": 1, "b": 2, "z:c": 3, "x:n:m": 4}
    assert options.split_options(given, ["x", "y"]) == ({"x": {"a": 1, "n:m": 4}, "y": {}}, {"b": 2, "z:c": 3})
    assert options.split_options({"x:a": 1, "a": 2}, ["x", "y"], merge=True) == {"x": {"a": 2}, "y": {"a": 2}}
    df = spark.createDataFrame([(k,) for k in [*given, "x"]], "k string")
    got = df.select(options.option_group(F.col("k"), ["x", "y"]), options.option_name(F.col("k"), ["x", "y"])).collect()
    assert list(map(tuple, got)) == [("x", "a"), (None, "b"), (None, "z:c"), ("x", "n:m"), (None, "x")]


def test_catalogues():
    from typing import ClassVar

    @collect_names
    class Some:
        A: ClassVar[str] = "a"
        B: ClassVar[str] = "b"
        C: ClassVar = "c"
        D: str = "d"

    assert Some.names == ["a", "b"] and columns(TRAIN_LABELS)[0] == "dataset"


def test_figures(spark):
    @with_figure
    def f(x, fig):
        return fig

    @with_figure(force=False)
    def h(fig):
        return fig

    mine = init_figure()
    assert f(1) == mine and f(1, fig=None) == mine and f(1, fig=mine) is mine and h(fig=None) is None and h() == mine
    rows = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 1.0, 1.0, "red")], "x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, rgb string")
    assert draw(rows)["data"][0]["x"] == [0.0, 1.0]


def test_traces_in_subplots(spark):
    from skarn.functions import geometry as g
    from skarn.operators import scene
    from skarn.plans import figure

    df = spark.createDataFrame([(1,)], "id int")
    rect = F.array(*(g.point(F.lit(x), F.lit(y), F.lit(1.0)) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))))
    origin = g.point(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    fig = figure.init_subplots(2, 3)
    assert [n for n in fig["layout"] if n.startswith("scene")] == ["scene", *(f"scene{k}" for k in range(2, 7))]
    assert fig["layout"]["scene5"]["domain"] == {"x": [1 / 3, 2 / 3], "y": [0.0, 0.5]}
    figure.draw(scene.frustum_edges(df, ["id"], origin, rect), fig=fig, row=2, col=2)
    figure.draw(scene.frustum_faces(df, ["id"], rect), fig=fig, row=2, col=2)
    figure.draw(scene.rays(df, ["id"], origin, rect), fig=fig, row=1, col=1, name="ray", hoverinfo="skip")
    edges, mesh, ray = fig["data"][0], fig["data"][4], fig["data"][5]
    assert (edges["name"], edges["showlegend"], edges["scene"], mesh["scene"], mesh["type"]) == ("Pyramid", False, "scene5", "scene5", "mesh3d")
    assert (ray["name"], ray["showlegend"], ray["scene"], ray["hoverinfo"]) == ("ray", False, "scene", "skip")
    plain = figure.draw(scene.points(df, origin))
    assert "showlegend" not in plain["data"][0] and "scene" not in plain["data"][0]
    with pytest.raises(ValueError, match="no cell"):
        figure.draw(scene.points(df, origin), fig=fig, row=3, col=1)
