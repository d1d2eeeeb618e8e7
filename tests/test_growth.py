"""Work that must not grow faster than the tables, told from plans."""

import re

from pyspark.sql import functions as F

from loomlake.operators import building as B, geometry as G, metrics as M, parsing as P, references as R, rules as U, traces as T
from loomlake.operators.records import sharegpt_samples


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_not_parsed_as_boxes(spark):
    turns = lambda a: [("user", "where"), ("assistant", "no"), ("assistant", a)]
    rows = [(1, turns('{"bbox": [1, 2, 3, 4]}')), (2, turns("over there")), (3, turns("plane|1,1,9,1,9,9,1,9")), (4, turns(" [1,2,3,4] ")), (5, turns("")), (6, [("user", "where")])]
    df = spark.createDataFrame(rows, "id int, messages array<struct<role string, content string>>").selectExpr("*", "array('a.png') as images", "'' as task", "100 as width", "100 as height")
    out = sharegpt_samples(df, "id")
    assert {r.id: (r.target_type, r.n_obb, r.gt_hbb) for r in out.collect()} == {1: ("hbb", 0, [1, 2, 3, 4]), 2: ("vqa", 0, None), 3: ("obb", 1, None), 4: ("hbb", 0, [1, 2, 3, 4])}
    # both parsers of JSON stand behind a test of the text
    assert re.search(r"CASE WHEN Contains\([^)]*\{\) THEN coalesce\(get_json_object", out._jdf.queryExecution().optimizedPlan().toString(), re.I)


def test_regions_take_one_shuffle_of_rows(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("image_id"), "id", (F.col("id") * 37 % 401).cast("double").alias("cx"), (F.col("id") * 53 % 401).cast("double").alias("cy"))
    out = G.split_rois(df, ["image_id"], 4, order="id")
    assert out.groupBy("image_id", "roi").count().agg(F.max("count")).first()[0] <= 4
    assert plan(out).count("Exchange") == 1


def test_rotated_iou_is_a_short_plan(spark):
    df = spark.sql("select array(named_struct('x', 0D, 'y', 0D), named_struct('x', 2D, 'y', 0D), named_struct('x', 2D, 'y', 2D), named_struct('x', 0D, 'y', 2D)) as a")
    df = df.unionByName(df.select(F.lit(None).cast(df.schema["a"].dataType).alias("a"))).withColumn("b", F.transform("a", lambda p: G.point(p["x"] + 1, p["y"])))
    out = G.with_obb_iou(df, "a", "b")
    assert sorted(r.iou for r in out.collect()) == [0.0, 1 / 3]
    assert len(plan(out)) < 20_000


def test_references_take_one_shuffle(spark):
    df = spark.range(60).select((F.col("id") % 4).alias("image_id"), F.floor(F.col("id") / 4).alias("object_index"), (F.col("id") % 3).cast("int").alias("class_id"), F.lit("ship").alias("class_name"), F.lit(1000).alias("image_width"), F.lit(1000).alias("image_height"))
    df = df.withColumns({"cx": F.col("object_index") * 61.0 % 1000, "cy": F.col("object_index") * 433.0 % 1000, "w": F.lit(30.0), "h": F.lit(30.0)})
    out = R.build_references(df)
    assert out.count() > 0
    assert plan(out).count("Exchange") == 1 and "FileScan" not in plan(out)


def test_texts_without_a_claim_meet_one_pattern(spark):
    """Classes and scenes are told pattern by pattern only in texts that hold any of them, and once for each row."""
    df = spark.createDataFrame([("The target is a ship.", "ship"), ("The object looks like an industrial building.", "ship"), ("It lies beside several ships", "ship"), ("grey", "plane"), (None, "plane")], "t string, c string")
    t, c = F.col("t"), F.col("c")
    out = df.select(T.claimed_classes(t).alias("a"), T.claims_another(t, c).alias("b"), T.scene_instead(t, c).alias("s"), T.many_instead(t, c).alias("m"))
    assert [tuple(r) for r in out.collect()] == [(["ship"], False, None, False), ([], False, "industrial building", False), ([], False, None, True), ([], False, None, False), ([], False, None, False)]
    shown = lambda x: df.select(x.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert shown(T.claims_another(t, c)).count("lower(") == 1  # it was told twice
    assert re.search(r"CASE WHEN RLIKE\(lambda \w+#\d+, [^\n]*?airport\|", shown(T.scene_instead(t, c)), re.I)
    assert "CASE WHEN ((((Contains(" in shown(T.many_instead(t, c))


def test_an_audit_reads_objects_once(spark):
    df = spark.sql("select * from values ('a', 1, 0, array('x')), ('a', 1, 1, array()), ('b', 2, 0, array('x', 'y')), ('b', null, null, null) as t(split, image_id, class_id, reasons)")
    out = M.audit(df, "split")
    got = {(r.split, r.metric, r.key): r.value for r in out.collect()}
    assert got == {
        ("a", "images", ""): 1, ("a", "objects", ""): 2, ("a", "valid", ""): 1, ("a", "invalid", ""): 1, ("a", "class", "0"): 1, ("a", "class", "1"): 1, ("a", "reason", "x"): 1,
        ("b", "images", ""): 1, ("b", "objects", ""): 2, ("b", "valid", ""): 0, ("b", "invalid", ""): 2, ("b", "class", "0"): 1, ("b", "class", None): 1, ("b", "reason", "x"): 1, ("b", "reason", "y"): 1,
    }
    assert "Union" not in plan(out)  # three passes before


def test_points_of_a_box_are_bound(spark):
    """The reasons of a box don't compute its corners again for each of them."""
    df = spark.sql("select 5D as cx, 5D as cy, 4D as w, 4D as h")
    shown = df.select(G.object_reasons(G.corners(), F.lit(9), F.lit(9)).alias("r"))
    assert shown.first().r == [] and shown._jdf.queryExecution().optimizedPlan().toString().count("named_struct(x, (") <= 4


def test_entries_without_a_name_are_spread(spark):
    """Entries without a name met the files under one key, so in one task."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, ("-1", "false")):
            spark.conf.set(k, v)
        entries = spark.sql("select id as entry, if(id < 900, ' ', concat('f', id)) as image, array(named_struct('obj_coord', array(0D, 0D, 1D, 1D), 'obj_corner', cast(null as array<double>), 'referring_sentence', '', 'obj_cls', 'Ship')) as objects from range(1000)")
        files = spark.sql("select concat('f', id) as image from range(950)")
        rows, seen, _ = B.explode_annotations(entries, files)
        assert rows.count() == 50 and seen.get == {"bad_entry": 900, "missing_image": 50}
        assert re.search(r"hashpartitioning\(__key#\d+", plan(rows))  # a bad entry's key is its own hash
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def shown(spark, c, **values):
    df = spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{k} {t}" for k, (_, t) in values.items()))
    return df.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()


def test_questions_of_other_lengths_are_not_compared(spark):
    """Pairs that fail by their lengths are dropped before the Arrow function."""
    df = spark.createDataFrame([(1, 0, "ship"), (1, 1, "a far longer question about grey harbor walls"), (1, 2, "ship"), (1, 3, "ships")], "t int, k int, q string")
    out = T.similar_questions(df, "t", "k", "q", 0.8)
    assert sorted((r.left, r.right, round(r.similarity, 4)) for r in out.collect()) == [(0, 2, 1.0), (0, 3, 0.8889)]
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"length\(__t#\d+\)", text[text.index("ArrowEvalPython") :])


def test_a_verdict_parses_its_prompt_once(spark):
    text = shown(spark, P.rule_verdict(F.concat(F.lit("a"), F.upper("p"))), p=("x", "string"))
    assert text.count("upper(p") == 1 and text.count("sequence(") + text.count("[0,1,2,3]") <= 4


def test_statements_are_drawn_in_a_lambda(spark):
    df = spark.sql("select 1 as a, 'ship' as c, 0.1D as x1, 0.1D as y1, 0.5D as x2, 0.6D as y2")
    out = B.mc_from_boxes(df, ["a"], F.col("c"), [F.col(c) for c in ("x1", "y1", "x2", "y2")])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("sha1(") <= 5  # eleven of the order before


def test_sorts_compare_natively(spark):
    """Corners and sentences are not compared by a lambda for each pair."""
    text = shown(spark, G.canonical_corners(F.col("p")), p=([(0.0, 0.0)], "array<struct<x double, y double>>")) + shown(spark, U.repeated_sentence(F.col("t")), t=("x", "string"))
    assert text.count("sort_array(") == 2 and "array_sort(" not in text


def test_pairs_and_their_sides_come_from_one_pass(spark, sf):
    from loomlake.plans.references import rotated_pairs

    both, p, t = rotated_pairs(spark, sf)
    assert set(both.inputFiles()) == set(p.inputFiles()) == set(t.inputFiles())
    assert t.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count() and 0 < p.count() < t.count()
