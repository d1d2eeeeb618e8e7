"""Readers on small files."""

import json

import pytest

from loomlake.sources import readers as S


def test_box_labels(spark, tmp_path):
    (tmp_path / "P1.txt").write_text("1 0.1 0.1 0.2 0.1 0.2 0.2 0.1 0.2\n\n2 10 10 20 10 20 20 10 20\nbad line\n")
    rows = S.read_box_labels(spark, str(tmp_path), 100, 200).orderBy("line").collect()
    assert [(r.image, r.object_index, r.class_id, r.mode, r.bad) for r in rows] == [("P1", 0, 1, "normalized", False), ("P1", 1, 2, "pixel", False), ("P1", 2, None, "pixel", True)]
    assert (rows[0].points[0].x, rows[0].points[0].y) == (10.0, 20.0)


def test_json_list(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "name": "x"}]))
    (tmp_path / "b.json").write_text(json.dumps({"items": [{"id": 2, "name": "y"}, {"id": 3}]}, indent=1))
    rows = S.read_json_list(spark, str(tmp_path), "id: long, name: string").orderBy("id").collect()
    assert [(r.id, r.name) for r in rows] == [(1, "x"), (2, "y"), (3, None)]


def test_voc_xml(spark, tmp_path):
    obj = lambda n, x: f"<object><name>{n}</name><bndbox><xmin>{x}</xmin><ymin>2</ymin><xmax>9</xmax><ymax>8</ymax></bndbox></object>"
    (tmp_path / "a.xml").write_text(f"<annotation><filename>i.jpg</filename>{obj('ship', 1)}{obj('car', 3)}</annotation>")
    rows = S.read_voc_xml(spark, str(tmp_path)).orderBy("object").collect()
    assert [(r.filename, r.phrase, r.x1, r.y2) for r in rows] == [("i.jpg", "ship", 1.0, 8.0), ("i.jpg", "car", 3.0, 8.0)]


def test_jsonl_modes(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": oops\n{"a": 2}\n')
    path = str(tmp_path / "l.jsonl")
    assert S.read_jsonl(spark, path, "a long", bad="skip").count() in (2, 3)
    assert sorted((r.a for r in S.read_jsonl(spark, path, "a long", bad="skip").collect()), key=str) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        S.read_jsonl(spark, path, "a long").collect()
    with pytest.raises(ValueError):
        S.load_table(spark, "x.arrow")


def test_labels_are_reported(spark, tmp_path):
    (tmp_path / "P1.txt").write_text("1 0.1 0.1 0.2 0.1 0.2 0.2 0.1 0.2\nbad line\n")
    labels = S.read_box_labels(spark, str(tmp_path), 100, 200)
    images = spark.createDataFrame([("P1",), ("P2",)], "image string")
    assert sorted(map(tuple, S.label_report(images, labels, "report").collect())) == [("P1", "bad_lines", 1, 1), ("P2", "no_label", 0, 0)]
    with pytest.raises(Exception, match="no label file for image P2"):
        S.label_report(images, labels).collect()


def test_voc_xml_of_objects_with_other_children(spark, tmp_path):
    box = "<bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox>"
    (tmp_path / "a.xml").write_text(f"<annotation><filename>i.jpg</filename><object>{box}<name> </name><text>a tank</text></object><object><a/><b/><c><q>5</q><q>6</q><q>7</q><q>8</q></c><d> grey ship </d></object><object><name>x</name></object></annotation>")
    rows = S.read_voc_xml(spark, str(tmp_path)).orderBy("object").collect()
    assert [tuple(r)[1:] for r in rows] == [(1, "a tank", 1.0, 2.0, 3.0, 4.0), (2, "grey ship", 5.0, 6.0, 7.0, 8.0), (3, "x", None, None, None, None)]


def test_splits_of_paths_with_signs(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "x int, split string").write.parquet(f"{tmp_path}/me@home/t.parquet")
    assert S.load_table(spark, f"{tmp_path}/me@home/t.parquet").count() == 2
    assert [r.x for r in S.load_table(spark, f"{tmp_path}/me@home/t.parquet@b").collect()] == [2]


def test_a_batch_with_errors_is_rejected_as_a_whole(spark, tmp_path):
    image = [("rgb", "a.png")]
    ok = ("1", "q", "", image, "r", "s", "t")
    df = lambda *rows: spark.createDataFrame(list(rows), S.GENERATION)
    assert S.to_generation_parquet(df(ok), f"{tmp_path}/good", f"{tmp_path}/e1") == 0
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/good").select("id", "gt", "task").collect()] == [("1", "", "t")]
    assert S.to_generation_parquet(df(ok, (None, "q", None, [], "r", "s", "t")), f"{tmp_path}/bad", f"{tmp_path}/e2") == 1
    assert not (tmp_path / "bad").exists() and spark.read.parquet(f"{tmp_path}/e2").first().faults == ["id", "gt", "image"]


def test_an_annotated_object_is_read_once(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<annotation><filename>i</filename><object><name>a</name></object></annotation>")
    plan = S.read_voc_xml(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("/object/name") == 1  # one path for all of an object
    assert plan.rindex("Generate") < plan.index("//filename")  # the name below the rows of objects, once for each file
