"""Queries of sources and streams, over driver tables and files that Spark derives from them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomlake.plans.fixtures import OBJECTS, ROLLOUTS, duck, frame
from loomlake.session import shared_dir
from loomlake.sources import readers as S
from loomlake.streaming import streams as X

QUERIES, ORACLES = {}, {}
E, O = duck(ROLLOUTS), duck(OBJECTS)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_read_jsonl", "select doc_id, lang, md5(text) as text from documents")
def _(spark, sf):
    """Documents written as JSON lines and read back under a schema."""
    path = scratch(spark, "jsonl")
    S.write_jsonl(spark.read.parquet(f"{sf}/documents.parquet"), path)
    return S.read_jsonl(spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.md5("text").alias("text"))


@query("s1_keep_bad_lines", "select cast(sum(cast(doc_id % 10 = 0 as int)) as bigint) as bad, cast(sum(cast(doc_id % 10 <> 0 as int)) as bigint) as good from documents")
def _(spark, sf):
    path = scratch(spark, "bad")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    d.select(F.when(F.col("doc_id") % 10 == 0, '{"doc_id": 1, oops').otherwise(F.to_json(F.struct("doc_id"))).alias("value")).write.text(path)
    df = S.read_jsonl(spark, path, "doc_id long", bad="keep").select("doc_id", "_corrupt_record").cache()
    return df.agg(F.count_if(F.col("_corrupt_record").isNotNull()).alias("bad"), F.count_if(F.col("_corrupt_record").isNull()).alias("good"))


@query("s3_load_table", "select p_partkey, p_brand from part")
def _(spark, sf):
    path = scratch(spark, "table") + ".csv"
    S.write_csv(spark.read.parquet(f"{sf}/part.parquet"), path)
    return S.load_table(spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand")


@query("s4_split_address", "select doc_id from documents where lang = 'de'")
def _(spark, sf):
    path = scratch(spark, "splits") + ".parquet"
    spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("split")).write.partitionBy("split").parquet(path)
    return S.load_table(spark, f"{path}@de").select("doc_id")


@query("s9_filter_by_index", "select doc_id, source from documents where doc_id in (select doc_id from labels)")
def _(spark, sf):
    return S.filter_by_index(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("doc_id", "source")


@query("s10_inventory", "with r as (select distinct o_custkey % 500 as name from orders), f as (select c_custkey % 700 as name, count(*) as n from customer group by 1) select coalesce(r.name, f.name) as name, case when n is null then 'missing' when r.name is null then 'unused' when n > 1 then 'duplicate' else 'ok' end as status from r full join f on r.name = f.name")
def _(spark, sf):
    r = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") % 500).alias("name"))
    f = spark.read.parquet(f"{sf}/customer.parquet").select((F.col("c_custkey") % 700).alias("name"))
    return S.inventory(r, f, "name")


@query("s11_split_valid", f"select count(*) filter (w > 15 and h > 15) as valid, count(*) filter (not (w > 15 and h > 15)) as rejected from ({O})")
def _(spark, sf):
    good, bad = S.split_valid(frame(spark, sf, OBJECTS), (F.col("w") > 15) & (F.col("h") > 15))
    return good.agg(F.count("*").alias("valid")).crossJoin(bad.agg(F.count("*").alias("rejected")))


@query("s16_merge_sources", """with a as (select doc_id, 'a' as source, lang || '/a_' || (doc_id % 50) || '.png' as p, 'x/' || doc_id % 7 || '/' || (doc_id % 50) || '.png' as image from documents where doc_id % 2 = 0 union all select doc_id, 'b', lang || '/b_' || (doc_id % 50) || '.png', 'x/' || doc_id % 7 || '/' || (doc_id % 50) || '.png' from documents where doc_id % 2 = 1)
 select p as first_path, count(*) as n, count(*) - 1 as suffixed from a group by p""")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("split"), F.concat(F.lit("x/"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), (F.col("doc_id") % 50).cast("string"), F.lit(".png")).alias("image"))
    m = S.merge_sources({"a": d.where("doc_id % 2 = 0"), "b": d.where("doc_id % 2 = 1")})
    first = F.regexp_replace("new_path", r"^([^_]*_\d+)_\d+\.", "$1.")
    return m.groupBy(first.alias("first_path")).agg(F.count("*").alias("n"), F.count_if(F.col("new_path") != first).alias("suffixed"))


def _event_stream(spark, sf):
    """``events`` as a stream: its rows written to a folder that the stream reads."""
    path = scratch(spark, "events")
    df = frame(spark, sf, ROLLOUTS).select("row_id", "uid", "event_type", "tokens", F.col("ts").cast("timestamp").alias("ts"))
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query("x1_ingest_log", f"select count(*) as n from ({E})")
def _(spark, sf):
    """Every event arrives once although the log is read twice: the second run finds nothing new."""
    out, mark = scratch(spark, "log"), scratch(spark, "mark")
    stream = X.ingest_log(_event_stream(spark, sf), "row_id", "ts")
    for _ in range(2):
        X.run_available(stream, out, mark)
    return spark.read.parquet(out).agg(F.count("*").alias("n"))


@query("x2_event_health", f"select date_trunc('day', ts)::timestamp as start, event_type, count(*) as calls, count(*) filter (event_type = 'error') as errors, max(tokens) as max_tokens from ({E}) group by 1, 2")
def _(spark, sf):
    """A stream of the events; the watermark is wide, so none is late."""
    health = X.event_health(_event_stream(spark, sf), watermark="20000 days")
    return X.run_latest(health, ["start", "event_type"], scratch(spark, "health"), scratch(spark, "mark"))


@query("x3_convert_stream", f"select row_id, upper(event_type) as kind from ({E}) where row_id % 10 <> 0")
def _(spark, sf):
    out = scratch(spark, "converted")
    stream = X.convert_stream(_event_stream(spark, sf), lambda d: d.select("row_id", F.upper("event_type").alias("kind")), F.col("row_id") % 10 != 0)
    X.run_available(stream, out, scratch(spark, "mark"))
    return spark.read.parquet(out)


@query("x4_blocks", "select event_id // 100 as block, count(*) as n, min(event_id) as first from events group by 1")
def _(spark, sf):
    df = X.blocks(spark.read.parquet(f"{sf}/events.parquet"), 100, "event_id")
    return df.groupBy("block").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("x4_stream_blocks", f"select uid, row_id, row_number() over (partition by uid order by ts, row_id) - 1 as place, (row_number() over (partition by uid order by ts, row_id) - 1) // 10 as block from ({E})")
def _(spark, sf):
    """Blocks of ten of each user's events, by state that is kept for each user."""
    out = scratch(spark, "blocks")
    X.run_available(X.stream_blocks(_event_stream(spark, sf), "uid", "row_id", "ts", 10, "20000 days"), out, scratch(spark, "mark"))
    return spark.read.parquet(out).select("uid", "row_id", "place", "block")


@query("s2_read_json_list", "select doc_id, lang, length(text) as n from documents")
def _(spark, sf):
    """Documents as whole-file lists of up to 500, some bare, some under a key."""
    path = scratch(spark, "lists")
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("g", F.floor(F.col("doc_id") / 500))
    items = F.to_json(F.collect_list(F.struct("doc_id", "lang", "text")))
    d.groupBy("g").agg(F.when(F.col("g") % 2 == 0, items).otherwise(F.concat(F.lit('{"samples": '), items, F.lit("}"))).alias("value")).write.partitionBy("g").text(path)
    return S.read_json_list(spark, path, "doc_id: long, lang: string, text: string").select("doc_id", "lang", F.length("text").alias("n"))


def _label_lines():
    corner = F.concat_ws(" ", *[F.format_string("%.4f", v / 1000) for v in (F.col("cx") - F.col("w") / 2, F.col("cy") - F.col("h") / 2, F.col("cx") + F.col("w") / 2, F.col("cy") - F.col("h") / 2, F.col("cx") + F.col("w") / 2, F.col("cy") + F.col("h") / 2, F.col("cx") - F.col("w") / 2, F.col("cy") + F.col("h") / 2)])
    return F.when(F.col("part") % 11 == 0, "no label").otherwise(F.concat_ws(" ", "class_id", corner))


@query("s6_read_box_labels", f"select image_id // 500 as scene, count(*) as lines, count(*) filter (part % 11 = 0) as bad, round(sum(case when part % 11 > 0 then cx - w/2 end), 3) as x from ({O}) where image_id // 500 % 7 <> 3 group by 1")
def _(spark, sf):
    """Scenes of 500 images as label files in shares of the size."""
    path = scratch(spark, "labels")
    o = frame(spark, sf, OBJECTS).withColumn("scene", F.floor(F.col("image_id") / 500)).where("scene % 7 <> 3")
    o.groupBy("scene").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("image_id", "object_index", _label_lines().alias("t")))), lambda x: x["t"]), "\n").alias("value")).write.partitionBy("scene").text(path)
    rows = S.read_box_labels(spark, path, 1000, 1000, r"scene=([^/]+)/")
    return rows.groupBy(F.col("image").cast("long").alias("scene")).agg(F.count(F.lit(1)).alias("lines"), F.count_if("bad").alias("bad"), F.round(F.sum(F.when(~F.col("bad"), F.get("points", 0)["x"])), 3).alias("x"))


@query("s6_label_report", f"with s as (select image_id // 500 as scene, count(*) filter (part % 11 > 0) as objects, count(*) filter (part % 11 = 0) as bad_lines from ({O}) group by 1) select cast(scene as varchar) as image, case when scene % 7 = 3 then 'no_label' when bad_lines > 0 then 'bad_lines' else 'ok' end as status, case when scene % 7 = 3 then 0 else objects end as objects, case when scene % 7 = 3 then 0 else bad_lines end as bad_lines from s")
def _(spark, sf):
    """Scenes against their label lines; every seventh has no file."""
    o = frame(spark, sf, OBJECTS).select(F.floor(F.col("image_id") / 500).cast("string").alias("image"), (F.col("part") % 11 == 0).alias("bad"))
    return S.label_report(o, o.where("image % 7 <> 3"), "report")


@query("s7_read_voc_xml", f"select image_id // 200 as scene, count(*) as objects, cast(sum(cx) as bigint) as x, count(*) filter (part % 3 <> 1) as called, min(case when part % 3 = 1 then 'the ' || class_name else class_name end) as first from ({O}) group by 1")
def _(spark, sf):
    """Annotation files of 200 images; the phrase and the box stand in several places."""
    path = scratch(spark, "voc")
    n, k = lambda c: F.col(c).cast("long").cast("string"), F.col("part") % 3
    box = F.when(k == 2, F.concat(F.lit("<a/><b/><c><q>"), n("cx"), F.lit("</q><q>1</q><q>2</q><q>3</q></c><d>"), "class_name", F.lit("</d>"))).otherwise(F.concat(F.lit("<bndbox><ymin>1</ymin><xmin>"), n("cx"), F.lit("</xmin><xmax>2</xmax><ymax>3</ymax></bndbox>")))
    said = F.when(k == 0, F.concat(F.lit("<name>"), "class_name", F.lit("</name>"))).when(k == 1, F.concat(F.lit("<name>no</name><phrase>the "), "class_name", F.lit("</phrase>"))).otherwise("")
    one = F.concat(F.lit("<object>"), said, box, F.lit("</object>"))
    o = frame(spark, sf, OBJECTS).withColumn("scene", F.floor(F.col("image_id") / 200))
    o.groupBy("scene").agg(F.concat(F.lit("<annotation><filename>f"), F.col("scene").cast("string"), F.lit("</filename>"), F.array_join(F.collect_list(one), "\n"), F.lit("</annotation>")).alias("value")).write.partitionBy("scene").text(path, lineSep="\n")
    rows = S.read_voc_xml(spark, path)
    scene = F.substring("filename", 2, 20).cast("long")
    return rows.groupBy(scene.alias("scene")).agg(F.count(F.lit(1)).alias("objects"), F.sum("x1").cast("long").alias("x"), F.count_if(~F.col("phrase").startswith("the ") & (F.col("y1") == 1) & (F.col("x2") == 2)).alias("__c"), F.min("phrase").alias("first")).withColumnRenamed("__c", "called")


@query("s11_generation_parquet", "select count(*) filter (doc_id % 10 > 0) as written, count(*) filter (doc_id % 10 = 0 or doc_id % 4 = 0) as rejected, count(*) filter (doc_id % 10 = 0 and doc_id % 4 > 0) as without_id from documents")
def _(spark, sf):
    """A batch whose rows are all valid is written, one with invalid rows is rejected as a whole, with its errors."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    row = lambda bad: d.select("doc_id", F.when(F.col("doc_id") % 10 > 0, F.col("doc_id").cast("string")).alias("id"), F.when(bad, " ").otherwise("ask").alias("query"), F.lit("").alias("gt"), F.array(F.struct(F.lit("rgb").alias("modality"), F.lit("a").alias("name"))).alias("image"), F.lit("r").alias("image_root"), F.lit("s").alias("data_source"), F.lit("t").alias("task"))
    good, wrong, none = (scratch(spark, n) for n in ("batch", "errors", "unwritten"))
    S.to_generation_parquet(row(F.lit(False)).where("doc_id % 10 > 0"), good, wrong)
    S.to_generation_parquet(row(F.col("doc_id") % 4 == 0), none, wrong)
    errors = spark.read.parquet(wrong)
    w = spark.read.parquet(good).agg(F.count(F.lit(1)).alias("written"))
    return w.join(errors.agg(F.count(F.lit(1)).alias("rejected"), F.count_if(F.array_join("faults", ",") == "id").alias("without_id")), how="cross")  # one row each


@query("s12_write_jsonl", f"select count(*) as n, cast(sum(object_index) as bigint) as total, count(distinct class_name) as classes from ({O})")
def _(spark, sf):
    path = scratch(spark, "jsonl-sink")
    S.write_jsonl(frame(spark, sf, OBJECTS).select("image_id", "object_index", "class_name", F.array("cx", "cy").alias("center")), path)
    j = spark.read.text(path).select(F.from_json("value", "image_id long, object_index long, class_name string, center array<double>").alias("j"))
    return j.where("size(j.center) = 2").agg(F.count(F.lit(1)).alias("n"), F.sum("j.object_index").alias("total"), F.count_distinct("j.class_name").alias("classes"))


@query("s13_write_csv", f"select image_id, object_index, class_name || ' ; ' || object_index as joined from ({O})")
def _(spark, sf):
    path = scratch(spark, "csv-sink")
    S.write_csv(frame(spark, sf, OBJECTS).select("image_id", "object_index", F.array("class_name", F.col("object_index").cast("string")).alias("joined")), path)
    return spark.read.csv(path, header=True, schema="image_id long, object_index long, joined string")


@query("s5_read_remote_json", "select doc_id, source from documents")
def _(spark, sf):
    """JSON lines under a URI with a scheme: any store that the session has a file system for is read the same way."""
    path = scratch(spark, "remote")
    path = path if "://" in path else f"file://{path}"
    S.write_jsonl(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), path)
    return S.read_jsonl(spark, path, "doc_id long, source string", bad="fail")
