"""Reading and writing annotation, conversation and log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructField, StringType, StructType

FORMATS = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "txt": "text"}


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, bad: str = "fail") -> DataFrame:
    """One object a line; blank lines are skipped. Bad lines: "fail" the job, "skip", or "keep" as rows whose
    ``_corrupt_record`` has the line."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read
    if bad == "keep":
        kind = StructType([*kind.fields, StructField("_corrupt_record", StringType())])
        return reader.schema(kind).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return reader.schema(kind).option("mode", {"fail": "FAILFAST", "skip": "DROPMALFORMED"}[bad]).json(path)


def read_json_list(spark: SparkSession, path: str, item: str, keys: tuple[str, ...] = ("data", "annotations", "samples", "items")) -> DataFrame:
    """Items of whole-file JSON: the file is an array, or an object with the array under one of ``keys``."""
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<{item}>>")
    under = F.coalesce(*[F.from_json(F.get_json_object("value", f"$.{k}"), f"array<struct<{item}>>") for k in keys])
    starts = F.startswith(F.ltrim(F.col("value")), F.lit("["))
    return text.select(F.explode(F.when(starts, listed).otherwise(under)).alias("x")).select("x.*")


def load_table(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """A table by its extension: csv (with header), json, jsonl, parquet or txt. ``path@split`` keeps rows of a split."""
    # only what follows the last @ of the last step can name a split
    head, at, part = path.rpartition("@")
    path, part = (head, part) if at and head and "/" not in part else (path, "")
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise ValueError(f"no reader for {kind!r}; one of {sorted(FORMATS)}")
    options = ({"header": True} if kind == "csv" else {"multiLine": True} if kind == "json" else {}) | options
    df = spark.read.format(FORMATS[kind]).options(**options).load(path)
    return df.where(F.col("split") == part) if part else df


def read_box_labels(spark: SparkSession, path: str, width: int, height: int, name: str = r"([^/]+?)(?:\.\w+)?$") -> DataFrame:
    """Label files of lines "class x1 y1 ... x4 y4" (shares of the size, or pixels): one row a line.

    ``bad`` names lines of other form; ``object_index`` counts the lines of a file in order. ``name``: where a file's path has its image's name.
    """
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), name, 1).alias("image"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    lines = lines.withColumn("parts", F.split(F.trim("text"), r"\s+")).where(F.trim("text") != "")
    v = F.transform(F.slice("parts", 2, 8), lambda x: x.try_cast("double"))
    lines = lines.withColumn("v", v)
    shares = F.array_max(F.transform("v", F.abs)) <= 1.5
    points = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct((F.get("v", i * 2) * F.when(shares, width).otherwise(1)).alias("x"), (F.get("v", i * 2 + 1) * F.when(shares, height).otherwise(1)).alias("y")))
    bad = (F.size("parts") != 9) | F.exists("v", lambda x: x.isNull()) | F.get("parts", 0).try_cast("double").isNull()
    out = lines.select("image", "line", bad.alias("bad"), F.get("parts", 0).try_cast("double").cast("int").alias("class_id"), F.when(shares, "normalized").otherwise("pixel").alias("mode"), points.alias("points"))
    return out.withColumn("object_index", F.row_number().over(W.partitionBy("image").orderBy("line")) - 1)


def label_report(images: DataFrame, labels: DataFrame, missing: str = "fail") -> DataFrame:
    """(image, status, objects, bad_lines) of all ``images`` (image): no_label, bad_lines, or ok.

    An image without a label file fails the job when the row is computed, unless ``missing`` is "report". A file without lines
    leaves no row of ``labels`` and counts as absent.
    """
    n = labels.groupBy("image").agg(F.count_if(~F.col("bad")).alias("objects"), F.count_if("bad").alias("bad_lines"))
    out = images.select("image").distinct().join(n, "image", "left")
    absent = F.raise_error(F.concat(F.lit("no label file for image "), "image")).cast("string") if missing == "fail" else F.lit("no_label")
    status = F.when(F.col("objects").isNull(), absent).when(F.col("bad_lines") > 0, "bad_lines").otherwise("ok")
    return out.select("image", status.alias("status"), F.coalesce("objects", F.lit(0)).alias("objects"), F.coalesce("bad_lines", F.lit(0)).alias("bad_lines"))


def read_voc_xml(spark: SparkSession, path: str) -> DataFrame:
    """Objects of annotation XML files: filename, object (from 1), phrase, x1, y1, x2, y2, by XPath; one row an object.

    The phrase is the first filled one of content, phrase, text, description and name, else the object's fourth child; the box is
    bndbox (by its names, else in order), else the third child's four children. What an object lacks is null.
    """
    files = spark.read.text(path, wholetext=True).select(F.expr("xpath_string(value, '//filename')").alias("filename"), F.regexp_extract_all("value", F.lit(r"(?s)<object(?:\s[^>]*)?>.*?</object>"), F.lit(0)).alias("__all"))
    files = files.select("filename", F.posexplode("__all").alias("i", "o"))  # the name is read before, once for each file
    sides = list(enumerate((("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2")), 1))
    phrases = [*(f"/object/{k}" for k in ("content", "phrase", "text", "description", "name")), "/object/*[4]"]
    places = {c: [f"/object/bndbox/{k}", f"/object/bndbox/*[{i}]", f"/object/*[3]/*[{i}]"] for i, (k, c) in sides}
    paths = [*phrases, *(p for some in places.values() for p in some)]
    # one path for all, so that an object is read once; no XML text holds the sign between them
    every = "concat(" + ", '\x01', ".join(paths) + ")"
    files = files.select("filename", "i", F.explode(F.array(F.split(F.xpath_string("o", F.lit(every)), "\x01", -1))).alias("__t"))
    told = lambda p: F.nullif(F.trim(F.get("__t", F.lit(paths.index(p)))), F.lit(""))
    first = lambda some: F.coalesce(*map(told, some))
    return files.select("filename", (F.col("i") + 1).alias("object"), first(phrases).alias("phrase"), *[first(some).try_cast("double").alias(c) for c, some in places.items()])


def filter_by_index(df: DataFrame, index: DataFrame, key: str) -> DataFrame:
    return df.join(index.select(key), key, "left_semi")


def inventory(refs: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """(name, status): missing (referenced only), unused (present only), duplicate (present several times) or ok."""
    r, f = refs.select(name).distinct().withColumn("r", F.lit(1)), files.groupBy(name).agg(F.count("*").alias("n"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("r").isNull(), "unused").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return r.join(f, name, "full").select(name, status.alias("status"))


def split_valid(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy ``ok``, and the others (a null condition is not satisfied)."""
    good = F.coalesce(ok, F.lit(False))
    return df.where(good), df.where(~good)


def merge_sources(sources: dict[str, DataFrame], path: str = "image", split: str = "split") -> DataFrame:
    """All sources in one layout: <split>/<source>_<base name>; equal new paths get suffixes _1, _2 and so on."""
    out = None
    for name, df in sources.items():
        base = F.regexp_replace(F.col(path), r"^.*/", "")
        df = df.withColumn("source", F.lit(name)).withColumn("new_path", F.concat(F.col(split), F.lit(f"/{name}_"), base))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    k = F.row_number().over(W.partitionBy("new_path").orderBy("source", path)) - 1
    suffixed = F.concat(F.regexp_replace("new_path", r"(\.\w+)?$", ""), F.lit("_"), F.col("k").cast("string"), F.regexp_extract("new_path", r"(\.\w+)$", 1))
    return out.withColumn("k", k).withColumn("new_path", F.when(F.col("k") > 0, suffixed).otherwise(F.col("new_path"))).drop("k")


#: The columns of a generation table.
GENERATION = "id string, query string, gt string, image array<struct<modality:string,name:string>>, image_root string, data_source string, task string"


def to_generation_parquet(df: DataFrame, path: str, errors: str, schema: str = GENERATION) -> int:
    """Writes ``df`` as a table of exactly the columns of ``schema`` at ``path`` if every row is valid; returns 0.

    A row is invalid if one of these is null, or an empty text or array where no answer is meant (all but gt). If any row is, nothing is written at
    ``path``: the invalid rows go to ``errors`` with the names of their faults, and their number is returned.
    """
    kind = StructType.fromDDL(schema)
    rows = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])
    empty = lambda f: F.size(f.name) == 0 if f.dataType.typeName() == "array" else F.trim(F.col(f.name)) == "" if f.name != "gt" else F.lit(False)
    faults = F.array_compact(F.array(*[F.when(F.col(f.name).isNull() | empty(f), F.lit(f.name)) for f in kind]))
    rows = rows.withColumn("faults", faults)
    bad = rows.where(F.size("faults") > 0)
    n = bad.count()
    if n:
        bad.write.parquet(errors)
    else:
        rows.drop("faults").write.parquet(path)
    return n


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; arrays become text joined by " ; "."""
    cols = [F.concat_ws(" ; ", F.transform(c, lambda x: x.cast("string"))).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.option("header", True).csv(path)
