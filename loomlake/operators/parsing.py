"""Tables of model output parsed to boxes, verdicts and messages. Extraction is regular expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomlake.operators import geometry as G
from loomlake.operators.columns import let
from loomlake.operators.joins import canonical_class

NUMBER = r"-?\d+(?:\.\d+)?"


def format_answer(cls: Column, confidence: Column | None, values: Column) -> Column:
    """class|confidence|v1,v2,... with whole numbers (ties to even)."""
    coords = F.array_join(F.transform(values, lambda v: F.bround(v, 0).cast("int").cast("string")), ",")
    return F.concat_ws("|", cls, *([] if confidence is None else [F.format_string("%.2f", confidence)]), coords)


def parse_detections(df: DataFrame, text: str, key: str, top: float = 1000.0) -> DataFrame:
    """(key, status, detections) of outputs with a block FINAL_DETECTIONS ... END_DETECTIONS.

    A line is class|[confidence|]eight numbers of 0..``top``; confidence is 1 if left out. Any bad line
    empties the result ("bad_line"); without a block the status is "no_block"; equal boxes count once.
    """
    block = F.regexp_extract(text, r"(?s)FINAL_DETECTIONS\s*\n(.*?)END_DETECTIONS", 1)
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    df = df.select(key, F.col(text).rlike(r"(?s)FINAL_DETECTIONS\s*\n.*?END_DETECTIONS").alias("__has"), lines.alias("__l"))

    def one(line: Column) -> Column:
        parts = F.split(line, r"\|")
        numbers = F.transform(F.split(F.get(parts, F.size(parts) - 1), ","), lambda v: F.trim(v).try_cast("double"))
        conf = F.when(F.size(parts) == 3, F.trim(F.get(parts, 1)).try_cast("double")).otherwise(F.lit(1.0))
        ok = F.size(parts).isin(2, 3) & (F.size(numbers) == 8) & F.forall(numbers, lambda v: F.coalesce((v >= 0) & (v <= top), F.lit(False))) & F.coalesce((conf >= 0) & (conf <= 1), F.lit(False))
        return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.lower(F.trim(F.get(parts, 0))).alias("class_name"), conf.alias("confidence"), numbers.alias("points"))

    df = df.withColumn("__d", F.transform("__l", one)).withColumn("__ok", F.forall("__d", lambda d: d["ok"]))
    status = F.when(~F.col("__has"), "no_block").when(~F.col("__ok"), "bad_line").otherwise("ok")
    clean = F.array_distinct(F.transform("__d", lambda d: F.struct(d["class_name"].alias("class_name"), d["confidence"].alias("confidence"), d["points"].alias("points"))))
    return df.select(key, status.alias("status"), F.when(F.col("__has") & F.col("__ok"), clean).otherwise(F.slice(clean, 1, 0)).alias("detections"))


def parse_box(text: Column) -> Column:
    """Four numbers: the JSON field bbox or box, else the first bracketed four; null if there are none."""
    # a text without a brace is no JSON object: telling that by parsing costs ten times as much
    field = F.when(F.contains(text, F.lit("{")), F.coalesce(F.get_json_object(text, "$.bbox"), F.get_json_object(text, "$.box")))
    json = F.coalesce(field, F.regexp_extract(text, r"[\[(]\s*(" + NUMBER + r"(?:\s*,\s*" + NUMBER + r"){3})\s*[\])]", 1))
    numbers = F.transform(F.regexp_extract_all(json, F.lit(NUMBER), F.lit(0)), lambda v: v.cast("double"))
    return F.when(F.size(numbers) == 4, numbers)


def spatial_candidates(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, kind, n, values): every bbox_2d=[...] (four numbers) and obb_8=[...] (eight) in a text."""
    out = None
    for kind, mark, n in (("bbox", "bbox_2d", 4), ("obb", "obb_8", 8)):
        found = F.regexp_extract_all(text, F.lit(mark + r"\s*[=:]\s*\[([^\]]*)\]"), F.lit(1))
        rows = df.select(*keys, F.posexplode(found).alias("n", "t")).select(*keys, F.lit(kind).alias("kind"), "n", F.transform(F.regexp_extract_all("t", F.lit(NUMBER), F.lit(0)), lambda v: v.cast("double")).alias("values"))
        rows = rows.where(F.size("values") == n)
        out = rows if out is None else out.unionByName(rows)
    return out


def focus_from_text(text: Column) -> Column:
    """The four whole numbers of "region [a, b, c, d]" in a question; null if there are none."""
    t = F.regexp_extract(text, r"(?i)region\s*\[\s*(\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*\d+)\s*\]", 1)
    return F.when(t != "", F.transform(F.split(t, r"\s*,\s*"), lambda v: v.cast("int")))


def verdict(text: Column) -> Column:
    """(accepted, reason) of "ACCEPT" or "REJECT: reason"; anything else is rejected as unparsed."""
    t = F.trim(text)
    up = F.upper(t)
    reason = F.trim(F.regexp_replace(t, r"(?is)^reject\s*:?", ""))
    return F.struct(F.startswith(up, F.lit("ACCEPT")).alias("accepted"), F.when(F.startswith(up, F.lit("ACCEPT")), "").when(F.startswith(up, F.lit("REJECT")), reason).otherwise("unparsed").alias("reason"))


def parse_message(text: Column) -> Column:
    """(action, question, answer) of a JSON object message; null where the action is not inspect or final or its text
    is missing."""
    j = F.from_json(text, "action string, thinking string, question string, answer string")
    ok = ((j["action"] == "inspect") & (F.trim(j["question"]) != "")) | ((j["action"] == "final") & (F.trim(j["answer"]) != ""))
    return F.when(ok, j)


def structured_answer(text: Column) -> Column:
    """(class_name, values) of "class|eight numbers"; values are null with another number of them, or without a bar."""

    def told(t: Column) -> Column:
        found = F.regexp_extract_all(F.regexp_extract(t, r"(?s)^[^|]*\|(.*)$", 1), F.lit(NUMBER), F.lit(0))
        values = F.when(F.contains(t, F.lit("|")), let(found, lambda v: F.when(F.size(v) == 8, F.transform(v, lambda x: x.cast("double")))))
        return F.struct(canonical_class(F.substring_index(t, "|", 1)).alias("class_name"), values.alias("values"))

    return let(F.trim(F.coalesce(text, F.lit(""))), told)


def rule_verdict(prompt: Column, least_iou: float = 0.1, ratio: float = 0.35) -> Column:
    """ACCEPT, or REJECT with the reason, of a verifier's prompt "Query: ... Answer: ... GT: ..."; null for a prompt of other form.

    Both must name a class, the same one. Where the query asks for a class, or the truth has no corners, that is all; else the
    answer needs corners of a simple quadrilateral whose box meets the truth's by ``least_iou`` and whose centre lies in it, widened by ``ratio``.
    """
    form = r"(?is)(?:^|.*?\n)Query:\s*(.*?)\nAnswer:\s*(.*?)\nGT:\s*([^\n]*)\s*$"
    # corners, boxes and the IoU are bound, and only computed for answers that get so far
    corners = lambda v: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: G.point(F.get(v, i * 2), F.get(v, i * 2 + 1)))
    sides = lambda b: [b[k] for k in ("x1", "y1", "x2", "y2")]

    def placed(x: Column) -> Column:
        a, b, iou = sides(x["a"]), sides(x["b"]), x["iou"]
        near = (iou >= least_iou) & G.center_in_expanded((a[0] + a[2]) / 2, (a[1] + a[3]) / 2, b, ratio, 1.0)
        return F.when(~near, F.concat(F.lit("REJECT: predicted region mismatches target geometry (HBB IoU="), F.format_string("%.3f", iou), F.lit(")"))).otherwise("ACCEPT")

    def shaped(p: Column, g: Column) -> Column:
        boxes = lambda c: F.struct(G.hbb(c).alias("a"), G.hbb(corners(g)).alias("b"))
        judged = lambda c: let(let(boxes(c), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), G.iou(sides(x["a"]), sides(x["b"])).alias("iou"))), placed)
        bad = lambda status: F.concat(F.lit("REJECT: invalid predicted OBB ("), status, F.lit(")"))
        return let(corners(p), lambda c: let(G.quad_status(c), lambda status: F.when(status != "ok", bad(status)).otherwise(judged(c))))

    def told(x: Column) -> Column:
        p, g = x["p"], x["g"]
        asks = x["q"].rlike(r"(?i)\b(?:which|what)\b[^?.]*\b(?:category|class)\b|classif")
        return (
            F.when(p["class_name"].isNull() | g["class_name"].isNull(), "REJECT: answer is not a valid canonical label or structured grounding output")
            .when(p["class_name"] != g["class_name"], "REJECT: canonical class mismatch").when(asks | g["values"].isNull(), "ACCEPT").when(p["values"].isNull(), "REJECT: missing complete clockwise OBB")
            .otherwise(shaped(p["values"], g["values"]))
        )

    def parsed(t: Column) -> Column:
        query, said, truth = (F.regexp_extract(t, form, i) for i in (1, 2, 3))
        return F.struct(query.alias("q"), structured_answer(said).alias("p"), structured_answer(truth).alias("g"))

    return let(prompt, lambda t: F.when(t.rlike(form), let(parsed(t), told)))


def tagged_message(text: Column) -> Column:
    """(action, thinking, question, answer) of a message in JSON, else in tags: <question> inspects, <answer> or "Final Answer:" ends; null where
    neither form holds, or both a question and an answer are there."""
    j = parse_message(text)
    tag = lambda t: F.nullif(F.trim(F.regexp_extract(text, rf"(?is)<{t}>(.*?)</{t}>", 1)), F.lit(""))
    question, answer = tag("question"), F.coalesce(tag("answer"), F.nullif(F.trim(F.regexp_extract(text, r"(?i)\[?Final Answer\]?\s*:\s*(.+)", 1)), F.lit("")))
    one = question.isNull() != answer.isNull()
    tags = F.struct(F.when(question.isNotNull(), "inspect").otherwise("final").alias("action"), F.coalesce(tag("thinking"), tag("think")).alias("thinking"), question.alias("question"), answer.alias("answer"))
    return F.coalesce(j, F.when(one, tags))


def verifier_json(text: Column) -> Column:
    """(passed, score, reason) of a verifier's JSON object; the score from 0 to 1, 0 if it is no number; null for other texts."""
    j = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), "pass boolean, score string, reason string")
    score = F.coalesce(j["score"].try_cast("double"), F.lit(0.0))
    return F.when(j["pass"].isNotNull() | j["score"].isNotNull(), F.struct(F.coalesce(j["pass"], F.lit(False)).alias("passed"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"), F.coalesce(j["reason"], F.lit("")).alias("reason")))
