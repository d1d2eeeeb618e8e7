"""Records of datasets, evaluation samples and run reports: visual questions, grounding, conversations, comparisons, statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomlake.operators import geometry as G
from loomlake.operators.columns import let
from loomlake.operators.conversations import final_text
from loomlake.operators.evidence import _FOCUS, _PLAIN_NUMBER, obb_output
from loomlake.operators.parsing import parse_box
from loomlake.operators.tokens import encode_pair


def _strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def with_image_mark(text: Column) -> Column:
    """The text, with <image> and a new line before it if it does not begin with that mark."""
    t = _strip(text)
    return F.when(F.startswith(F.lower(t), F.lit("<image>")), t).otherwise(F.concat(F.lit("<image>\n"), t))


def vqa_records(df: DataFrame, key: str, files: DataFrame | None = None, root: str = "") -> DataFrame:
    """(key, query, gt, image, image_root, task) of conversations of exactly two turns whose first holds [vqa] in any case.

    Columns: key, image, messages (array of (role, content)). Rows without an image name go, and those whose image is not in ``files`` (image).
    """
    first, second = F.get("messages", 0)["content"], F.get("messages", 1)["content"]
    keep = (F.size("messages") == 2) & F.contains(F.lower(F.coalesce(first, F.lit(""))), F.lit("[vqa]")) & (F.coalesce("image", F.lit("")) != "")
    rows = df.where(keep)
    if files is not None:
        rows = rows.join(files.select("image").distinct(), "image", "left_semi")
    return rows.select(key, with_image_mark(first).alias("query"), _strip(second).alias("gt"), F.array(F.struct(F.lit("rgb").alias("modality"), F.col("image").alias("name"))).alias("image"), F.lit(root).alias("image_root"), F.lit("vqa").alias("task"))


def modality_name(raw: Column) -> Column:
    """How a modality is shown: by its short names, else as it is."""
    k = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(k.isin("rgb", "vis", "optical"), "RGB / Visible").when(k.isin("inf", "ir", "infrared"), "Infrared").when(k == "sar", "Synthetic Aperture Radar (SAR)").otherwise(raw)


def image_meta(prefix: Column, images: Column) -> Column:
    """``prefix`` with the modality and size of each of ``images`` (array of (modality, width, height)): one line, or one numbered line each."""
    size = lambda x: F.concat(x["width"].cast("string"), F.lit("x"), x["height"].cast("string"))
    shown = lambda x: F.coalesce(modality_name(x["modality"]), F.lit("None"))
    one = F.concat(F.lit("- Modality: "), shown(F.get(images, 0)), F.lit(" (size: "), size(F.get(images, 0)), F.lit(")"))
    many = F.array_join(F.transform(images, lambda x, i: F.concat(F.lit("- Image "), (i + 1).cast("string"), F.lit(": Modality: "), shown(x), F.lit(", size: "), size(x), F.lit("\n"))), "")
    p = F.coalesce(prefix, F.lit(""))
    return F.when(F.coalesce(F.size(images), F.lit(0)) <= 0, p).when(F.size(images) == 1, F.concat(p, one)).otherwise(F.concat(p, many))


def trace_text(rounds: Column, final_thinking: Column) -> Column:
    """Reasoning, question and observation of each round that is no control round, then the last reasoning, a line each.

    ``rounds``: array of (thinking, visual_question, observation, control_round).
    """
    said = lambda name, v: F.concat(F.lit(f"{name}: "), F.coalesce(v, F.lit("")))
    live = F.filter(rounds, lambda t: ~F.coalesce(t["control_round"], F.lit(False)))
    parts = F.flatten(F.transform(live, lambda t: F.array(said("Reasoning", t["thinking"]), said("Visual question", t["visual_question"]), said("Visual observation", t["observation"]))))
    last = F.when(F.coalesce(final_thinking, F.lit("")) != "", F.array(said("Reasoning", final_thinking))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(parts, last), "\n")


def custom_sharegpt(df: DataFrame) -> DataFrame:
    """(id, messages, images, metadata) of accepted traces: the trace's text, the end of reasoning and the forced final answer.

    Columns: id, query, rounds, final_thinking, teacher_forced_final, image_path, task, bucket.
    """
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    content = F.concat(_strip(trace_text(F.col("rounds"), F.col("final_thinking"))), F.lit("\n</think>\n"), _strip(F.col("teacher_forced_final")))
    return df.select("id", F.array(turn("user", F.col("query")), turn("assistant", content)).alias("messages"), F.array("image_path").alias("images"), F.struct("task", F.col("bucket").alias("trajectory_bucket"), "id").alias("metadata"))


def rl_rows(df: DataFrame) -> DataFrame:
    """(problem, images, answer, metadata) of grounding references, with boxes in whole thousandths.

    Columns: id, reference, image_path, class_name, class_id, points (pixels), image_width, image_height.
    """
    whole = lambda v, size: F.bround(G.to_norm(v, F.col(size), 1000.0), 0).cast("int")
    corners = G.canonical_corners(F.col("points"))
    bbox = let(G.hbb(F.col("points")), lambda b: F.array(*[whole(b[k], s) for k, s in (("x1", "image_width"), ("y1", "image_height"), ("x2", "image_width"), ("y2", "image_height"))]))
    obb = F.flatten(F.transform(corners, lambda p: F.array(whole(p["x"], "image_width"), whole(p["y"], "image_height"))))
    answer = F.struct("class_name", bbox.alias("bbox"), obb.alias("obb"), F.array(F.lit(0), F.lit(1000)).alias("coordinate_range"), F.col("id").alias("source_id"))
    meta = F.struct(F.lit("ref_grounding_rl").alias("task"), "image_width", "image_height", "reference", "class_id")
    return df.select(F.concat(F.lit("Locate the object described by this referring expression: "), "reference").alias("problem"), F.array("image_path").alias("images"), answer.alias("answer"), meta.alias("metadata"))


def grounding_samples(refs: DataFrame, image: str = "image_id", cls: str = "class_name") -> DataFrame:
    """Adds ``ref_group``: unique where the image has one object of the class (same_class_count, 1 if null), else nonunique; gt_hbb from
    the corners where it is null; and coordinate_mode, norm1000_obb by default."""
    hull = F.array(*[G.hbb(F.col("points"))[k] for k in ("x1", "y1", "x2", "y2")])
    group = F.when(F.coalesce("same_class_count", F.lit(1)) == 1, "unique").otherwise("nonunique")
    return refs.withColumns({"ref_group": group, "gt_hbb": F.coalesce("gt_hbb", hull), "coordinate_mode": F.coalesce("coordinate_target", F.lit("norm1000_obb"))})


def external_box(box: Column, width: Column, height: Column) -> Column:
    """A box of four numbers in pixels: shares, percent or thousandths by its largest value (1.5, 100.5, 1000.5), else pixels. Null without four."""
    largest = F.array_max(F.transform(box, lambda v: F.abs(v)))
    scale = F.when(largest <= 1.5, 1.0).when(largest <= 100.5, 100.0).when(largest <= 1000.5, 1000.0)
    pixel = F.transform(box, lambda v, i: F.when(scale.isNull(), v).otherwise(v / scale * F.when(i % 2 == 0, width).otherwise(height)))
    return F.when(F.size(box) == 4, pixel)


def sharegpt_samples(df: DataFrame, key: str) -> DataFrame:
    """(key, question, gt, image, target_type, n_obb, gt_hbb): evaluation samples of conversations.

    Columns: key, messages (role, content), images (paths), task, width, height. The question is of the first user, the answer of the last
    assistant; rows that lack one of these or an image go. The target is obb if the answer's lines are rotated boxes or
    the task says obb or detection, hbb if it is a box of four numbers or the task says ground, else vqa.
    """
    users, helpers = F.filter("messages", lambda m: m["role"].isin("user", "human")), F.filter("messages", lambda m: m["role"].isin("assistant", "gpt"))
    told = F.struct(F.get(users, 0)["content"].alias("__u"), F.try_element_at(helpers, F.lit(-1))["content"].alias("__a"), F.get("images", 0).alias("__i"))
    # out of an explode, as the filter would compute them again
    df = df.select("*", F.explode(F.array(told)).alias("__t")).select(*df.columns, "__t.*")
    df = df.where((F.coalesce("__u", F.lit("")) != "") & (F.coalesce("__a", F.lit("")) != "") & (F.coalesce("__i", F.lit("")) != ""))
    df = df.select("*", F.explode(F.array(final_text(F.col("__a")))).alias("__g"))
    # a line of a box has a bar
    boxes = F.when(F.contains("__g", F.lit("|")), F.size(obb_output(F.col("__g"), F.col("width"), F.col("height"), F.lit("auto"))["predictions"])).otherwise(0)
    df = df.select("*", F.explode(F.array(F.struct(boxes.alias("__o"), parse_box(F.col("__g")).alias("__h")))).alias("__p")).select("*", "__p.*")
    task = F.coalesce("task", F.lit(""))
    kind = F.when((F.col("__o") > 0) | task.contains("obb") | task.contains("detection"), "obb").when(F.col("__h").isNotNull() | task.contains("ground"), "hbb").otherwise("vqa")
    return df.select(key, F.col("__u").alias("question"), F.col("__g").alias("gt"), F.col("__i").alias("image"), kind.alias("target_type"), F.col("__o").alias("n_obb"), F.col("__h").alias("gt_hbb"))


# The region that a question names.
_QUESTION_REGION = rf"(?i)(?:region|roi|bbox|box|coordinates?)[^\[\n]{{0,100}}\[\s*{_PLAIN_NUMBER}(?:\s*,\s*{_PLAIN_NUMBER}){{3}}\s*\]"


def redact_regions(text: Column) -> Column:
    """Focus regions and other boxes of a question without their numbers."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), _FOCUS, "focus region [hidden]")
    return F.regexp_replace(out, _QUESTION_REGION, "target ROI [hidden]")


def canonical_tags(text: Column) -> Column:
    """(text, changed): a reasoner's response with harmless variants of tags made the same.

    Code fences go, <think> becomes <thinking>, "[Question]: ..." the tagged question, "Final Answer:" at the beginning of a line the marked one. Without
    reasoning tags, what stands before the question or answer becomes the reasoning, or a stock sentence if nothing does.
    """
    original = _strip(text)
    out = _strip(F.replace(F.replace(original, F.lit("```xml"), F.lit("")), F.lit("```"), F.lit("")))
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<\s*think\s*>", "<thinking>"), r"(?i)<\s*/\s*think\s*>", "</thinking>")
    asked = r"(?i)\[\s*Question\s*\]\s*:\s*([\s\S]+)$"
    out = F.when(out.rlike(asked), F.concat(F.regexp_replace(out, asked, ""), F.lit("<question>"), _strip(F.regexp_extract(out, asked, 1)), F.lit("</question>"))).otherwise(out)
    out = F.regexp_replace(out, r"(?im)^\s*Final\s+Answer\s*:\s*", "[Final Answer]: ")
    mark = r"(?i)(?:<question>|\[Final Answer\]\s*:)"
    head, tail = F.regexp_extract(out, rf"(?s)^(.*?)({mark}.*)$", 1), F.regexp_extract(out, rf"(?s)^(.*?)({mark}.*)$", 2)
    # The stock sentence
    stock = F.lit("<thinking>Format-normalized response based on the collected visual evidence.</thinking>\n")
    told = F.when(_strip(head) != "", F.concat(F.lit("<thinking>"), _strip(head), F.lit("</thinking>\n"), _strip(tail))).otherwise(F.concat(stock, out))
    out = F.when(~out.rlike(r"(?i)<thinking>\s*[\s\S]*?\s*</thinking>") & out.rlike(mark), told).otherwise(out)
    return F.struct(out.alias("text"), (out != original).alias("changed"))


def compare_models(labels: DataFrame, metrics: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for each of ``labels`` (experiment, model): its metrics as columns, and ``missing``, the tables that have no row of the model.

    ``metrics``: (source, model, metric, value), values as text; ``wanted``: column -> (source, metric). One aggregation by model, one join.
    """
    sources = list(dict.fromkeys(s for s, _ in wanted.values()))
    pick = lambda s, m: F.max(F.when((F.col("source") == s) & (F.col("metric") == m), F.col("value")))
    wide = metrics.groupBy("model").agg(*[pick(s, m).alias(c) for c, (s, m) in wanted.items()], F.collect_set("source").alias("__has"))
    out = labels.join(wide, "model", "left")
    missing = F.filter(F.array(*map(F.lit, sources)), lambda s: ~F.array_contains(F.coalesce("__has", F.array().cast("array<string>")), s))
    return out.select("experiment", "model", *wanted, missing.alias("missing"))


def run_status(report: DataFrame, least: dict[str, float], hard: list[str], quality: list[str]) -> DataFrame:
    """Adds ``hard_failures``, ``quality_failures``, and ``status``: FAIL with a hard failure, WARN with one of quality, else PASS.

    Columns: attempted, perceiver_calls and log_present; the counts named in ``hard`` and ``quality`` (a failure where over 0); for each task of
    ``least`` total_, strict_ and both_pass counts: no samples or a strict rate under the least one is a failure of quality, and more accepted grounding traces
    than passed both gates a hard one.
    """
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    flag = lambda c: F.when(count(c) > 0, F.concat(F.lit(f"{c}="), F.col(c).cast("string")))
    log = F.when(~F.coalesce("log_present", F.lit(False)), "api_log_missing").when((count("attempted") > 0) & (count("perceiver_calls") == 0), "perceiver_calls=0")
    firm = [log, *map(flag, hard)]
    soft = []
    for task, rate in least.items():
        total, strict = count(f"total_{task}"), count(f"strict_{task}")
        got = F.round(strict / F.greatest(total, F.lit(1)), 6)
        soft.append(F.when(total == 0, f"no_{task}_samples").when(got < rate, F.concat(F.lit(f"{task}_strict_rate="), F.format_string("%.3f", got), F.lit(f"<{rate:.3f}"))))
    firm.append(F.when(count("strict_grounding") > count("both_pass"), "strict_grounding_contains_iou_or_center_only_pass"))
    df = report.withColumns({"hard_failures": F.array_compact(F.array(*firm)), "quality_failures": F.array_compact(F.array(*soft, *map(flag, quality)))})
    return df.withColumn("status", F.when(F.size("hard_failures") > 0, "FAIL").when(F.size("quality_failures") > 0, "WARN").otherwise("PASS"))


def encode_feedback(df: DataFrame, cutoff: int, eos: int | None = None) -> DataFrame:
    """Adds input_ids, labels, kl_input_ids, kl_labels and kto_tag (whether the desired answer is there).

    Columns: prompt, desired, undesired, kl_desired, kl_undesired (token arrays; an empty or null desired answer stands aside for the undesired one). The
    kl pair is a mismatched answer to the same prompt, such as ``shifted_pairs`` gives. ``eos`` ends both answers before they are cut.
    """
    none = F.array().cast("array<int>")
    pick = lambda a, b: F.when(F.coalesce(F.size(a), F.lit(0)) > 0, F.col(a)).otherwise(F.coalesce(b, none))
    end = lambda c: F.concat(c, F.array(F.lit(eos))) if eos is not None else c
    df = df.withColumns({"kto_tag": F.coalesce(F.size("desired"), F.lit(0)) > 0, "__a": end(pick("desired", "undesired")), "__k": end(pick("kl_desired", "kl_undesired"))})
    return encode_pair(encode_pair(df, "prompt", "__a", cutoff), "prompt", "__k", cutoff, "kl_").drop("__a", "__k")


def feedback_counts(df: DataFrame) -> DataFrame:
    """One row: desirable and undesirable examples, and ``one_kind`` if one of the kinds is absent."""
    n = df.agg(F.count_if("kto_tag").alias("desirable"), F.count_if(~F.col("kto_tag")).alias("undesirable"))
    return n.withColumn("one_kind", (F.col("desirable") == 0) | (F.col("undesirable") == 0))
