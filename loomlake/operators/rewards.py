"""Rule rewards of responses: formats, boxes, classes, numbers. Expressions over columns, one row a response."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from loomlake.operators.geometry import iou, point, with_obb_iou

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def boxed_content(text: Column) -> Column:
    """Inside of the last \\boxed{...}; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(r"\\boxed\{([^{}]*)\}"), F.lit(1))
    return F.get(found, F.size(found) - 1)


def format_flag(text: Column, style: str) -> Column:
    """1 if the whole response has the layout: think then \\boxed ("boxed"), or think then answer ("answer")."""
    pattern = {"boxed": r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$", "answer": r"(?s)^<think>.*?</think>\s*<answer>.*?</answer>$"}[style]
    return F.when(text.rlike(pattern), 1).otherwise(0)


def to_number(text: Column) -> Column:
    """A number or fraction as double; null if it is neither."""
    t = F.regexp_replace(F.trim(text), ",", "")
    top, bottom = (F.regexp_extract(t, r"^([-+]?\d+)\s*/\s*(\d+)$", i).try_cast("double") for i in (1, 2))
    return F.when(t.rlike(r"^[-+]?\d+\s*/\s*\d+$"), F.when(bottom != 0, top / bottom)).otherwise(t.try_cast("double"))


def numeric_accuracy(answer: Column, truth: Column) -> Column:
    """1 - (e^|x - k| - 1) / (e^|k| - 1), within 0..1; computed as a ratio that cannot overflow. 0 if either is no number."""
    x, k = to_number(answer), to_number(truth)
    a, b = F.abs(x - k), F.abs(k)
    tiny = a / F.greatest(b, F.lit(1e-9))
    delta = a - b
    ratio = F.when(delta > 60, F.lit(math.inf)).when(delta < -60, F.lit(0.0)).otherwise(F.exp(delta) * (1 - F.exp(-a)) / F.greatest(1 - F.exp(-b), F.lit(1e-9)))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.when(b < 1e-6, tiny).otherwise(ratio)))
    return F.when(x.isNull() | k.isNull() | F.isnan(x) | F.isnan(k), F.lit(0.0)).otherwise(score)


def thought(text: Column) -> Column:
    """The first reasoning block with single spaces; null if there is none."""
    t = F.regexp_extract(text, r"(?is)<think>(.*?)</think>", 1)
    return F.when(text.rlike(r"(?is)<think>.*?</think>"), F.trim(F.regexp_replace(t, r"\s+", " ")))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit("[A-Za-z']+|[0-9]+"), F.lit(0)))


def wait_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?i)\bwait\b"), F.lit(0)))


def thinking_score(text: Column, opening: Column, words: Column, waits: Column) -> Column:
    """0 to 1: how well a response's first reasoning block keeps to its opening (0.34), word budget (0.33) and number of "wait" (0.33).

    A budget that is overrun counts budget / words, waits lose in proportion to those asked for. What is not asked for (null, a budget
    of 0) is met. 0 without a block.
    """
    t = thought(text)
    asked = F.lower(_spaces(_quotes(opening)))
    begins = F.when(opening.isNull() | (opening == ""), 1.0).otherwise(F.startswith(F.lower(t), asked).cast("double"))
    n, w = word_count(t), wait_count(t)
    budget = F.when(words.isNull() | (words <= 0) | (n <= words), 1.0).otherwise(words / F.greatest(n, F.lit(1)))
    wait = F.when(waits.isNull() | (waits < 0), 1.0).when(waits == 0, (w == 0).cast("double")).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(w - waits) / waits))
    return F.when(t.isNull(), 0.0).when(opening.isNull() & words.isNull() & waits.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.34 * begins + 0.33 * budget + 0.33 * wait)))


def _spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _quotes(text: Column) -> Column:
    return F.regexp_replace(text, "^[\\s'\"\u201c\u201d\u2018\u2019]+|[\\s'\"\u201c\u201d\u2018\u2019]+$", "")


def tight(text: Column) -> Column:
    """No white space around <, > and /, so that loosely written tags are found."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*(<|>|/)\s*", "$1")


def shortcut_share(expected: Column) -> Column:
    """``expected`` where it is a share of 0 to 1; the job fails elsewhere, as rewards without it mislead."""
    ok = (expected >= 0) & (expected <= 1)
    return F.when(F.coalesce(ok, F.lit(False)), expected).otherwise(F.raise_error(F.concat(F.lit("shortcut expectation must be in [0,1]: "), F.coalesce(expected.cast("string"), F.lit("missing")))).cast("double"))


def _four(text: Column) -> Column:
    """The first four numbers of a text as an array; null if there are fewer."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda v: v.cast("double"))
    return F.when(F.size(numbers) >= 4, F.slice(numbers, 1, 4))


_JSON_BOX = rf'(?i)"\s*bbox\s*"\s*:\s*\[\s*({NUMBER}(?:\s*,\s*{NUMBER}){{3}})\s*\]'
_LOOSE_BOX = r"""(?is)["']?\s*bbox\s*["']?\s*:\s*\[\s*([^\]]+)\]"""


def response_box(text: Column, style: str) -> Column:
    """(box, fallback): the predicted box of a response, as four numbers, by one of five conventions; null if there is none.

    ``boxed``: in the last \\boxed{...}, from 0 to 1. ``boxed_after_think``: that, after the first </think>. ``json``: the first
    "bbox": [four numbers] after the first </think> of a whole reasoning block. ``answer``: after </think> (and after Answer: if
    that follows) the first bbox: [...] of numbers from 0 to 1000, with or without quotes, else the first bracket of four such numbers, which is
    a fallback. ``tags``: between box tags. Texts are taken as they are; ``tight`` them first.
    """
    got, fallback = None, F.lit(False)
    if style in ("boxed", "boxed_after_think"):
        unit = lambda c: F.when((F.size(c) == 4) & F.forall(c, lambda v: (v >= 0) & (v <= 1)), c)
        numbers = lambda t: F.transform(F.regexp_extract_all(F.coalesce(boxed_content(t), F.lit("")), F.lit(NUMBER), F.lit(0)), lambda v: v.cast("double"))
        got = unit(numbers(text)) if style == "boxed" else box_after_think(text)
    elif style == "json":
        tail = F.when(text.rlike(r"(?is)<\s*think\s*>.*?</\s*think\s*>"), F.regexp_extract(text, r"(?is)^.*?</\s*think\s*>(.*)$", 1))
        got = _four(F.regexp_extract(tail, _JSON_BOX, 1))
    elif style == "answer":
        tail = F.when(text.rlike(r"(?i)</\s*think\s*>"), F.regexp_extract(text, r"(?is)^.*?</\s*think\s*>(.*)$", 1))
        tail = F.when(tail.rlike("(?i)\\banswer\\s*[:\uff1a]"), F.regexp_extract(tail, "(?is)^.*?\\banswer\\s*[:\uff1a](.*)$", 1)).otherwise(tail)
        fits = lambda c: F.coalesce(F.forall(c, lambda v: (v >= 0) & (v <= 1000)), F.lit(False))
        named = _four(F.regexp_extract(tail, _LOOSE_BOX, 1))
        named = F.when(fits(named), named)
        other = F.get(F.filter(F.transform(F.regexp_extract_all(tail, F.lit(r"\[\s*([^\]]+)\]"), F.lit(1)), _four), lambda c: c.isNotNull() & fits(c)), 0)
        got, fallback = F.coalesce(named, other), named.isNull() & other.isNotNull()
    elif style == "tags":
        got = box_in_tags(text)
    else:
        raise ValueError(f"unknown style {style}")
    return F.struct(got.alias("box"), F.coalesce(fallback, F.lit(False)).alias("fallback"))


def ordered_box(box: Column, top: float) -> list[Column]:
    """Corners in order, clipped to 0 to ``top``."""
    b = [F.greatest(F.lit(0.0), F.least(F.lit(top), F.get(box, i))) for i in range(4)]
    return [F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3])]


def _box_iou(box: Column, truth: Column, top: float) -> Column:
    return F.when(box.isNotNull(), iou(ordered_box(box, top), ordered_box(truth, top))).otherwise(F.lit(0.0))


def iou_reward(df: DataFrame, response: str, truth: str, opening: Column, words: Column, waits: Column, expected: Column, format_weight: float = 0.1, center_weight: float = 0.0) -> DataFrame:
    """Adds iou, accuracy_raw, format, format_m, thinking, overall: the plain IoU of the \\boxed box (0 to 1) counts, with the format.

    Format: of five rules (reasoning block, box, opening, word budget, number of "wait") m hold: (e^m - 1) / (e^5 - 1).
    accuracy_raw is (e^IoU - 1) / (e - 1) and the centre score by ``center_weight``, thinking the finer score of the same rules; both
    are reported only. The shortcut expectation must be there all the same.
    """
    text = tight(F.col(response))
    df = df.withColumns({"__r": text, "__b": response_box(text, "boxed")["box"], "__e": shortcut_share(expected)}).withColumn("__t", thought(F.col("__r")))
    t, b, g = F.col("__t"), F.col("__b"), [F.get(truth, i) for i in range(4)]
    rules = [t.isNotNull(), b.isNotNull(), (opening != "") & F.startswith(F.lower(t), F.lower(_spaces(_quotes(opening)))), (words > 0) & (word_count(t) <= words), (waits >= 0) & (wait_count(t) == waits)]
    m = sum((F.coalesce(r, F.lit(False)).cast("int") for r in rules), F.lit(0))
    df = df.withColumns({"iou": _box_iou(b, F.col(truth), 1.0), "format_m": m, "thinking": thinking_score(F.col("__r"), opening, words, waits)})
    p = ordered_box(b, 1.0)
    d, r = F.hypot((p[0] + p[2] - g[0] - g[2]) / 2, (p[1] + p[3] - g[1] - g[3]) / 2), F.greatest(F.hypot(g[2] - g[0], g[3] - g[1]) / 2, F.lit(1e-8))
    raw = (1 - center_weight) * F.expm1("iou") / math.expm1(1.0) + center_weight * r / F.greatest(d, r)
    df = df.withColumns({"accuracy_raw": F.when(b.isNull(), 0.0).otherwise(raw), "format": F.expm1(F.col("format_m").cast("double")) / math.expm1(5.0)})
    # the expectation is only looked at, so that rows without it fail
    return df.withColumn("overall", F.when(F.col("__e").isNotNull(), (1 - format_weight) * F.col("iou") + format_weight * F.col("format"))).drop("__r", "__b", "__e", "__t")


def json_box_reward(df: DataFrame, response: str, truth: str, expected: Column, format_weight: float = 0.1, k: float = 2.5, shape: str = "as_written") -> DataFrame:
    """Adds iou, accuracy_raw, accuracy, format_think, format_answer, format_box, format_total, overall for boxes in JSON (0 to 1000).

    accuracy_raw: exp(k IoU - 1) / (e^k - 1) at most 1 (``shape="expm1"``: (e^(k IoU) - 1) / (e^k - 1)), 0 without a box; accuracy is what is above
    the shortcut expectation E: (raw - E) / (1 - E), 0 if E is 1. Format: a whole reasoning block, Answer: after it, a box after it, a
    third each; half of that if a box is before its end only.
    """
    if shape not in ("as_written", "expm1"):
        raise ValueError(f"unknown shape {shape}")
    text = tight(F.col(response))
    df = df.withColumns({"__r": text, "__b": response_box(text, "json")["box"], "__e": shortcut_share(expected)})
    r, b, e = F.col("__r"), F.col("__b"), F.col("__e")
    block = r.rlike(r"(?is)<\s*think\s*>.*?</\s*think\s*>")
    head, tail = (F.when(block, F.regexp_extract(r, r"(?is)^(.*?</\s*think\s*>)(.*)$", i)) for i in (1, 2))
    df = df.withColumns({"iou": _box_iou(b, F.col(truth), 1000.0), "format_think": block.cast("double"), "format_answer": F.coalesce(tail.rlike("(?i)\\banswer\\s*[:\uff1a]"), F.lit(False)).cast("double"), "format_box": b.isNotNull().cast("double")})
    raw = F.exp(F.col("iou") * k - 1) / math.expm1(k) if shape == "as_written" else F.expm1(F.col("iou") * k) / math.expm1(k)
    early = F.coalesce(head.rlike(_JSON_BOX), F.lit(False)) & b.isNull()
    total = (F.col("format_think") + F.col("format_answer") + F.col("format_box")) / 3 * F.when(early, 0.5).otherwise(1.0)
    df = df.withColumns({"accuracy_raw": F.when(b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))), "format_total": total})
    df = df.withColumn("accuracy", F.when(e < 1, (F.col("accuracy_raw") - e) / (1 - e)).otherwise(F.lit(0.0)))
    return df.withColumn("overall", (1 - format_weight) * F.col("accuracy") + format_weight * F.col("format_total")).drop("__r", "__b", "__e")


def answer_box_reward(df: DataFrame, response: str, truth: str, expected: Column, format_weight: float = 0.1) -> DataFrame:
    """Adds iou, accuracy_raw (the IoU), accuracy, format_thinkclose, format_bbox_after, fallback, format_total, overall (boxes of 0 to 1000).

    Format: </think>, and a named box after it, a half each; half of that if a named box is before </think> only, and half again
    where the box was read from any bracket of four numbers. accuracy is (IoU - E) / (1 - E); if E is 1, 1 for a perfect box and else 0.
    """
    text = tight(F.col(response))
    df = df.withColumns({"__r": text, "__p": response_box(text, "answer"), "__e": shortcut_share(expected)})
    r, b, e = F.col("__r"), F.col("__p.box"), F.col("__e")
    close = r.rlike(r"(?i)</\s*think\s*>")
    head, tail = (F.when(close, F.regexp_extract(r, r"(?is)^(.*?</\s*think\s*>)(.*)$", i)) for i in (1, 2))
    found = _four(F.regexp_extract(tail, _LOOSE_BOX, 1))
    named = F.coalesce(F.forall(found, lambda v: (v >= 0) & (v <= 1000)), F.lit(False))
    early = F.coalesce(head.rlike(rf"(?i)\bbbox\s*:\s*\[\s*{NUMBER}"), F.lit(False)) & ~named
    df = df.withColumns({"iou": _box_iou(b, F.col(truth), 1000.0), "format_thinkclose": close.cast("double"), "format_bbox_after": named.cast("double"), "fallback": F.col("__p.fallback")})
    total = (F.col("format_thinkclose") + F.col("format_bbox_after")) / 2 * F.when(early, 0.5).otherwise(1.0) * F.when(F.col("fallback"), 0.5).otherwise(1.0)
    perfect = F.when(F.col("iou") >= 1 - 1e-12, 1.0).otherwise(0.0)
    df = df.withColumns({"accuracy_raw": F.col("iou"), "accuracy": F.when(1 - e <= 1e-12, perfect).otherwise((F.col("iou") - e) / (1 - e)), "format_total": total})
    return df.withColumn("overall", (1 - format_weight) * F.col("accuracy") + format_weight * F.col("format_total")).drop("__r", "__p", "__e")


def class_obb_reward(df: DataFrame, response: str, cls: Column, truth: str, format_weight: float = 0.1, class_weight: float = 0.2) -> DataFrame:
    """Adds format, class_score, iou, overall as ``class_box_reward``, for rotated boxes: obb of eight numbers against ``truth`` (corner points)."""
    body = F.regexp_extract(response, r"(?s)Answer:\s*(\{.*?\})\s*$", 1)
    df = df.withColumn("parsed", F.from_json(F.when(body != "", body), "class_name string, obb array<double>"))
    full = F.col(response).rlike(r"(?s)<think>.*?</think>\s*Answer:\s*\{.*?\}\s*$")
    df = df.withColumn("format", F.when(F.col("parsed").isNull(), 0.0).when(full, 1.0).otherwise(0.5))
    name = F.trim(F.regexp_replace(F.translate(F.lower(F.col("parsed.class_name")), "_-", "  "), r"\s+", " "))
    df = df.withColumn("class_score", F.coalesce((name == cls).cast("double"), F.lit(0.0)))
    v = F.col("parsed.obb")
    some = F.coalesce((F.size(v) == 8) & (F.size(truth) == 4), F.lit(False))
    points = F.when(some, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: point(F.get(v, i * 2), F.get(v, i * 2 + 1))))
    df = with_obb_iou(df.withColumns({"has_obb": some, "predicted": F.coalesce(points, F.col(truth))}), "predicted", truth)
    df = df.withColumn("iou", F.when(F.col("has_obb"), F.coalesce("iou", F.lit(0.0))).otherwise(F.lit(0.0)))
    rest = max(0.0, 1 - format_weight - class_weight)
    return df.withColumn("overall", format_weight * F.col("format") + class_weight * F.col("class_score") + rest * F.col("iou")).drop("parsed", "has_obb", "predicted")


def box_after_think(text: Column) -> Column:
    """Four numbers of 0..1 in a \\boxed{...} after the first </think>, as an array; null otherwise."""
    tail = F.when(F.contains(text, F.lit("</think>")), F.regexp_extract(text, r"(?s)</think>(.*)$", 1))
    numbers = F.transform(F.regexp_extract_all(F.coalesce(boxed_content(tail), F.lit("")), F.lit(NUMBER), F.lit(0)), lambda v: v.cast("double"))
    ok = (F.size(numbers) == 4) & F.forall(numbers, lambda v: (v >= 0) & (v <= 1))
    return F.when(ok, numbers)


def box_reward(df: DataFrame, response: str, truth: list[Column], opening: Column, words: Column, waits: Column, center_weight: float = 0.2, format_weight: float = 0.1, expected: Column | None = None) -> DataFrame:
    """Adds iou, accuracy, format, thinking, overall; with ``expected``, what a shortcut would get on average (0 to 1, 1 left out), accuracy_raw
    too, and accuracy is (raw - E) / (1 - E).

    Format: of five rules (reasoning block, box after it, opening, word budget, number of "wait") m hold;
    (e^m - 1) / (e^5 - 1). Accuracy: exp(5 * iou - 1) / (e^5 - 1) and the centre score by weight.
    """
    df = df.withColumn("__t", thought(F.col(response))).withColumn("__b", box_after_think(F.col(response)))
    t = F.col("__t")
    n_words = word_count(t)
    n_waits = wait_count(t)
    rules = [t.isNotNull(), F.col("__b").isNotNull(), F.startswith(F.lower(t), F.lower(opening)), n_words <= words, n_waits == waits]
    m = sum((F.coalesce(r, F.lit(False)).cast("int") for r in rules), F.lit(0))
    df = df.withColumn("format", F.expm1(m.cast("double")) / math.expm1(5.0))
    b = [F.get("__b", i) for i in range(4)]
    df = df.withColumn("iou", F.coalesce(iou([F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3])], truth), F.lit(0.0)))
    d = F.hypot((b[0] + b[2] - truth[0] - truth[2]) / 2, (b[1] + b[3] - truth[1] - truth[3]) / 2)
    r = F.greatest(F.hypot(truth[2] - truth[0], truth[3] - truth[1]) / 2, F.lit(1e-8))
    shaped = F.least(F.lit(1.0), F.exp(F.col("iou") * 5 - 1) / math.expm1(5.0))
    accuracy = (1 - center_weight) * shaped + center_weight * r / F.greatest(d, r)
    df = df.withColumns({"accuracy": F.when(F.col("__b").isNull(), F.lit(0.0)).otherwise(accuracy), "thinking": thinking_score(F.col(response), opening, words, waits)})
    if expected is not None:
        e = shortcut_share(expected)
        df = df.withColumn("accuracy_raw", F.col("accuracy")).withColumn("accuracy", F.when(e < 1, (F.col("accuracy_raw") - e) / (1 - e)))
    return df.withColumn("overall", format_weight * F.col("format") + (1 - format_weight) * F.col("accuracy")).drop("__t", "__b")


def class_box_reward(df: DataFrame, response: str, cls: Column, truth: list[Column], format_weight: float = 0.1, class_weight: float = 0.2) -> DataFrame:
    """Adds format (1 with reasoning, 0.5 without, 0 without an answer object), class_score, iou, overall."""
    body = F.regexp_extract(response, r"(?s)Answer:\s*(\{.*?\})\s*$", 1)
    df = df.withColumn("__j", F.from_json(F.when(body != "", body), "class_name string, bbox array<double>"))
    full = F.col(response).rlike(r"(?s)<think>.*?</think>\s*Answer:\s*\{.*?\}\s*$")
    df = df.withColumn("format", F.when(F.col("__j").isNull(), 0.0).when(full, 1.0).otherwise(0.5))
    name = F.trim(F.regexp_replace(F.translate(F.lower(F.col("__j.class_name")), "_-", "  "), r"\s+", " "))
    df = df.withColumn("class_score", F.coalesce((name == cls).cast("double"), F.lit(0.0)))
    clip = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(1000.0), F.get("__j.bbox", i)))
    b = [F.least(clip(0), clip(2)), F.least(clip(1), clip(3)), F.greatest(clip(0), clip(2)), F.greatest(clip(1), clip(3))]
    df = df.withColumn("iou", F.when(F.size("__j.bbox") == 4, iou(b, truth)).otherwise(F.lit(0.0)))
    rest = max(0.0, 1 - format_weight - class_weight)
    return df.withColumn("overall", format_weight * F.col("format") + class_weight * F.col("class_score") + rest * F.col("iou")).drop("__j")


def box_in_tags(text: Column) -> Column:
    """Four numbers between box tags, after the first </think> if there is one, as an array; null otherwise."""
    tail = F.when(text.rlike("(?i)</think>"), F.regexp_extract(text, r"(?is)^.*?</think>(.*)$", 1)).otherwise(text)
    parts = F.transform(F.split(F.regexp_extract(tail, r"<\|box_start\|>\s*(.*?)\s*<\|box_end\|>", 1), ","), lambda v: F.trim(v))
    return F.when((F.size(parts) == 4) & F.forall(parts, lambda v: v.rlike(f"^{NUMBER}$")), F.transform(parts, lambda v: v.cast("double")))


def box_tag_accuracy(df: DataFrame, response: str, truth: list[Column], k: float = 2.5) -> DataFrame:
    """Adds iou and accuracy of a box between tags: exp(k * iou - 1) / (e^k - 1), at most 1; both 0 without four numbers.

    Corners of both boxes are put in order and clipped to 0..1. A null response counts as one without a box.
    """
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    ordered = lambda b: [unit(F.least(b[0], b[2])), unit(F.least(b[1], b[3])), unit(F.greatest(b[0], b[2])), unit(F.greatest(b[1], b[3]))]
    df = df.withColumn("__b", box_in_tags(F.col(response)))
    some = F.col("__b").isNotNull()
    df = df.withColumn("iou", F.when(some, iou(ordered([F.get("__b", i) for i in range(4)]), ordered(truth))).otherwise(F.lit(0.0)))
    shaped = F.least(F.lit(1.0), F.exp(F.col("iou") * k - 1) / math.expm1(k))
    return df.withColumn("accuracy", F.when(some, shaped).otherwise(F.lit(0.0))).drop("__b")


# Fixed values of the final-answer convention: replacements, then removals, each in this order.
REPLACED = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges",
    "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]
# Fixed patterns of the same convention: math between dollars, wrappers, shorthand of fractions and roots.
REWRITTEN = [(r"(.*?)\$(.*?)\$(.*)", r"\$$2\$"), (r"\\text\{(.*?)\}", "$1"), (r"\\textbf\{(.*?)\}", "$1"), (r"\\overline\{(.*?)\}", "$1"), (r"\\boxed\{(.*)\}", "$1"), (r"frac([^{])(.)", "frac{$1}{$2}"), (r"sqrt([^{])", "sqrt{$1}")]


def normal_answer(text: Column) -> Column:
    """What follows the last equals sign, without units, fillers, spaces and TeX wrappers; no commas in plain whole numbers."""
    out = F.substring_index(text, "=", -1)
    for old, new in [*REPLACED, *((r, "") for r in REMOVED)]:
        out = F.replace(out, F.lit(old), F.lit(new))
    for pattern, new in REWRITTEN:
        out = F.regexp_replace(out, f"(?d){pattern}", new)
    out = F.replace(out, F.lit("$"), F.lit(""))
    out = F.when(out.rlike(r"^,*\d[\d,]*$"), F.replace(out, F.lit(","), F.lit(""))).otherwise(out)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def answer_reward(df: DataFrame, response: str, truth: str, length: str, most: int, buffer: int, factor: float) -> DataFrame:
    """Adds accuracy (1 or -1), overlong (0 to -1), overall and accuracy_normalized (1 or 0).

    The answer is the rest of the line after the last "Answer:" in the last 300 characters. Responses of more than
    ``most - buffer`` tokens lose in proportion, of more than ``most`` fully. Without an answer, or with a null
    response or truth, accuracy is -1.
    """
    found = F.regexp_extract_all(F.right(F.col(response), F.lit(300)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    answer = F.coalesce(F.get(found, F.size(found) - 1), F.lit("[INVALID]"))
    free = most - buffer
    n = F.col(length)
    overlong = F.when(n <= free, F.lit(0.0)).when(n <= most, (F.lit(free) - n) / F.lit(buffer)).otherwise(F.lit(-1.0))
    df = df.withColumn("accuracy", F.when(normal_answer(answer) == normal_answer(F.col(truth)), 1.0).otherwise(-1.0)).withColumn("overlong", overlong)
    return df.withColumn("overall", F.col("accuracy") + F.col("overlong") * factor).withColumn("accuracy_normalized", (F.col("accuracy") + 1) / 2)
