"""Rules over reasoning traces and their observations. Texts are matched in lower case by JVM patterns."""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomlake.operators.columns import let

# The words that claim a class.
CLAIM_WORDS = {
    "plane": ("plane", "aircraft", "airplane", "jet"),
    "helicopter": ("helicopter", "rotorcraft"),
    "ship": ("ship", "boat", "vessel", "watercraft"),
    "harbor": ("harbor", "marina", "port", "dockyard"),
    "storage tank": ("storage tank", "tank"),
    "bridge": ("bridge",),
    "large vehicle": ("large vehicle", "truck", "bus", "trailer", "lorry"),
    "small vehicle": ("small vehicle", "car", "sedan", "suv", "pickup"),
    "roundabout": ("roundabout", "traffic circle"),
    "baseball diamond": ("baseball diamond", "baseball field"),
    "tennis court": ("tennis court",),
    "basketball court": ("basketball court",),
    "ground track field": ("ground track field", "running track"),
    "soccer ball field": ("soccer ball field", "soccer field", "football field"),
    "swimming pool": ("swimming pool",),
}
# Scenes that are no targets, and the classes that some of them agree with.
SCENES = (
    "parking lot", "airport", "airfield", "runway", "marina", "dock area", "docking area", "industrial building",
    "warehouse", "building", "road", "waterway", "industrial area", "commercial area", "residential area",
)
FITTING_SCENES = {"harbor": {"marina", "dock area", "docking area"}}
# Who a sentence is about, and how it attributes a class.
SUBJECT = r"(?:\btarget\b|\bobject\b|\bstructure\b|\bfeature\b|\bit\b)"
ATTRIBUTES = (
    r"(?:\bis\b|\bare\b|\bappears?\s+to\s+be\b|\blooks?\s+like\b|\bseems?\s+to\s+be\b|\bidentified\s+as\b|\bclassified\s+as\b|"
    r"\b(?:could\s+be\s+)?interpreted\s+as\b|\b(?:appears?|seems?)\s+consistent\s+with\b|\b(?:appears?|seems?)\s+to\s+fit\s+(?:the\s+)?description\s+of\b|"
    r"\bfits?\s+(?:the\s+)?description\s+of\b|\bis\s+indicative\s+of\b)\s+(?:an?\s+|the\s+)?"
)
IS = r"(?:\bis\b|\bappears?\s+to\s+be\b|\blooks?\s+like\b|\bseems?\s+to\s+be\b)\s+(?:an?\s+|the\s+)?"


def _words(cls: str) -> str:
    return "(?:" + "|".join(map(re.escape, CLAIM_WORDS[cls])) + ")"


def _for_class(text: Column, target: Column, pattern) -> Column:
    """Whether ``text`` matches ``pattern(words)`` for the words of the class that ``target`` names; another target stands for itself, null for none."""
    cases = [F.when(target == c, text.rlike(pattern(_words(c)))) for c in CLAIM_WORDS]
    head, tail = pattern("\0").split("\0", 1)  # the word may come several times
    own = F.concat(F.lit("(?:\\Q"), F.replace(target, F.lit("\\E"), F.lit("")), F.lit("\\E)"))
    pieces = [x for t in tail.split("\0") for x in (own, F.lit(t))]
    return F.coalesce(*cases, F.rlike(text, F.concat(F.lit(head), *pieces)), F.lit(False))


def denies(text: Column, target: Column) -> Column:
    """Whether an observation says that the target's class is not there."""
    # The patterns
    return _for_class(F.lower(text), target, lambda w: rf"\bno\s+(?:such\s+|clear\s+)?{w}s?\b|\bnot\s+(?:an?\s+|the\s+)?{w}\b|\bwithout\s+(?:an?\s+|any\s+)?{w}s?\b|\b(?:does|do)\s+not\s+(?:appear|look|seem)[^.!?]{{0,35}}\b{w}\b")


def _affirmed(t: Column, pattern: str) -> Column:
    """Whether the pattern has a match without a negation in the 25 characters before it."""
    parts = F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"), F.split(t, pattern, -1).alias("p"))
    before = lambda s, i: F.concat(F.array_join(F.flatten(F.transform(F.slice(s["m"], 1, i), lambda x, j: F.array(F.get(s["p"], j), x))), ""), F.get(s["p"], i))
    said_no = lambda s, i: F.right(before(s, i), F.lit(25)).rlike(r"\b(?:no|not|without|isn['\u2019]?t|aren['\u2019]?t)\b")
    return F.when(t.rlike(pattern), let(parts, lambda s: F.exists(F.sequence(F.lit(0), F.size(s["m"]) - 1), lambda i: ~said_no(s, i)))).otherwise(F.lit(False))


def claimed_classes(text: Column) -> Column:
    """Classes that an observation attributes to its subject, but not where one of no, not, without, isn't or aren't stands in the 25 characters before."""
    claimed = lambda t, c: t.rlike(_words(c)) & _affirmed(t, SUBJECT + r"[^.!?]{0,100}?" + ATTRIBUTES + _words(c) + r"s?\b")
    some = ATTRIBUTES + "(?:" + "|".join(map(_words, CLAIM_WORDS)) + ")"  # one pattern tells the texts that attribute no class at all
    return let(F.lower(text), lambda t: F.when(t.rlike(some), F.array_compact(F.array(*[F.when(claimed(t, c), F.lit(c)) for c in CLAIM_WORDS]))).otherwise(F.array().cast("array<string>")))


def claims_another(text: Column, target: Column) -> Column:
    """Whether the claimed classes are several, or another one than the target's."""
    return another_than(claimed_classes(text), target)


def another_than(found: Column, target: Column) -> Column:
    """``claims_another`` of classes that are already told."""
    return let(found, lambda some: (F.size(some) > 1) | F.exists(some, lambda c: c != target))


def scene_instead(text: Column, target: Column) -> Column:
    """The first scene that the subject is said to be, null if none or if it agrees with the target's class."""
    told = lambda t, s: F.contains(t, F.lit(s)) & t.rlike(SUBJECT + r"[^.!?]{0,70}?" + IS + re.escape(s) + r"\b")
    fits = lambda s: reduce(lambda a, b: a | b, [target == c for c, some in FITTING_SCENES.items() if s in some], F.lit(False))
    some = IS + "(?:" + "|".join(map(re.escape, SCENES)) + r")\b"  # one pattern tells the texts in which nothing is said to be a scene
    return let(F.lower(text), lambda t: F.when(t.rlike(some), F.coalesce(*[F.when(told(t, s) & ~F.coalesce(fits(s), F.lit(False)), F.lit(s)) for s in SCENES])))


def many_instead(text: Column, target: Column) -> Column:
    """Whether several of the target's class are described instead of one."""
    # looking for a word costs far less than a pattern
    some = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in ("multiple", "numerous", "several", "many", "row")])
    many = lambda t: _for_class(t, target, lambda w: rf"\b(?:multiple|numerous|several|many|rows?\s+of)\s+(?:\w+\s+){{0,2}}{w}s?\b")
    return let(F.lower(text), lambda t: F.when(some(t), many(t)).otherwise(F.lit(False)))


def unsafe_question(q: Column) -> Column:
    """Why a question about coordinates leads the answer, or null."""
    # The patterns
    corner = lambda t: t.rlike(r"\b(top[- ]left|top[- ]right|bottom[- ]left|bottom[- ]right) corner\b") & ~t.rlike(r"four corners|all four|complete.*(?:obb|box)")
    why = lambda t: F.when(corner(t), "partial_corner_coordinate_question").when(t.rlike(r"\bare (?:the )?(?:four )?corners?.*\d"), "proposed_coordinates_for_confirmation").when(t.rlike(r"orientation angle.*degrees"), "numeric_angle_instead_of_direct_visual_geometry")
    return let(F.regexp_replace(F.lower(F.coalesce(q, F.lit(""))), r"\s+", " "), why)


def contradicts(thinking: Column, answer: Column) -> Column:
    """Whether a classification's reasoning speaks against its own answer, by phrases."""
    t, a = F.lower(F.coalesce(thinking, F.lit(""))), F.lower(F.coalesce(answer, F.lit("")))
    said = lambda *some: reduce(lambda x, y: x | y, [F.contains(t, F.lit(p)) for p in some])
    # The phrases
    vehicle = said("not a road vehicle", "appears to be a building", "industrial building", "part of a larger structure", "rather than a vehicle")
    ship = said("clearly a pier", "object is a pier", "not a ship", "dock, not")
    return a.isin("large vehicle", "small vehicle") & vehicle | (a == "ship") & ship | (a == "plane") & said("object appears to be a runway") & ~said("wings")


def focus_text(focus: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(focus, lambda v: F.bround(v, 0).cast("int").cast("string")), ","), F.lit("]"))


def in_range(values: Column, n: int, upper: Column | float) -> Column:
    """Whether there are ``n`` finite values from 0 to ``upper``."""
    ok = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= upper))
    return values.isNotNull() & (F.size(values) == n) & F.coalesce(ok, F.lit(False))


def quotes_focus(text: Column, focus: Column) -> Column:
    """Whether a question names the focus region by its rounded box."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")
    return in_range(focus, 4, 1000.0) & F.contains(t, F.lit("focus region")) & F.contains(F.replace(t, F.lit(" "), F.lit("")), focus_text(focus))


def answer_in_range(answer: Column, target: Column, width: Column, height: Column) -> Column:
    """Whether an answer "class|eight numbers" keeps to the range of its coordinates (pixel_obb, norm100_obb, norm1000_obb)."""
    tail = F.when(F.contains(answer, F.lit("|")), F.regexp_extract(answer, r"(?s)^[^|]*\|(.*)$", 1))
    nums = F.transform(F.regexp_extract_all(tail, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda v: v.cast("double"))
    size = lambda i: F.when(i % 2 == 0, F.greatest(F.lit(0.0), width - 1.0)).otherwise(F.greatest(F.lit(0.0), height - 1.0))
    pixel = F.size(F.filter(nums, lambda v, i: (v >= 0) & (v <= size(i)))) == 8
    norm = lambda upper: F.forall(nums, lambda v: (v >= 0) & (v <= upper))
    return F.coalesce((F.size(nums) == 8) & F.when(target == "norm100_obb", norm(100.0)).when(target == "norm1000_obb", norm(1000.0)).otherwise(pixel), F.lit(False))


# Words that do not count in a question.
STOPWORDS = ["a", "an", "any", "are", "be", "can", "could", "do", "does", "for", "in", "is", "it", "of", "on", "or", "present", "that", "the", "there", "this", "to", "what", "which", "with"]


def _ratio(a: str, b: str, least: float) -> float:
    """The sequence ratio of two texts, or an upper bound of it if that is below ``least``: lengths and counts of characters cost far less."""
    if a == b:
        return 1.0
    both = len(a) + len(b)
    for common in (lambda: min(len(a), len(b)), lambda: (Counter(a) & Counter(b)).total()):
        if (most := 2.0 * common() / both) < least:
            return most
    return SequenceMatcher(None, a, b).ratio()


def _sequence_ratio(a: Column, b: Column, least: Column) -> Column:
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        told = {}  # questions recur, so each pair of texts is compared once in a batch
        for pair in zip(x, y, z):
            if pair not in told:
                told[pair] = _ratio(*pair)
        return pd.Series([told[pair] for pair in zip(x, y, z)], dtype="float64")

    return ratio(a, b, least)


def question_words(question: Column) -> Column:
    """The words of a question without stop words, joined by blanks; empty if it has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_join(F.filter(words, lambda w: ~w.isin(STOPWORDS)), " ")


def _alike(a: str, b: str, threshold: float) -> float:
    """The similarity of ``similar_questions`` of two texts of words; below ``threshold`` it may be less."""
    v, w = set(a.split(" ")), set(b.split(" "))
    jaccard = len(v & w) / len(v | w)
    return max(jaccard, _ratio(a, b, 0.0 if jaccard >= threshold else threshold))


def most_alike(words: Column, earlier: Column, threshold: float) -> Column:
    """The highest similarity of a question to earlier ones of its trace (``question_words`` of all), null below the threshold: no pairs become rows."""

    @F.pandas_udf("double")
    def most(x: pd.Series, y: pd.Series) -> pd.Series:
        told = {}  # questions recur, so each pair of texts is compared once in a batch

        def alike(a: str, b: str) -> float:
            if (b, a) not in told:
                told[b, a] = _alike(b, a, threshold)
            return told[b, a]

        best = [max((alike(a, b) for b in some if b), default=0.0) if a and some is not None else 0.0 for a, some in zip(x, y)]
        return pd.Series([v if v >= threshold else None for v in best], dtype="float64")

    return most(words, earlier)


def repeats_question(questions: Column, threshold: float) -> Column:
    """Whether a question of a trace is similar to an earlier one of these."""

    @F.pandas_udf("boolean")
    def twice(every: pd.Series) -> pd.Series:
        told = {}

        def any_pair(words: tuple[str, ...]) -> bool:
            return any(_alike(a, b, threshold) >= threshold for i, b in enumerate(words) for a in words[:i])

        out = []
        for some in every:
            words = () if some is None else tuple(w for w in some if w)
            if len(words) > 1 and words not in told:
                told[words] = any_pair(words)
            out.append(len(words) > 1 and told[words])
        return pd.Series(out, dtype="bool")

    return twice(F.transform(questions, question_words))


def similar_questions(df: DataFrame, trace: str, order: str, question: str, threshold: float, best: bool = False) -> DataFrame:
    """(trace, left, right, similarity): for each question the first earlier one of its trace that is similar enough, with ``best`` all of them.

    Similarity is the larger of the Jaccard index of the words without stop words and the sequence ratio of
    these words' text; a question without such words is like none. Traces are short lists of turns, so pairs
    inside one are few; where the Jaccard index is too small, the sequence ratio is only computed if its bounds reach the threshold, and
    pairs that fail by their lengths are dropped before.
    """
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(STOPWORDS))
    # words come out of an explode, so that the filter doesn't compute them again
    one = df.select(trace, F.col(order).alias("right"), F.explode(F.array(words)).alias("w")).where(F.size("w") > 0)
    one = one.withColumn("__t", F.array_join("w", " "))
    two = one.select(trace, F.col("right").alias("left"), F.col("w").alias("v"), F.col("__t").alias("__u"))
    both = one.join(two, trace).where("left < right").withColumn("j", F.size(F.array_intersect("w", "v")) / F.size(F.array_union("w", "v")))
    near = 2.0 * F.least(F.length("__t"), F.length("__u")) / (F.length("__t") + F.length("__u")) >= threshold
    least = F.when(F.col("j") >= threshold, 0.0).otherwise(F.lit(float(threshold)))  # pairs that are alike by words need their ratio
    told = both.where((F.col("j") >= threshold) | near).withColumn("s", _sequence_ratio(F.col("__u"), F.col("__t"), least))
    found = told.select(trace, "left", "right", F.greatest("j", "s").alias("similarity")).where(F.col("similarity") >= threshold)
    if best:
        return found
    first = found.groupBy(trace, "right").agg(F.min(F.struct("left", "similarity")).alias("first"))
    return first.select(trace, "first.left", "right", "first.similarity")


def bucket_traces(df: DataFrame, min_rounds: int, strict_score: float, single_score: float, single: bool = True, reject_repairs: bool = False) -> DataFrame:
    """Adds ``bucket`` (strict, single_round_verified or null) and ``reasons``.

    Columns: success, error, verified, verifier_reason, score, geometry_ok, geometry_reason, perception_rounds, repairs.
    """
    rounds, score = F.coalesce("perception_rounds", F.lit(0)), F.coalesce("score", F.lit(0.0))
    when = lambda c, text: F.when(c, text)
    said = lambda name, value, other: F.concat(F.lit(f"{name}:"), F.coalesce(value, F.lit(other)))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    why = [when(no("success"), said("generation", F.col("error"), "None")), when(no("verified"), said("verifier", F.col("verifier_reason"), "failed")), when(no("geometry_ok"), said("geometry", F.col("geometry_reason"), "None"))]
    if reject_repairs:
        why.append(when(F.coalesce("repairs", F.lit(0)) > 0, F.lit("format_repair_used")))
    df = df.withColumn("__why", F.array_compact(F.array(*why)))
    good = F.size("__why") == 0
    bucket = F.when(good & (rounds >= min_rounds) & (score >= strict_score), "strict").when(good & (rounds == 1) & F.lit(single) & (score >= single_score), "single_round_verified")
    few = F.when(rounds < 1, "no_visual_observation").when(rounds < min_rounds, F.concat(F.lit("too_few_perception_rounds:"), rounds.cast("string")))
    df = df.withColumn("bucket", bucket)
    return df.withColumn("reasons", F.when(F.col("bucket").isNull(), F.array_compact(F.concat("__why", F.array(few)))).otherwise(F.array().cast("array<string>"))).drop("__why")


def merge_trace(lang: Column, history: Column, final: Column) -> Column:
    """One training text of a trace: a header by language, of each turn the reasoning, the question and the observation, then the answer.

    ``history``: array of (reasoner, query, perceiver). A turn's question is ``query``, else the first one tagged in ``reasoner``.
    """
    # The headers
    zh, en = "好的，我将会以自问自答的方式逐步推理，最终给出回复。 ", "Alright, I will reason in a self Q&A style and give the final reply. "
    l = F.lower(F.trim(F.coalesce(lang, F.lit(""))))  # noqa: E741
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    first = lambda c, tag: strip(F.regexp_extract(strip(c), rf"(?is)<{tag}>(.*?)</{tag}>", 1))
    asked = lambda t: F.when(strip(t["query"]) != "", strip(t["query"])).otherwise(first(t["reasoner"], "question"))
    said = F.flatten(F.transform(history, lambda t: F.array(first(t["reasoner"], "thinking"), strip(F.regexp_replace(asked(t), r"\s+", " ")), strip(t["perceiver"]))))
    body = F.array_join(F.filter(said, lambda x: x != ""), " ")
    return F.concat(F.lit("<think>"), F.when(l.startswith("zh") | (l == "cn"), zh).otherwise(en), body, F.lit("</think>"), F.coalesce(final, F.lit("")))


def postprocess_traces(df: DataFrame) -> DataFrame:
    """Training rows of the traces that ended well: no error, success, a final answer. Columns: id, error, success, final_answer, lang, history."""
    ok = (F.coalesce("error", F.lit("")) == "") & F.coalesce("success", F.lit(False)) & (F.coalesce("final_answer", F.lit("")) != "")
    return df.where(ok).withColumn("thinking", merge_trace(F.col("lang"), F.col("history"), F.col("final_answer")))


def final_only(df: DataFrame, query: str, answer: str, thinking: bool = True) -> DataFrame:
    """Adds ``messages``: the question and the bare answer (after ``</think>`` for thinking templates); rows without an answer have null."""
    a = F.trim(F.coalesce(answer, F.lit("")))
    said = F.concat(F.lit("</think>\n"), a) if thinking else a
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return df.withColumn("messages", F.when(a != "", F.array(turn("user", F.trim(query)), turn("assistant", said))))


def matched_datasets(direct: DataFrame, finals: DataFrame, traces: DataFrame, key: str | None = None) -> DataFrame:
    """Both training sets in one table, ``dataset`` A (direct and final-only rows) and B (direct rows and traces).

    With ``key`` the job fails unless finals and traces have the same keys, each as often: then the sets differ in their answers only.
    """
    if key:
        side = lambda df, n: df.select(key, F.lit(n).alias("__n"))
        odd = side(finals, 1).unionByName(side(traces, -1)).groupBy(key).agg(F.sum("__n").alias("n")).where("n <> 0")
        wrong = odd.agg(F.count(F.lit(1)).alias("__odd"))
        traces = traces.join(F.broadcast(wrong), how="cross").withColumn("__odd", F.when(F.col("__odd") > 0, F.raise_error(F.concat(F.lit("training sets differ in "), F.col("__odd").cast("string"), F.lit(" keys"))))).where("__odd is null").drop("__odd")  # one row
    a, b = (direct.unionByName(x).withColumn("dataset", F.lit(n)) for x, n in ((finals, "A"), (traces, "B")))
    return a.unionByName(b)


def final_gate(reports: DataFrame, required: list[str]) -> DataFrame:
    """One row: passed, and critical: required reports that are missing or did not pass. ``reports``: (name, passed)."""
    want = reports.sparkSession.createDataFrame([(n,) for n in required], "name string")
    bad = want.join(reports, "name", "left").groupBy("name").agg(F.count("passed").alias("n"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("ok"))
    text = F.when(F.col("n") == 0, F.concat(F.lit("missing report: "), "name")).when(~F.col("ok"), F.concat("name", F.lit(" did not pass")))
    return bad.agg(F.array_sort(F.array_compact(F.collect_list(text))).alias("critical")).select((F.size("critical") == 0).alias("passed"), "critical")


def subset_check(some: DataFrame, every: DataFrame, key: str, chosen: Column) -> DataFrame:
    """One row: rows of ``some`` that ``every`` lacks, rows of ``some`` that the predicate would not choose, and chosen rows that are missing."""
    a, b = some.select(key).distinct(), every.withColumn("__c", chosen).groupBy(key).agg(F.max(F.col("__c").cast("int")).alias("c"))
    x = a.withColumn("s", F.lit(1)).join(b, key, "full")
    return x.agg(F.count_if(F.col("c").isNull()).alias("unknown"), F.count_if((F.col("s") == 1) & (F.col("c") == 0)).alias("unchosen"), F.count_if(F.col("s").isNull() & (F.col("c") == 1)).alias("missing"))
