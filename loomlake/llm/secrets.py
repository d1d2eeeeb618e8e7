"""Secret scans with DataFrame functions only: rules, and character Markov models for strings no rule knows.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers (of
case-folded characters, and of the case of a letter given the kind of the one before), are counted from labelled samples: values that a rule found are random strings, the other
words of the same documents are ordinary. A long token whose log-likelihood ratio is high is a secret; so is
a high-scoring stretch of it between separators, where a token as a whole is diluted by ordinary words.
What rules found is taken out first, so that the parts left and right of it are tokens of their own.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

# The base rules. Each: kind, pattern, group that must have a least length, that length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = [("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24)]  # hex: runs of 24 or more are the runs of [0-9a-f]+ that pass
KINDS = [k for k, *_ in RULES] + ["markov"]
FOLDED = "abcdefghijklmnopqrstuvwxyz0123456789+/_=-"
ALPHABET = FOLDED + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = "/=_-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Log-likelihood ratio in thousandths of a nat: least total, and least mean for each pair of characters.
LEAST_TOTAL, LEAST_MEAN = 20_000, 400
#: A stretch of a token ends where its score, less the least mean, falls this far below its best.
DROP = LEAST_TOTAL // 2
#: The most that the case of one letter may say, in thousandths of a nat.
MOST_CASE = 1_000
#: Documents whose words and rule hits are the labelled samples, the first of them in hash order.
SAMPLE_DOCS = 4_000


RANGE = "array<struct<start:bigint,end:bigint>>"


def _ratio(t: Column, weights: Column) -> Column:
    """The log-likelihood ratio of a token of two characters and more, in thousandths: one pass over its characters."""
    last = F.struct(F.lit(-1).alias("code"), F.lit(0).alias("sum"))

    def step(a: Column, c: Column) -> Column:
        code = F.instr(F.lit(ALPHABET), c) - 1
        return F.struct(code.alias("code"), (a["sum"] + F.when(a["code"] < 0, 0).otherwise(F.get(weights, a["code"] * len(ALPHABET) + code))).alias("sum"))

    return F.aggregate(F.split(t, ""), last, step, lambda a: a["sum"])


def _is_random(t: Column, weights: Column) -> Column:
    score = _ratio(t, weights)
    return (F.length(t) >= 16) & (score >= LEAST_TOTAL) & (score >= LEAST_MEAN * (F.length(t) - 1))


def _stretches(t: Column, weights: Column) -> Column:
    """Random stretches of a token between / = - and _, as (start, end) in it: runs of words that together score high, and words that do alone.

    Words are taken one by one; a run ends where its score, less the least mean for each pair, is no longer
    positive, or ``DROP`` below its best, and reaches up to its best. So each of several keys in a token is found.
    """
    run = lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    state = lambda at, start, total, best, end, out: F.struct(at.alias("at"), start.alias("start"), total.alias("total"), best.alias("best"), end.alias("end"), out.alias("out"))
    zero, empty = F.lit(0).cast("long"), F.array().cast(RANGE)
    parts = F.transform(F.regexp_extract_all(t, F.lit(r"[^/=_-]+=*|[/=_-]+"), F.lit(0)), lambda p: F.struct(
        F.length(p).cast("long").alias("n"), (~p.rlike("^[/=_-]")).alias("word"), F.when(F.length(p) > 1, _ratio(p, weights) - LEAST_MEAN * (F.length(p) - 1)).otherwise(0).cast("long").alias("v")))
    closed = lambda a: F.when(a["best"] > 0, F.concat(a["out"], F.array(run(a["start"], a["end"])))).otherwise(a["out"])

    def step(a: Column, p: Column) -> Column:
        total, end = a["total"] + p["v"], a["at"] + p["n"]
        start = F.when(a["best"] > 0, a["start"]).otherwise(a["at"])
        ends = (total <= 0) | (total <= a["best"] - DROP)
        return (
            F.when(~p["word"], state(end, a["start"], a["total"], a["best"], a["end"], a["out"]))
            .when(ends, state(end, end, zero, zero, end, closed(a)))
            .when(total > a["best"], state(end, start, total, total, end, a["out"]))
            .otherwise(state(end, a["start"], total, a["best"], a["end"], a["out"]))
        )

    runs = F.aggregate(parts, state(zero, zero, zero, zero, zero, empty), step, closed)
    # single words with their places
    words = F.aggregate(parts, F.struct(zero.alias("at"), empty.alias("out")), lambda a, p: F.struct((a["at"] + p["n"]).alias("at"), F.when(p["word"] & (p["n"] >= 16), F.concat(a["out"], F.array(run(a["at"], a["at"] + p["n"])))).otherwise(a["out"]).alias("out")), lambda a: a["out"])
    tell = lambda x: _is_random(F.substring(t, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")), weights)
    good = F.filter(runs, tell)
    alone = F.filter(words, lambda x: tell(x) & ~F.exists(good, lambda g: (g["start"] <= x["start"]) & (x["end"] <= g["end"])))
    return F.concat(good, alone)


#: Elements whose results are gathered before they join all others, and code points of a piece of text: so that arrays and
#: texts are not copied, or counted through from the beginning, for each element.
TOGETHER, PIECE = 128, 4096


def _running(items: Column, kind: str, emit, advance) -> Column:
    """emit(at, x) of each x of ``items``, in order, where at begins with 0 and becomes advance(at, x) behind each."""
    zero, none, more = F.lit(0).cast("long"), F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    inner = lambda a, x: state(advance(a["at"], x), F.concat(a["out"], F.array(emit(a["at"], x))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / TOGETHER).cast("int")), lambda i: F.slice(items, i * TOGETHER + 1, TOGETHER))
    outer = lambda a, block: F.get(F.transform(F.array(F.aggregate(block, state(a["at"], none), inner)), lambda r: state(r["at"], F.concat(a["out"], F.array(r["out"])))), 0)
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(blocks, state(zero, more), outer)["out"])).otherwise(none)


def _spans(pieces: Column, matches: Column, keep, kind: str) -> Column:
    """Spans of the matches that ``keep(index)`` accepts; a running sum over the texts between matches and the matches gives the places."""
    lens = F.zip_with(F.transform(F.slice(pieces, 1, F.size(matches)), F.length), F.transform(matches, F.length), lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    starts = _running(lens, "bigint", lambda at, x: at + x["p"], lambda at, x: at + x["p"] + x["m"])
    spans = F.zip_with(starts, matches, lambda start, m: F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("order"), (start + F.length(m)).alias("end")))
    return F.when(F.size(matches) > 0, F.filter(spans, lambda _, i: keep(i))).otherwise(F.array().cast("array<struct<start:bigint,order:int,end:bigint>>"))


def _rule_columns(df: DataFrame) -> DataFrame:
    """Adds, for each rule, its matches, the groups that decide, and the pieces between matches. Texts without a match get empty arrays."""
    empty = F.array().cast("array<string>")
    for kind, pattern, group, _ in RULES:
        hit = F.col("text").rlike(pattern)
        df = df.withColumn(f"{kind}_m", F.when(hit, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(empty))
        some = F.size(f"{kind}_m") > 0
        df = df.withColumn(f"{kind}_g", F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).otherwise(empty) if group else F.col(f"{kind}_m"))
        df = df.withColumn(f"{kind}_p", F.when(some, F.split("text", pattern, -1)).otherwise(empty))
    return df


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def train_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> list[int]:
    """Weights of all character pairs: log of (chance in random strings / chance in ordinary words), in thousandths.

    Counted over the first ``sample_docs`` documents in hash order: a bounded labelled sample. Both models
    have priors, so they work where no rule has a hit; an empty table gives the ratio of the priors.
    """
    ids = docs.select(F.col(f"`{id_col}`").alias("id")).orderBy(F.xxhash64("id"), "id").limit(sample_docs).distinct()
    some = _texts(docs, id_col, text_col).join(F.broadcast(ids), "id", "left_semi")
    values = F.concat(F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= 16), *(F.regexp_extract_all("text", F.lit(p), F.lit(0)) for _, p, g, _ in RULES if not g))
    rest = F.col("text")
    for _, pattern, *_ in RULES:
        rest = F.regexp_replace(rest, pattern, " ")
    # long tokens are what is to be told, so they are no samples, but for numbers
    ordinary = F.filter(F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0)), lambda t: (F.length(t) < 16) | t.rlike("^[0-9]+$"))
    tokens = some.select(F.explode(F.array(F.struct(F.lit(1).alias("random"), values.alias("t")), F.struct(F.lit(0).alias("random"), ordinary.alias("t")))).alias("s"))
    tokens = tokens.select("s.random", F.explode("s.t").alias("t"))
    pairs = tokens.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substring(F.col("t"), i, F.lit(2)))).alias("pair"))
    counts = pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()  # two models of 67 * 67 pairs
    return _weights([(r["random"], *r["pair"], r["n"]) for r in counts])


def _kind(c: str) -> str:
    return "lower" if c.islower() else "upper" if c.isupper() else "other"


def _weights(counts: list[tuple[int, str, str, int]]) -> list[int]:
    """Of all pairs of ``ALPHABET``, from counts of (random or not, character, next one, number)."""
    folded: Counter = Counter()
    cases: Counter = Counter()
    for random, a, b, n in counts:
        folded[random, a.lower(), b.lower()] += n
        if b.isalpha():
            cases[random, _kind(a), b.isupper()] += n
    # rare pairs: of random strings all characters are as likely, of ordinary words as likely as they are at all
    often = {b: sum(folded[0, a, b] for a in FOLDED) + 0.1 for b in FOLDED}
    every = sum(often.values())
    upper = (sum(n for (k, _, u), n in cases.items() if u and not k) + 1) / (sum(n for (k, *_), n in cases.items() if not k) + 2)

    def chance(random: int, a: str, b: str) -> float:
        n, of = folded[random, a, b], sum(folded[random, a, x] for x in FOLDED)
        return (n + 1) / (of + len(FOLDED)) if random else (n + 2 * often[b] / every) / (of + 2)

    def case(a: str, b: str) -> float:
        usual = upper if b.isupper() else 1 - upper
        one, other = ((cases[k, _kind(a), b.isupper()] + 2 * p) / (cases[k, _kind(a), True] + cases[k, _kind(a), False] + 2) for k, p in ((1, 0.5), (0, usual)))
        return max(-MOST_CASE, min(MOST_CASE, 1000 * math.log(one / other)))

    ratios = {(a, b): 1000 * math.log(chance(1, a, b) / chance(0, a, b)) for a in FOLDED for b in FOLDED}
    # what stands beside a separator says nothing: words are joined by them as random strings hold them
    return [0 if {a, b} & set(SEPARATORS) else round(ratios[a.lower(), b.lower()] + (case(a, b) if b.isalpha() else 0)) for a in ALPHABET for b in ALPHABET]


def find_secrets(docs: DataFrame, weights: list[int], id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Every row of ``docs`` as (id, text, base, spans): arrays of (start, order, end), sorted, code points, end exclusive.

    With ``keep``, also ``row``, the row as it was in one struct, so that no column's name clashes with these.

    ``base`` has the rules' spans (leftmost, not overlapping within a kind, failing matches dropped),
    ``spans`` these and the tokens, or stretches of tokens, outside of base spans that the Markov models tell to
    be random. ``order`` is the place of the kind in ``KINDS``. A null text counts as empty and has no spans.
    Repeated rows stay; all whole texts are scanned; no shuffle.
    """
    more_cols = ["row"] if keep else []
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if keep else []))
    df = _rule_columns(texts)

    def long_enough(kind: str, least: int):
        return lambda i: F.length(F.get(F.col(f"{kind}_g"), i)) >= least

    found = [_spans(F.col(f"{k}_p"), F.col(f"{k}_m"), long_enough(k, n), k) for k, _, _, n in RULES]
    df = df.select("id", "text", *more_cols, F.array_sort(F.concat(*found)).alias("base"))
    # base spans as blanks, so that places stay and what is left of a token is a token
    df = df.withColumn("free", _blanked(F.col("text"), F.col("base")))
    df = df.withColumn("tokens", F.regexp_extract_all("free", F.lit(CANDIDATE), F.lit(0)))
    model, none = F.lit(weights), F.array().cast(RANGE)

    def found_in(token: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length(token).cast("long").alias("end")))
        return F.when(_is_random(token, model), whole).when(token.rlike("[/=_-]"), _stretches(token, model)).otherwise(none)

    df = df.withColumn("random", F.when(F.size("tokens") > 0, F.transform("tokens", found_in)).otherwise(F.array().cast(f"array<{RANGE}>")))
    some = F.exists("random", lambda r: F.size(r) > 0)
    empty = F.array().cast("array<string>")
    df = df.withColumn("tokens", F.when(some, F.col("tokens")).otherwise(empty))
    df = df.withColumn("pieces", F.when(F.size("tokens") > 0, F.split("free", CANDIDATE, -1)).otherwise(empty))
    places = _spans(F.col("pieces"), F.col("tokens"), lambda i: F.size(F.get("random", i)) > 0, "markov")
    hits = F.filter("random", lambda r: F.size(r) > 0)
    moved = lambda p, r: F.struct((p["start"] + r["start"]).alias("start"), p["order"].alias("order"), (p["start"] + r["end"]).alias("end"))
    more = F.flatten(F.zip_with(places, hits, lambda p, rs: F.transform(rs, lambda r: moved(p, r))))
    return df.select("id", "text", *more_cols, "base", F.array_sort(F.concat("base", more)).alias("spans"))


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to before ``end`` of a text in pieces of ``PIECE``."""
    i, j = (F.floor(x / PIECE).cast("int") for x in (start, end))
    from_, to = ((x % PIECE).cast("int") for x in (start, end))
    some = F.concat(F.substring(F.get(pieces, i), from_ + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, F.greatest(F.lit(0), j - i - 1)), ""), F.coalesce(F.substring(F.get(pieces, j), F.lit(1), to), F.lit("")))
    return F.when(start >= end, "").when(i == j, F.substring(F.get(pieces, i), from_ + 1, (end - start).cast("int"))).otherwise(some)


def _without(text: Column, spans: Column, fill) -> Column:
    """``text`` with ``fill(n, begins)`` for the n characters of each of the sorted spans that no earlier one covers; ``begins``: none are covered."""
    gap = "struct<a:bigint,z:bigint,n:bigint,begins:boolean>"
    step = lambda at, s: F.struct(at.alias("a"), F.greatest(at, s["start"]).alias("z"), F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(at, s["start"])).alias("n"), (s["start"] >= at).alias("begins"))
    parts = _running(spans, gap, step, lambda at, s: F.greatest(at, s["end"]))
    whole = F.array(F.struct(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("p"), parts.alias("g"), F.array_max(F.transform(spans, lambda s: s["end"])).alias("at")))
    join = lambda w: F.concat(F.array_join(F.transform(w["g"], lambda g: F.concat(_cut(w["p"], g["a"], g["z"]), fill(g["n"], g["begins"]))), ""), _cut(w["p"], w["at"], F.length(text).cast("long")))
    return F.when(F.size(spans) > 0, F.get(F.transform(whole, join), 0)).otherwise(text)


def _blanked(text: Column, spans: Column) -> Column:
    """``text`` with blanks for its spans, so that places stay."""
    return _without(text, spans, lambda n, _: F.repeat(F.lit(" "), n.cast("int")))


def redacted(text: Column, spans: Column, mark: str = "<SECRET>") -> Column:
    """``text`` with each span, or run of overlapping ones, replaced by ``mark``."""
    return _without(text, spans, lambda _, begins: F.when(begins, mark).otherwise(""))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_assign, n_access, n_hex, base_sha256, spans (as text). See ``find_secrets``."""
    df = find_secrets(docs, train_model(docs, id_col, text_col), id_col, text_col)
    number = lambda k: F.size(F.filter("base", lambda s: s["order"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return df.select(F.col("id").alias(id_col), *map(number, KINDS[:3]), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
