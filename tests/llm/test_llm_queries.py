"""The registered queries: SQL where there is some, and the pipeline stage by stage."""

import pytest
from compare import assert_same, connect

from loomlake.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name])


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns
        steps[name] = {r.doc_id: r.text for r in docs.collect()}
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(steps["secrets"]) == set(steps["decontamination"]) <= set(steps["near_duplicates"]) <= set(steps["toxicity"]) <= set(before)
    assert len(steps["secrets"]) < len(before)
    assert len(steps["secrets"]) > 0.6 * len(before)
    for i, t in steps["secrets"].items():
        assert t == before[i] or "<SECRET>" in t
    final = P.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in final.collect()} == set(steps["secrets"])
    assert P.run(spark, sf).count() == len(steps["secrets"])


def test_pipeline_decides_by_row(spark, tmp_path):
    """Null and repeated ids: each row goes or stays by its own text."""
    import random

    import corpus_pipeline as P

    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    bad = lambda: f"{text(20)} vile grubby nasty {text(20)}"
    train = [(i, bad() if i % 8 == 0 else text(40)) for i in range(400)]
    spark.createDataFrame([(i, int(i % 8 == 0)) for i, _ in train], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    passage = text(30)
    spark.createDataFrame([("b", passage)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = lambda rows: spark.createDataFrame([(i, t, "en", len(t)) for i, t in rows], "doc_id long, text string, lang string, n_chars long")

    def kept(stage, rows, of):
        return sorted(((r.doc_id, r.text) for r in stage(spark, frame(rows), str(tmp_path)).collect() if (r.doc_id, r.text) in of), key=repr)

    clean, toxic, leak = [text(40) for _ in range(2)], bad(), f"{text(5)} {passage} {text(5)}"
    more = [(None, toxic), (None, clean[0]), (500, toxic), (500, clean[1]), (501, toxic), (501, toxic)]
    assert kept(P.toxicity_stage, train + more, more) == sorted([(None, clean[0]), (500, clean[1])], key=repr)
    more = [(None, leak), (None, clean[0]), (500, leak), (500, clean[1]), (501, leak), (501, leak)]
    assert kept(P.decontamination_stage, more, more) == sorted([(None, clean[0]), (500, clean[1])], key=repr)
    a, b, c, d = (text(60) for _ in range(4))
    more = [(None, a), (9, a), (9, a), (4, a), (4, d), (None, b), (None, f"{b} end"), (7, c), (7, c), (None, "")]
    assert kept(P.near_duplicates_stage, more, more) in [sorted([(4, a), (4, d), (None, x), (7, c), (None, "")], key=repr) for x in (b, f"{b} end")]


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_with_nulls_empty_tables_and_clashing_names(spark, tmp_path, empty):
    import corpus_pipeline as P

    names = ["id", "spans", "base", "node", "comp", "sig", "tag", "n", "words", "score", "component_id"]
    rows = [(1, "a b c d e f g", "en"), (None, None, None), (2, "", None), (2, None, "x"), (3, "token=abcdefgh12345 rest of it", "en")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([] if empty else [(i, t, lang, "s", len(t or ""), *names) for i, t, lang in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step = docs
    for name, stage in P.STAGES[:-1]:
        step = P.materialize(stage(spark, step, str(tmp_path)), name)
        assert step.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in step.collect())) == ([] if empty else [(0, ""), (1, "a b c d e f g"), (2, ""), (2, ""), (3, "<SECRET> rest of it")])
    out = P.run(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) * (not empty) and all(len(r.token_ids) == r.n_tokens for r in out)


def test_empty_tables(spark):
    from loomlake.llm import decontaminate, html_extract, quality, substring_dedup, toxicity

    docs = spark.createDataFrame([], "doc_id long, text string, id string, tag string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("a", "some words of a test")], "item_id string, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for made in (decontaminate.decontaminate(docs, bench), html_extract.extract_pages(pages), quality.quality(docs, labels), substring_dedup.remove_repeats(docs), toxicity.toxicity(docs, labels)):
        assert made.collect() == []
