"""The pipeline against brute force on the smallest documents, stage by stage."""

import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F
from test_llm import LOWER, best_fit, brute_base, brute_components, check_packed

import corpus_pipeline
from veil.llm import packing
from veil.llm.queries import vocabulary


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    """Each stage's input and result rows; the first input has odd rows and clashing columns added."""
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("score", F.lit("mine")).withColumn("spans", F.lit(1))
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "Mail bob@example.com, please, about the thing that we said.")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    out, where = [], tmp_path_factory.mktemp("stages")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(where / str(i)))
        after = spark.read.parquet(str(where / str(i)))
        out.append((name, docs.columns, docs.collect(), after.columns, after.collect()))
        docs = after
    return out


def test_columns_and_rows(stages):
    for name, before_columns, before, after_columns, after in stages[:-1]:
        assert after_columns == before_columns
        kept = {r.doc_id: r for r in after}
        given = {r.doc_id: r for r in before}
        assert len(kept) == len(after) and kept.keys() <= given.keys()
        if name != "pii_redaction":
            assert all(given[i] == r for i, r in kept.items())


def test_quality_drops_few_good_rows(spark, data, stages):
    good = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").filter("quality = 1").collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").filter("quality = 0").collect()}
    kept = {r.doc_id for r in stages[0][4]}
    assert len(good & kept) >= 0.95 * len(good) and len(bad & kept) <= 0.3 * len(bad)


def test_one_document_of_each_component_stays(stages):
    components = brute_components([(r.doc_id, r.text) for r in stages[1][2]])
    assert {r.doc_id for r in stages[1][4]} == {i for i, (_, c) in components.items() if i == c}


def test_leaks_go_and_others_stay(spark, data, stages):
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").translate(LOWER)))
    items = [plain(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    held = {r.doc_id for r in stages[2][2] if any(i in plain(r.text) for i in items)}
    assert {r.doc_id for r in stages[2][4]} == {r.doc_id for r in stages[2][2]} - held


def test_no_personal_data_is_left(stages):
    given = {r.doc_id: r for r in stages[3][2]}
    for r in stages[3][4]:
        assert not brute_base(r.text or "")
        if r.text == given[r.doc_id].text:
            assert r == given[r.doc_id]
        else:
            assert r.n_chars is None or r.n_chars == len(r.text)


def test_packing_of_what_is_left(stages):
    rows = [(r.doc_id, r.text) for r in stages[4][2]]
    pieces = stages[4][4]
    used = check_packed(rows, pieces, 2048, packing.TokenIds(vocabulary("byte_bpe_50k.json")))
    assert {p.doc_id for p in pieces} == {i for i, _ in rows} and used <= best_fit([p.length for p in pieces], 2048)


def test_run_on_repeated_rows_and_long_texts(spark, data, tmp_path, stages):
    """run() on tables where rows repeat, ids and texts are missing, and one text is very long."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = sorted({r.doc_id for r in stages[4][2]} & {r.doc_id for r in docs.collect()})
    twice = docs.filter(F.col("doc_id").isin(kept[:3]))
    first = docs.filter(F.col("doc_id") == kept[0])
    long = docs.filter(F.col("doc_id").isin(kept)).agg(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat("text", F.lit(" "), F.reverse("text"))))).alias("text"))
    more = long.withColumn("doc_id", F.lit(10**7).cast("long")).unionByName(first.withColumn("doc_id", F.lit(None).cast("long")).select("text", "doc_id"))
    more = more.unionByName(spark.createDataFrame([(None, 10**7 + 1), ("", 10**7 + 2)], "text string, doc_id long"))
    docs.unionByName(twice).unionByName(twice).unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    spans = {}
    for x in pieces:
        spans.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in spans.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(parts))]
        assert [at for at, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    times = collections.Counter((x.doc_id, x.piece) for x in pieces)
    held = {i for i, _ in times}
    assert {n for (i, _), n in times.items() if i in kept[:3]} == {3} and {n for (i, _), n in times.items() if i not in kept[:3]} == {1}
    assert held & set(kept) and len(set(kept) - held) <= 0.05 * len(kept)  # repeated rows may move the classifier a little
    if 10**7 in held:
        own = sorted((x for x in pieces if x.doc_id == 10**7), key=lambda x: x.piece)
        assert len(own) > 50 and all(x.length == 2048 for x in own[1:]) and [x.start for x in own[1:]] == list(itertools.accumulate(x.length for x in own[:-1]))


def test_empty_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0, name


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(4, 1), (5, 7)]])
def test_quality_keeps_all_without_a_model(spark, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "some text of a clean document", "mine"), (2, "", "mine"), (3, None, "mine")], "doc_id long, text string, score string")
    kept = corpus_pipeline.quality_classifier(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [1, 2, 3]
