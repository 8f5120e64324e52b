import hashlib
import re

import pytest
from pyspark.sql import functions as F

from .test_ngram_join import shingle_set
from .test_text_operators import cut, plain_items

import corpus_pipeline as CP
from webloom.llm import quality as Q
from webloom.llm import sentencepiece_codec as C


def test_stages_on_small_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in CP.STAGES:
        docs = stage(spark, docs, data).cache()
        n = docs.count()
        assert 0 < n <= before, name
        if name != CP.STAGES[-1][0]:
            assert docs.columns == columns
        before = n
    assert docs.where("size(ids) <> n_tokens").count() == 0


ITEM = "A farmer sells 12 boxes to Maria for 5 dollars each and then buys 7 more boxes from Maria before noon"
PROSE = [" ".join(hashlib.md5(f"{i} {j}".encode()).hexdigest()[: 3 + j % 6].translate(str.maketrans("0123456789", "ghijklmnop")) for j in range(60)) for i in range(8)]
EXTRA = "x string, row int, f long, r long, base string, _metadata string, label int, score double"


@pytest.fixture
def odd_folder(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated ids and rows, extra columns with clashing names."""
    near = PROSE[0].split()
    near[30] = "changed"
    rows = [
        (1, PROSE[0], "en", "a", 10),
        (1, PROSE[0], "en", "a", 10),  # a repeated row
        (2, " ".join(near), "en", "a", 10),
        (None, PROSE[0].upper(), "en", "a", 10),  # a near copy without an id
        (3, PROSE[1], "en", "b", 10),
        (3, PROSE[2], "de", "b", 10),  # a repeated id
        (None, PROSE[3], None, None, None),
        (None, f"{PROSE[4]}. {ITEM}. {PROSE[5]}", "en", "b", 10),
        (4, None, None, None, None),
        (None, None, None, None, None),
        (None, "", "en", "b", 0),
        (5, "", "en", "b", 0),
        (6, PROSE[6] + " write to a@b.co or 1.2.3.4 now", "en", "b", 10),
        (7, " ".join(f"{PROSE[7]} {i}" for i in range(2_000)), "en", "b", 10),
    ]
    docs = spark.createDataFrame([(*r, "keep", i, 1, 2, "b", "m", 0, 0.5) for i, r in enumerate(rows)], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def plain_near(rows):
    """One row of each group of near duplicates, by comparing all pairs."""
    sets = [shingle_set(r.text, CP.SHINGLE) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= CP.SIMILAR * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    groups = {}
    for r, x in zip(rows, root):
        groups.setdefault(x, []).append(r)
    return [min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for g in groups.values()]


def keys(rows):
    return sorted((str(r.doc_id), str(r.text)) for r in rows)


def test_odd_rows_through_every_stage(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    columns = docs.schema.names
    for name, stage in CP.STAGES[:4]:
        before = docs.collect()
        stage(spark, docs, odd_folder).write.parquet(f"{odd_folder}/{name}")
        docs = spark.read.parquet(f"{odd_folder}/{name}")
        assert docs.schema.names == columns
        after = docs.collect()
        if name == "quality":  # without labels everything is good
            assert keys(after) == keys(before)
        if name == "near_duplicates":
            assert keys(after) == keys(plain_near(before)) and len(after) == 11
        if name == "decontamination":
            assert keys(after) == keys([r for r in before if not plain_items([(1, ITEM)], r.text)]) and len(after) == len(before) - 1
        if name == "personal_data":
            assert len(after) == len(before)
            new = {r.row: r for r in after}
            for r in before:
                text = None if r.text is None else cut(r.text, [(k, m.start(), m.end()) for k, rx in (("email", r"a@b\.co"), ("ip", r"1\.2\.3\.4")) for m in re.finditer(rx, r.text)])
                assert new[r.row].text == text and new[r.row].n_chars == (len(text) if text != r.text else r.n_chars)
        assert all((r.x, r.f, r.r, r.base, r._metadata, r.label, r.score) == ("keep", 1, 2, "b", "m", 0, 0.5) for r in after)
    whole = C.load(C.model_path())[0]
    got = CP.STAGES[4][1](spark, docs, odd_folder).collect()
    assert sorted((str(r.doc_id), r.n_tokens, list(r.ids)) for r in got) == sorted((str(r.doc_id), len(ids), ids) for r in docs.collect() for ids in [[1, *whole.encode(r.text or ""), 2]])


def test_empty_tables_through_every_stage(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet").limit(0)
    for _, stage in CP.STAGES:
        assert stage(spark, docs, odd_folder).count() == 0


def test_quality_stage_keeps_what_the_classifier_calls_good(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in Q.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in CP.quality(spark, docs, data).collect()} == good


def test_odd_rows_meet_a_trained_model(spark, odd_folder, data):
    """Labels teach a model from real documents among which the odd rows stand; each row is kept or rejected as its score says."""
    real, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.read.parquet(f"{odd_folder}/documents.parquet").select(*real.columns, F.lit("odd").alias("x"))
    shift = 1_000_000
    docs = odd.withColumn("doc_id", F.col("doc_id") + shift).unionByName(real.withColumn("x", F.lit("real")))
    docs.write.parquet(f"{odd_folder}/both")
    labels.write.mode("overwrite").parquet(f"{odd_folder}/labels.parquet")
    docs = spark.read.parquet(f"{odd_folder}/both")
    kept = CP.quality(spark, docs, odd_folder)
    assert kept.columns == docs.columns
    scored = Q.quality_scores(docs, labels).collect()
    assert len(scored) == docs.count() and {r.predicted for r in scored} == {0, 1}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in scored if r.predicted == 1)
    assert all(0 <= r.score <= 1 for r in scored)


def test_entry_has_all_queries():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 14))
