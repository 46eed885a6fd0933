import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tideline.llm.exact_dedup import exact_groups
from tideline.llm.quality import quality
from test_dedup import brute_components, brute_repeats
from test_models import BYTE, check_pieces, library

COLUMNS = list(pipeline.COLUMNS)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted copies, near copies, a shared passage, and odd rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*COLUMNS)
    rows = [tuple(r) for r in docs.orderBy("doc_id").limit(120).collect()]
    good = [r for r in rows if r[2] == "en" and len(r[1].split()) > 200][:8]
    passage = " ".join(f"shared{i}" for i in range(80))
    for n, r in enumerate(good[:4]):
        words = r[1].split(" ")
        words[len(words) // 2] = "Changed"
        rows.append((5000 + n, r[1], "en", "copy", 1))
        rows.append((6000 + n, " ".join(words), "en", "near", 1))
    for n, r in enumerate(good[4:6]):
        rows.append((7000 + n, " ".join(w[::-1] for w in r[1].split(" ")) + " " + passage, "en", "p", 1))
    rows += [(8000, None, None, None, None), (8001, "", "en", "x", 0), (8002, "short", "xx", "x", 5)]
    path = tmp_path_factory.mktemp("pipeline")
    frame = spark.createDataFrame(rows, docs.schema).withColumn("extra", F.lit("clash")).withColumn("_text", F.lit(1))
    frame.repartition(3).write.parquet(f"{path}/documents.parquet")
    return f"{path}", rows, good


@pytest.fixture(scope="module")
def seen(spark, folder, tmp_path_factory):
    """What each of the first four stages keeps, by identifier."""
    path, *_ = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES[:4]:
        at = f"{tmp_path_factory.mktemp('stage')}/out"
        out = stage(spark, docs, path)
        assert out.columns == COLUMNS
        out.write.parquet(at)
        docs = spark.read.parquet(at)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    return seen


def test_stages_one_after_another(spark, folder, seen):
    path, rows, good = folder
    first = seen["quality rules"]
    judged = {r._id: r.kept for r in quality(spark.read.parquet(f"{path}/documents.parquet")).collect()}
    assert set(first) == {i for i, kept in judged.items() if kept}
    assert not {8000, 8001, 8002} & set(first)
    assert all((r.text, r.source) == next((t, s) for i, t, _, s, _ in rows if i == r.doc_id) for r in first.values())

    best = {}
    for r in first.values():
        best[r.text] = max(r.doc_id, best.get(r.text, -1))
    second = seen["exact dedup"]
    assert set(second) == set(best.values())

    third = seen["near dedup"]
    groups = brute_components([(i, r.text) for i, r in second.items()], 4, 4)
    assert set(third) == {i for i, _, component in groups if i == component}

    fourth = seen["passage dedup"]
    assert set(fourth) == set(third)
    order = sorted(third)
    expected = brute_repeats([third[i].text.encode() for i in order], 400)
    for i, (_, removed, *_rest) in zip(order, expected):
        if removed == 0:
            assert fourth[i].text == third[i].text
        assert fourth[i].n_chars == len(fourth[i].text)
    for n in (7000, 7001):
        if n in fourth and {7000, 7001} <= set(fourth):
            assert "shared40" not in fourth[n].text


def test_run_packs_what_the_stages_keep(spark, folder, seen):
    path, *_ = folder
    t = library(BYTE)
    ids = {
        i: t.encode(r.text, add_special_tokens=False).ids + [1] for i, r in seen["passage dedup"].items()
    }
    found = pipeline.run(spark, path).withColumnRenamed("doc_id", "_id").collect()
    check_pieces(found, ids, 2048)


def test_empty_documents(spark, folder, tmp_path):
    path, *_ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}").count() == 0


def test_group_sizes_count_repeated_rows(spark):
    rows = [(1, "a")] * 3 + [(2, "a")]
    found = exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.group_size, r.keep_id, r.kept) for r in found) == {(4, 2, False): 3, (4, 2, True): 1}
