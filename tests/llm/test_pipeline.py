"""The pipeline against a brute-force version of all five stages."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm.conftest import corpus
from tests.llm.test_operators import TOKENIZER, components_by_hand, dedup_by_hand, oracle, packed_right, words
from tickforge.llm import quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, lang, s, n) for i, t, lang, s, n, *_ in corpus(7, 90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{path}/documents.parquet")
    long_enough = [t for _, t, *_ in rows if t and 30 < len(t.split()) < 100]
    items = [(0, " ".join(long_enough[0].split()[3:28])), (1, " ".join(f"z{i}" for i in range(20)))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_stages(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = {r[0] for r in oracle(quality.ORACLE["op3_quality_rules"], rows) if r[-1]}
    by_hand = {i: t for i, t, *_ in rows if i in kept}
    groups = components_by_hand(list(by_hand.items()))
    by_hand = {i: t for i, t in by_hand.items() if groups[i][1] == i}
    deduped = dedup_by_hand(list(by_hand.items()))
    by_hand = {i: deduped[i][2] for i in by_hand}
    item = items[0][1].split()

    def leaks(text):
        w = words(text, True)
        return any(sum(a == b for a, b in zip(w[k : k + len(item)], item, strict=False)) >= 13 for k in range(len(w)))

    by_hand = {i: t for i, t in by_hand.items() if not leaks(t)}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.durable(stage(spark, docs, path), "test-stage")
        seen.append(docs.count())
        if name != "best-fit packing":
            assert docs.columns == columns
            final = {r.doc_id: r.text for r in docs.collect()}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert final == by_hand
    assert seen[0] == len(kept) and seen == sorted(seen[:4], reverse=True) + seen[4:]
    packed_right(docs.collect(), list(by_hand.items()), 2048)


def test_run_equals_stages(spark, folder):
    path, _, _ = folder
    rows = corpus_pipeline.run(spark, path).collect()
    assert rows and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_run_leaves_its_last_table_only_and_takes_nulls_and_empty_tables(spark, tmp_path):
    import os

    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")))
    good = " ".join(f"w{i}" for i in range(40))
    for name, rows in {"some": [(None, good, None, None, None), (None, None, None, None, 0), (3, good, "en", "s", 1), (3, good, "en", "s", 1)], "none": []}.items():
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in out} <= {None, 3} and (name == "some") == bool(out)
    left = set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))) - before
    assert len(left) == 2 and all(x.startswith("stage-best-fit-packing") for x in left), left
