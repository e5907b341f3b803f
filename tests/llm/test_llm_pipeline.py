"""The stages of the pipeline over the smallest tables, each judged on its own input."""

import sys
from collections import defaultdict
from pathlib import Path

import public_tokenizers
import pytest

from .test_llm_duplicates import brute_components, line_set, normal, roots
from .test_llm_texts import checked_packing

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage, by its name."""
    import corpus_pipeline

    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(folder / name))
        after = spark.read.parquet(str(folder / name))
        out[name] = (docs.collect(), after.collect(), docs.columns, after.columns)
        docs = after
    return out


def test_stages_keep_the_columns_of_documents(stages):
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, (_, _, before, after) in stages.items():
        if name != "packing":
            assert before == after


def test_quality_follows_the_labels(spark, stages):
    before, after, *_ = stages["quality"]
    kept = {r["doc_id"] for r in after}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    told = [(q, i in kept) for i, q in labels.items() if i in {r["doc_id"] for r in before}]
    assert sum(bool(q) == k for q, k in told) / len(told) > 0.95


def test_every_line_component_is_left_once(stages):
    before, after, *_ = stages["line_dedup"]
    distinct = sorted({normal(line) for r in before for line in (r["text"] or "").split("\n")} - {""})
    sets = [line_set(line) for line in distinct]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b]))]
    edges = [(a, b) for a, b in near if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    component = dict(zip(distinct, roots(range(len(distinct)), edges).values()))
    left = defaultdict(int)
    for r in after:
        for line in (r["text"] or "").split("\n"):
            if normal(line):
                left[component[normal(line)]] += 1
    assert dict(left) == dict.fromkeys(component.values(), 1)


def test_one_document_of_each_group_stays(stages):
    before, after, *_ = stages["near_dedup"]
    components, sets = brute_components([(r["doc_id"], r["text"]) for r in before], 4, 5)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, c in components.items() if i == c)


def test_no_document_holds_a_whole_item(spark, stages):
    before, after, *_ = stages["decontamination"]
    flat = lambda t: " ".join((t or "").lower().split())
    items = [flat(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    holds = {r["doc_id"] for r in before if any(i in flat(r["text"]) for i in items)}
    kept = {r["doc_id"] for r in after}
    assert not holds & kept
    assert len(before) - len(after) <= len(holds) + 2


def test_all_that_is_left_is_packed(stages):
    from tokenizers import Tokenizer

    before, after, *_ = stages["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    checked_packing([(r["doc_id"], r["text"]) for r in before], after, tokenizer, 4096)


def test_run_gives_the_last_stage(spark, stages):
    import corpus_pipeline

    key = lambda r: (r["doc_id"], r["piece"], r["ids_crc32"], r["length"])
    assert sorted(map(key, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(key, stages["packing"][1]))
