"""The pipeline's stages against plain versions of each, and the entry point without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import test_benchmark_leaks
import test_near_classes
import test_shared_lines
from corpus import awkward, frame

from sitewise.llm import quality
from sitewise.session import durable

REPO = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


def rows(docs):
    return sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = rows(docs)
        docs = durable(stage(spark, docs, SF))
        held[name] = (before, rows(docs))
        assert docs.columns[: len(columns)] == columns

    before, after = held["quality classifier"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.quality(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    good = {r.doc_id for r in scored.filter("predicted = 1").collect()}
    assert after == [r for r in before if r[0] in good] and 0 < len(after) < len(before)

    before, after = held["line dedup"]
    assert after == sorted([(d, t) for d, t, _, _ in test_shared_lines.plain(before, 10)], key=str)

    before, after = held["minhash near-dedup"]
    classes = {d: c for d, c, _ in test_near_classes.plain(before)[0]}
    assert after == [r for r in before if classes[r[0]] == r[0]] and len(after) < len(before)

    before, after = held["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d for d, _, _ in test_benchmark_leaks.plain(docs=before, items=items)}
    assert after == [r for r in before if r[0] not in hit] and hit

    before, after = held["mixing to target weights"]
    assert after == before and docs.filter("mix_rate < 0 or mix_copies is null").isEmpty()
    assert rows(corpus_pipeline.run(spark, SF)) == after


def test_stages_take_awkward_and_empty_tables(spark):
    for table in (frame(spark, awkward()), frame(spark, [])):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = durable(stage(spark, docs, SF))
            assert docs.columns[: len(table.columns)] == table.columns


def test_entry_without_corpus_operators(tmp_path):
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")
    shutil.copytree(REPO, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 100 and int(said[1]) > 100 and said[2:] == ["False", "False"]
