import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pytest

from termloom.llm import registry

ROOT = Path(__file__).resolve().parents[2]


def test_stages_take_messy_documents(spark, messy, empty, folder):
    for docs in (messy, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert out.count() <= docs.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == list(corpus_pipeline.COLUMNS)


def test_every_operator_has_a_query():
    names = {n.split("_")[0] for n in registry.QUERIES}
    assert names == {*(f"op{i}" for i in range(1, 14)), "pipeline"}


def test_pipeline_keeps_clean_documents(spark, folder):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert 0.8 * docs < len(got) < docs
    assert all(r["n_tokens"] > 0 for r in got.values())


@pytest.mark.parametrize("missing", ["termloom.llm", "corpus_pipeline"])
def test_the_rest_imports_without_it(missing):
    code = f"import sys; sys.modules[{missing!r}] = None\nimport __spark_entry__ as e\nassert not any(n.startswith('op') for n in e.queries()) and e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
