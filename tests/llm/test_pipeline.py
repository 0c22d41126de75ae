import os
import subprocess
import sys

import corpus_pipeline
from reference import contamination

from scriptorium.llm.decontaminate import contaminated_spans
from scriptorium.llm.line_dedup import repeated_lines
from scriptorium.llm.near_dedup import near_duplicates
from scriptorium.llm.tables import load, staged

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        kept[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert repeated_lines(kept["line_dedup"]).where("n_lines > 0").count() == 0
    assert near_duplicates(kept["near_dedup"]).where("not kept").count() == 0
    benchmark = load(spark, sf_dir, "benchmark")
    clean = kept["decontamination"]
    assert contaminated_spans(clean, benchmark).where("size(spans) > 0").count() == 0
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    assert not any(hit for _, hit, _ in contamination(texts, items).values())
    assert kept["mixing"].count() == clean.count() > 100
    final = corpus_pipeline.run(spark, sf_dir)
    assert sorted(final.columns) == sorted(kept["mixing"].columns)
    assert sorted(r["doc_id"] for r in final.collect()) == sorted(texts)


def test_no_oracle_means_none():
    assert corpus_pipeline.ORACLE_SQL is None
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "near_dedup", "decontamination", "mixing",
    ]


def test_rest_imports_without_the_subpackage(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", "scriptorium", ".git"):
            os.symlink(os.path.join(ROOT, name), tmp_path / name)
    os.mkdir(tmp_path / "scriptorium")
    for name in os.listdir(os.path.join(ROOT, "scriptorium")):
        if name != "llm":
            os.symlink(os.path.join(ROOT, "scriptorium", name), tmp_path / "scriptorium" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-B", "-c", code], check=True, cwd=tmp_path, env=env)
