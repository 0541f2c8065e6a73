import corpus_pipeline
from quillvec.llm import mixing, near_dup, toxicity, winnowing

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    """Each stage's rows against its operator's result on the stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    after = []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.settle(stage(spark, docs, SF), "test")
        after.append((name, docs, out))
        docs = out
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert [n for n, _, _ in after] == ["toxicity", "near-duplicates", "decontamination", "mixing", "shards"]
    for _, _, out in after[:-1]:
        assert out.columns == columns

    _, given, out = after[0]
    machine = toxicity.train(given, spark.read.parquet(f"{SF}/labels.parquet"), ~toxicity.held_out())
    assert ids(out) == ids(toxicity.toxicity(given, machine).where(f"score < {toxicity.THRESHOLD}"))
    _, given, out = after[1]
    assert ids(out) == ids(near_dup.near_duplicates(given).where("kept"))
    _, given, out = after[2]
    assert ids(out) == ids(winnowing.contamination(given, spark.read.parquet(f"{SF}/benchmark.parquet")).where("NOT contaminated"))
    _, given, out = after[3]
    repeats = mixing.mix(given, "doc_id", given["source"], mixing.word_count(given["text"])).collect()
    assert ids(out) == sorted(r["doc_id"] for r in repeats for _ in range(r["repeats"]))
    _, given, out = after[4]
    assert ids(out) == ids(given)
    assert {r["shard"] for r in out.select("shard").distinct().collect()} == set(range(16))


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "curve"] and out.count() > 100


def test_workers_need_no_installed_package(tmp_path):
    """A driver started elsewhere, whose Python workers cannot import the package."""
    import os
    import subprocess
    import sys

    import __spark_entry__ as entry

    names = ["op2_repair_tokens", "op3_site_templates", "op5_toxicity", "op9_near_duplicates", "op10_language_id"]
    script = tmp_path / "driver.py"
    script.write_text(
        "import importlib.util\n"
        f"spec = importlib.util.spec_from_file_location('entry', {entry.__file__!r})\n"
        "m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)\n"
        "from quillvec.session import build_session\n"
        "spark = build_session('elsewhere', 2)\n"
        f"print('rows', *[m.queries()[n](spark, {SF!r}).count() for n in {names!r}])\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "rows 200 50 200 200 200" in done.stdout, done.stdout + done.stderr[-2000:]
