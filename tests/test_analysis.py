import json

import pytest

from veridoc import cli
from veridoc.config import Config, ConfigError
from veridoc.operators import authorship
from veridoc.plans import analysis, benchmark, jobs
from veridoc.sources import readers, sinks
from veridoc.streaming import score_stream, watch_parquet


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    body = "alpha beta gamma delta epsilon zeta eta theta iota kappa. "
    (source / "b.txt").write_text(body)
    (source / "a.TXT").write_text(body)
    (source / 'c,"d".txt').write_text("network compiler memory process scheduler kernel")
    (source / "e.txt").write_text("")
    (source / "skip.md").write_text("no")
    (source / "deep").mkdir()
    (source / "deep" / "f.txt").write_text("no")
    return source


def test_folder_source(spark, folder):
    rows = readers.from_folder(spark, str(folder)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.filename, r.bytes) for r in rows] == [(0, "a.TXT", 58), (1, "b.txt", 58), (2, 'c,"d".txt', 48), (3, "e.txt", 0)]


def test_lines_of_a_file_stay_together(spark, folder):
    (folder / "g.txt").write_text("one two\nthree four\r\nfive")
    assert readers.from_folder(spark, str(folder)).where("filename = 'g.txt'").first().text == "one two\nthree four\r\nfive"
    corpus = readers.read_corpus(spark, str(folder / "g.txt"))
    assert [r.text for r in corpus.collect()] == ["one two\nthree four\r\nfive"]
    assert authorship.train(spark, corpus).ngrams.count() == 3  # n-grams run over the ends of lines
    with pytest.raises(readers.SourceError):
        readers.from_folder(spark, str(folder / "none"))


def test_report(spark, folder, tmp_path):
    found = analysis.analyze_folder(spark, Config(input=str(folder), output=str(tmp_path / "out")))
    assert [(p["doc_a"], p["doc_b"]) for p in found["flagged_pairs"]] == [(0, 1)]
    matrix = found["similarity_matrix"]
    assert all(matrix[i][i] == 1.0 for i in range(4)) and matrix[0][1] == matrix[1][0] == pytest.approx(1)
    assert found["benchmark"]["candidate_generation"]["total_pairs"] == 6
    assert set(found["benchmark"]["stage_times_ms"]) == {"io", "tokenize_tfidf", "minhash_lsh", "similarity", "perplexity", "write_outputs", "total"}
    lines = (tmp_path / "out" / "similarity_matrix.csv").read_text().splitlines()
    assert lines[0] == 'document,a.TXT,b.txt,"c,""d"".txt",e.txt' and lines[1] == "a.TXT,1.000,1.000,0.000,0.000"
    text = (tmp_path / "out" / "report.json").read_text()
    assert 'c,\\"d\\".txt' in text and json.loads(text)["meta"]["num_docs"] == 4
    shaped = analysis.normalise(found, "j")
    assert shaped["flagged_pairs"][0]["doc_a"] == "a.TXT" and shaped["speedup"] is None and shaped["num_docs"] == 4


def test_long_form_beyond_the_dense_bound(spark, folder, tmp_path, capsys, monkeypatch):
    dense = analysis.analyze_folder(spark, Config(input=str(folder), output=str(tmp_path / "dense")))
    monkeypatch.setattr(sinks, "DENSE_DOCUMENTS", 3)
    out = tmp_path / "out"
    for _ in range(2):  # a second run replaces the first
        assert cli.main(["--input", str(folder), "--out-dir", str(out)], spark) == 0
    said = capsys.readouterr().out
    assert "documents: 4\n" in said and "flagged pairs: 1\n" in said and " of 4\n" in said
    read = {name: spark.read.parquet(f"{out}/{name}").collect() for name in sinks.TABLES}
    assert {r.filename for r in read["documents"]} == {d["filename"] for d in dense["documents"]}
    assert [(r.a, r.b) for r in read["flagged_pairs"]] == [(0, 1)]
    assert {(r.filename, round(r.ai_score, 9)) for r in read["ai_scores"]} == {(s["filename"], round(s["ai_score"], 9)) for s in dense["ai_scores"]}
    assert read["similarity"] and spark.read.option("header", True).csv(f"{out}/ai_scores.csv").count() == 4
    found = json.loads((out / "report.json").read_text())
    assert found["meta"]["num_docs"] == 4 and found["benchmark"]["candidate_generation"]["flagged_pairs"] == 1
    shaped = analysis.normalise(found, "j")
    assert shaped["num_docs"] == 4 and shaped["tables"] == list(sinks.TABLES)


def test_cli_codes(spark, folder, tmp_path, capsys):
    out = str(tmp_path / "o")
    assert cli.main(["--input", str(folder), "--out-dir", out, "--benchmark"], spark) == 0
    assert "flagged pairs: 1" in capsys.readouterr().out
    assert cli.main(["--input", str(folder), "--bands", "0"], spark) == 2
    assert cli.main(["--what"], spark) == 2
    assert cli.main(["--help"], spark) == 0
    assert cli.main(["--input", str(tmp_path / "none"), "--out-dir", out], spark) == 3
    (tmp_path / "empty").write_text("...")
    assert cli.main(["--input", str(folder), "--corpus", str(tmp_path / "empty"), "--out-dir", out], spark) == 4
    assert cli.main(["--input", str(folder), "--corpus", str(tmp_path / "missing"), "--out-dir", out], spark) == 0


def test_config():
    assert Config(bands=50, rows=5).banding == (20, 5) and Config(bands=10, rows=4).banding == (10, 4)
    assert Config(mode="serial", threads=8).threads_used == 1 and Config(ngram=1).order == 2
    for wrong in ({"sim_threshold": 1.1}, {"ai_threshold": -1}, {"threads": 0}, {"rows": 1_000_001}, {"mode": "x"}):
        with pytest.raises(ConfigError):
            Config(**wrong)


def test_stopwords_and_uploads(spark, tmp_path):
    (tmp_path / "s").write_text("# no\n The\nand  \n\nand\n")
    assert set(readers.read_stopwords(spark, str(tmp_path / "s"))) == {" the", "and"}
    assert readers.read_stopwords(spark, str(tmp_path / "none")) == ()
    assert readers.validate_uploads([("x/a.txt", 1), ("a.txt", 2), ("b.TXT", 3)]) == ["a.txt", "b.TXT"]
    for wrong in ([], [("a.md", 1)], [("a.txt", 6 << 20)], [(f"{i}.txt", 1) for i in range(201)]):
        with pytest.raises(readers.SourceError):
            readers.validate_uploads(wrong)
    held = [str(i) for i in range(199)]
    assert readers.merge_selection(held, ["x", "y"]) == (held, False) and readers.merge_selection(held, ["x"])[1]


def test_numbers_are_written_as_c_does():
    assert next(iter(list(sinks.matrix_lines(["a"], {(0, 0): 0.0625}))[1:])) == "a,0.062"
    assert '"x": 0.500000' in sinks.report_json({"x": 0.5})


def test_jobs(tmp_path):
    store = jobs.JobStore(str(tmp_path))
    job = store.submit([("a.txt", b"x"), ("dir/a.txt", b"y")])
    assert job.num_docs == 2 and len(job.job_id) == 12 and store.get(job.job_id).progress == 0
    with pytest.raises(jobs.JobNotReady):
        store.result(job.job_id)
    assert store.run(job.job_id, lambda i, o: {"ok": 1}).status == "complete" and store.result(job.job_id) == {"ok": 1}
    other = store.submit([("a.txt", b"x")])
    assert store.run(other.job_id, lambda i, o: 1 / 0).error == "division by zero" and store.get(other.job_id).progress == 1
    for call in (lambda: store.get("none"), lambda: store.file(job.job_id, "report.json")):
        with pytest.raises(jobs.JobNotFound):
            call()


def test_benchmark(spark):
    runs = benchmark.points(spark, [(1, 100.0), (2, 60.0), (4, 40.0)])  # a serial share of 0.2
    fit = benchmark.amdahl_fit(runs).first()
    assert fit.serial_share == pytest.approx(0.2, abs=0.002) and fit.error < 1e-3
    assert benchmark.amdahl_fit(benchmark.points(spark, [(1, 5.0)])).first().serial_share == 0
    shares = benchmark.stage_shares(spark.createDataFrame([("a", 1.0), ("b", 3.0)], "stage string, ms double")).orderBy("stage").collect()
    assert [s.share for s in shares] == [0.25, 0.75]
    rows = benchmark.sweep(lambda n: {"runtime_ms": 100.0 / n}, (1, 2))
    assert [r["speedup"] for r in rows] == [1.0, 2.0]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta gamma delta. Short one."), (2, "")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    query = score_stream(watch_parquet(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), authorship.train(spark))
    query.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == [1, 2] and rows[1].mean_perplexity == 1000
