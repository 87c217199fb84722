"""The whole analysis: documents in, flagged pairs and authorship scores out, and the report."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import authorship, similarity, terms
from ..sources import readers, sinks


class EmptyCorpusError(ValueError):
    """The model's corpus can be read but holds no words."""


@dataclass
class Result:
    """Lazy tables of an analysis; close() frees what is cached."""

    config: Config
    documents: DataFrame
    tokens: DataFrame
    pairs: DataFrame
    scores: DataFrame
    flagged: DataFrame
    authorship: DataFrame
    stage_times_ms: dict[str, float] = field(default_factory=dict)
    held: list[DataFrame] = field(default_factory=list)

    def similarity_long(self) -> DataFrame:
        return similarity.similarity_long(self.scores, self.documents)

    def close(self) -> None:
        for df in self.held:
            df.unpersist()


def analyze(spark: SparkSession, documents: DataFrame, config: Config | None = None, stopwords=None, corpus: DataFrame | None = None) -> Result:
    """documents: (doc_id, filename, text, bytes). Tokens feed several tables and are cached, spilling to disk; pairs are
    scored at once, as classes in the scratch folder."""
    config = config or Config()
    words = readers.STOPWORDS if stopwords is None else stopwords
    tokens = terms.tokenized(documents, words).persist(StorageLevel.MEMORY_AND_DISK)
    began = time.time()
    met = similarity.candidates_of(tokens, config.banding)
    middle = time.time()
    scored = similarity.candidate_scores(met, tokens)
    times = {"minhash_lsh": (middle - began) * 1000, "similarity": (time.time() - middle) * 1000}
    scores = scored.pairs().drop("first_band", "first_key")
    model = authorship.train(spark, corpus, config.ngram, words)
    if model.vocabulary.isEmpty():
        raise EmptyCorpusError("the corpus has no words")
    judged = authorship.authorship_scores(documents, tokens, model, config.ai_threshold, words)
    names = documents.select("doc_id", "filename")
    judged = names.join(judged, "doc_id").persist(StorageLevel.MEMORY_AND_DISK)
    return Result(config, documents, tokens, scored.pairs().select("a", "b", "first_band", "first_key"), scores, scored.pairs(config.sim_threshold), judged, times, [tokens, judged])


def run_stages(result: Result) -> dict[str, int]:
    """Runs the stages one after the other, timing each; returns the counts."""
    times, counts = result.stage_times_ms, {}

    def timed(name, action):
        began = time.time()
        value = action()
        times[name] = times.get(name, 0.0) + (time.time() - began) * 1000
        return value

    counts["documents"] = timed("io", result.documents.count)
    counts["tokens"] = timed("tokenize_tfidf", lambda: result.tokens.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0])
    counts["candidate_pairs"] = timed("minhash_lsh", result.pairs.count)
    timed("similarity", result.scores.count)
    counts["flagged_pairs"] = result.flagged.count()
    timed("perplexity", result.authorship.count)
    counts["total_pairs"] = counts["documents"] * (counts["documents"] - 1) // 2
    return counts


def flagged_in_order(result: Result) -> DataFrame:
    """Flagged pairs by the first band and key in which they met."""
    return result.flagged.orderBy("first_band", "first_key", "a", "b")


def _meta(config: Config, documents: int) -> dict:
    return {"num_docs": documents, "threads_used": config.threads_used, "mode": config.mode, "sim_threshold": config.sim_threshold, "ai_threshold": config.ai_threshold}


def report(result: Result, counts: dict[str, int] | None = None) -> dict:
    """The report as a dictionary, for at most sinks.DENSE_DOCUMENTS documents."""
    counts = counts or run_stages(result)
    if counts["documents"] > sinks.DENSE_DOCUMENTS:
        raise ValueError(f"a dense matrix is made for {sinks.DENSE_DOCUMENTS} documents at most; write the tables instead")
    docs = result.documents.select("doc_id", "filename", "bytes").orderBy("doc_id").collect()
    place = {d.doc_id: i for i, d in enumerate(docs)}
    matrix = [[1.0 if i == j else 0.0 for j in range(len(docs))] for i in range(len(docs))]
    for s in result.scores.collect():
        a, b = place[s.a], place[s.b]
        matrix[a][b] = matrix[b][a] = s.combined
    names = {d.doc_id: d.filename for d in docs}
    flagged = [{"doc_a": s.a, "doc_b": s.b, "filename_a": names[s.a], "filename_b": names[s.b], "cosine": s.cosine, "rabin_karp": s.rabin_karp, "combined": s.combined} for s in flagged_in_order(result).collect()]
    scores = [{"filename": s.filename, "mean_perplexity": s.mean_perplexity, "perplexity_variance": s.perplexity_variance, "ai_score": s.ai_score, "flagged": s.flagged} for s in result.authorship.orderBy("doc_id").collect()]
    times = dict(result.stage_times_ms)
    times["write_outputs"] = 0.0
    times["total"] = sum(times.values())
    config = result.config
    return {
        "meta": _meta(config, len(docs)),
        "documents": [{"doc_id": d.doc_id, "filename": d.filename, "bytes": d.bytes} for d in docs],
        "similarity_matrix": matrix,
        "flagged_pairs": flagged,
        "ai_scores": scores,
        "benchmark": {"stage_times_ms": times, "candidate_generation": {k: counts[k] for k in ("total_pairs", "candidate_pairs", "flagged_pairs")}},
    }


def long_report(result: Result, counts: dict[str, int]) -> dict:
    """The report of any number of documents: counts alone, as the rows are in the tables."""
    times = dict(result.stage_times_ms)
    times["write_outputs"] = 0.0
    times["total"] = sum(times.values())
    return {
        "meta": _meta(result.config, counts["documents"]),
        "flagged_documents": result.authorship.where("flagged").count(),
        "tables": list(sinks.TABLES),
        "benchmark": {"stage_times_ms": times, "candidate_generation": {k: counts[k] for k in ("total_pairs", "candidate_pairs", "flagged_pairs")}},
    }


def write_long(folder: str, result: Result) -> None:
    """The tables, and ai_scores.csv as a folder of parts."""
    sinks.write_tables(folder, result.documents, result.similarity_long(), flagged_in_order(result), result.authorship)
    sinks.scores_csv(result.authorship, f"{folder}/ai_scores.csv")


def normalise(found: dict, job_id: str, wall_ms: float | None = None) -> dict:
    """The report in the shape that clients read: file names as doc_a and doc_b, combined as score.
    A long report has no rows; `tables` then names the tables that hold them."""
    times = found.get("benchmark", {}).get("stage_times_ms", {})
    return {
        "job_id": job_id,
        "num_docs": found.get("meta", {}).get("num_docs", len(found.get("documents", []))),
        "documents": [d["filename"] for d in found.get("documents", [])],
        "matrix": found.get("similarity_matrix"),
        "flagged_pairs": [{"doc_a": p["filename_a"], "doc_b": p["filename_b"], "cosine": p["cosine"], "rabin_karp": p["rabin_karp"], "score": p["combined"]} for p in found.get("flagged_pairs", [])],
        "ai_scores": [{"filename": s["filename"], "mean_perplexity": s["mean_perplexity"], "ppl_variance": s["perplexity_variance"], "ai_score": s["ai_score"], "flagged": s["flagged"]} for s in found.get("ai_scores", [])],
        "runtime_ms": times.get("total", wall_ms),
        "speedup": None,
        "meta": found.get("meta", {}),
        "benchmark": found.get("benchmark", {}),
    } | ({"tables": found["tables"]} if "tables" in found else {})


def analyze_folder(spark: SparkSession, config: Config, stopwords_path: str | None = None) -> dict:
    """Reads a folder, runs the analysis, writes the outputs, returns the report; beyond sinks.DENSE_DOCUMENTS
    documents the long form is written and the report has counts alone."""
    documents = readers.from_folder(spark, config.input)
    result = analyze(spark, documents, config, readers.read_stopwords(spark, stopwords_path), readers.read_corpus(spark, config.corpus))
    try:
        counts = run_stages(result)
        dense = counts["documents"] <= sinks.DENSE_DOCUMENTS
        found = report(result, counts) if dense else long_report(result, counts)
        began = time.time()
        if dense:
            sinks.write_report(config.output, found)
        else:
            write_long(config.output, result)
        times = found["benchmark"]["stage_times_ms"]
        times["write_outputs"] = (time.time() - began) * 1000
        times["total"] += times["write_outputs"]
        sinks.write_json(config.output, found)
        return found
    finally:
        result.close()
