"""Sinks: the matrix, the authorship scores and the report. Numbers are formatted as C's printf does."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_field

DENSE_DOCUMENTS = 2000
TABLES = ("documents", "similarity", "flagged_pairs", "ai_scores")


def matrix_lines(names: list[str], cells: dict[tuple[int, int], float]) -> Iterable[str]:
    yield ",".join(["document", *map(csv_field, names)])
    for i, name in enumerate(names):
        yield ",".join([csv_field(name), *(f"{cells.get((i, j), 1.0 if i == j else 0.0):.3f}" for j in range(len(names)))])


def score_lines(scores: Iterable) -> Iterable[str]:
    yield "filename,mean_perplexity,ppl_variance,ai_score,flagged"
    for s in scores:
        yield f"{csv_field(s['filename'])},{s['mean_perplexity']:.3f},{s['perplexity_variance']:.3f},{s['ai_score']:.3f},{'true' if s['flagged'] else 'false'}"


def _write(path: str, lines: Iterable[str]) -> None:
    with open(path, "w", encoding="utf-8", newline="") as file:
        file.writelines(f"{line}\n" for line in lines)


def write_report(folder: str, report: dict) -> dict[str, str]:
    """similarity_matrix.csv, ai_scores.csv and report.json of a report of few documents."""
    os.makedirs(folder, exist_ok=True)
    names = [d["filename"] for d in report["documents"]]
    paths = {k: os.path.join(folder, v) for k, v in (("matrix", "similarity_matrix.csv"), ("scores", "ai_scores.csv"), ("report", "report.json"))}
    cells = {(i, j): v for i, row in enumerate(report["similarity_matrix"]) for j, v in enumerate(row)}
    _write(paths["matrix"], matrix_lines(names, cells))
    _write(paths["scores"], score_lines(report["ai_scores"]))
    write_json(folder, report)
    return paths


def write_json(folder: str, report: dict) -> None:
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "report.json"), "w", encoding="utf-8") as file:
        file.write(report_json(report))


class _Fixed(float):
    """A number written with so many digits."""

    digits = 6

    def __repr__(self):
        return f"{float(self):.{self.digits}f}"


class _Short(_Fixed):
    digits = 3


def report_json(report: dict) -> str:
    """Matrix cells and times with three digits, scores with six."""

    def shaped(value, digits):
        if isinstance(value, dict):
            return {k: shaped(v, _Short if k in ("similarity_matrix", "stage_times_ms") else digits) for k, v in value.items()}
        if isinstance(value, list):
            return [shaped(v, digits) for v in value]
        return digits(value) if isinstance(value, float) else value

    return _dump(shaped(report, _Fixed))


def _dump(value, indent: str = "") -> str:
    inner = indent + "  "
    if isinstance(value, dict):
        return "{\n" + ",\n".join(f"{inner}{json.dumps(k)}: {_dump(v, inner)}" for k, v in value.items()) + f"\n{indent}}}" if value else "{}"
    if isinstance(value, list):
        if value and isinstance(value[0], (dict, list)):
            return "[\n" + ",\n".join(inner + _dump(v, inner) for v in value) + f"\n{indent}]"
        return "[" + ", ".join(_dump(v, inner) for v in value) + "]"
    return repr(value) if isinstance(value, _Fixed) else json.dumps(value, ensure_ascii=False)


def write_tables(folder: str, documents: DataFrame, long: DataFrame, flagged: DataFrame, scores: DataFrame) -> None:
    """The results of any number of documents as Parquet, the matrix in its long form, written in parallel."""
    for name, df in zip(TABLES, (documents.drop("text"), long, flagged, scores)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_folder(texts: DataFrame, folder: str) -> int:
    """A file for each row of (filename, text) in a folder that all executors see; null texts make empty files. Returns
    the number of files."""
    pafs.FileSystem.from_uri(folder)[0].create_dir(pafs.FileSystem.from_uri(folder)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, text in zip(batch.column("filename").to_pylist(), batch.column("text").to_pylist()):
                with store.open_output_stream(f"{place}/{name}") as file:
                    file.write((text or "").encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return texts.select("filename", "text").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def scores_csv(scores: DataFrame, path: str) -> None:
    """ai_scores.csv of any number of documents, as a folder of parts."""
    text = lambda c: F.format_string("%.3f", c)
    scores.select("filename", text(F.col("mean_perplexity")).alias("mean_perplexity"), text(F.col("perplexity_variance")).alias("ppl_variance"), text(F.col("ai_score")).alias("ai_score"), "flagged").write.option("header", True).option("quote", '"').option("escape", '"').mode("overwrite").csv(path)
