"""Command line: python -m veridoc.cli --input FOLDER."""

from __future__ import annotations

import argparse
import json
import sys

from .config import MODES, Config, ConfigError

OK, BAD_ARGUMENTS, BAD_INPUT, BAD_CORPUS = 0, 2, 3, 4


def parser() -> argparse.ArgumentParser:
    d = Config()
    p = argparse.ArgumentParser(prog="veridoc", description="Similarity and authorship of a folder of .txt files")
    p.add_argument("--input", required=True)
    p.add_argument("--corpus", default=None)
    p.add_argument("--out-dir", dest="output", default=d.output)
    p.add_argument("--stopwords", default=None)
    for name, default in (("threads", d.threads), ("bands", d.bands), ("rows", d.rows), ("ngram", d.ngram)):
        p.add_argument(f"--{name}", type=int, default=default)
    p.add_argument("--sim-threshold", type=float, default=d.sim_threshold)
    p.add_argument("--ai-threshold", type=float, default=d.ai_threshold)
    p.add_argument("--mode", choices=MODES, default=d.mode)
    p.add_argument("--benchmark", action="store_true")
    p.add_argument("--verbose", action="store_true")
    return p


def main(arguments: list[str] | None = None, spark=None) -> int:
    try:
        options = vars(parser().parse_args(arguments))
    except SystemExit as stop:
        return OK if stop.code == 0 else BAD_ARGUMENTS
    stopwords = options.pop("stopwords")
    try:
        config = Config(**options)
    except ConfigError as error:
        print(error, file=sys.stderr)
        return BAD_ARGUMENTS
    from pyspark.errors import AnalysisException

    from .plans.analysis import EmptyCorpusError, analyze_folder
    from .session import local_session
    from .sources.readers import SourceError

    spark = spark or local_session(config.threads_used)
    try:
        found = analyze_folder(spark, config, stopwords)
    except EmptyCorpusError as error:
        print(error, file=sys.stderr)
        return BAD_CORPUS
    except (SourceError, AnalysisException, OSError) as error:
        print(error, file=sys.stderr)
        return BAD_INPUT
    pairs = found["benchmark"]["candidate_generation"]
    print(f"documents: {found['meta']['num_docs']}")
    print(f"candidate pairs: {pairs['candidate_pairs']} of {pairs['total_pairs']}")
    print(f"flagged pairs: {pairs['flagged_pairs']}")
    flagged = found["flagged_documents"] if "flagged_documents" in found else sum(s["flagged"] for s in found["ai_scores"])
    print(f"flagged documents: {flagged} of {found['meta']['num_docs']}")
    if config.benchmark:
        print(json.dumps({"threads": config.threads_used, "mode": config.mode} | found["benchmark"]))
    return OK


if __name__ == "__main__":
    sys.exit(main())
