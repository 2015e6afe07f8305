"""Scalability experiment over the documents table, written as text files.

Like the published experiments, the input is a folder of text files: the
``documents`` table's text is written as a corpus of ``4 x max cores`` files
(data Spark derives from the table, optionally several copies to reach the
published data size), then ``scripts.experiment`` times, at each core
count, the global count (the Spark program) and the per-word files (the
MapReduce program), and summarises the run log with the engine's own
operators.

Usage: python scripts/scaling.py [sf_dir] [cores,...] [runs] [copies]
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import subprocess
import sys
import tempfile
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def write_corpus(spark, sf_dir: str, out: str, n_files: int, copies: int = 1) -> None:
    """Write the documents' text ``copies`` times as ``n_files`` text files.

    Copies bring the corpus to the published datasets' size (the "toy" set
    has 32.9M words; eight copies of sf0.1 have 32.1M) using only the given
    table; each copy is a plain append of the same derived text.
    """
    from pyspark.sql import functions as F

    from lexitally.sources.tables import read_table

    text = read_table(spark, sf_dir, "documents", ["text"]).select(F.col("text").alias("value"))
    per_copy = max(1, n_files // copies)
    for i in range(copies):
        text.repartition(per_copy).write.mode("overwrite" if i == 0 else "append").text(out)


def prepare_corpus(sf_dir: str, out: str, n_files: int, copies: int = 1) -> None:
    from lexitally.session import build_session

    spark = build_session(f"local[{min(n_files, 8)}]", "lexitally-corpus")
    write_corpus(spark, sf_dir, out, n_files, copies)
    spark.stop()


def corpus_path() -> str:
    return tempfile.mkdtemp(prefix="lexitally-corpus-") + "/documents"


def run_scaling(sf_dir: str, cores: list[int], runs: int = 3, copies: int = 1,
                corpus: str | None = None,
                jobs: tuple[str, ...] = ("count", "wordcount")) -> dict:
    """Time the count per core count; ``corpus`` may be written beforehand
    (``write_corpus``) by a session the caller already has."""
    from scripts.experiment import scaling_run

    if corpus is None:
        corpus = corpus_path()
        subprocess.run([sys.executable, __file__, "--prepare", sf_dir, corpus,
                        str(4 * max(cores)), str(copies)], capture_output=True, text=True,
                       timeout=1800, check=True)
    rows = scaling_run(corpus, cores, runs, dataset="documents", jobs=jobs)
    return {
        "input": f"{sf_dir}/documents.parquet text x{copies} as text files",
        "copies": copies,
        "runs_per_config": runs,
        "words": {("count" if "/" not in r.dataset else r.dataset.split("/", 1)[1]):
                  r.word_count for r in rows},
        "configs": [{"job": "count" if "/" not in r.dataset else r.dataset.split("/", 1)[1],
                     "cores": r.cores, "runtime_s": round(r.avg_runtime_s, 4),
                     "init_s": round(r.avg_init_s, 4),
                     "processing_s": round(r.avg_processing_s, 4),
                     "throughput_words_per_sec": round(r.throughput_words, 1),
                     "throughput_mb_per_sec": round(r.throughput_mb, 3),
                     "speedup": round(r.speedup, 4),
                     "parallel_efficiency": round(r.parallel_efficiency, 4)} for r in rows],
    }


def main(argv) -> None:
    sf_dir = argv[1] if len(argv) > 1 else os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = [int(c) for c in (argv[2] if len(argv) > 2 else "1,2,4,8").split(",")]
    runs = int(argv[3]) if len(argv) > 3 else 3
    copies = int(argv[4]) if len(argv) > 4 else 1
    print(json.dumps(run_scaling(sf_dir, cores, runs, copies)))


if __name__ == "__main__":
    if len(sys.argv) > 1 and sys.argv[1] == "--prepare":
        prepare_corpus(sys.argv[2], sys.argv[3], int(sys.argv[4]), int(sys.argv[5]))
    else:
        main(sys.argv)
