"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of the test tables; BENCH_CPUS: cores; BENCH_DUCKDB=1 adds the times of the
same results in SQL on the same machine. Each query first runs on the smallest tables, so that
start-up and compilation are not counted.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridprep.session import build_session  # noqa: E402
from suite import registry  # noqa: E402
from suite.fixtures import SPREAD  # noqa: E402

HEADLINE = [
    "grids_job", "surviving_tokens", "pad_center", "augment_fanout", "augment_preview_job",
    "training_table_job", "batches_job", "border_filter", "dominance_filter_docs", "alpha_composite",
    "palette_decode", "vocabulary", "encode_ids", "encode_ids_large_vocab", "chunk_pad", "row_forward_fill",
    "col_position", "sliding_chunks", "tokens_to_grid", "bpe_pairs", "word_pieces", "dense_index", "attach_last",
    "metadata_join", "collate_batches", "inventory_rollup", "chain_stage", "upsert_dedupe", "latest_checkpoint",
    "weighted_nll", "blend_vectors", "sum_vectors", "best_of_n", "allowed_tokens", "row_state", "top_p_filter",
    "negatives", "holdout_split", "token_share", "species_shape",
]


def timed(run):
    started = time.perf_counter()
    run()
    return round(time.perf_counter() - started, 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            SPREAD: cpus,
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = registry.queries(), registry.oracles()
    small = os.path.join(os.path.dirname(os.path.abspath(sf_dir)), "sf0.001")

    def spark_run(name, folder):
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()

    times, sql_times = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        if os.path.isdir(small):
            spark_run(name, small)
        times[name] = timed(lambda: spark_run(name, sf_dir))
        print(name, times[name], file=sys.stderr, flush=True)
    if os.environ.get("BENCH_DUCKDB"):
        from suite.check import connect

        db = connect(sf_dir)
        db.execute(f"SET threads = {cpus}")
        for name in times:
            if name in oracles:
                sql_times[name] = timed(lambda: db.execute(f"CREATE OR REPLACE TEMP TABLE result AS {oracles[name]}"))
                print(name, "sql", sql_times[name], file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }
    if sql_times:
        result["duckdb"] = sql_times
    print(json.dumps(result))


if __name__ == "__main__":
    main()
