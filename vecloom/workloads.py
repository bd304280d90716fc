"""Verification and benchmark runs of a collection: ``python -m vecloom.workloads verify|bench ...``.

verify --mode recall      exact and index recall against a ground-truth file, and the queries whose exact recall is below 1
verify --mode mutation    a third inserts, a third updates, the rest deletes; every one checked by search
bench --mode search       latency, throughput and recall of single queries
bench --mode write|mix    write latency and throughput, alone or among reads
"""

from __future__ import annotations

import argparse
import json
import math
import random
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import Collection, Database
from .fs import Files, shared_folder
from .operators import evaluate, search
from .sources import vectorfiles
from .types import CollectionSchema, CompactionParams, FieldSchema, FieldType, MetadataSchema, Metric, SegmentParams

META = MetadataSchema((FieldSchema(0, "idx", FieldType.INT64), FieldSchema(1, "label", FieldType.STRING)))


def nearest_rank(samples: Sequence[float], p: float) -> float:
    """The sorted sample at round(p / 100 * (n - 1)), halves up; 0.0 without samples."""
    xs = sorted(samples)
    return xs[math.floor(p / 100 * (len(xs) - 1) + 0.5)] if xs else 0.0


def summary(seconds: Sequence[float], wall: float) -> dict[str, float]:
    ms = [1000 * s for s in seconds]
    return {"n": len(ms), "avg_ms": sum(ms) / len(ms) if ms else 0.0, **{f"p{p}_ms": nearest_rank(ms, p) for p in (50, 95, 99)}, "per_second": len(ms) / wall if wall else 0.0}


def _save(spark: SparkSession, path: str, what: dict) -> None:
    """JSON in place of what the path had, on whatever file system it names."""
    files = Files(spark, path)
    files.delete(path)
    files.publish(path, json.dumps(what))


def opened(spark: SparkSession, args: argparse.Namespace, dimension: int) -> tuple[Collection, bool]:
    """The collection, and whether it was there already; compaction parameters count only with a data folder."""
    base = args.data_dir or shared_folder(spark)
    db = Database(spark, base)
    try:
        return db.collection("work"), True
    except ValueError:
        params = CompactionParams(level_count_multiplier=args.level_count_multiplier) if args.data_dir and args.level_count_multiplier else CompactionParams()
        segments = SegmentParams(m=args.m, ef_construction=args.ef_construction, ef_search=args.ef_search, segment_capacity=args.segment_capacity)
        return db.create_collection(CollectionSchema("work", dimension, Metric.parse(args.metric), segments, params, metadata_schema=META)), False


def loaded(spark: SparkSession, args: argparse.Namespace) -> tuple[Collection, DataFrame]:
    base = vectorfiles.load_vectors(spark, args.base_file)
    c, there = opened(spark, args, len(base.select("vector").first()[0]))
    if not there:
        rows = base.select(F.concat(F.lit("doc_"), F.col("idx")).alias("doc_id"), "vector", "idx")
        c.ingest(rows.limit(args.preload) if getattr(args, "preload", None) else rows)
    return c, base


def verify_recall(spark: SparkSession, args: argparse.Namespace) -> dict:
    c, _ = loaded(spark, args)
    queries = evaluate.query_subset(vectorfiles.load_vectors(spark, args.query_file).withColumnRenamed("idx", "query_id"), args.num_queries, args.seed)
    truth = vectorfiles.load_groundtruth(spark, args.ground_truth_file, args.k)
    if c.manifest.index is None:
        c.build_index(min(64, max(1, c.count() // 40)))
    exact = evaluate.hits_to_ids(c.search_many(queries, args.k)).withColumnRenamed("ids", "exact")
    found = [(r["query_id"], [h.doc_id for h in c.search(list(r["vector"]), args.k, strategy="index")]) for r in queries.collect()]
    index = spark.createDataFrame(found, "query_id long, found array<string>")
    each = truth.join(exact, "query_id").join(index, "query_id").select("query_id", evaluate.recall_at_k(F.col("ids"), F.col("exact"), args.k).alias("exact"), evaluate.recall_at_k(F.col("ids"), F.col("found"), args.k).alias("index")).cache()
    mean = each.agg(F.avg("exact"), F.avg("index")).first()
    low = [r["query_id"] for r in each.where("exact < 1").orderBy("query_id").limit(100).collect()]
    return {"exact_recall": mean[0], "index_recall": mean[1], "exact_below_one": low}


def verify_mutation(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Inserts and updates with vectors of the base file, and deletes, then a search for each vector with k its
    multiplicity: a vector that several documents hold ties with itself, so each of them must be among as many."""
    c, base = loaded(spark, args)
    rng, n = random.Random(args.seed), args.num_mutations
    total = base.count()
    picked = rng.sample(range(total), min(total, n - n // 3))
    taken = [rng.randrange(total) for _ in range(2 * (n // 3))]
    rows = {r["idx"]: list(r["vector"]) for r in base.where(F.col("idx").isin([*picked, *taken])).collect()}  # at most 2 * num_mutations
    updates, deletes = picked[: n // 3], picked[n // 3 :]
    jobs = [("upsert", f"new_doc_{i}", taken[i], {"idx": i, "label": f"insert_{i}"}) for i in range(n // 3)]
    jobs += [("upsert", f"doc_{i}", taken[n // 3 + at], {"idx": i, "label": f"update_{i}"}) for at, i in enumerate(updates)]
    jobs += [("delete", f"doc_{i}", i, None) for i in deletes]

    def one(job: tuple[str, str, int, dict | None]):
        op, d, vector, meta = job
        return c.upsert(d, rows[vector], meta) if op == "upsert" else c.delete(d)

    with ThreadPoolExecutor(max(1, args.concurrency)) as pool:
        tokens = list(pool.map(one, jobs))
    written = {d: (rows[vector], meta) for _, d, vector, meta in jobs}
    if tokens:
        c.wait_visible(max(tokens))
    asked = spark.createDataFrame([(d, [float(x) for x in v]) for d, (v, _) in written.items()], "query_id string, vector array<double>")
    live = c.rows().select("doc_id", F.col("vector").cast("array<double>").alias("vector"), c._shown().alias("metadata")).cache()
    copies = {r["query_id"]: r["n"] for r in asked.select("query_id", F.transform("vector", lambda x: x.cast("float").cast("double")).alias("vector")).join(evaluate.multiplicity(live), "vector", "left").collect()}
    k = max([1, *(x or 1 for x in copies.values())])
    hits: dict[str, list[str]] = {}
    for r in search.nearest_join(asked, live, k, c.schema.metric).orderBy("query_id", "rank").collect():
        hits.setdefault(r["query_id"], []).append(r["id"])
    shown = {r["doc_id"]: c._plain(r["metadata"]) for r in live.where(F.col("doc_id").isin(list(written))).collect()}
    bad = []
    for d, (_, meta) in written.items():
        if meta is None:
            ok = d not in hits.get(d, []) and d not in shown
        else:
            ok = d in hits.get(d, [])[: copies.get(d) or 1] and shown.get(d) == meta
        if not ok:
            bad.append(d)
    return {"checked": len(written), "failed": bad, "passed": not bad}


def bench_search(spark: SparkSession, args: argparse.Namespace) -> dict:
    c, _ = loaded(spark, args)
    queries = evaluate.query_subset(vectorfiles.load_vectors(spark, args.query_file).withColumnRenamed("idx", "query_id"), args.num_queries, args.seed)
    rows = [(r["query_id"], list(r["vector"])) for r in queries.collect()]
    for _, v in rows[: args.warmup_queries]:
        c.search(v, args.k)

    def one(row: tuple[int, list[float]]) -> tuple[int, list[str], float]:
        t = time.time()
        return row[0], [h.doc_id for h in c.search(row[1], args.k)], time.time() - t

    start = time.time()
    with ThreadPoolExecutor(max(1, args.concurrency)) as pool:  # Spark runs the jobs of several threads side by side
        done = list(pool.map(one, rows))
    found = {i: ids for i, ids, _ in done}
    out = {"mode": "search", **summary([s for *_, s in done], time.time() - start)}
    t = time.time()
    c.search_many(queries, args.k).write.format("noop").mode("overwrite").save()
    out["batch_queries_per_second"] = len(rows) / (time.time() - t)
    if not args.no_recall:
        path = args.load_exact_results or (f"{args.data_dir}/exact_results.json" if args.data_dir else None)
        files = Files(spark, path or ".")
        if path and files.exists(path):
            exact = {int(k): v for k, v in json.loads(files.read(path)).items()}
        else:
            exact = {r["query_id"]: list(r["ids"]) for r in evaluate.hits_to_ids(c.search_many(queries, args.k)).collect()}
            save = args.save_exact_results or path
            if save:
                _save(spark, save, exact)
        out["recall"] = sum(len(set(found[i][: args.k]) & set(exact[i][: args.k])) / args.k for i in found) / max(1, len(found))
    return out


def bench_write(spark: SparkSession, args: argparse.Namespace, reads: bool = False) -> dict:
    """Writes (and, with a Bernoulli draw for each operation, reads) of the base file's vectors."""
    c, base = loaded(spark, args)
    n = args.num_ops if reads else args.num_writes
    vectors = [list(r["vector"]) for r in base.orderBy("idx").limit(n).collect()]  # num_ops rows
    asked = [list(r["vector"]) for r in vectorfiles.load_vectors(spark, args.query_file).limit(100).collect()] if reads else []
    rng, first = random.Random(args.seed), c.count()
    took: dict[str, list[float]] = {"read": [], "write": []}
    start, token = time.time(), None
    for i in range(n):
        t = time.time()
        if reads and rng.random() < args.read_write_ratio:
            c.search(asked[i % len(asked)], args.k)
            took["read"].append(time.time() - t)
            continue
        d = f"doc_{rng.randrange(first)}" if args.write_pattern == "update" else f"doc_{first + i}"
        token = c.upsert(d, vectors[i % len(vectors)])
        if args.wait_visible:
            c.wait_visible(token)
        took["write"].append(time.time() - t)
    wall = time.time() - start
    if token:
        c.wait_visible(token)
    return {"mode": "mix" if reads else "write", "operations_per_second": n / wall if wall else 0.0, **{k: summary(v, wall) for k, v in took.items() if v}}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vecloom.workloads")
    sub = p.add_subparsers(dest="command", required=True)
    for name, modes, capacity in (("verify", ("recall", "mutation"), 100_000), ("bench", ("search", "write", "mix"), 500_000)):
        s = sub.add_parser(name)
        s.add_argument("--mode", choices=modes, default=modes[0])
        for flag in ("--base-file", "--query-file", "--ground-truth-file", "--data-dir", "--save-summary", "--save-exact-results", "--load-exact-results"):
            s.add_argument(flag, required=flag == "--base-file")
        for flag, value in (("--k", 10), ("--num-queries", 100), ("--seed", 42), ("--m", 16), ("--ef-construction", 200), ("--ef-search", 50), ("--segment-capacity", capacity), ("--num-mutations", 100), ("--level-count-multiplier", 0), ("--warmup-queries", 10), ("--num-writes", 1000), ("--preload", 0), ("--num-ops", 1000), ("--concurrency", 1)):
            s.add_argument(flag, type=int, default=value)
        s.add_argument("--metric", default="l2")
        s.add_argument("--write-pattern", choices=("append", "update"), default="append")
        s.add_argument("--read-write-ratio", type=float, default=0.8)
        for flag in ("--no-recall", "--wait-visible"):
            s.add_argument(flag, action="store_true")
    return p


def run(spark: SparkSession, argv: Sequence[str]) -> dict:
    args = parser().parse_args(argv)
    if args.command == "verify" and args.mode == "recall" and not (args.query_file and args.ground_truth_file):
        raise ValueError("recall needs --query-file and --ground-truth-file")
    if args.command == "bench":
        if args.mode in ("search", "mix") and not args.query_file:
            raise ValueError(f"--mode {args.mode} needs --query-file")
        if args.mode != "search" and args.write_pattern == "update" and args.preload <= 0:
            raise ValueError("--write-pattern update needs --preload > 0")
        if args.mode == "mix" and not 0 < args.read_write_ratio < 1:
            raise ValueError("--read-write-ratio must lie between 0 and 1")
    jobs = {("verify", "recall"): verify_recall, ("verify", "mutation"): verify_mutation, ("bench", "search"): bench_search, ("bench", "write"): bench_write, ("bench", "mix"): lambda s, a: bench_write(s, a, True)}
    out = jobs[args.command, args.mode](spark, args)
    if args.save_summary:
        _save(spark, args.save_summary, out)
    return out


if __name__ == "__main__":
    import sys

    print(json.dumps(run(SparkSession.builder.getOrCreate(), sys.argv[1:])))
