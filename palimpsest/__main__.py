"""`python -m palimpsest COMMAND ...`: extraction, audits, splits, corpora, verification and probes over files.

Versions come from a SQLite file (articles, or sentences with --source), episodes and pairs from folders that `extract` and `pairs`
wrote. Every command writes to a folder that must not be there yet, unless --force is given, and prints a summary as JSON.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import alignment as A
from palimpsest.operators import audit as U
from palimpsest.operators import corpora as C
from palimpsest.operators import metrics as M
from palimpsest.operators import models as L
from palimpsest.operators import projections as J
from palimpsest.operators import selection as S
from palimpsest.operators import splits as P
from palimpsest.operators import verify as V
from palimpsest.session import local_session
from palimpsest.settings import Extraction, names, numbers
from palimpsest.sources import artifacts as R
from palimpsest.sources import publication as B
from palimpsest.sources import tables as T


def versions(spark: SparkSession, args) -> tuple[DataFrame, list]:
    """Versions of the file, of a hash sample of lineages where --articles is given, and their order."""
    tables = T.sqlite_tables(spark, args.database)
    if args.source:
        _, rows = T.discover(tables, T.SENTENCE_ALIASES, T.SENTENCE_REQUIRED, args.table)
        out, order = T.sentence_versions(rows, args.source), ["place", *A.version_order(None, "version_id")]
    else:
        _, rows = T.discover(tables, T.ARTICLE_ALIASES, T.ARTICLE_REQUIRED, args.table)
        out, order = T.article_versions(rows, X.sentence_split), A.version_order("created", "version_id")
    if args.articles:
        keys = S.sample_keys(S.qualifying(out, F.col("lineage_id"), 3).select("lineage_id"), "lineage_id", args.articles, args.seed)
        out = out.join(keys, "lineage_id", "left_semi")
    return out, order


def extract(spark, args) -> dict:
    """[K03] Episodes and their audit."""
    own = Extraction(args.context_before, args.context_after, args.least, args.most, args.low, args.high)
    found, order = versions(spark, args)
    replaced = A.replacements(found, order, **own.arguments())
    A.episodes(replaced, args.seed, args.examples or None).write.parquet(f"{args.output}/episodes")
    audit = U.extraction_audit(found, order, replaced, spark.read.parquet(f"{args.output}/episodes")).first().asDict()
    B.put_json(spark, f"{args.output}/audit.json", audit)
    return audit


def inspect(spark, args) -> dict:
    return {"tables": R.inspected(T.sqlite_tables(spark, args.database))}


def pairs(spark, args) -> dict:
    found, order = versions(spark, args)
    held = spark.read.parquet(args.episodes)
    out = A.temporal_pairs(found, order, held, args.target or None, args.seed)
    out.write.parquet(f"{args.output}/table")
    return B.write_pairs(args.output, spark.read.parquet(f"{args.output}/table"), held, args.target or None, args.seed)


def audit_context(spark, args) -> dict:
    e = J.checked_episodes(spark.read.parquet(args.episodes))
    report = U.context_report(e)
    bands, reuse = U.version_bands(e, "v1_version_id"), U.pair_reuse(e)
    rows = lambda df: [r.asDict() for r in df.collect()]
    return {"context": rows(report)[0], "gates": rows(U.viability_gates(report))[0], "lineages": rows(U.lineage_concentration(e))[0], "pair_reuse": rows(reuse)[0], "version_bands": rows(bands),
            "edit_similarity": rows(U.distribution(e, "edit_similarity"))[0], "warnings": [r["warning"] for r in rows(U.context_warnings(report, bands, reuse)) if r["holds"]]}


def audit_numeric(spark, args) -> dict:
    flags = U.numeric_flags(J.checked_episodes(spark.read.parquet(args.episodes)))
    return {"categories": [r.asDict() for r in U.category_summary(flags).collect()], "trajectories": [r.asDict() for r in U.trajectories(flags).collect()]}


def audit_labels(spark, args) -> dict:
    found, order = versions(spark, args)
    rows = A.episodes(A.replacements(found, order), args.seed)
    return {"rates": U.integrity_rates(rows).first().asDict(), "categories": [r.asDict() for r in U.label_integrity(rows).collect()], "samples": [r.asDict() for r in U.mismatch_sample(rows, args.samples).collect()]}


def splits(spark, args) -> dict:
    stats = P.lineage_stats(U.numeric_flags(spark.read.parquet(args.episodes), "selected_index"))
    buckets = P.greedy_folds(stats, args.folds, args.seed)
    buckets.write.parquet(f"{args.output}/assigned")
    buckets = spark.read.parquet(f"{args.output}/assigned")
    members = P.membership(buckets, args.folds)
    summary = P.partition_summary(members, stats)
    B.write_split(args.output, buckets, members, summary, {"folds": args.folds, "seed": args.seed})
    return {"gates": P.gates(P.balance(summary, stats, args.folds)).first().asDict(), "verification": P.verification(members, stats, args.folds).first().asDict()}


def _members(spark, args) -> tuple[DataFrame, int]:
    settings = B.get_json(spark, f"{args.splits}/settings.json")
    return P.membership(spark.read.parquet(f"{args.splits}/buckets"), settings["folds"]), settings["folds"]


def corpora(spark, args) -> dict:
    (m, folds), e, p = _members(spark, args), spark.read.parquet(args.episodes), spark.read.parquet(args.pairs)
    sizes = p.groupBy("lineage_id").agg(F.count("*").alias("n"))
    records = C.build(e, m, p, P.balanced_buckets(sizes, folds), folds, args.seed)
    T.write_corpora(records, f"{args.output}/records")
    return V.corpora(f"{args.output}/records", e, p, m).first().asDict()


def verify_corpora(spark, args) -> dict:
    (m, _), e, p = _members(spark, args), spark.read.parquet(args.episodes), spark.read.parquet(args.pairs)
    return V.corpora(f"{args.corpora}/records", e, p, m).first().asDict()


def probes(spark, args) -> dict:
    """Probes of arms (columns of vectors by episode_id) over folds, with a report for each arm and fold."""
    rows = J.labelled(spark.read.parquet(args.vectors), J.future_labels(spark.read.parquet(args.episodes)))
    buckets = spark.read.parquet(f"{args.splits}/buckets")
    folds = B.get_json(spark, f"{args.splits}/settings.json")["folds"]
    known = tuple(c for c, kind in rows.dtypes if kind.startswith("array"))
    e = spark.read.parquet(args.episodes).select("episode_id", "lineage_id").join(buckets, "lineage_id")
    data = rows.join(e, "episode_id").select(F.col("episode_id").alias("id"), "lineage_id", F.col("bucket").alias("fold_bucket"), "label", *known)
    done = {}
    for arm in names(args.arms, known):
        out = L.probe(data.select("id", "fold_bucket", arm, "label"), arm, "label", folds).where(F.col("fold").isin(*numbers(args.folds, folds)))
        out.write.parquet(f"{args.output}/{arm}")
        done[arm] = [r.asDict() for r in M.binary_metrics(spark.read.parquet(f"{args.output}/{arm}"), ["fold"]).orderBy("fold").collect()]
    return done


def prompts(spark, args) -> dict:
    asked, answers = J.oracle_prompts(spark.read.parquet(args.episodes), args.size, args.seed)
    T.write_jsonl(asked, f"{args.output}/prompts")
    T.write_jsonl(answers, f"{args.output}/answers")
    return {"items": answers.count()}


def score_prompts(spark, args) -> dict:
    read = lambda p: spark.read.json(p)
    return M.swap_consistency(read(args.original), read(args.swapped), read(args.answers)).first().asDict()


COMMANDS = {
    "inspect": (inspect, ["database"]), "extract": (extract, ["database", "output"]), "pairs": (pairs, ["database", "output", "episodes"]), "audit-context": (audit_context, ["output", "episodes"]),
    "audit-numeric": (audit_numeric, ["output", "episodes"]), "audit-labels": (audit_labels, ["database", "output"]), "splits": (splits, ["output", "episodes"]), "corpora": (corpora, ["output", "episodes", "pairs", "splits"]),
    "verify-corpora": (verify_corpora, ["output", "episodes", "pairs", "splits", "corpora"]), "probes": (probes, ["output", "episodes", "splits", "vectors"]), "prompts": (prompts, ["output", "episodes"]),
    "score-prompts": (score_prompts, ["output", "original", "swapped", "answers"]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    own = top.add_subparsers(dest="command", required=True)
    for name, (_, needed) in COMMANDS.items():
        p = own.add_parser(name)
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        p.add_argument("--force", action="store_true")
        for n, default in (("seed", 17), ("articles", 0), ("examples", 0), ("target", 0), ("size", 300), ("samples", 50), ("context-before", 1), ("context-after", 1), ("least", 20), ("most", 500)):
            p.add_argument(f"--{n}", type=int, default=default)
        for n, default in (("low", 0.15), ("high", 0.98)):
            p.add_argument(f"--{n}", type=float, default=default)
        p.add_argument("--source"), p.add_argument("--table"), p.add_argument("--arms", default="all")
        p.add_argument("--folds", type=str if name == "probes" else int, default="all" if name == "probes" else 10)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parser().parse_args(argv)
    run, needed = COMMANDS[args.command]
    spark = spark or SparkSession.getActiveSession() or local_session()
    if "output" not in needed:
        found = run(spark, args)
    else:

        def fill(folder: str) -> dict:
            args.output = folder
            done = run(spark, args)
            B.put_json(spark, f"{folder}/report.json", json.loads(json.dumps(done, default=str)))
            return done

        found = B.publish(spark, args.output, fill, args.force)
    print(json.dumps(found, default=str, sort_keys=True))
    return found


if __name__ == "__main__":
    main()
