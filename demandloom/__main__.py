"""Jobs on the command line: `spark-submit -m`-style entry, `python -m demandloom <job> ...`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.operators.registry import CANDIDATE, COMPARED_METRIC
from demandloom.plans.batch import delete_listings, deliver_saved, load_tables, materialize, save_listings
from demandloom.plans.model_jobs import champion_model, promote_models, score_request, train_candidate
from demandloom.schemas import LISTING_CSV, LISTING_VIEW
from demandloom.session import build_session, staged
from demandloom.sources.events import stream_messages
from demandloom.sources.online import merge_online
from demandloom.sources.registry import Registry
from demandloom.sources.snapshots import Store
from demandloom.sources.tables import scan_csv
from demandloom.streaming import stream_materialize
from demandloom.streaming.promotions import registered_scorer, score_by_promotions, with_control


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="demandloom")
    parser.add_argument("--master", default=None)
    jobs = parser.add_subparsers(dest="job", required=True)

    load = jobs.add_parser("load", help="load the CSV files into tables")
    load.add_argument("--data-dir", required=True)
    load.add_argument("--warehouse", required=True)

    build = jobs.add_parser("materialize", help="build features and write both stores")
    build.add_argument("--warehouse", required=True)
    build.add_argument("--offline", required=True)
    build.add_argument("--online", required=True)

    fit = jobs.add_parser("train", help="fit on the offline store and register a candidate")
    fit.add_argument("--offline", required=True)
    fit.add_argument("--registry", required=True)
    fit.add_argument("--model-name", default="demand")

    choose = jobs.add_parser("promote", help="compare candidates with champions")
    choose.add_argument("--registry", required=True)
    choose.add_argument("--model-name", default="demand")
    choose.add_argument("--version", type=int, default=None)
    choose.add_argument("--candidate-alias", default=CANDIDATE)
    choose.add_argument("--metric", default=COMPARED_METRIC)
    choose.add_argument("--events", default=None)

    for name, text in (("save", "save new listings from a CSV file"), ("score", "score listings of a CSV file")):
        job = jobs.add_parser(name, help=text)
        job.add_argument("--input", required=True)
        job.add_argument("--rejects", required=True, help="folder for rows that break a rule")
        if name == "save":
            job.add_argument("--warehouse", required=True)
            job.add_argument("--events", default=None)
        else:
            job.add_argument("--registry", required=True)
            job.add_argument("--model-name", default="demand")
            job.add_argument("--output", required=True)

    remove = jobs.add_parser("delete", help="delete saved listings by id")
    remove.add_argument("--warehouse", required=True)
    remove.add_argument("ids", type=int, nargs="+")

    again = jobs.add_parser("deliver", help="announce saved listings that were not announced")
    again.add_argument("--warehouse", required=True)
    again.add_argument("--events", required=True)

    merge = jobs.add_parser("merge", help="merge the batches of the online store and drop old versions")
    merge.add_argument("--online", required=True)
    merge.add_argument("--keep", type=int, default=2)

    listen = jobs.add_parser("stream-materialize", help="saved-listing messages to online rows")
    listen.add_argument("--messages", required=True)
    listen.add_argument("--online", required=True)
    listen.add_argument("--events", required=True)
    listen.add_argument("--rejects", required=True)
    listen.add_argument("--checkpoint", required=True)
    listen.add_argument("--keep-running", action="store_true")

    serve = jobs.add_parser("stream-score", help="score online rows as they arrive, by the promotions among them")
    serve.add_argument("--rows", required=True, help="folder of feature rows with a time column `at`")
    serve.add_argument("--promotions", required=True)
    serve.add_argument("--registry", required=True)
    serve.add_argument("--model-name", default="demand")
    serve.add_argument("--output", required=True)
    serve.add_argument("--events", default=None)
    serve.add_argument("--checkpoint", required=True)
    serve.add_argument("--keep-running", action="store_true")
    return parser.parse_args(argv)


#: Columns of a listing that has no id yet.
REQUEST = T.StructType([f for f in LISTING_CSV.fields if f.name != LISTING_VIEW.key])


def save(spark: SparkSession, args: argparse.Namespace) -> None:
    """Ids follow the order of the rows in the file."""
    new = scan_csv(spark, args.input, REQUEST).withColumn("request", F.monotonically_increasing_id())
    rows, announced = save_listings(
        spark, args.warehouse, staged(new, "requests"), "request", args.events, args.rejects
    )
    print(f"saved {rows.count()} listings, {'announced' if announced else 'not announced'}")


def score(spark: SparkSession, args: argparse.Namespace) -> None:
    model, version = champion_model(Registry(spark, args.registry), args.model_name)
    scored, rejected = score_request(scan_csv(spark, args.input, REQUEST), model, version)
    scored.write.mode("overwrite").parquet(args.output)
    rejected.write.mode("overwrite").parquet(args.rejects)


def stream_score(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = spark.readStream.schema(spark.read.parquet(args.rows).schema).parquet(args.rows)
    stream = with_control(rows, stream_messages(spark, args.promotions))
    scorer = registered_scorer(Registry(spark, args.registry), args.model_name)
    score_by_promotions(
        stream, args.model_name, scorer, args.output, args.checkpoint, args.events, not args.keep_running
    ).awaitTermination()


def main(argv: list[str] | None = None) -> None:
    args = parse_args(argv)
    spark = build_session(master=args.master)
    if args.job == "load":
        load_tables(spark, args.data_dir, args.warehouse)
    elif args.job == "materialize":
        materialize(spark, args.warehouse, args.offline, args.online)
    elif args.job == "train":
        registry = Registry(spark, args.registry).create()
        version = train_candidate(spark, args.offline, registry, args.model_name)
        print(f"registered version {version}")
    elif args.job == "save":
        save(spark, args)
    elif args.job == "score":
        score(spark, args)
    elif args.job == "delete":
        ids = spark.createDataFrame([(i,) for i in args.ids], f"{LISTING_VIEW.key} long")
        delete_listings(spark, args.warehouse, ids).show(truncate=False)
    elif args.job == "deliver":
        print(f"delivered {deliver_saved(spark, args.warehouse, args.events)} events")
    elif args.job == "merge":
        merge_online(spark, args.online)
        Store(spark, args.online).expire(args.keep)
    elif args.job == "stream-materialize":
        stream_materialize(
            stream_messages(spark, args.messages),
            args.online,
            args.events,
            args.rejects,
            args.checkpoint,
            available_now=not args.keep_running,
        ).awaitTermination()
    elif args.job == "stream-score":
        stream_score(spark, args)
    else:
        promote_models(
            Registry(spark, args.registry),
            args.model_name,
            args.version,
            args.metric,
            args.candidate_alias,
            args.events,
        ).show(truncate=False)


if __name__ == "__main__":
    main()
