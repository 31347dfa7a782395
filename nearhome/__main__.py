"""Command line of the jobs, for spark-submit or ``python -m nearhome``.

    python -m nearhome prepare    --folder /data --models /models
    python -m nearhome stream     --folder /data --models /models --servers host:9092 --checkpoint /chk/similar
    python -m nearhome cosine     --folder /data --models /models --servers host:9092 --checkpoint /chk/cosine
    python -m nearhome store      --folder /data --servers host:9092 --checkpoint /chk/store
    python -m nearhome recommend  --url jdbc:mysql://... --properties db.properties --models /models
    python -m nearhome notify     --url jdbc:mysql://... --properties db.properties --models /models
"""

from __future__ import annotations

import argparse

from nearhome.operators import store
from nearhome.plans import jobs
from nearhome.schemas import OUTPUT_TOPIC
from nearhome.session import build_session, ship_package
from nearhome.sources import kafka
from nearhome.sources.tables import DatabaseTables, FolderTables
from nearhome.streaming import similarity


def read_properties(path: str) -> dict[str, str]:
    """``name = value`` lines, such as user, password and driver; credentials stay out of the command line."""
    with open(path) as lines:
        pairs = (line.split("=", 1) for line in lines if "=" in line and not line.lstrip().startswith("#"))
        return {name.strip(): value.strip() for name, value in pairs}


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="nearhome")
    commands = main.add_subparsers(dest="command", required=True)
    for name in ("prepare", "stream", "cosine", "store", "recommend", "notify"):
        command = commands.add_parser(name)
        place = command.add_mutually_exclusive_group(required=True)
        place.add_argument("--folder", help="shared folder of Parquet tables")
        place.add_argument("--url", help="JDBC address of the database")
        command.add_argument("--properties", help="file with the JDBC properties")
        command.add_argument("--partitions", type=int, default=32, help="parallel ranges of a database scan")
        if name != "store":
            command.add_argument("--models", required=True, help="shared folder of the models")
        if name == "recommend":
            command.add_argument("--by-type", action="store_true", help="score interactions by their type")
        if name in ("stream", "cosine", "store"):
            command.add_argument("--servers", required=True)
            command.add_argument("--starting", choices=kafka.STARTING_OFFSETS, default="earliest")
            command.add_argument("--checkpoint", required=True, help="folder of this query alone")
            command.add_argument("--every", help="trigger interval, such as '10 seconds'")
    return main


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = build_session(f"nearhome-{args.command}")
    ship_package(spark)
    if args.folder:
        tables = FolderTables(spark, args.folder)
    else:
        tables = DatabaseTables(spark, args.url, read_properties(args.properties) if args.properties else {}, args.partitions)
    if args.command == "prepare":
        jobs.prepare_similarity(spark, tables, args.models)
    elif args.command == "recommend":
        jobs.recommend_all(spark, tables, args.models, by_type=args.by_type)
    elif args.command == "notify":
        jobs.notify(spark, tables, args.models)
    elif args.command == "store":
        results = kafka.read_stream(spark, args.servers, OUTPUT_TOPIC, starting=args.starting)
        jobs.store_stream(tables, results, args.checkpoint, every=args.every).awaitTermination()
    elif args.command == "cosine":
        messages = kafka.read_stream(spark, args.servers, starting=args.starting)
        sink = similarity.kafka_sink(args.servers, encode=store.to_cosine_messages)
        jobs.cosine_stream(spark, tables, messages, sink, args.models, args.checkpoint, every=args.every).awaitTermination()
    else:
        messages = kafka.read_stream(spark, args.servers, starting=args.starting)
        sink = similarity.kafka_sink(args.servers)
        jobs.similarity_stream(spark, tables, messages, sink, args.models, args.checkpoint, every=args.every).awaitTermination()


if __name__ == "__main__":
    main()
