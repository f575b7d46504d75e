"""Pools from the command line: ``python -m rosterlake.cli seed|verify|export POOL ...``."""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rosterlake.operators import views
from rosterlake.session import build_session, ship
from rosterlake.sources import pool as source


def seed(spark: SparkSession, pool: str, files: str, now: int) -> int:
    """Import JSON files (each an array of records, or an object with key ``candidates``) into a folder; the number of records."""
    bodies = source.read_envelopes(spark, files)
    rows = source.ingest(source.unpack(bodies, "file_name", "body"), ["file_name", "record_no"], "record", now)
    kept = [c.split()[0] for c in source.CANDIDATES.split(", ")]
    before = spark.read.parquet(pool).count() if source.exists(spark, pool) else 0
    source.write_pool(rows.select(*kept), pool)
    return spark.read.parquet(pool).count() - before


def verify(spark: SparkSession, pool: str, most: int = 20) -> list[str]:
    """The first lines of the pool, best first: per cent, verdict and name."""
    rows = spark.read.parquet(pool).orderBy(*views.plain_order()).limit(most)
    cards = views.cards(rows, int(time.time())).join(rows.select("id", F.coalesce("score", F.lit(0.0)).alias("s")), "id").orderBy(F.desc("s"), "id")
    return [f"{r.percent_label:>4}  {r.verdict_label:<10}  {r.name}" for r in cards.collect()]


def export(spark: SparkSession, pool: str, where: str) -> None:
    """Every record as a line of JSON, ready to be imported again."""
    source.export(spark.read.parquet(pool)).select("record").write.mode("overwrite").text(where)


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rosterlake")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, more in (("seed", "files"), ("verify", None), ("export", "where")):
        command = commands.add_parser(name)
        command.add_argument("pool")
        if more:
            command.add_argument(more)
    chosen = parser.parse_args(arguments)
    spark = spark or build_session()
    ship(spark)
    if chosen.command == "seed":
        print(f"{seed(spark, chosen.pool, chosen.files, int(time.time()))} records imported")
    elif chosen.command == "verify":
        print("\n".join(verify(spark, chosen.pool)))
    else:
        export(spark, chosen.pool, chosen.where)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
