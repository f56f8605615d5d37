"""A line shell: PUT key value, GET key, DELETE key, HELP, EXIT.

script() runs a table of lines as one Spark query; main() reads lines and keeps the versions of a session.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The longest line that is read, in bytes.
MAX_LINE = 1 << 20
# What the shell says.
HELP = "commands: PUT <key> <value>, GET <key>, DELETE <key>, HELP, EXIT"
USAGE = {"PUT": "usage: PUT <key> <value>", "GET": "usage: GET <key>", "DELETE": "usage: DELETE <key>"}
ALIASES = {"DEL": "DELETE", "?": "HELP", "QUIT": "EXIT"}


def parsed(lines: DataFrame) -> DataFrame:
    """lines (line_no, line) with verb, key, value and ok (the arity is right). A value keeps its inner spaces."""
    split = lines.select("line_no", F.trim(F.coalesce("line", F.lit(""))).alias("text")).withColumn("words", F.split("text", r"\s+", 3))
    split = split.withColumn("said", F.upper(F.col("words")[0]))
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    value = F.get("words", F.lit(2))
    n = F.when(F.col("text") == "", 0).otherwise(F.size("words"))
    told = split.select("line_no", "text", F.coalesce(F.try_element_at(names, "said"), "said").alias("verb"), F.get("words", F.lit(1)).alias("key"), value.alias("value"), n.alias("n"))
    ok = F.when(F.col("verb") == "PUT", F.col("n") >= 3).when(F.col("verb").isin("GET", "DELETE"), F.col("n") == 2).otherwise(F.lit(True))
    return told.withColumn("ok", ok)


def script(lines: DataFrame) -> DataFrame:
    """(line_no, output) of a whole script; a GET sees the last PUT or DELETE of its key before it. Lines from
    EXIT on and empty lines have no output.
    """
    commands = parsed(lines)
    stop = commands.where("verb = 'EXIT'").agg(F.coalesce(F.min("line_no"), F.lit((1 << 62))).alias("stop"))
    live = commands.where("n > 0").join(F.broadcast(stop), F.col("line_no") < F.col("stop")).drop("stop")  # one row
    before = Window.partitionBy("key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    wrote = F.when(F.col("ok") & F.col("verb").isin("PUT", "DELETE"), F.struct(F.when(F.col("verb") == "PUT", F.col("value")).alias("value")))
    joined = live.withColumn("stored", F.last(wrote, True).over(before)["value"])
    usage = F.col("verb")
    said = (
        F.when(F.col("verb") == "HELP", HELP)
        .when(~F.col("verb").isin("PUT", "GET", "DELETE"), F.concat(F.lit("unknown command: "), F.col("verb"), F.lit(" (try HELP)")))
        .when(~F.col("ok"), F.coalesce(*[F.when(usage == k, v) for k, v in USAGE.items()]))
        .when(F.col("verb") == "GET", F.coalesce("stored", F.lit("(not found)")))
        .otherwise("OK")
    )
    return joined.select("line_no", said.alias("output"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark", description="interactive versioned store")
    parser.add_argument("-dir", default=None, help="folder of the store; none: in memory")
    parser.add_argument("-memtable-size", type=int, default=1000, help="commits that are kept in memory before a flush")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    from .operators.snapshot import get, last_applied_ts
    from .sources.segments import SegmentStore

    schema = "key string, ts bigint, op int, value string"
    store = SegmentStore(spark, args.dir) if args.dir else None
    recent: list[tuple] = []
    ts = last_applied_ts(store.read()) if store and store.manifest() else 0
    for line in sys.stdin:
        if len(line.encode()) > MAX_LINE:
            print("line too long")
            continue
        words = line.split(None, 2)
        verb = ALIASES.get(words[0].upper(), words[0].upper()) if words else ""
        if not verb:
            continue
        if verb == "EXIT":
            break
        if verb == "HELP":
            print(HELP)
        elif verb not in USAGE:
            print(f"unknown command: {verb} (try HELP)")
        elif len(words) != (3 if verb == "PUT" else 2):
            print(USAGE[verb])
        elif verb == "GET":
            rows = spark.createDataFrame(recent, schema)
            if store and store.manifest():
                rows = rows.unionByName(store.read())
            row = get(rows, words[1].strip()).first()
            print(row["value"] if row else "(not found)")
        else:
            ts += 1
            recent.append((words[1].strip(), ts, 1 if verb == "PUT" else 2, words[2].strip() if verb == "PUT" else None))
            print("OK")
            if store and len(recent) >= args.memtable_size:
                store.flush(spark.createDataFrame(recent, schema), ts)
                store.compact(ts)
                recent = []
    if store and recent:
        store.flush(spark.createDataFrame(recent, schema), ts)


if __name__ == "__main__":
    main()
