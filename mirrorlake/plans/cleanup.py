"""Applying a plan to files, and reports. Every removal is tried; failures are rows, not errors."""

import contextlib
import os
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorlake.functions.paths import csv_field

HEADER = "set_id,keep,path,width,height,format,size_bytes"


def apply_plan(plan: DataFrame, root: str, to="trash", target: str | None = None) -> DataFrame:
    """Remove the files of a plan (set_id, file_id, rel_path, size_bytes) by tasks: rel_path, size_bytes, message
    (null where it worked). to: delete, or move to target keeping relative paths; trash moves to root/.Trash."""
    target = target or os.path.join(root, ".Trash")

    def run(batches):
        for pdf in batches:
            said = []
            for rel in pdf.rel_path:
                try:
                    here, goal = os.path.join(root, rel), os.path.join(target, rel)
                    # a task that is run again finds its work done
                    if to == "delete":
                        with contextlib.suppress(FileNotFoundError):
                            os.remove(here)
                    elif os.path.exists(here) or not os.path.exists(goal):
                        os.makedirs(os.path.dirname(goal), exist_ok=True)
                        shutil.move(here, goal)
                    said.append(None)
                except OSError as e:
                    said.append(str(e))
            yield pdf[["rel_path", "size_bytes"]].assign(message=said)

    from mirrorlake.sources.shared import stash

    return stash(plan.select("rel_path", "size_bytes").mapInPandas(run, "rel_path string, size_bytes long, message string"), "removed")


def forget(catalogue, done: DataFrame) -> int:
    """Drop the rows of the files that are gone; rewrite the index only if there were any."""
    n = catalogue.delete_paths(done.where("message is null"))
    if n:
        catalogue.compact()
    return n


def describe(plan: DataFrame) -> str:
    r = plan.agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b")).first()
    return f"{r.n} files, {r.b / 1e6:.1f} MB"


def plan_lines(plan: DataFrame) -> DataFrame:
    """The list that is read before a plan is confirmed: a path a line, for write.text."""
    return plan.select(F.col("rel_path").alias("value"))


def csv_lines(members: DataFrame) -> DataFrame:
    """One line a member, largest gain first, oldest member first within a set."""
    gain = members.groupBy("set_id").agg(F.sum(F.when(~F.col("auto_keep"), F.col("size_bytes")).otherwise(0)).alias("gain"))
    cols = [F.col("set_id").cast("string"), F.when(F.col("auto_keep"), "keep").otherwise("remove"), csv_field("rel_path"), *[F.col(c).cast("string") for c in ("width", "height", "format", "size_bytes")]]
    return members.join(gain, "set_id").orderBy(F.desc("gain"), "set_id", "mtime_seconds", "rel_path").select(F.concat_ws(",", *cols).alias("value"))


def json_lines(members: DataFrame) -> DataFrame:
    """One JSON object a set in column value, largest gain first; for write.text, or a report piece by piece."""
    from mirrorlake.operators.matching import nested

    rows = nested(members).orderBy(F.desc("recoverable_bytes"), "set_id")
    return rows.select(F.to_json(F.struct("set_id", "recoverable_bytes", "members")).alias("value"))


def json_report(members: DataFrame, out) -> None:
    """The sets as one JSON array, written to a stream with one partition of it in memory at a time."""
    out.write("[")
    for k, r in enumerate(json_lines(members).toLocalIterator()):
        out.write((",\n" if k else "\n") + r.value)
    out.write("\n]\n")
