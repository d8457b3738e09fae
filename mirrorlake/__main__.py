"""python -m mirrorlake report|clean FOLDER: find duplicate pictures and, if asked, clean them up."""

import argparse
import sys


def main(args=None) -> int:
    p = argparse.ArgumentParser(prog="mirrorlake")
    p.add_argument("verb", choices=("report", "clean"))
    p.add_argument("folder")
    p.add_argument("--db")
    p.add_argument("--format", choices=("json", "csv"), default="json")
    p.add_argument("--strictness", choices=("close", "balanced", "wide", "yolo"), default="balanced")
    p.add_argument("--sensitivity", type=float)
    p.add_argument("--ignore-colour", action="store_true")
    p.add_argument("--corners", action="store_true")
    p.add_argument("--within-a-folder", action="store_true")
    p.add_argument("--apply", action="store_true")
    p.add_argument("--to", choices=("trash", "move", "delete"), default="trash")
    p.add_argument("--move-dir")
    a = p.parse_args(args)
    if a.to == "move" and not a.move_dir:
        p.error("--to move needs --move-dir")

    from pyspark.sql import SparkSession

    from mirrorlake.operators.matching import Thresholds, find_sets
    from mirrorlake.operators.review import auto_plan
    from mirrorlake.plans import cleanup
    from mirrorlake.plans.scan import scan
    from mirrorlake.sources.catalogue import Catalogue
    from mirrorlake.sources.shared import stash

    spark = SparkSession.builder.appName("mirrorlake").getOrCreate()
    index = a.db or f"{a.folder}/.mirrorlake"
    scan(spark, a.folder, index)
    more = {"ignore_colour": a.ignore_colour, "corners": a.corners, "within_a_folder": a.within_a_folder}
    t = Thresholds.at(a.sensitivity, **more) if a.sensitivity is not None else Thresholds.preset(a.strictness, **more)
    members = stash(find_sets(stash(Catalogue(spark, index).signatures(), "signatures"), t), "members")
    if a.verb == "report":
        if a.format == "csv":
            print(cleanup.HEADER)
            for r in cleanup.csv_lines(members).toLocalIterator():
                print(r.value)
        else:
            cleanup.json_report(members, sys.stdout)
        return 0
    plan = stash(auto_plan(members), "plan")
    for r in cleanup.plan_lines(plan).toLocalIterator():
        print(r.value)
    print(cleanup.describe(plan))
    if a.apply:
        done = cleanup.apply_plan(plan, a.folder, a.to, a.move_dir)
        cleanup.forget(Catalogue(spark, index), done)
        failed = 0
        for r in done.where("message is not null").toLocalIterator():
            failed = 1
            print(f"{r.rel_path}: {r.message}")
        return failed
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
