"""A scan pass: list the folder, diff with the index, read what is new or changed, upsert, drop what is gone."""

import os
import time
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorlake.functions import containers, decode, kernels
from mirrorlake.operators import review
from mirrorlake.sources.catalogue import Catalogue
from mirrorlake.sources.listing import listing
from mirrorlake.sources.shared import shared_dir, stash

OUTCOME = "rel_path string, size_bytes long, mtime_seconds long, outcome string, message string, format string, width int, height int, channels int, dct_hashes binary, ring_stats binary, corners binary, staged string"


@dataclass(frozen=True)
class Summary:
    indexed: int
    removed: int
    not_pictures: int
    failed: int
    unchanged: int


def _prints(rgb, row: dict) -> dict:
    f = kernels.fingerprint(rgb)
    return row | {"outcome": "indexed", "dct_hashes": f["hashes"], "ring_stats": f["rings"].tobytes(), "corners": kernels.pack_corners(f["corners"])}


def look(raw: bytes, row: dict, stage: str) -> dict:
    """Outcome of one file: indexed, not_a_picture, failed, or staged for the image source."""
    fmt = containers.detect(raw[:4096])
    if fmt is None:
        return row | {"outcome": "not_a_picture", "message": "no picture format"}
    row = row | {"format": fmt}
    if containers.is_animated(fmt, raw):
        return row | {"outcome": "not_a_picture", "message": "animated"}
    turned = containers.orientation(raw) in (5, 6, 7, 8)
    try:
        if fmt == "png":
            rgb, channels = decode.png(raw)
            h, w = rgb.shape[:2]
            return _prints(rgb, row | {"width": h if turned else w, "height": w if turned else h, "channels": channels})
        if fmt in ("webp", "heic"):
            return row | {"outcome": "failed", "message": f"no decoder for {fmt}"}
        size, name = None, "tiff"
        if fmt not in ("jpeg", "gif", "tiff"):
            found = containers.preview(raw)
            if not found:
                return row | {"outcome": "failed", "message": "no preview in the raw file"}
            raw, size = found
            name = "jpg"
            inner = containers.jpeg_size(raw)
            size = size if size and (not inner or size[0] * size[1] > inner[0] * inner[1]) else inner
        else:
            name = {"jpeg": "jpg", "gif": "gif", "tiff": "tif"}[fmt]
        path = f"{stage}/{uuid.uuid4().hex}.{name}"
        with open(path, "wb") as f:
            f.write(raw)
        row = row | {"outcome": "staged", "staged": os.path.basename(path), "message": "turned" if turned else ""}
        return row | ({"width": size[0], "height": size[1]} if size else {})
    except Exception as e:  # a broken file is an outcome, not an error of the pass
        return row | {"outcome": "failed", "message": str(e)[:200]}


def outcomes(files: DataFrame) -> DataFrame:
    """files (rel_path, abs_path, size_bytes, mtime_seconds) -> one outcome row each. JPEG, GIF and TIFF bytes
    (for raw files their preview) are put into the shared folder under safe names and decoded by Spark's
    image source, so no list of paths is gathered anywhere."""
    spark = files.sparkSession
    stage = f"{shared_dir(spark)}/mirrorlake/stage-{uuid.uuid4().hex}"
    local = stage.removeprefix("file://")
    os.makedirs(local, exist_ok=True)
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in OUTCOME.split(", ")])

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():  # one file at a time is in memory
                row = {c: r[c] for c in ("rel_path", "size_bytes", "mtime_seconds")}
                try:
                    with open(r["abs_path"], "rb") as f:
                        row = look(f.read(), row, local)
                except OSError as e:
                    row = row | {"outcome": "failed", "message": str(e)[:200]}
                yield pa.RecordBatch.from_pylist([row], schema)

    first = stash(files.mapInArrow(read, OUTCOME), "outcomes")
    waiting = first.where("outcome = 'staged'")
    if waiting.isEmpty():
        return first
    pictures = spark.read.format("image").option("dropInvalid", "true").load(stage).select("image.*").withColumn("staged", F.substring_index("origin", "/", -1))
    rows = waiting.join(pictures.select("staged", F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("n"), "data"), "staged", "left")

    def finish(batches):
        for batch in batches:
            for r in batch.to_pylist():
                row = {c: r[c] for c in ("rel_path", "size_bytes", "mtime_seconds", "format")}
                if r["data"] is None:
                    row = row | {"outcome": "failed", "message": "could not be decoded"}
                else:
                    whole = (r["width"] or r["w"], r["height"] or r["h"])
                    whole = whole[::-1] if r["message"] == "turned" else whole
                    row = _prints(decode.from_image_row(r["data"], r["h"], r["w"], r["n"]), row | {"width": whole[0], "height": whole[1], "channels": r["n"]})
                yield pa.RecordBatch.from_pylist([row], schema)

    decoded = stash(rows.mapInArrow(finish, OUTCOME), "decoded")
    return first.where("outcome != 'staged'").unionByName(decoded)


def scan(spark: SparkSession, root: str, index: str, recurse=True, compare_only=False) -> Summary:
    """Bring the index up to date with the folder; with compare_only just count what would change."""
    catalogue = Catalogue(spark, index)
    there = stash(listing(spark, root, recurse), "listing")
    state = stash(review.scan_diff(there, catalogue.known()), "diff")
    counts = review.diff_counts(state).first()
    if compare_only:
        return Summary(counts.to_index, counts.removed, 0, 0, counts.unchanged)
    if counts.removed:
        catalogue.delete_paths(state.where("state = 'removed'"))
    n = {}
    if counts.to_index:
        todo = there.join(state.where("state in ('new', 'changed')").select("rel_path"), "rel_path", "left_semi")
        found = outcomes(todo)
        now = int(time.time())
        n = {r.outcome: r["count"] for r in found.groupBy("outcome").count().collect()}
        good = found.where("outcome = 'indexed'").withColumn("fingerprint_version", F.lit(review.FINGERPRINT_VERSION).cast("long"))
        if n.get("indexed"):
            catalogue.upsert(good.drop("outcome", "message", "staged"), now)
        if n.get("not_a_picture") or n.get("failed"):
            catalogue.not_pictures(found.where("outcome != 'indexed'").select("rel_path", "size_bytes", "mtime_seconds"), now)
    catalogue.set_meta("last_scan", str(int(time.time())))
    catalogue.set_meta("recurse", "1" if recurse else "0")
    return Summary(n.get("indexed", 0), counts.removed, n.get("not_a_picture", 0), n.get("failed", 0), counts.unchanged)
