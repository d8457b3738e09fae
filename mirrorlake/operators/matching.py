"""The search: band shortlist, verification, components, sets with a keeper.

signatures has file_id, hashes (array of 8 variants, each an array of four 64-bit words), rings (weighted
colour signature, array<float>), width, height and what sets show (rel_path, format, channels, size_bytes,
mtime_seconds); corners (array of structs x, y, descriptor binary) where corner matching is on."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirrorlake.functions import hashing, paths

from .components import components

HASH_BITS = 255
#: Percent of bits for the named strictnesses.
PRESETS = {"close": 5, "balanced": 15, "wide": 30, "yolo": 50}


@dataclass(frozen=True)
class Thresholds:
    max_bits: int = HASH_BITS * 15 // 100
    max_ring: float = 0.075
    ignore_colour: bool = False
    whole_frame: bool = True
    corners: bool = False
    within_a_folder: bool = False

    @classmethod
    def at(cls, percent: float, **more) -> "Thresholds":
        percent = min(50.0, max(0.0, percent))
        return cls(max_bits=int(HASH_BITS * percent / 100), max_ring=max(0.005 * percent, 0.005), **more)

    @classmethod
    def preset(cls, name: str, **more) -> "Thresholds":
        return cls.at(PRESETS.get(name, 15), **more)


def fold_identical(signatures: DataFrame, within_a_folder=False) -> DataFrame:
    """Rows with equal hashes, rings and size become one family under its least id: file_id, representative.
    The families are found by one aggregate, which combines before it shuffles."""
    key = [F.to_json(F.struct("hashes", "rings")).alias("k"), "width", "height"]
    key += [paths.folder_of("rel_path").alias("folder")] if within_a_folder else []
    rows = signatures.select("file_id", F.sha2(key[0], 256).alias("k"), *key[1:])
    names = ["k", "width", "height"] + (["folder"] if within_a_folder else [])
    return rows.join(rows.groupBy(*names).agg(F.min("file_id").alias("representative")), names).select("file_id", "representative")


def band_index(hashes: DataFrame, id_col="file_id", width=16, total=64, word="hash") -> DataFrame:
    """(id, variant, band, value) for rows (id, variant, word)."""
    return hashes.select(id_col, "variant", F.posexplode(hashing.bands(word, width, total)).alias("band", "value"))


def band_pairs(index: DataFrame, id_col="file_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (lo, hi) that share a band: variant 0 of one side against all variants of the other."""
    probe = index.where("variant = 0").select(F.col(id_col).alias("a"), "band", "value", *extra).distinct()
    build = index.select(F.col(id_col).alias("b"), "band", "value", *extra).distinct()
    pairs = probe.join(build, ["band", "value", *extra]).where("a != b")
    return pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()


def _exploded(signatures: DataFrame, within: bool) -> DataFrame:
    rows = signatures.select("file_id", *([paths.folder_of("rel_path").alias("folder")] if within else []), F.posexplode("hashes").alias("variant", "words"))
    words = F.flatten(F.array(*[hashing.bands(F.col("words")[k], 16, 64) for k in range(4)]))
    return rows.select("file_id", *(["folder"] if within else []), "variant", F.posexplode(words).alias("band", "value"))


def candidates(signatures: DataFrame, t: Thresholds) -> DataFrame:
    """Shortlist of pairs (lo, hi) of folded representatives."""
    out = None
    if t.whole_frame:
        extra = ("folder",) if t.within_a_folder else ()
        out = band_pairs(_exploded(signatures, t.within_a_folder), extra=extra)
    if t.corners:
        from .corners import corner_pairs

        more = corner_pairs(signatures, within_a_folder=t.within_a_folder)
        out = more if out is None else out.unionByName(more).distinct()
    return out if out is not None else signatures.select(F.col("file_id").alias("lo"), F.col("file_id").alias("hi")).limit(0)


def verify(pairs: DataFrame, signatures: DataFrame, t: Thresholds) -> DataFrame:
    """Pairs that match: whole frames by shape, hash and colour; else, where corners are on, by agreement.
    The cheap test runs first; only its complement goes through the corner kernel."""
    keep = ["hashes", "rings", "width", "height", "rel_path"] + (["corners"] if t.corners else [])
    side = lambda s, x: s.select(F.col("file_id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in keep])
    rows = pairs.join(side(signatures, "lo"), "lo").join(side(signatures, "hi"), "hi")
    if t.within_a_folder:
        rows = rows.where(paths.folder_of("lo_rel_path") == paths.folder_of("hi_rel_path"))
    whole = F.lit(False)
    if t.whole_frame:
        whole = paths.aspect_ok("lo_width", "lo_height", "hi_width", "hi_height")
        whole &= hashing.hamming_any(F.col("lo_hashes"), F.col("hi_hashes")[0]) <= t.max_bits
        if not t.ignore_colour:
            whole &= hashing.ring_distance("lo_rings", "hi_rings").cast("float") <= F.lit(t.max_ring).cast("float")
    rows = rows.withColumn("whole", F.coalesce(whole, F.lit(False)))
    found = rows.where("whole").select("lo", "hi")
    if t.corners:
        from .corners import agreeing

        found = found.union(agreeing(rows.where("not whole").select("lo", "hi", "lo_corners", "hi_corners")))
    return found


def rank(members: DataFrame) -> DataFrame:
    """set_id and member columns -> with score and auto_keep: the best by score, then age, then path."""
    best = Window.partitionBy("set_id").orderBy(F.desc("score"), "mtime_seconds", "rel_path", "file_id")
    return members.withColumn("score", paths.keep_score()).withColumn("auto_keep", F.row_number().over(best) == 1)


def find_sets(signatures: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Members of all duplicate sets: set_id (least file id), member columns, score and auto_keep."""
    family = fold_identical(signatures, t.within_a_folder)
    one = signatures.join(family.where("file_id = representative").select("file_id"), "file_id")
    links = verify(candidates(one, t), one, t).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    links = links.union(family.where("file_id != representative").select("file_id", "representative"))
    named = components(links, "sets").select(F.col("node").alias("file_id"), F.col("root").alias("set_id"))
    shown = ["file_id", "rel_path", "width", "height", "format", "channels", "size_bytes", "mtime_seconds"]
    return rank(named.join(signatures.select(*shown), "file_id"))


def nested(members: DataFrame) -> DataFrame:
    """set_id, members (oldest first) and recoverable_bytes."""
    shown = ["mtime_seconds", "rel_path", "file_id", "width", "height", "format", "channels", "size_bytes", "auto_keep"]
    return members.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("members"), F.sum(F.when(~F.col("auto_keep"), F.col("size_bytes")).otherwise(0)).alias("recoverable_bytes"))
