"""Incremental diff, review marks, ignored pairs, clean-up plans and row maintenance, as DataFrame joins."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FINGERPRINT_VERSION = 2


def scan_diff(listing: DataFrame, known: DataFrame, version=FINGERPRINT_VERSION) -> DataFrame:
    """listing (rel_path, size_bytes, mtime_seconds) against known (the same, fingerprint_version, not_a_picture)
    -> rel_path, state: new, changed, unchanged or removed. One full outer join."""
    k = known.select("rel_path", F.col("size_bytes").alias("k_size"), F.col("mtime_seconds").alias("k_mtime"), F.coalesce("fingerprint_version", F.lit(-1)).alias("k_version"), F.coalesce("not_a_picture", F.lit(False)).alias("k_not"), F.lit(True).alias("was"))
    rows = listing.select("rel_path", "size_bytes", "mtime_seconds", F.lit(True).alias("there")).join(k, "rel_path", "full_outer")
    fresh = (F.col("size_bytes") == F.col("k_size")) & (F.col("mtime_seconds") == F.col("k_mtime")) & (F.col("k_not") | (F.col("k_version") == version))
    state = F.when(F.col("there").isNull(), "removed").when(F.col("was").isNull(), "new").when(fresh, "unchanged").otherwise("changed")
    return rows.select("rel_path", state.alias("state"))


def diff_counts(diff: DataFrame) -> DataFrame:
    """One row: indexed (new and changed), removed and unchanged."""
    count = lambda *x: F.coalesce(F.sum(F.col("state").isin(*x).cast("long")), F.lit(0))
    return diff.agg(count("new", "changed").alias("to_index"), count("removed").alias("removed"), count("unchanged").alias("unchanged"))


def set_pairs(members: DataFrame) -> DataFrame:
    """All unordered pairs inside each set: set_id, lower, higher. Sets are what one person reviews; for a
    plan over large ones use ignored_sets, which counts instead."""
    a, b = members.select("set_id", F.col("file_id").alias("lower")), members.select("set_id", F.col("file_id").alias("higher"))
    return a.join(b, "set_id").where("lower < higher")


def ignored_sets(members: DataFrame, ignored: DataFrame) -> DataFrame:
    """set_id of the sets of two or more members of which every pair is ignored. The ignored pairs that lie
    inside a set are counted against n (n - 1) / 2, so the pairs of a set are never made."""
    edges = ignored.select(F.least("lower", "higher").alias("lower"), F.greatest("lower", "higher").alias("higher")).where("lower < higher").distinct()
    low = members.select("set_id", F.col("file_id").alias("lower"))
    high = members.select(F.col("set_id").alias("high_set"), F.col("file_id").alias("higher"))
    inside = edges.join(low, "lower").join(high, "higher").where("set_id = high_set").groupBy("set_id").agg(F.count("*").alias("pairs"))
    sizes = members.groupBy("set_id").agg(F.count_distinct("file_id").alias("n"))
    return sizes.join(inside, "set_id").where("n >= 2 and pairs = n * (n - 1) div 2").select("set_id")


def cleanup_plan(members: DataFrame, marks: DataFrame, ignored: DataFrame) -> DataFrame:
    """set_id, file_id, rel_path, size_bytes of what goes: every unmarked member of every set not ignored. A
    set without marks loses all its members."""
    rows = members.join(ignored_sets(members, ignored), "set_id", "left_anti")
    return rows.join(marks.select("file_id").distinct(), "file_id", "left_anti").select("set_id", "file_id", "rel_path", "size_bytes")


def auto_plan(members: DataFrame) -> DataFrame:
    """The plan that keeps only the automatic keeper of each set."""
    return members.where("not auto_keep").select("set_id", "file_id", "rel_path", "size_bytes")


def rebuild_sets(stored: DataFrame, images: DataFrame) -> DataFrame:
    """Stored (set_id, file_id, at) with the images that still exist; sets of fewer than two go."""
    rows = stored.join(images.select("file_id"), "file_id", "left_semi")
    good = rows.groupBy("set_id").agg(F.count("*").alias("n")).where("n >= 2")
    return rows.join(good.select("set_id"), "set_id", "left_semi")


def in_order(stored: DataFrame) -> DataFrame:
    """Stored (set_id, file_id, at) as one row a set in the order it was kept in: at, set_id, file_ids (ascending)."""
    return stored.groupBy("at", "set_id").agg(F.sort_array(F.collect_list("file_id")).alias("file_ids")).orderBy("at", "set_id")


# ---- verbs of a review: each gives the marks or ignored pairs as they are afterwards -------------------


def open_members(members: DataFrame, ignored: DataFrame) -> DataFrame:
    """Members of the sets that are still sets of copies, that is, not wholly ignored."""
    return members.join(ignored_sets(members, ignored), "set_id", "left_anti")


def _pairs_of(members: DataFrame, sets: DataFrame) -> DataFrame:
    return set_pairs(members.join(sets.select("set_id").distinct(), "set_id", "left_semi")).select("lower", "higher")


def ignore_sets(ignored: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """No two pictures of the chosen sets (set_id) are copies: all their pairs are ignored. Marks stay."""
    return insert_or_ignore(ignored, _pairs_of(members, sets))


def unignore_sets(ignored: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    return ignored.join(_pairs_of(members, sets), ["lower", "higher"], "left_anti")


def mark(marks: DataFrame, ids: DataFrame) -> DataFrame:
    return insert_or_ignore(marks.select("file_id"), ids.select("file_id"))


def unmark(marks: DataFrame, ids: DataFrame) -> DataFrame:
    return without(marks.select("file_id"), ids, "file_id")


def toggle(marks: DataFrame, members: DataFrame, ignored: DataFrame, ids: DataFrame) -> DataFrame:
    """The chosen pictures are marked if they were not and else unmarked; those in ignored sets, or in none, stay."""
    moved = open_members(members, ignored).select("file_id").join(ids.select("file_id"), "file_id", "left_semi").distinct()
    marks = marks.select("file_id").distinct()
    return marks.join(moved, "file_id", "left_anti").union(moved.join(marks, "file_id", "left_anti"))


def keep_only(marks: DataFrame, members: DataFrame, ignored: DataFrame, ids: DataFrame) -> DataFrame:
    """The chosen pictures become all that their sets keep; ignored sets stay as they are."""
    chosen = open_members(members, ignored).join(ids.select("file_id").distinct(), "file_id", "left_semi")
    off = members.join(chosen.select("set_id").distinct(), "set_id", "left_semi")
    return mark(unmark(marks, off), chosen)


def keep_all_of(marks: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    return mark(marks, members.join(sets.select("set_id").distinct(), "set_id", "left_semi"))


def keep_none_of(marks: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    return unmark(marks, members.join(sets.select("set_id").distinct(), "set_id", "left_semi"))


def mark_everything(marks: DataFrame, members: DataFrame, ignored: DataFrame) -> DataFrame:
    return mark(marks, open_members(members, ignored))


def unmark_everything(marks: DataFrame, members: DataFrame, ignored: DataFrame) -> DataFrame:
    return unmark(marks, open_members(members, ignored))


def auto_mark(marks: DataFrame, members: DataFrame, ignored: DataFrame) -> DataFrame:
    """The keeper of every set that is not ignored is marked besides what is."""
    return mark(marks, open_members(members, ignored).where("auto_keep"))


def take_up_the_marks(members: DataFrame, marks: DataFrame) -> DataFrame:
    """(set_id, file_id) of the members that earlier marks name; a mark whose picture is in no set is passed by."""
    return members.select("set_id", "file_id").join(marks.select("file_id"), "file_id", "left_semi").select("set_id", "file_id")


def forget_members(members: DataFrame, marks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and marks (set_id, file_id) without the files (rel_path) that are gone; a set of one is none."""
    left = without(members, gone)
    many = left.groupBy("set_id").agg(F.count("*").alias("n")).where("n > 1").select("set_id")
    left = left.join(many, "set_id", "left_semi")
    return left, marks.join(left.select("set_id", "file_id"), ["set_id", "file_id"], "left_semi")


def walk(members: DataFrame, ignored: DataFrame, file_id: int, ahead=True, by_set=False) -> DataFrame:
    """Where a cursor key leads from a picture: no row at either end, else set_id and file_id. Members stand by age
    and path in their set, sets by set_id; sets that are ignored are stepped over. by_set keeps the place in the
    set, or the last one of any shorter set on the way. Aggregates only, so no task sees all sets."""
    order = [F.col("mtime_seconds"), F.col("rel_path"), F.col("file_id")]
    here = members.where(F.col("file_id") == file_id).select("set_id").first()
    if here is None:
        return members.select("set_id", "file_id").limit(0)
    own = [r.file_id for r in members.where(F.col("set_id") == here.set_id).orderBy(*order).select("file_id").collect()]  # one set
    place = own.index(file_id)
    sizes = members.groupBy("set_id").agg(F.count("*").alias("n"))
    shut = ignored_sets(members, ignored)
    alone = shut.where(F.col("set_id") == here.set_id).isEmpty()
    if not by_set and alone and 0 <= place + (1 if ahead else -1) < len(own):
        return members.where(F.col("file_id") == own[place + (1 if ahead else -1)]).select("set_id", "file_id")
    beyond = F.col("set_id") > here.set_id if ahead else F.col("set_id") < here.set_id
    nearest = sizes.where(beyond).join(shut, "set_id", "left_anti").agg((F.min if ahead else F.max)("set_id").alias("s")).first().s
    if nearest is None:
        return members.select("set_id", "file_id").limit(0)
    if by_set:
        least = sizes.where(F.col("set_id").between(*sorted((here.set_id + (1 if ahead else -1), nearest)))).agg(F.min("n").alias("n")).first().n
        at = min(place, least - 1)
    else:
        at = 0 if ahead else sizes.where(F.col("set_id") == nearest).first().n - 1
    there = members.where(F.col("set_id") == nearest).select("set_id", "file_id", F.row_number().over(Window.partitionBy("set_id").orderBy(*order)).alias("place"))
    return there.where(F.col("place") == at + 1).select("set_id", "file_id")


def without(rows: DataFrame, gone: DataFrame, key="rel_path") -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Delete file ids from files and from all that refers to them."""
    ids = gone.select("file_id").distinct()
    out = {}
    for name, rows in tables.items():
        for column in [c for c in ("file_id", "id", "lower", "higher") if c in rows.columns]:
            rows = rows.join(ids.withColumnRenamed("file_id", column), column, "left_anti")
        out[name] = rows
    return out


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of new replace those of old with the same key; columns in keep (such as an id) stay as in old."""
    stay = old.join(new.select(*key), key, "left_anti")
    if keep:
        held = old.select(*key, *[F.col(c).alias(f"__{c}") for c in keep])
        new = new.join(held, key, "left")
        new = reduce(lambda df, c: df.withColumn(c, F.coalesce(F.col(f"__{c}"), F.col(c))).drop(f"__{c}"), keep, new)
    return stay.unionByName(new.select(*old.columns))


def insert_or_ignore(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).distinct()


def recoverable(members: DataFrame) -> DataFrame:
    """One row: sets, members, duplicates (members less sets) and recoverable bytes."""
    return members.agg(
        F.count_distinct("set_id").alias("n_sets"), F.count("*").alias("n_members"), (F.count("*") - F.count_distinct("set_id")).alias("duplicates"), F.coalesce(F.sum(F.when(~F.col("auto_keep"), F.col("size_bytes"))), F.lit(0)).alias("recoverable_bytes")
    )
