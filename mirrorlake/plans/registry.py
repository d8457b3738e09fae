"""Named queries over the driver's tables, each with the DuckDB SQL that must give the same rows.

The driver's tables hold no pictures, so roles are played by others: an embedding is an 8x8 block of
coefficients (near copies are planted by mirroring every tenth), a document is a picture file whose
facts derive from its id and length, equal texts are duplicate sets."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorlake.functions import dates, hashing, paths
from mirrorlake.operators import corners, matching, review
from mirrorlake.operators.components import components

LIMIT_BITS = 9
MIRRORED = 1000000


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- roles -------------------------------------------------------------------------------------------


def _blocks(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("block"))
    mirror = F.transform("block", lambda x, i: F.when(i % 2 == 1, -x).otherwise(x))
    return e.union(e.where("vec_id % 10 = 0").select(F.col("vec_id") + MIRRORED, mirror))


def _hashes(blocks):
    every = F.array(*[hashing.variant_hash("block", v) for v in range(8)])
    return blocks.select("vec_id", F.posexplode(every).alias("variant", "hash"))


def _files(spark, d):
    """Documents as picture files."""
    doc = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, ("jpg", "png", "webp", "TIFF"))), (doc % 4 + 1).cast("int"))
    mark = F.element_at(F.array(*map(F.lit, (" - Copy", "", "(1)", "_2", "copy of "))), (doc % 5 + 1).cast("int"))
    path = F.concat("source", F.when(doc % 3 == 0, "/Downloads/").when(doc % 3 == 1, "/").otherwise("/new folder/"), F.lit("doc"), doc.cast("string"), mark, F.lit("."), ext)
    return _t(spark, d, "documents").select(
        doc.alias("file_id"), path.alias("rel_path"), (100 + F.col("n_chars") % 1900).cast("int").alias("width"), (100 + F.expr("n_chars div 7") % 1100).cast("int").alias("height"),
        paths.format_of(path).alias("format"), (1 + doc % 4).cast("int").alias("channels"), (F.col("n_chars") * (1 + doc % 3)).alias("size_bytes"), (1600000000 + doc * 7919 % 1000003).alias("mtime_seconds"), "text",
    )


_FILES = """files AS (SELECT doc_id AS file_id,
  source || CASE doc_id % 3 WHEN 0 THEN '/Downloads/' WHEN 1 THEN '/' ELSE '/new folder/' END || 'doc' || doc_id::VARCHAR
    || [' - Copy', '', '(1)', '_2', 'copy of '][(doc_id % 5 + 1)::INT] || '.' || ['jpg', 'png', 'webp', 'TIFF'][(doc_id % 4 + 1)::INT] AS rel_path,
  (100 + n_chars % 1900)::INT AS width, (100 + (n_chars // 7) % 1100)::INT AS height,
  ['jpeg', 'png', 'webp', 'tiff'][(doc_id % 4 + 1)::INT] AS format, (1 + doc_id % 4)::INT AS channels,
  n_chars * (1 + doc_id % 3) AS size_bytes, 1600000000 + doc_id * 7919 % 1000003 AS mtime_seconds, text FROM documents)"""


def _members(spark, d):
    """Members of the sets of equal texts, ranked."""
    f = _files(spark, d).withColumn("k", F.sha2("text", 256))
    sets = f.groupBy("k").agg(F.min("file_id").alias("set_id"), F.count("*").alias("n")).where("n > 1")
    return matching.rank(f.join(sets, "k").drop("k", "text", "n"))


_SCORE = """log2(greatest(width::DOUBLE * height::DOUBLE, 1.0)) + CASE WHEN format IN ('jpeg', 'webp', 'heic') THEN 0.0 ELSE 0.30 END
  - least(greatest(size_bytes, 0)::DOUBLE / greatest(width::DOUBLE * height::DOUBLE, 1.0), 8.0) / 8.0 * 0.20
  + CASE WHEN channels >= 3 THEN 0.15 ELSE 0.0 END + CASE WHEN channels IN (2, 4) THEN 0.08 ELSE 0.0 END
  - (least(0.05 * (contains(stem, ' - copy')::INT + contains(stem, ' copy')::INT + contains(stem, 'copy of ')::INT + contains(stem, '-copy')::INT
      + contains(stem, '_copy')::INT + contains(stem, '(1)')::INT + contains(stem, '(2)')::INT + contains(stem, '(3)')::INT + starts_with(stem, '~')::INT
      + regexp_matches(stem, '[_-][0-9]+$')::INT + contains(low, '/copy/')::INT + contains(low, '/new folder')::INT + contains(low, '/downloads/')::INT), 0.15)
    + least(length(rel_path) * 0.0005, 0.05))"""

_SCORED = f"""{_FILES},
named AS (SELECT *, lower(rel_path) AS low, regexp_replace(regexp_replace(lower(rel_path), '^.*/', ''), '[.][^.]*$', '') AS stem FROM files),
scored AS (SELECT *, ({_SCORE})::DOUBLE AS score FROM named)"""

_MEMBERS = f"""{_SCORED},
sets AS (SELECT text, min(file_id) AS set_id FROM scored GROUP BY text HAVING count(*) > 1),
members AS (SELECT s.set_id, f.*, row_number() OVER (PARTITION BY s.set_id ORDER BY round(score, 9) DESC, mtime_seconds, rel_path, file_id) = 1 AS auto_keep
  FROM scored f JOIN sets s USING (text))"""

_BLOCKS = f"""blocks AS (SELECT vec_id, embedding::DOUBLE[] AS block FROM embeddings
  UNION ALL SELECT vec_id + {MIRRORED}, list_transform(range(0, 64), lambda i: CASE WHEN i % 2 = 1 THEN -embedding[i + 1]::DOUBLE ELSE embedding[i + 1]::DOUBLE END) FROM embeddings WHERE vec_id % 10 = 0)"""

_HASHES = f"""{_BLOCKS},
variants AS (SELECT vec_id, block, unnest(range(0, 8)) AS variant FROM blocks),
moved AS (SELECT vec_id, variant, list_transform(range(1, 64), lambda i:
    (CASE WHEN variant & 4 > 0 THEN block[(i % 8) * 8 + i // 8 + 1] ELSE block[i + 1] END)
    * (CASE WHEN variant & 1 > 0 AND (i % 8) % 2 = 1 THEN -1 ELSE 1 END) * (CASE WHEN variant & 2 > 0 AND (i // 8) % 2 = 1 THEN -1 ELSE 1 END)) AS m FROM variants),
middle AS (SELECT *, list_sort(m)[32] AS mid FROM moved),
hashes AS (SELECT vec_id, variant::INT AS variant, list_sum(list_transform(range(0, 63), lambda k: CASE WHEN m[k + 1] > mid THEN (1::BIGINT << k::INT) ELSE 0 END))::BIGINT AS hash FROM middle)"""

_INDEX = f"""{_HASHES},
idx AS (SELECT vec_id, variant, band::INT AS band, ((hash >> (16 * band)::INT) & 65535)::INT AS value FROM (SELECT *, unnest(range(0, 4)) AS band FROM hashes))"""

_PAIRS = f"""{_INDEX},
pairs AS (SELECT DISTINCT least(a.vec_id, b.vec_id) AS lo, greatest(a.vec_id, b.vec_id) AS hi
  FROM idx a JOIN idx b ON a.band = b.band AND a.value = b.value AND a.vec_id <> b.vec_id WHERE a.variant = 0)"""

_VERIFIED = f"""{_PAIRS},
verified AS (SELECT lo, hi, min(bit_count(xor(a.hash, b.hash)))::INT AS distance FROM pairs JOIN hashes a ON a.vec_id = lo JOIN hashes b ON b.vec_id = hi AND b.variant = 0
  GROUP BY lo, hi HAVING min(bit_count(xor(a.hash, b.hash))) <= {LIMIT_BITS})"""

_Q: dict = {}
_O: dict = {}


def _query(sql=None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _O[f.__name__] = sql
        return f

    return add


# ---- signatures and search ---------------------------------------------------------------------------


@_query(f"WITH {_HASHES} SELECT vec_id, variant, hash FROM hashes")
def variant_hashes(spark, d):
    return _hashes(_blocks(spark, d))


@_query(f"WITH {_INDEX} SELECT vec_id, variant, band, value FROM idx")
def band_index(spark, d):
    return matching.band_index(_hashes(_blocks(spark, d)), "vec_id")


@_query(f"WITH {_INDEX} SELECT band, value, count(*)::BIGINT AS n FROM idx GROUP BY band, value")
def band_bucket_counts(spark, d):
    return band_index(spark, d).groupBy("band", "value").agg(F.count("*").alias("n"))


@_query(f"WITH {_PAIRS} SELECT lo, hi FROM pairs")
def band_candidates(spark, d):
    return matching.band_pairs(band_index(spark, d), "vec_id")


@_query(f"WITH {_VERIFIED} SELECT lo, hi, distance FROM verified")
def hamming_verify(spark, d):
    hashes = _hashes(_blocks(spark, d))
    pairs = matching.band_pairs(matching.band_index(hashes, "vec_id"), "vec_id")
    low = hashes.select(F.col("vec_id").alias("lo"), F.col("hash").alias("a"))
    high = hashes.where("variant = 0").select(F.col("vec_id").alias("hi"), F.col("hash").alias("b"))
    both = pairs.join(low, "lo").join(high, "hi").groupBy("lo", "hi").agg(F.min(hashing.hamming("a", "b")).alias("distance"))
    return both.where(F.col("distance") <= LIMIT_BITS)


@_query(f"""WITH {_VERIFIED},
weighted AS (SELECT vec_id, list_transform(range(0, 64), lambda i: block[i + 1] * CASE WHEN i % 4 IN (1, 2) THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END) AS w FROM blocks)
SELECT lo, hi, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.w[i] - b.w[i]) * (a.w[i] - b.w[i]))) / 64), 6)::DOUBLE AS distance
FROM verified JOIN weighted a ON a.vec_id = lo JOIN weighted b ON b.vec_id = hi""")
def ring_distance_pairs(spark, d):
    pairs = hamming_verify(spark, d).drop("distance")
    w = _blocks(spark, d).select("vec_id", hashing.ring_weighted("block").alias("w"))
    rows = pairs.join(w.select(F.col("vec_id").alias("lo"), F.col("w").alias("a")), "lo").join(w.select(F.col("vec_id").alias("hi"), F.col("w").alias("b")), "hi")
    return rows.select("lo", "hi", F.round(hashing.ring_distance("a", "b"), 6).alias("distance"))


@_query(f"""WITH RECURSIVE {_VERIFIED},
edges AS (SELECT lo AS a, hi AS b FROM verified UNION SELECT hi, lo FROM verified),
reach(node, other) AS (SELECT a, b FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT node AS vec_id, least(node, min(other)) AS set_id FROM reach GROUP BY node""")
def match_components(spark, d):
    edges = hamming_verify(spark, d).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    return components(edges, "match").select(F.col("node").alias("vec_id"), F.col("root").alias("set_id"))


@_query(f"""WITH RECURSIVE {_VERIFIED},
edges AS (SELECT lo AS a, hi AS b FROM verified UNION SELECT hi, lo FROM verified),
reach(node, other) AS (SELECT a, b FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
roots AS (SELECT node, least(node, min(other)) AS set_id FROM reach GROUP BY node)
SELECT set_id, node AS file_id, (row_number() OVER (PARTITION BY set_id ORDER BY node DESC) = 1) AS auto_keep FROM roots""")
def duplicate_sets(spark, d):
    """Flagship: hashes, bands, verification, components and a keeper (the largest picture: the mirror is given more pixels)."""
    named = match_components(spark, d)
    shown = named.select(
        F.col("vec_id").alias("file_id"), "set_id", F.concat(F.lit("v/"), F.lpad(F.col("vec_id").cast("string"), 12, "0"), F.lit(".png")).alias("rel_path"), (F.col("vec_id") + 1).cast("int").alias("width"),
        F.lit(64).alias("height"), F.lit("png").alias("format"), F.lit(3).alias("channels"), F.lit(0).cast("long").alias("size_bytes"), F.lit(0).cast("long").alias("mtime_seconds"),
    )
    return matching.rank(shown).select("set_id", "file_id", "auto_keep")


@_query(f"""WITH {_FILES} SELECT a.file_id AS lo, b.file_id AS hi FROM files a JOIN files b ON b.file_id = a.file_id + 1
WHERE abs(greatest(a.width, a.height)::DOUBLE / least(a.width, a.height) - greatest(b.width, b.height)::DOUBLE / least(b.width, b.height))
  / greatest(greatest(a.width, a.height)::DOUBLE / least(a.width, a.height), greatest(b.width, b.height)::DOUBLE / least(b.width, b.height)) < 0.06""")
def aspect_filter(spark, d):
    f = _files(spark, d)
    a, b = f.select(F.col("file_id").alias("lo"), F.col("width").alias("w1"), F.col("height").alias("h1")), f.select(F.col("file_id").alias("hi"), F.col("width").alias("w2"), F.col("height").alias("h2"))
    return a.join(b, F.col("hi") == F.col("lo") + 1).where(paths.aspect_ok("w1", "h1", "w2", "h2")).select("lo", "hi")


@_query("SELECT min(doc_id) AS representative, count(*)::BIGINT AS copies FROM documents GROUP BY text")
def fold_identical(spark, d):
    f = _files(spark, d).select("file_id", F.sha2("text", 256).alias("k"))
    return f.groupBy("k").agg(F.min("file_id").alias("representative"), F.count("*").alias("copies")).drop("k")


@_query(
    "WITH n AS (SELECT greatest(1, count(*) * 8) AS filed FROM documents), b AS (SELECT filed, least(20, greatest(6, ceil(log2(greatest(1, filed // 96)))))::INT AS bits FROM n),\n"
    "r AS (SELECT bits, greatest(1, filed >> bits) * 32 AS most FROM b),\n"
    "c AS (SELECT doc_id, p AS place, md5(CASE WHEN p < 6 THEN (length(text) % 97)::VARCHAR || '/' || p::VARCHAR ELSE doc_id::VARCHAR || '/' || p::VARCHAR END) AS h FROM (SELECT doc_id, text, unnest(range(0, 8)) AS p FROM documents)),\n"
    "w AS (SELECT doc_id, place, [('0x' || substr(h, 2, 15))::BIGINT, ('0x' || substr(h, 18, 15))::BIGINT] AS words FROM c),\n"
    "k AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, place, words, {t} AS t, (" + " + ".join(f"CASE WHEN {i} < bits THEN ((words[{b // 64 + 1}] >> {b % 64}) & 1) * {1 << i} ELSE 0 END" for i, b in enumerate(row)) + ")::INT AS key FROM w, r"
        for t, row in enumerate(corners.sampled_bits(120, 4))
    )
    + "),\n"
    "g AS (SELECT t, key FROM k, r GROUP BY t, key, most HAVING count(*) <= most), f AS (SELECT k.* FROM k JOIN g USING (t, key)),\n"
    "x AS (SELECT DISTINCT a.doc_id AS asker, b.doc_id AS other, a.place FROM f a JOIN f b ON a.t = b.t AND a.key = b.key AND a.doc_id <> b.doc_id\n"
    "  WHERE bit_count(xor(a.words[1], b.words[1])) + bit_count(xor(a.words[2], b.words[2])) <= 24)\n"
    "SELECT DISTINCT least(asker, other) AS lo, greatest(asker, other) AS hi FROM (SELECT asker, other FROM x GROUP BY asker, other HAVING count(DISTINCT place) >= 3)"
)
def corner_bucket_candidates(spark, d):
    """Each document shows 8 made-up descriptors of 120 bits, 6 of them shared by texts of equal length mod 97."""
    p = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("place")
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("file_id"), (F.length("text") % 97).cast("string").alias("n"), p)
    h = F.md5(F.concat(F.when(F.col("place") < 6, F.col("n")).otherwise(F.col("file_id").cast("string")), F.lit("/"), F.col("place").cast("string")))
    word = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("long")
    rows = rows.withColumn("h", h).select("file_id", "place", F.array(word(2), word(18)).alias("words"))
    return corners.bucket_pairs(rows, *corners.bucket_rule(rows.count()), total=120, tables=4)


# ---- files, scores and sets --------------------------------------------------------------------------


@_query(f"WITH {_SCORED} SELECT file_id, round(score, 9)::DOUBLE AS score FROM scored")
def keep_score(spark, d):
    return _files(spark, d).select("file_id", F.round(paths.keep_score(), 9).alias("score"))


@_query(f"WITH {_MEMBERS} SELECT set_id, file_id FROM members WHERE auto_keep")
def keeper_per_set(spark, d):
    return _members(spark, d).where("auto_keep").select("set_id", "file_id")


@_query(f"""WITH {_MEMBERS} SELECT set_id, CASE WHEN auto_keep THEN 'keep' ELSE 'remove' END AS keep,
CASE WHEN regexp_matches(rel_path, '[,"\n]') THEN '"' || replace(rel_path, '"', '""') || '"' ELSE rel_path END AS path, width, height, format, size_bytes FROM members""")
def duplicate_sets_report(spark, d):
    keep = F.when(F.col("auto_keep"), "keep").otherwise("remove")
    return _members(spark, d).select("set_id", keep.alias("keep"), paths.csv_field("rel_path").alias("path"), "width", "height", "format", "size_bytes")


@_query(f"WITH {_MEMBERS} SELECT set_id, sum(CASE WHEN auto_keep THEN 0 ELSE size_bytes END)::BIGINT AS recoverable_bytes, string_agg(file_id::VARCHAR, ',' ORDER BY mtime_seconds, rel_path) AS members FROM members GROUP BY set_id")
def nested_sets(spark, d):
    return matching.nested(_members(spark, d)).select("set_id", "recoverable_bytes", F.array_join(F.transform("members", lambda m: m["file_id"].cast("string")), ",").alias("members"))


@_query(f"WITH {_MEMBERS} SELECT count(DISTINCT set_id)::BIGINT AS n_sets, count(*)::BIGINT AS n_members, (count(*) - count(DISTINCT set_id))::BIGINT AS duplicates, sum(CASE WHEN auto_keep THEN 0 ELSE size_bytes END)::BIGINT AS recoverable_bytes FROM members")
def recoverable_bytes(spark, d):
    return review.recoverable(_members(spark, d))


@_query("""WITH f AS (SELECT doc_id AS file_id, 'd' || (doc_id % 2)::VARCHAR AS folder, text FROM documents),
g AS (SELECT text, folder, min(file_id) AS set_id FROM f GROUP BY ALL HAVING count(*) > 1) SELECT folder, set_id, file_id FROM f JOIN g USING (text, folder)""")
def within_folder_sets(spark, d):
    path = F.concat(F.lit("d"), (F.col("doc_id") % 2).cast("string"), F.lit("/x"), F.col("doc_id").cast("string"))
    f = _t(spark, d, "documents").select(F.col("doc_id").alias("file_id"), paths.folder_of(path).alias("folder"), F.sha2("text", 256).alias("k"))
    sets = f.groupBy("folder", "k").agg(F.min("file_id").alias("set_id"), F.count("*").alias("n")).where("n > 1")
    return f.join(sets, ["folder", "k"]).select("folder", "set_id", "file_id")


# ---- diff, review and clean-up -----------------------------------------------------------------------

_DIFF = f"""{_FILES},
listing AS (SELECT rel_path, size_bytes + CASE WHEN file_id % 7 = 0 THEN 1 ELSE 0 END AS size_bytes, mtime_seconds FROM files WHERE file_id % 10 <> 1),
known AS (SELECT rel_path, size_bytes, mtime_seconds, CASE WHEN file_id % 11 = 0 THEN 1 ELSE 2 END AS version, file_id % 13 = 0 AS not_a_picture FROM files WHERE file_id % 10 <> 0),
diff AS (SELECT rel_path, CASE WHEN l.rel_path IS NULL THEN 'removed' WHEN k.rel_path IS NULL THEN 'new'
  WHEN l.size_bytes = k.size_bytes AND l.mtime_seconds = k.mtime_seconds AND (k.not_a_picture OR k.version = 2) THEN 'unchanged' ELSE 'changed' END AS state
  FROM listing l FULL JOIN known k USING (rel_path))"""


def _diff(spark, d):
    f = _files(spark, d)
    listing = f.where("file_id % 10 <> 1").withColumn("size_bytes", F.col("size_bytes") + F.when(F.col("file_id") % 7 == 0, 1).otherwise(0))
    known = f.where("file_id % 10 <> 0").withColumn("fingerprint_version", F.when(F.col("file_id") % 11 == 0, 1).otherwise(2)).withColumn("not_a_picture", F.col("file_id") % 13 == 0)
    return review.scan_diff(listing, known)


@_query(f"WITH {_DIFF} SELECT rel_path, state FROM diff")
def scan_diff(spark, d):
    return _diff(spark, d)


@_query(f"WITH {_DIFF} SELECT count(*) FILTER (state IN ('new', 'changed'))::BIGINT AS to_index, count(*) FILTER (state = 'removed')::BIGINT AS removed, count(*) FILTER (state = 'unchanged')::BIGINT AS unchanged FROM diff")
def compare_only(spark, d):
    return review.diff_counts(_diff(spark, d))


_IGNORED = f"""{_MEMBERS},
every AS (SELECT a.set_id, a.file_id AS lower, b.file_id AS higher FROM members a JOIN members b ON a.set_id = b.set_id AND a.file_id < b.file_id),
ignored AS (SELECT DISTINCT lower, higher FROM every WHERE set_id % 3 = 0 AND NOT (set_id % 2 = 0 AND (lower + higher) % 5 = 0)),
gone AS (SELECT set_id FROM every LEFT JOIN ignored i USING (lower, higher) GROUP BY set_id HAVING bool_and(i.lower IS NOT NULL))"""


def _ignored(members):
    return review.set_pairs(members).where("set_id % 3 = 0 and not (set_id % 2 = 0 and (lower + higher) % 5 = 0)").select("lower", "higher")


@_query(f"WITH {_IGNORED} SELECT set_id FROM gone")
def ignored_sets(spark, d):
    m = _members(spark, d)
    return review.ignored_sets(m, _ignored(m))


@_query(f"WITH {_IGNORED} SELECT set_id, file_id, rel_path, size_bytes FROM members WHERE set_id NOT IN (SELECT set_id FROM gone) AND NOT (auto_keep AND set_id % 4 <> 0)")
def cleanup_plan(spark, d):
    """Keepers are marked in sets not divisible by four; the others have no mark and lose every member."""
    m = _members(spark, d)
    return review.cleanup_plan(m, m.where("auto_keep and set_id % 4 <> 0"), _ignored(m))


@_query(f"WITH {_MEMBERS} SELECT set_id, file_id, rel_path, size_bytes FROM members WHERE NOT auto_keep")
def auto_plan(spark, d):
    return review.auto_plan(_members(spark, d))


@_query("SELECT 'labels' AS tbl, doc_id FROM labels WHERE doc_id % 10 <> 3 UNION ALL SELECT 'files', doc_id FROM documents WHERE doc_id % 10 <> 3")
def cascade_delete(spark, d):
    files, labels = _t(spark, d, "documents").select(F.col("doc_id").alias("id")), _t(spark, d, "labels").select(F.col("doc_id").alias("file_id"))
    left = review.cascade_delete({"files": files, "labels": labels}, files.where("id % 10 = 3").select(F.col("id").alias("file_id")))
    return left["labels"].select(F.lit("labels").alias("tbl"), F.col("file_id").alias("doc_id")).union(left["files"].select(F.lit("files"), "id"))


@_query(f"""WITH {_MEMBERS}, s AS (SELECT set_id, file_id FROM members WHERE file_id % 5 <> 2), n AS (SELECT set_id FROM s GROUP BY set_id HAVING count(*) >= 2)
SELECT set_id, file_id FROM s WHERE set_id IN (SELECT set_id FROM n)""")
def stored_sets_rebuild(spark, d):
    return review.rebuild_sets(_members(spark, d).select("set_id", "file_id"), _files(spark, d).where("file_id % 5 <> 2"))


@_query(f"""WITH {_FILES} SELECT file_id AS id, rel_path, size_bytes FROM files WHERE file_id % 2 = 0 AND file_id % 3 <> 0
UNION ALL SELECT CASE WHEN file_id % 2 = 0 THEN file_id ELSE file_id + 5000000 END, rel_path, size_bytes + 7 FROM files WHERE file_id % 3 = 0""")
def upsert_merge(spark, d):
    f = _files(spark, d).select(F.col("file_id").alias("id"), "rel_path", "size_bytes")
    new = f.where("id % 3 = 0").select((F.col("id") + 5000000).alias("id"), "rel_path", (F.col("size_bytes") + 7).alias("size_bytes"))
    return review.upsert(f.where("id % 2 = 0"), new, ["rel_path"], keep=("id",))


# ---- scalars -----------------------------------------------------------------------------------------


@_query("""SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, regexp_replace(regexp_replace(url, '^.*/', ''), '[.][^.]*$', '') AS stem,
lower(regexp_extract(regexp_replace(url, '^.*/', ''), '[.]([^.]*)$', 1)) AS ext, regexp_matches(regexp_replace(regexp_replace(url, '^.*/', ''), '[.][^.]*$', ''), '[_-][0-9]+$') AS numbered FROM pages""")
def path_scalars(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", paths.folder_of("url").alias("folder"), paths.stem(u).alias("stem"), paths.extension(u).alias("ext"), paths.has_copy_number(paths.stem(u)).alias("numbered"))


@_query("""SELECT event_id, strftime(make_timestamp((floor(epoch(ts))::BIGINT - 1700000000 * (event_id % 2)) * 1000000), '%Y-%m-%d %H:%M') AS shown, floor(epoch(ts))::BIGINT AS seconds FROM events""")
def mtime_render(spark, d):
    s = dates.whole_seconds(F.to_timestamp_ltz(F.col("ts").cast("string")))
    return _t(spark, d, "events").select("event_id", dates.file_date(s - 1700000000 * (F.col("event_id") % 2)).alias("shown"), s.alias("seconds"))


@_query("""WITH x AS (SELECT event_id, ts, extract(hour FROM ts) AS h FROM events)
SELECT event_id, ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'][month(ts)] || ' ' || day(ts)::VARCHAR || ', ' || year(ts)::VARCHAR
  || ', ' || (CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END)::VARCHAR || strftime(ts, ':%M:%S') || CASE WHEN h < 12 THEN ' am' ELSE ' pm' END AS said FROM x""")
def said_plainly(spark, d):
    return _t(spark, d, "events").select("event_id", dates.said_plainly(F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).alias("said"))


# ---- kernels (rows only; tests hold their results) ----------------------------------------------------


def _picture(words, side=96):
    """A picture of overlapping grey boxes drawn by a sequence that the 64 numbers start."""
    import numpy as np

    draw = np.random.default_rng(np.frombuffer(np.array(words, np.float32).tobytes(), np.uint32))
    out = np.full((side, side), 128, np.uint8)
    for y, x, h, w, grey in zip(*(draw.integers(lo, hi, side * side // 160) for lo, hi in ((0, side), (0, side), (6, side // 3), (6, side // 3), (20, 236))), strict=True):
        out[y : y + h, x : x + w] = grey
    return np.repeat(out[..., None], 3, 2)


@_query()
def image_scan(spark, d):
    """A PNG is made of every embedding and goes through detection, decoding and fingerprinting."""
    import pyarrow as pa

    def run(batches):
        from mirrorlake.functions.decode import write_png
        from mirrorlake.plans.scan import look

        for batch in batches:
            for r in batch.to_pylist():
                got = look(write_png(_picture(r["embedding"])), {"vec_id": r["vec_id"]}, "")
                row = {"vec_id": r["vec_id"], "outcome": got["outcome"], "format": got["format"], "width": got["width"], "height": got["height"], "dct_hashes": got["dct_hashes"].hex(), "n_corners": len(got["corners"]) // 36}
                yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([("vec_id", pa.int64()), ("outcome", pa.string()), ("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("dct_hashes", pa.string()), ("n_corners", pa.int32())])
    return _t(spark, d, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, outcome string, format string, width int, height int, dct_hashes string, n_corners int")


@_query()
def corner_agreement(spark, d):
    """Agreeing corners of a picture made of every embedding with a shifted crop of it, and with its negative.
    A row takes tens of milliseconds and a few hundred bytes, so rows are dealt out evenly first."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        from mirrorlake.functions import kernels

        def corners(gray):
            places, bits = kernels.feature_arrays(gray)
            return places.astype(np.float32), bits.view("<u8")

        for batch in batches:
            crop, negative = [], []
            for embedding in batch.column(1).to_pylist():
                gray = kernels.luma(_picture(embedding, 160))
                whole = corners(gray)
                crop.append(kernels.agreement(whole, corners(gray[12:, 20:])))
                negative.append(kernels.agreement(whole, corners(255 - gray)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crop, pa.int32()), pa.array(negative, pa.int32())], ["vec_id", "crop", "negative"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return _t(spark, d, "embeddings").select("vec_id", "embedding").repartition(parts).mapInArrow(run, "vec_id long, crop int, negative int")


def queries():
    from . import index_queries

    return {**_Q, **index_queries.queries()}


def oracle_sql():
    from . import index_queries

    return {**_O, **index_queries.oracle_sql()}
