"""Queries over an index, a review and the whole search, each with its DuckDB SQL; registry.py adds them to its own.

Documents play picture files as in registry.py. Fingerprints of the index are made of the texts' digests. Signatures
of the search are made of the embeddings: four blocks of coefficients, of which every tenth picture has a mirror
image and every fifteenth an exact copy."""

import uuid

from pyspark.sql import functions as F

from mirrorlake.functions import hashing, paths, texts
from mirrorlake.operators import matching, review
from mirrorlake.plans import cleanup, notes
from mirrorlake.sources import migrate, sqlite
from mirrorlake.sources.catalogue import SCHEMAS, Catalogue
from mirrorlake.sources.shared import shared_dir, stash

from . import registry as r

COPIED = 2 * r.MIRRORED

_Q: dict = {}
_O: dict = {}


def _query(sql=None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _O[f.__name__] = sql
        return f

    return add


# ---- the index ---------------------------------------------------------------------------------------


def _records(spark, d):
    f = r._files(spark, d)
    digest = F.sha2("text", 256)
    return f.select(
        "rel_path", "size_bytes", "mtime_seconds", "width", "height", "format", F.col("channels"), F.when(F.col("file_id") % 11 == 0, 1).otherwise(2).cast("long").alias("fingerprint_version"),
        F.unhex(F.repeat(digest, F.lit(8))).alias("dct_hashes"), F.unhex(F.repeat(digest, F.lit(6))).alias("ring_stats"), F.unhex(F.lit("")).alias("corners"), "file_id",
    )


def _index(spark) -> Catalogue:
    return Catalogue(spark, f"{shared_dir(spark)}/mirrorlake/index-{uuid.uuid4().hex}")


def _filled(spark, d, where="true") -> Catalogue:
    c = _index(spark)
    c.upsert(_records(spark, d).where(where), 1)
    return c


@_query(f"""WITH {r._FILES} SELECT rel_path, size_bytes, mtime_seconds, CASE WHEN file_id % 3 = 0 THEN -1 WHEN file_id % 11 = 0 THEN 1 ELSE 2 END::BIGINT AS fingerprint_version, file_id % 3 = 0 AS not_a_picture FROM files""")
def index_known(spark, d):
    """Pictures and rejected files as the next scan sees them; a rejected one has no fingerprint left."""
    c = _filled(spark, d)
    c.not_pictures(_records(spark, d).where("file_id % 3 = 0"), 2)
    return c.known().select("rel_path", "size_bytes", "mtime_seconds", "fingerprint_version", "not_a_picture")


@_query(f"""WITH {r._FILES} SELECT rel_path, size_bytes + CASE WHEN file_id % 4 = 0 THEN 9 ELSE 0 END AS size_bytes, CASE WHEN file_id % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS last_scanned_at, CASE WHEN file_id % 5 = 0 THEN file_id % 4 <> 0 ELSE true END AS id_stays FROM files""")
def index_upsert(spark, d):
    """Known paths keep their ids when they are read again; new ones get fresh ids."""
    c = _filled(spark, d, "file_id % 4 <> 0 or file_id % 5 <> 0")
    before = stash(c.table("files").select("rel_path", F.col("id").alias("was")), "before")
    c.upsert(_records(spark, d).where("file_id % 4 = 0").withColumn("size_bytes", F.col("size_bytes") + 9), 2)
    after = c.table("files").join(before, "rel_path", "left")
    return after.select("rel_path", "size_bytes", "last_scanned_at", F.coalesce(F.col("id") == F.col("was"), F.lit(False)).alias("id_stays"))


@_query(f"WITH {r._FILES} SELECT rel_path, width, height, format, channels, size_bytes, mtime_seconds FROM files WHERE file_id % 3 <> 0 AND file_id % 10 <> 7")
def indexed_images(spark, d):
    """Files with a picture and a fingerprint, after some were rejected and some deleted."""
    c = _filled(spark, d)
    c.not_pictures(_records(spark, d).where("file_id % 3 = 0"), 2)
    c.delete_paths(r._files(spark, d).where("file_id % 10 = 7"))
    return c.indexed_images().select("rel_path", "width", "height", "format", "channels", "size_bytes", "mtime_seconds")


@_query("""SELECT * FROM (SELECT 'files' AS what, count(*)::BIGINT AS n FROM documents WHERE doc_id % 10 <> 7 UNION ALL SELECT 'pictures', count(*) FROM documents WHERE doc_id % 10 <> 7 AND doc_id % 3 <> 0
UNION ALL SELECT 'removed', count(*) FROM documents WHERE doc_id % 10 = 7 UNION ALL SELECT 'images', count(*) FROM documents WHERE doc_id % 10 <> 7 AND doc_id % 3 <> 0 UNION ALL SELECT 'fingerprints', count(*) FROM documents WHERE doc_id % 10 <> 7 AND doc_id % 3 <> 0)""")
def index_counts(spark, d):
    c = _filled(spark, d)
    c.not_pictures(_records(spark, d).where("file_id % 3 = 0"), 2)
    gone = c.delete_paths(r._files(spark, d).where("file_id % 10 = 7"))
    rows = [("files", c.count_files()), ("pictures", c.count_pictures()), ("removed", gone), ("images", c.table("images").count()), ("fingerprints", c.table("fingerprints").count())]
    return spark.createDataFrame(rows, "what string, n long")


@_query("SELECT * FROM (VALUES ('recurse', '0'), ('percent', '12.5')) t(key, value)")
def index_meta(spark, d):
    """Set, set again and forget; what was forgotten is not the same as off."""
    c = _index(spark)
    for key, value in (("recurse", "1"), ("percent", "12.5"), ("corners", "1"), ("recurse", "0")):
        c.set_meta(key, value)
    c.forget_meta("corners")
    assert c.meta("corners") is None and c.meta("recurse") == "0"
    return c.table("meta")


@_query("SELECT * FROM (VALUES ('corners', true), ('ignore_colour', false), ('keep_index', true), ('recurse', true), ('whole_frame', true), ('within_a_folder', true)) t(flag, value)")
def index_notes(spark, d):
    """Settings written after a search and read back; flags that were never noted are absent."""
    c = _index(spark)
    notes.Notes(recurse=True, within_a_folder=True, ignore_colour=False, whole_frame=True, corners=True, keep_index=True, percent=15.0).sound().write(c)
    held = notes.Notes.read(c)
    return spark.createDataFrame([(k, getattr(held, k)) for k in notes.FLAGS if getattr(held, k) is not None and k not in ("auto_rescan", "auto_mark")], "flag string, value boolean")


_PAIRED = f"""{r._MEMBERS}, every AS (SELECT a.set_id, a.file_id AS lower, b.file_id AS higher FROM members a JOIN members b ON a.set_id = b.set_id AND a.file_id < b.file_id)"""


@_query(f"WITH {_PAIRED} SELECT lower, higher FROM every WHERE set_id % 2 = 0 AND NOT (lower + higher) % 5 = 0")
def ignored_pairs(spark, d):
    """Pairs ignored twice, once the other way round, and some taken back."""
    c, pairs = _index(spark), review.set_pairs(r._members(spark, d))
    c.ignore(pairs.where("set_id % 2 = 0"))
    c.ignore(pairs.where("set_id % 4 = 0").select(F.col("higher").alias("lower"), F.col("lower").alias("higher")))
    c.unignore(pairs.where("(lower + higher) % 5 = 0").select(F.col("higher").alias("lower"), F.col("lower").alias("higher")))
    return c.ignored()


@_query(f"WITH {r._MEMBERS} SELECT file_id FROM members WHERE (file_id % 2 = 0 OR auto_keep) AND file_id % 7 <> 0")
def kept_marks(spark, d):
    c, m = _index(spark), r._members(spark, d)
    assert c.kept() is None
    c.keep_these(m.where("file_id % 2 = 0"))
    c.keep_these(m.where("auto_keep"))
    c.unkeep_these(m.where("file_id % 7 = 0"))
    return c.kept()


@_query(f"""WITH {r._MEMBERS}, listed AS (SELECT set_id, rel_path, file_id FROM members), turns AS (SELECT set_id, row_number() OVER (ORDER BY set_id) - 1 AS turn FROM (SELECT DISTINCT set_id FROM listed)),
s AS (SELECT turn, rel_path FROM listed JOIN turns USING (set_id) WHERE file_id % 5 <> 2) SELECT turn::BIGINT AS turn, string_agg(rel_path, '|' ORDER BY rel_path) AS members FROM s GROUP BY turn HAVING count(*) >= 2""")
def stored_sets(spark, d):
    """Sets kept in an index and read back in order, after some of their files were deleted."""
    c = _filled(spark, d)
    ids = c.table("files").select("id", "rel_path")
    sets = r._members(spark, d).select("set_id", "rel_path").join(ids, "rel_path").select("set_id", F.col("id").alias("file_id"))
    c.begin_review()
    c.store_sets(sets.limit(0))
    c.store_sets(sets)
    c.delete_paths(r._files(spark, d).where("file_id % 5 = 2"))
    named = c.sets_in_order().select("at", F.explode("file_ids").alias("id")).join(ids, "id")
    return named.groupBy(F.col("at").alias("turn")).agg(F.array_join(F.sort_array(F.collect_list("rel_path")), "|").alias("members"))


@_query("SELECT * FROM (VALUES (0, false, false, 0), (1, true, true, 0), (2, true, true, 1), (3, true, false, 1), (4, false, false, 0)) t(step, keep_there, sets_there, marks)")
def review_tables(spark, d):
    """Tables of a review: none, begun, marked, sets given up, over."""
    c, rows = _index(spark), []

    def note():
        rows.append((len(rows), c.exists("keep"), c.exists("duplicate_sets"), c.table("keep").count()))

    note()
    c.begin_review()
    note()
    c.keep_these(spark.createDataFrame([(5,)], "file_id long"))
    note()
    c.clear_sets()
    note()
    c.review_over()
    note()
    return spark.createDataFrame(rows, "step int, keep_there boolean, sets_there boolean, marks int")


@_query(f"""WITH {r._FILES} SELECT file_id AS id, rel_path, size_bytes, CASE WHEN file_id % 2 = 0 THEN mtime_seconds ELSE (mtime_seconds * 1000 + 999) // 1000 END AS mtime_seconds, file_id AS last_scanned_at, false AS not_a_picture FROM files""")
def migrated_files(spark, d):
    """Files of two older layouts: times in nanoseconds and in milliseconds, a column that nothing reads any more."""
    old = r._files(spark, d).select(F.col("file_id").alias("id"), "rel_path", "size_bytes", "mtime_seconds", F.col("file_id").alias("last_scanned_at"), F.lit("x").alias("bytes_hash"))
    nanos = old.where("id % 2 = 0").withColumn("mtime_ns", F.col("mtime_seconds") * 1000000000 + 999999999).drop("mtime_seconds")
    millis = old.where("id % 2 = 1").withColumn("mtime_ms", F.col("mtime_seconds") * 1000 + 999).drop("mtime_seconds")
    return migrate.table("files", nanos, SCHEMAS["files"]).unionByName(migrate.table("files", millis, SCHEMAS["files"]))


@_query(f"WITH {r._FILES} SELECT file_id, 1::BIGINT AS fingerprint_version, md5(text) AS dct_hashes, 0 AS n_corners FROM files")
def migrated_fingerprints(spark, d):
    """Fingerprints of a layout without corners and with a hash that nothing reads."""
    old = r._files(spark, d).select("file_id", F.lit(1).cast("long").alias("fingerprint_version"), F.unhex(F.md5("text")).alias("dct_hashes"), F.unhex(F.lit("00")).alias("ring_stats"), F.lit("x").alias("dct_hash"))
    new = migrate.table("fingerprints", old, SCHEMAS["fingerprints"])
    return new.select("file_id", "fingerprint_version", F.lower(F.hex("dct_hashes")).alias("dct_hashes"), F.octet_length("corners").alias("n_corners"))


@_query(f"WITH {r._FILES} SELECT rel_path, size_bytes + CASE WHEN file_id % 2 = 0 THEN 3 ELSE 0 END AS size_bytes, width FROM files WHERE file_id % 10 <> 1")
def compacted_index(spark, d):
    """An index after changes, written whole again, opened anew."""
    c = _filled(spark, d)
    for k in range(3):
        c.upsert(_records(spark, d).where("file_id % 2 = 0").withColumn("size_bytes", F.col("size_bytes") + k + 1), k)
    c.delete_paths(r._files(spark, d).where("file_id % 10 = 1"))
    c.compact()
    c = Catalogue(spark, c.path)
    assert all(len(parts) == 1 for parts in c._at.values())
    return c.indexed_images().select("rel_path", "size_bytes", "width")


@_query("SELECT count(*) FILTER (doc_id % 3 <> 0)::BIGINT AS pictures, false AS there FROM documents")
def discarded_index(spark, d):
    c = _filled(spark, d)
    c.not_pictures(_records(spark, d).where("file_id % 3 = 0"), 2)
    n = c.delete()
    return spark.createDataFrame([(n, c._exists("versions"))], "pictures long, there boolean")


@_query(f"WITH {r._FILES} SELECT rel_path, size_bytes, mtime_seconds, width, height, format, channels, md5(text) AS digest FROM files WHERE file_id % 3 <> 0")
def sqlite_exchange(spark, d):
    """An index written into a SQLite file and read from it into another."""
    c = _filled(spark, d)
    c.not_pictures(_records(spark, d).where("file_id % 3 = 0"), 2)
    folder = shared_dir(spark).removeprefix("file://")
    path = f"{folder}/index-{uuid.uuid4().hex}.sqlite"
    sqlite.export_index(c, path)
    new = sqlite.import_index(spark, path, f"{shared_dir(spark)}/mirrorlake/index-{uuid.uuid4().hex}")
    digest = r._files(spark, d).select("rel_path", F.md5("text").alias("digest"), F.sha2("text", 256).alias("sha"))
    rows = new.indexed_images().join(digest, "rel_path").where(F.lower(F.hex(F.substring("dct_hashes", 1, 32))) == F.col("sha"))
    return rows.select("rel_path", "size_bytes", "mtime_seconds", "width", "height", "format", "channels", "digest")


@_query(f"""WITH {r._FILES}, h AS (SELECT rel_path, sha256(text) AS h FROM files WHERE file_id % 13 <> 0)
SELECT rel_path, upper(substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS first_word, 32 AS n_words, 48 AS n_rings, 1 AS n_corners, 258 AS x, 772 AS y FROM h""")
def index_signatures(spark, d):
    """What the search reads of an index: packed columns as words, rings and corners; a hash of another length is passed by."""
    c = _index(spark)
    rows = _records(spark, d)
    corner = F.unhex(F.concat(F.lit("02010403"), F.repeat(F.lit("00"), F.lit(32))))
    c.upsert(rows.withColumn("dct_hashes", F.when(F.col("file_id") % 13 == 0, F.unhex(F.lit("0011"))).otherwise(F.col("dct_hashes"))).withColumn("corners", corner), 1)
    first = F.upper(F.lpad(F.hex(F.col("hashes")[0][0]), 16, "0"))
    return c.signatures().select("rel_path", first.alias("first_word"), F.size(F.flatten("hashes")).alias("n_words"), F.size("rings").alias("n_rings"), F.size("corners").alias("n_corners"), F.col("corners")[0]["x"].alias("x"), F.col("corners")[0]["y"].alias("y"))


@_query("""SELECT * FROM (SELECT 'indexed' AS outcome, count(*) FILTER (doc_id % 5 <> 0)::BIGINT AS n FROM documents UNION ALL SELECT 'forgotten', count(*) FILTER (doc_id % 5 = 0) FROM documents UNION ALL SELECT 'parts', 5 FROM documents LIMIT 3)""")
def forget_and_compact(spark, d):
    """Rows of removed files go and the index is written whole again; nothing is written where none was removed."""
    c = _filled(spark, d)
    done = r._files(spark, d).select("rel_path", "size_bytes", F.when(F.col("file_id") % 5 != 0, "in use").alias("message"))
    n = cleanup.forget(c, done)
    at = dict(c._at)
    assert cleanup.forget(c, done.where("message is not null")) == 0 and c._at == at
    return spark.createDataFrame([("indexed", c.indexed_images().count()), ("forgotten", n), ("parts", sum(map(len, c._at.values())))], "outcome string, n long")


# ---- files by their bytes ----------------------------------------------------------------------------


def _tiff(entries):
    """A little-endian TIFF of one directory."""
    import struct

    place, body, tail = 8 + 2 + 12 * len(entries) + 4, struct.pack("<H", len(entries)), b""
    for tag, kind, count, value in entries:
        if len(value) > 4:
            value, tail = struct.pack("<I", place + len(tail)), tail + value
        body += struct.pack("<HHI", tag, kind, count) + value.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", 8) + body + struct.pack("<I", 0) + tail


def _made(k: int, text: str) -> bytes:
    """The bytes of a made-up file; k tells what it is."""
    import struct

    word = text.encode()
    chunk = lambda kind, data=b"": struct.pack(">I", len(data)) + kind + data + b"\0\0\0\0"
    png = lambda *parts: b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + b"".join(parts) + chunk(b"IDAT") + chunk(b"IEND")
    frame = b"\x2c" + bytes(9) + b"\2" + b"\1a\0"
    gif = b"GIF89a" + bytes(7)
    exif = b"Exif\0\0" + _tiff([(0x010F, 2, len(word) + 1, word + b"\0"), (0x0112, 3, 1, struct.pack("<H", 6))])
    field = b"\x1c\2\5" + struct.pack(">H", len(word)) + word
    iptc = b"Photoshop 3.0\0" + b"8BIM\x04\x04\0\0" + struct.pack(">I", len(field)) + field
    xmp = b"http://ns.adobe.com/xap/1.0/\0" + b'<x:xmpmeta><rdf:Description rdf:about="x"/><dc:title><rdf:Alt><rdf:li>' + word + b"</rdf:li></rdf:Alt></dc:title></x:xmpmeta>"
    segment = lambda mark, data: b"\xff" + bytes([mark]) + struct.pack(">H", len(data) + 2) + data
    return (
        png(chunk(b"tEXt", b"Author\0" + word)), png(chunk(b"acTL", bytes(8))), gif + b"\x21\xfe" + bytes([len(word)]) + word + b"\0" + frame + b"\x3b", gif + frame + frame + b"\x3b",
        b"\xff\xd8" + segment(0xE1, exif) + b"\xff\xd9", b"\xff\xd8" + segment(0xED, iptc) + b"\xff\xd9", b"\xff\xd8" + segment(0xE1, xmp) + segment(0xFE, word) + b"\xff\xd9",
        _tiff([(0x010F, 2, len(word) + 1, word + b"\0")]), _tiff([(0x010F, 2, 6, b"NIKON\0")]), _tiff([(0x010F, 2, 5, b"SONY\0")]), b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 4) + b"\2\0\0\0",
        b"\0\0\0\x18ftypheic\0\0\0\0", b"\0\0\0\x18ftypcrx \0\0\0\1", b"IIU\0\x08\0\0\0", word, b"",
    )[k]


def _made_files(spark, d):
    """doc_id, kind and content of a made-up file a document, of sixteen kinds."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def make(kind, text):
        import pandas as pd

        return pd.Series([_made(k, t) for k, t in zip(kind, text, strict=True)])

    docs = r._t(spark, d, "documents")
    return docs.select("doc_id", (F.col("doc_id") % 16).cast("int").alias("kind"), F.concat(F.lit("by "), "source").alias("word")).withColumn("content", make("kind", "word"))


_NAMES = "['png', 'png', 'gif', 'gif', 'jpeg', 'jpeg', 'jpeg', 'tiff', 'nef', 'arw', 'webp', 'heic', 'cr3', 'rw2', NULL, NULL]"


@_query(f"SELECT doc_id, {_NAMES}[(doc_id % 16 + 1)::INT] AS format, doc_id % 16 IN (1, 3, 10) AS animated, CASE WHEN doc_id % 16 = 4 THEN 6 ELSE 1 END AS way FROM documents")
def files_by_their_bytes(spark, d):
    """Format by the first bytes, animation, and the way up."""
    from pyspark.sql.functions import pandas_udf

    from mirrorlake.functions import containers

    @pandas_udf("format string, animated boolean, way int")
    def look(content):
        import pandas as pd

        rows = [(f := containers.detect(x[:4096]), bool(f) and containers.is_animated(f, x), containers.orientation(x) if f else 1) for x in map(bytes, content)]
        return pd.DataFrame(rows, columns=["format", "animated", "way"])

    return _made_files(spark, d).select("doc_id", look("content").alias("f")).select("doc_id", "f.format", "f.animated", "f.way")


@_query(f"""WITH x AS (SELECT doc_id, doc_id % 16 AS k, 'by ' || source AS word FROM documents) SELECT doc_id, 'Description' AS name, 'Author' AS k, word AS v FROM x WHERE k = 0
UNION ALL SELECT doc_id, 'Description', 'Comment', word FROM x WHERE k = 2 UNION ALL SELECT doc_id, 'Description', 'Title', word FROM x WHERE k IN (5, 6) UNION ALL SELECT doc_id, 'File', 'Comment', word FROM x WHERE k = 6
UNION ALL SELECT doc_id, 'Image', 'Make', CASE k WHEN 8 THEN 'NIKON' WHEN 9 THEN 'SONY' ELSE word END FROM x WHERE k IN (4, 7, 8, 9)""")
def metadata_entries(spark, d):
    """A row an entry of what pictures say of themselves: text chunks, comments, Exif, IPTC and XMP."""
    from mirrorlake.functions.metadata import metadata_udf

    known = F.element_at(F.array(*[F.lit(x) for x in ("png", "png", "gif", "gif", "jpeg", "jpeg", "jpeg", "tiff", "nef", "arw", "webp", "heic", "cr3", "rw2", None, None)]), F.col("kind") + 1)
    rows = _made_files(spark, d).withColumn("format", known).where("format is not null and format != 'rw2'")
    groups = rows.select("doc_id", F.explode(metadata_udf()("content", "format")).alias("g"))
    return groups.select("doc_id", "g.name", F.explode("g.entries").alias("e")).select("doc_id", "name", "e.k", "e.v").where("k != 'Orientation'")


@_query("""WITH c AS (SELECT doc_id, unnest(range(0, 10)) AS i, md5(doc_id::VARCHAR) AS h FROM documents),
p AS (SELECT doc_id, i, ('0x' || substr(h, i * 3 + 1, 2))::INT AS red, ('0x' || substr(h, i * 3 + 2, 2))::INT AS green, ('0x' || substr(h, i * 3 + 3, 1) || '0')::INT AS blue FROM c)
SELECT doc_id, sum(floor(0.2126 * red + 0.7152 * green + 0.0722 * blue + 0.5))::BIGINT AS grey FROM p GROUP BY doc_id""")
def luma_sums(spark, d):
    """Grey values of ten pixels made of a digest."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def grey(digest):
        import numpy as np
        import pandas as pd

        from mirrorlake.functions import kernels

        pixels = [[[int(h[i * 3 : i * 3 + 2], 16), int(h[i * 3 + 1 : i * 3 + 3], 16), int(h[i * 3 + 2] + "0", 16)] for i in range(10)] for h in digest]
        return pd.Series(kernels.luma(np.array(pixels, np.uint8)).astype(np.int64).sum(1))

    return r._t(spark, d, "documents").select("doc_id", grey(F.md5(F.col("doc_id").cast("string"))).alias("grey"))


# ---- the search --------------------------------------------------------------------------------------


def _signatures(spark, d):
    """Rows of the search: hashes of four turns of the block, rings of its absolute values, facts by id."""
    b = r._blocks(spark, d)
    b = b.union(b.where("vec_id % 15 = 0").select(F.col("vec_id") + COPIED, "block"))
    turned = b.select("vec_id", "block", *[F.concat(F.slice("block", 16 * k + 1, 64), F.slice("block", 1, 16 * k)).alias(f"b{k}") for k in range(4)])
    hashes = F.array(*[F.array(*[hashing.variant_hash(f"b{k}", v) for k in range(4)]) for v in range(8)])
    i = F.col("vec_id")
    path = F.concat(F.when(i % 3 == 0, "a/").otherwise("b/"), F.lit("p"), i.cast("string"), F.when(i % 4 == 0, " copy").otherwise(""), F.lit(".png"))
    small = i % r.MIRRORED
    return turned.select(
        i.alias("file_id"), hashes.alias("hashes"), F.transform(F.slice("block", 1, 48), lambda x: F.abs(x).cast("float")).alias("rings"), (600 + small % 7).cast("int").alias("width"), (400 + small % 5).cast("int").alias("height"),
        path.alias("rel_path"), F.lit("png").alias("format"), F.lit(3).alias("channels"), (10000 + i % 977 * 13).cast("long").alias("size_bytes"), (1600000000 + i % 1009 * 7).cast("long").alias("mtime_seconds"),
    )


_ROWS = f"""{r._BLOCKS},
pictures AS (SELECT vec_id AS file_id, block FROM blocks UNION ALL SELECT vec_id + {COPIED}, block FROM blocks WHERE vec_id % 15 = 0),
facts AS (SELECT file_id, (600 + (file_id % {r.MIRRORED}) % 7)::INT AS width, (400 + (file_id % {r.MIRRORED}) % 5)::INT AS height, CASE WHEN file_id % 3 = 0 THEN 'a' ELSE 'b' END AS folder,
  CASE WHEN file_id % 3 = 0 THEN 'a/' ELSE 'b/' END || 'p' || file_id::VARCHAR || CASE WHEN file_id % 4 = 0 THEN ' copy' ELSE '' END || '.png' AS rel_path, 'png' AS format, 3 AS channels,
  10000 + file_id % 977 * 13 AS size_bytes, 1600000000 + file_id % 1009 * 7 AS mtime_seconds FROM pictures)"""

_SEARCH = f"""{_ROWS},
one AS (SELECT p.*, folder FROM pictures p JOIN facts USING (file_id)),
family AS (SELECT file_id, min(file_id) OVER (PARTITION BY block, width, height) AS representative FROM pictures JOIN facts USING (file_id)),
inside AS (SELECT file_id, min(file_id) OVER (PARTITION BY block, width, height, folder) AS representative FROM pictures JOIN facts USING (file_id)),
turns AS (SELECT file_id, k, list_concat(block[16 * k + 1:], block[1:16 * k]) AS block FROM (SELECT file_id, block, unnest(range(0, 4)) AS k FROM pictures)),
variants AS (SELECT file_id, k, block, unnest(range(0, 8)) AS variant FROM turns),
moved AS (SELECT file_id, k, variant, list_transform(range(1, 64), lambda i: (CASE WHEN variant & 4 > 0 THEN block[(i % 8) * 8 + i // 8 + 1] ELSE block[i + 1] END)
    * (CASE WHEN variant & 1 > 0 AND (i % 8) % 2 = 1 THEN -1 ELSE 1 END) * (CASE WHEN variant & 2 > 0 AND (i // 8) % 2 = 1 THEN -1 ELSE 1 END)) AS m FROM variants),
middle AS (SELECT *, list_sort(m)[32] AS mid FROM moved),
hashes AS (SELECT file_id, k, variant, list_sum(list_transform(range(0, 63), lambda j: CASE WHEN m[j + 1] > mid THEN (1::BIGINT << j::INT) ELSE 0 END))::BIGINT AS hash FROM middle),
bands AS (SELECT file_id, variant, k, band, ((hash >> (16 * band)::INT) & 65535)::INT AS value FROM (SELECT *, unnest(range(0, 4)) AS band FROM hashes)),
reps AS (SELECT file_id FROM family WHERE file_id = representative),
shortlist AS (SELECT DISTINCT least(a.file_id, b.file_id) AS lo, greatest(a.file_id, b.file_id) AS hi FROM bands a JOIN bands b ON a.k = b.k AND a.band = b.band AND a.value = b.value AND a.file_id <> b.file_id
  WHERE a.variant = 0 AND a.file_id IN (SELECT file_id FROM reps) AND b.file_id IN (SELECT file_id FROM reps)),
compared AS (SELECT lo, hi, a.variant, sum(bit_count(xor(a.hash, b.hash))) AS bits FROM shortlist JOIN hashes a ON a.file_id = lo JOIN hashes b ON b.file_id = hi AND b.variant = 0 AND b.k = a.k GROUP BY lo, hi, a.variant),
nearest AS (SELECT lo, hi, min(bits) AS bits FROM compared GROUP BY lo, hi),
shaped AS (SELECT n.lo, n.hi, x.folder AS f1, y.folder AS f2 FROM nearest n JOIN facts x ON x.file_id = lo JOIN facts y ON y.file_id = hi JOIN pictures p ON p.file_id = lo JOIN pictures q ON q.file_id = hi
  WHERE bits <= 38 AND abs(x.width::DOUBLE / x.height - y.width::DOUBLE / y.height) / greatest(x.width::DOUBLE / x.height, y.width::DOUBLE / y.height) < 0.06
    AND sqrt(list_sum(list_transform(range(1, 49), lambda i: (abs(p.block[i]) - abs(q.block[i])) * (abs(p.block[i]) - abs(q.block[i])))) / 48) <= 0.075)"""


def _sets_of(edges: str) -> str:
    """SQL: components of edges (a, b), each picture with its set and whether it is the keeper."""
    return f"""edges AS ({edges}), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, other) AS (SELECT a, b FROM both_ways UNION SELECT x.node, e.b FROM reach x JOIN both_ways e ON e.a = x.other),
roots AS (SELECT node, least(node, min(other)) AS set_id FROM reach GROUP BY node),
named AS (SELECT set_id, f.*, lower(rel_path) AS low, regexp_replace(regexp_replace(lower(rel_path), '^.*/', ''), '[.][^.]*$', '') AS stem FROM roots JOIN facts f ON f.file_id = node),
ranked AS (SELECT set_id, file_id, row_number() OVER (PARTITION BY set_id ORDER BY round(({r._SCORE})::DOUBLE, 9) DESC, mtime_seconds, rel_path, file_id) = 1 AS auto_keep FROM named)"""


def _folded(signatures):
    family = matching.fold_identical(signatures)
    return stash(signatures.join(family.where("file_id = representative").select("file_id"), "file_id"), "folded")


@_query(f"WITH {_SEARCH} SELECT file_id, representative FROM family")
def search_fold(spark, d):
    return matching.fold_identical(_signatures(spark, d))


@_query(f"WITH {_SEARCH} SELECT file_id, representative FROM inside")
def search_fold_within_a_folder(spark, d):
    return matching.fold_identical(_signatures(spark, d), within_a_folder=True)


@_query(f"WITH {_SEARCH} SELECT lo, hi FROM shortlist")
def search_candidates(spark, d):
    return matching.candidates(_folded(_signatures(spark, d)), matching.Thresholds())


@_query(f"WITH {_SEARCH} SELECT lo, hi FROM shaped")
def search_verified(spark, d):
    one = _folded(_signatures(spark, d))
    return matching.verify(matching.candidates(one, matching.Thresholds()), one, matching.Thresholds())


@_query(f"WITH RECURSIVE {_SEARCH}, {_sets_of('SELECT lo AS a, hi AS b FROM shaped UNION ALL SELECT file_id, representative FROM family WHERE file_id <> representative')} SELECT set_id, file_id, auto_keep FROM ranked")
def search_sets(spark, d):
    """The whole search: fold, shortlist, verify, components, keeper."""
    return matching.find_sets(stash(_signatures(spark, d), "signatures")).select("set_id", "file_id", "auto_keep")


_WITHIN = _SEARCH.replace("reps AS (SELECT file_id FROM family", "reps AS (SELECT file_id FROM inside")


@_query(f"WITH RECURSIVE {_WITHIN}, {_sets_of('SELECT lo AS a, hi AS b FROM shaped WHERE f1 = f2 UNION ALL SELECT file_id, representative FROM inside WHERE file_id <> representative')} SELECT set_id, file_id, auto_keep FROM ranked")
def search_sets_within_a_folder(spark, d):
    return matching.find_sets(stash(_signatures(spark, d), "signatures"), matching.Thresholds(within_a_folder=True)).select("set_id", "file_id", "auto_keep")


def _with_corners(signatures):
    """24 corners a picture at made-up places; a mirror image shows those of its picture, moved, the last of them
    with a few bits changed. Exact copies have the corners of what they copy."""
    seed = F.col("file_id") % r.MIRRORED
    moved = (F.col("file_id") / r.MIRRORED).cast("int") % 2
    word = lambda p, j: F.xxhash64(seed, p, F.lit(j))
    corner = lambda p: F.struct((20 + F.pmod(F.xxhash64(seed, p, F.lit(98)), F.lit(400)) + 7 * moved).cast("int").alias("x"), (20 + F.pmod(F.xxhash64(seed, p, F.lit(99)), F.lit(400)) + 3 * moved).cast("int").alias("y"), F.array(F.when(p > 20, word(p, 0).bitwiseXOR(moved * 5)).otherwise(word(p, 0)), *[word(p, j) for j in (1, 2, 3)]).alias("words"))
    return signatures.withColumn("corners", F.transform(F.sequence(F.lit(0), F.lit(23)), corner))


_PLANTED = f"SELECT file_id % {r.MIRRORED} AS a, file_id AS b FROM pictures WHERE file_id >= {r.MIRRORED}"


@_query(f"WITH RECURSIVE {_ROWS}, {_sets_of(_PLANTED)} SELECT set_id, file_id, auto_keep FROM ranked")
def search_sets_by_corners(spark, d):
    """Corners only: pictures of which 16 corners or more agree in one arrangement; here the planted ones."""
    rows = stash(_with_corners(_signatures(spark, d)), "signatures")
    return matching.find_sets(rows, matching.Thresholds(whole_frame=False, corners=True)).select("set_id", "file_id", "auto_keep")


# ---- the review --------------------------------------------------------------------------------------

_REVIEW = f"""{r._IGNORED},
marks AS (SELECT file_id FROM members WHERE file_id % 4 = 1),
open_ AS (SELECT * FROM members WHERE set_id NOT IN (SELECT set_id FROM gone))"""


def _review(spark, d):
    m = stash(r._members(spark, d), "members")
    return m, m.where("file_id % 4 = 1").select("file_id"), r._ignored(m)


@_query(f"WITH {_REVIEW} SELECT lower, higher FROM ignored UNION SELECT lower, higher FROM every WHERE set_id % 5 = 1")
def ignore_a_set(spark, d):
    m, _, ignored = _review(spark, d)
    return review.ignore_sets(ignored, m, m.where("set_id % 5 = 1"))


@_query(f"WITH {_REVIEW} SELECT lower, higher FROM ignored EXCEPT SELECT lower, higher FROM every WHERE set_id % 2 = 1")
def unignore_a_set(spark, d):
    m, _, ignored = _review(spark, d)
    return review.unignore_sets(ignored, m, m.where("set_id % 2 = 1"))


_VERBS = {
    "toggle": "(SELECT file_id FROM marks EXCEPT SELECT file_id FROM open_ WHERE file_id % 3 = 0) UNION (SELECT file_id FROM open_ WHERE file_id % 3 = 0 AND file_id % 4 <> 1)",
    "keep_only": "(SELECT file_id FROM marks EXCEPT SELECT file_id FROM open_ WHERE set_id IN (SELECT set_id FROM open_ WHERE auto_keep AND set_id % 2 = 0)) UNION SELECT file_id FROM open_ WHERE auto_keep AND set_id % 2 = 0",
    "keep_all": "SELECT file_id FROM marks UNION SELECT file_id FROM members WHERE set_id % 3 = 1",
    "keep_none": "SELECT file_id FROM marks EXCEPT SELECT file_id FROM members WHERE set_id % 3 = 1",
    "mark_everything": "SELECT file_id FROM marks UNION SELECT file_id FROM open_",
    "unmark_everything": "SELECT file_id FROM marks EXCEPT SELECT file_id FROM open_",
    "auto_mark": "SELECT file_id FROM marks UNION SELECT file_id FROM open_ WHERE auto_keep",
    "mark": "SELECT file_id FROM marks UNION SELECT file_id FROM members WHERE file_id % 9 = 0",
    "unmark": "SELECT file_id FROM marks EXCEPT SELECT file_id FROM members WHERE file_id % 3 = 0",
}


@_query(f"WITH {_REVIEW} " + " UNION ALL ".join(f"SELECT '{verb}' AS verb, file_id FROM ({sql})" for verb, sql in _VERBS.items()))
def review_verbs(spark, d):
    """The marks after each verb by itself; sets that are ignored keep theirs where the verb is not about one set."""
    m, marks, ignored = _review(spark, d)
    third = m.where("set_id % 3 = 1")
    after = {
        "toggle": review.toggle(marks, m, ignored, m.where("file_id % 3 = 0")),
        "keep_only": review.keep_only(marks, m, ignored, m.where("auto_keep and set_id % 2 = 0")),
        "keep_all": review.keep_all_of(marks, m, third),
        "keep_none": review.keep_none_of(marks, m, third),
        "mark_everything": review.mark_everything(marks, m, ignored),
        "unmark_everything": review.unmark_everything(marks, m, ignored),
        "auto_mark": review.auto_mark(marks, m, ignored),
        "mark": review.mark(marks, m.where("file_id % 9 = 0")),
        "unmark": review.unmark(marks, m.where("file_id % 3 = 0")),
    }
    out = None
    for verb, rows in after.items():
        rows = rows.select(F.lit(verb).alias("verb"), "file_id")
        out = rows if out is None else out.union(rows)
    return out


@_query(f"WITH {_REVIEW} SELECT set_id, file_id FROM members WHERE file_id IN (SELECT file_id FROM marks) AND set_id % 2 = 0")
def take_up_the_marks(spark, d):
    """Marks of an earlier review on the sets that are there now; a mark outside of them is passed by."""
    m, marks, _ = _review(spark, d)
    return review.take_up_the_marks(m.where("set_id % 2 = 0"), marks)


@_query(f"""WITH {_REVIEW}, left_ AS (SELECT * FROM members WHERE file_id % 3 <> 0), many AS (SELECT set_id FROM left_ GROUP BY set_id HAVING count(*) > 1)
SELECT 'member' AS what, set_id, file_id FROM left_ WHERE set_id IN (SELECT set_id FROM many)
UNION ALL SELECT 'mark', set_id, file_id FROM left_ WHERE set_id IN (SELECT set_id FROM many) AND file_id IN (SELECT file_id FROM marks)""")
def forget_members(spark, d):
    m, marks, _ = _review(spark, d)
    left, kept = review.forget_members(m, review.take_up_the_marks(m, marks), m.where("file_id % 3 = 0"))
    return left.select(F.lit("member").alias("what"), "set_id", "file_id").union(kept.select(F.lit("mark"), "set_id", "file_id"))


@_query(f"""WITH {_REVIEW}, placed AS (SELECT set_id, file_id, row_number() OVER (PARTITION BY set_id ORDER BY mtime_seconds, rel_path, file_id) - 1 AS place, count(*) OVER (PARTITION BY set_id) AS n FROM members),
here AS (SELECT * FROM placed WHERE set_id = (SELECT min(set_id) FROM members WHERE set_id > (SELECT median(set_id) FROM members)) AND place = 1),
ahead AS (SELECT min(set_id) AS s FROM open_ WHERE set_id > (SELECT set_id FROM here)), back AS (SELECT max(set_id) AS s FROM open_ WHERE set_id < (SELECT set_id FROM here)),
shut AS (SELECT count(*) AS n FROM gone WHERE set_id = (SELECT set_id FROM here)),
forward AS (SELECT p.set_id, p.file_id FROM placed p, here h, shut WHERE CASE WHEN shut.n = 0 AND h.place + 1 < h.n THEN p.set_id = h.set_id AND p.place = h.place + 1 ELSE p.set_id = (SELECT s FROM ahead) AND p.place = 0 END),
behind AS (SELECT p.set_id, p.file_id FROM placed p, here h, shut WHERE CASE WHEN shut.n = 0 AND h.place > 0 THEN p.set_id = h.set_id AND p.place = h.place - 1 ELSE p.set_id = (SELECT s FROM back) AND p.place = p.n - 1 END),
next_set AS (SELECT p.set_id, p.file_id FROM placed p, here h WHERE p.set_id = (SELECT s FROM ahead) AND p.place = least(h.place, (SELECT min(n) - 1 FROM placed WHERE set_id > h.set_id AND set_id <= (SELECT s FROM ahead)))),
last_set AS (SELECT p.set_id, p.file_id FROM placed p, here h WHERE p.set_id = (SELECT s FROM back) AND p.place = least(h.place, (SELECT min(n) - 1 FROM placed WHERE set_id < h.set_id AND set_id >= (SELECT s FROM back))))
SELECT 'forward' AS key, * FROM forward UNION ALL SELECT 'back', * FROM behind UNION ALL SELECT 'next_set', * FROM next_set UNION ALL SELECT 'last_set', * FROM last_set""")
def cursor_walk(spark, d):
    """Where the four cursor keys lead from the second picture of the set after the median one."""
    m, _, ignored = _review(spark, d)
    middle = m.agg(F.median("set_id").alias("s")).first().s
    here = m.where(F.col("set_id") > middle).agg(F.min("set_id").alias("s")).first().s
    at = m.where(F.col("set_id") == here).orderBy("mtime_seconds", "rel_path", "file_id").select("file_id").limit(2).collect()[1].file_id
    out = None
    for key, ahead, by_set in (("forward", True, False), ("back", False, False), ("next_set", True, True), ("last_set", False, True)):
        rows = review.walk(m, ignored, at, ahead, by_set).select(F.lit(key).alias("key"), "set_id", "file_id")
        out = rows if out is None else out.union(rows)
    return out


@_query(f"WITH {r._MEMBERS} SELECT rel_path AS value FROM members WHERE NOT auto_keep")
def plan_lines(spark, d):
    return cleanup.plan_lines(review.auto_plan(r._members(spark, d)))


@_query(f"WITH {r._MEMBERS} SELECT count(*)::VARCHAR || ' files, ' || printf('%.1f', sum(size_bytes) / 1e6) || ' MB' AS said FROM members WHERE NOT auto_keep")
def plan_description(spark, d):
    return spark.createDataFrame([(cleanup.describe(review.auto_plan(r._members(spark, d))),)], "said string")


@_query(f"""WITH {r._MEMBERS}, g AS (SELECT set_id, sum(CASE WHEN auto_keep THEN 0 ELSE size_bytes END)::BIGINT AS gain FROM members GROUP BY set_id)
SELECT row_number() OVER (ORDER BY gain DESC, set_id, mtime_seconds, rel_path) AS line, set_id::VARCHAR || ',' || CASE WHEN auto_keep THEN 'keep' ELSE 'remove' END || ',' || rel_path || ',' || width::VARCHAR || ',' || height::VARCHAR || ',' || format || ',' || size_bytes::VARCHAR AS value
FROM members JOIN g USING (set_id)""")
def report_csv(spark, d):
    """Lines of the report in their order: the largest gain first, the oldest picture first in a set."""
    rows = cleanup.csv_lines(r._members(spark, d)).collect()  # a report is read by a person; here for the numbers of its lines
    return spark.createDataFrame([(k + 1, x.value) for k, x in enumerate(rows)], "line long, value string")


@_query(f"""WITH {r._MEMBERS} SELECT set_id, sum(CASE WHEN auto_keep THEN 0 ELSE size_bytes END)::BIGINT AS recoverable_bytes, count(*)::BIGINT AS n_members, max(CASE WHEN auto_keep THEN file_id END) AS kept FROM members GROUP BY set_id""")
def report_json(spark, d):
    lines = cleanup.json_lines(r._members(spark, d))
    shape = "struct<set_id:bigint,recoverable_bytes:bigint,members:array<struct<file_id:bigint,auto_keep:boolean>>>"
    got = lines.select(F.from_json("value", shape).alias("s")).select("s.*")
    return got.select("set_id", "recoverable_bytes", F.size("members").cast("long").alias("n_members"), F.filter("members", lambda m: m["auto_keep"])[0]["file_id"].alias("kept"))


# ---- scalars -----------------------------------------------------------------------------------------


@_query("""SELECT doc_id, 'Kept ' || (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE n_chars END)::VARCHAR || ' of {all} in ' || source || '{x}' AS filled, (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE n_chars END)::VARCHAR || CASE WHEN doc_id % 3 = 0 THEN ' file' ELSE ' files' END AS counted,
  regexp_replace(regexp_replace(printf('%.2f', n_chars / 7.0::DOUBLE), '0+$', ''), '[.]$', '') AS trimmed, CASE WHEN doc_id % 50 = 0 THEN 0 ELSE least(n_chars, (doc_id % 50) * 100) * 1000 // ((doc_id % 50) * 100) END::BIGINT AS share FROM documents""")
def messages(spark, d):
    docs = r._t(spark, d, "documents")
    n = F.when(F.col("doc_id") % 3 == 0, F.lit(1)).otherwise(F.col("n_chars"))
    return docs.select(
        "doc_id", texts.fill("Kept {n} of {all} in {where}{x}", n=n, where=F.col("source")).alias("filled"), texts.counted(n, "file", "files").alias("counted"),
        texts.trimmed(F.col("n_chars") / 7.0).alias("trimmed"), texts.fraction(F.col("n_chars"), F.col("doc_id") % 50 * 100, 1000).alias("share"),
    )


@_query("""SELECT doc_id, CASE WHEN w <= 512 AND h <= 512 THEN w WHEN w >= h THEN 512 ELSE greatest(w * 512 // h, 1) END::INT AS width, CASE WHEN w <= 512 AND h <= 512 THEN h WHEN w >= h THEN greatest(h * 512 // w, 1) ELSE 512 END::INT AS height FROM (SELECT doc_id, n_chars % 3000 + 1 AS w, doc_id * 37 % 2000 + 1 AS h FROM documents)""")
def fitted_sizes(spark, d):
    rows = r._t(spark, d, "documents").select("doc_id", (F.col("n_chars") % 3000 + 1).alias("w"), (F.col("doc_id") * 37 % 2000 + 1).alias("h"))
    return rows.select("doc_id", texts.fit_within("w", "h", 512).alias("s")).select("doc_id", "s.width", "s.height")


@_query("""WITH x AS (SELECT doc_id, ['png', 'gif', 'webp', 'tiff', 'heic', 'cr2', 'cr3', 'nef', 'arw', 'rw2', 'jpeg', 'bmp', ''][(doc_id % 13 + 1)::INT] AS name FROM documents)
SELECT doc_id, CASE WHEN name IN ('bmp', '') THEN 'jpeg' ELSE name END AS format, name IN ('jpeg', 'webp', 'heic', 'bmp', '') AS lossy, doc_id % 13 IN (3, 4) AS away FROM x""")
def stored_formats(spark, d):
    """Formats by their stored names, and folders that a listing keeps out of."""
    names = F.array(*map(F.lit, ("png", "gif", "webp", "tiff", "heic", "cr2", "cr3", "nef", "arw", "rw2", "jpeg", "bmp", "")))
    rows = r._t(spark, d, "documents").select("doc_id", F.element_at(names, (F.col("doc_id") % 13 + 1).cast("int")).alias("name"), F.when(F.col("doc_id") % 13 == 3, ".git").when(F.col("doc_id") % 13 == 4, "@eaDir").otherwise("a.b@c").alias("folder"))
    return rows.select("doc_id", texts.parse_format("name").alias("format"), paths.is_lossy(texts.parse_format("name")).alias("lossy"), texts.kept_out(F.col("folder")).alias("away"))


@_query("""SELECT p / 10.0::DOUBLE AS percent, trunc(255 * least(greatest(p / 10.0::DOUBLE, 0), 50) / 100)::INT AS max_bits, CASE WHEN abs(p / 10.0::DOUBLE - 5) < 0.05 THEN 'close' WHEN abs(p / 10.0::DOUBLE - 15) < 0.05 THEN 'balanced' WHEN abs(p / 10.0::DOUBLE - 30) < 0.05 THEN 'wide' WHEN abs(p / 10.0::DOUBLE - 50) < 0.05 THEN 'yolo' END AS preset FROM (SELECT unnest(range(0, 601, 5)) AS p)""")
def thresholds(spark, d):
    """What a sensitivity means, and the named one that it is."""
    rows = [(p / 10, matching.Thresholds.at(p / 10).max_bits) for p in range(0, 601, 5)]
    named = None
    for name, percent in matching.PRESETS.items():
        test = texts.on_preset(F.col("percent"), F.lit(float(percent)))
        named = F.when(test, name) if named is None else named.when(test, name)
    return spark.createDataFrame(rows, "percent double, max_bits int").withColumn("preset", named)


def queries():
    return dict(_Q)


def oracle_sql():
    return dict(_O)
