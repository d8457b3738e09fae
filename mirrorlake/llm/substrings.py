"""Operator 10: exact removal of repeated strings of LENGTH bytes, with a run-length compressed index.

Every string of LENGTH bytes owns an anchor: the leftmost of the least hashes of its K-byte pieces. Equal
strings have equal anchors, so repeats can only be found among strings with the same anchor hash.
1. Each text is cut into runs of strings with one anchor. A run is known by its anchor hash, the hash of all
   its bytes, and its place. Runs go to the partition of their anchor, as packed arrays. Of runs that are
   equal within a batch one goes there; the others are settled where they are found.
2. A run that occurs twice as a whole is repeated. Other runs whose anchor occurs elsewhere are asked for.
3. Their bytes are read again. Runs of the same anchors are concatenated (a byte that UTF-8 never holds
   between them) and indexed in pieces of bounded size: suffix order, Burrows-Wheeler transform in runs,
   and samples at both ends of every run with the length of the match to the neighbour across the end.
   Streaming the matching statistics from the samples (a match of n at one place is one of n - 1 at the
   next) gives for every place the longest match elsewhere; places with LENGTH or more are marked.
   Anchors with more than HOT different runs take another exact way: their strings are hashed one by
   one and dealt out by that hash.
4. The marked byte ranges of each text are united and cut out.

Equality is by 64-bit hashes of known-equal anchors (128 bits together) and by suffix order.

Defined cases: a null text is empty; texts under LENGTH bytes lose nothing; repeated rows are repeats of one
another; null ids take part; cuts may fall inside a character, so what is kept is binary; very long
texts are worked on in overlapping pieces; an empty table gives an empty result; other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table
from .packed import U64, column, mix, prefix_hash, range_hash, slices

LENGTH = 400
K = 160
HOT = 8192
#: Bytes of one index.
INDEX = 1 << 20
#: Bytes of text between two flushes of runs, and most bytes of a text that are worked on at once.
FLUSH, PIECE = 1 << 25, 1 << 22
_POS = U64((1 << 24) - 1)

#: kind 0: a run to settle; 1: a run that is settled, sent as a partner only; 2: settled, passed on.
RUN = np.dtype([("h", "<u8"), ("c", "<u8"), ("th", "<i8"), ("idh", "<i8"), ("s", "<u4"), ("n", "<u4"), ("kind", "<u4")])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by minima from both ends of blocks of w."""
    n = len(x)
    pad = -n % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """(anchor hash, run hash, row, first start, number of starts) of all runs of strings with one anchor."""
    none = tuple(np.zeros(0, t) for t in (U64, U64, np.int64, np.int64, np.int64))
    if len(data) < length:
        return none
    sums = prefix_hash(data)
    at = np.arange(len(data) - k + 1)
    g = range_hash(sums, at, at + k)
    least = sliding_min((g & ~_POS) | at.astype(U64), length - k + 1) & _POS
    long = np.flatnonzero(np.diff(offsets) >= length)
    edge = np.zeros(len(least) + 1, np.int32)
    np.add.at(edge, offsets[long], 1)
    np.add.at(edge, offsets[long + 1] - length + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    same = np.r_[False, valid[1:] & valid[:-1] & (least[1:] == least[:-1])]
    start = np.flatnonzero(valid & ~same)
    if not len(start):
        return none
    end = np.flatnonzero(valid & ~np.r_[same[1:], False])
    anchor = least[start].astype(np.int64)
    whole = mix(range_hash(sums, start, end + length) ^ mix((anchor - start).astype(U64)))
    row = np.searchsorted(offsets, start, "right") - 1
    return g[anchor], whole, row, start - offsets[row], end - start + 1


def _pieces(data, offsets, length, most):
    """(first row, place in the text, bytes, offsets): rows together, or pieces of a long row."""
    for lo, part, offs in slices(data, offsets, min(1 << 20, most)):
        if len(part) <= most:
            yield lo, 0, part, offs
        else:
            for a in range(0, len(part) - length + 1, most):
                piece = part[a : a + most + length - 1]
                yield lo, a, piece, np.array([0, len(piece)])


def _pack(rows: np.ndarray, parts: int) -> pa.RecordBatch:
    part = (mix(rows["h"] ^ U64(991)) % U64(parts)).astype(np.int64)
    settled = rows["kind"] == 2
    part[settled] = np.arange(int(settled.sum())) % parts
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else np.zeros(1, np.int64)
    blobs = [rows[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def _settle(rows: np.ndarray) -> np.ndarray:
    """Of equal runs in one batch, one is sent as a partner and all are passed on as settled."""
    order = np.lexsort((rows["c"], rows["h"]))
    rows = rows[order]
    new = np.r_[True, (rows["h"][1:] != rows["h"][:-1]) | (rows["c"][1:] != rows["c"][:-1])]
    name = np.cumsum(new) - 1
    many = np.bincount(name)[name] > 1
    partner = rows[many & new]
    rows["kind"][many] = 2
    partner["kind"] = 1
    return np.concatenate([rows, partner])


def _cut(length, k, parts, flush, most):
    def cut(batches):
        held, size = [], 0
        for batch in batches:
            data, offsets = column(batch, "text")
            th, idh = batch.column(batch.schema.get_field_index("th")).to_numpy(), batch.column(batch.schema.get_field_index("idh")).to_numpy()
            for lo, a, part, offs in _pieces(data, offsets, length, most):
                h, c, row, s, n = runs(part, offs, length, k)
                rows = np.zeros(len(h), RUN)
                rows["h"], rows["c"], rows["th"], rows["idh"], rows["s"], rows["n"] = h, c, th[lo + row], idh[lo + row], s + a, n
                held.append(rows)
                size += len(part)
                if size > flush:
                    yield _pack(_settle(np.concatenate(held)), parts)
                    held, size = [], 0
        if held:
            yield _pack(_settle(np.concatenate(held)), parts)

    return cut


def _meet(most):
    """Per partition: settled runs (ask 0), and runs whose bytes are needed (ask 1, or 2 under hot anchors, those
    with more than most different runs)."""

    def meet(batches):
        yield from _met(batches, most)

    return meet


def _met(batches, most):
    held, key = [], None

    def out():
        rows = np.concatenate(held)
        done = rows[rows["kind"] == 2]
        rows = rows[rows["kind"] != 2]
        rows = rows[np.lexsort((rows["kind"], rows["c"], rows["h"]))]
        new_h = np.r_[True, rows["h"][1:] != rows["h"][:-1]][: len(rows)]
        new = new_h | np.r_[True, rows["c"][1:] != rows["c"][:-1]][: len(rows)]
        name, anchor = np.cumsum(new) - 1, np.cumsum(new_h) - 1
        twice = (np.bincount(name, 1 + (rows["kind"] == 1)) > 1)[name] if len(rows) else np.zeros(0, bool)
        settled = np.concatenate([done, rows[twice & (rows["kind"] == 0)]])
        different = np.bincount(anchor, new)[anchor] if len(rows) else np.zeros(0)
        open_ = np.bincount(anchor, ~twice)[anchor] if len(rows) else np.zeros(0)
        ask = new & (different > 1) & (open_ > 0)
        wanted, hot = rows[ask], different[ask] > most
        rows = np.concatenate([settled, wanted])
        kind = np.r_[np.zeros(len(settled), np.int32), np.where(hot, 2, 1).astype(np.int32)]
        past = np.r_[np.ones(len(settled), bool), twice[ask]]
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["th"]), pa.array(rows["idh"]), pa.array(rows["h"].astype(np.int64)), pa.array(rows["s"].astype(np.int64)), pa.array(rows["n"].astype(np.int64)), pa.array(kind), pa.array(past)],
            ["th", "idh", "h", "s", "n", "ask", "settled"],
        )

    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and part != key:
                yield out()
                held = []
            key = part
            held.append(np.frombuffer(blob, RUN))
    if held:
        yield out()


def _asked(batches):
    """The asked-for runs of each text: their rows."""
    for batch in batches:
        at = {c: batch.schema.get_field_index(c) for c in batch.schema.names}
        th, idh = batch.column(at["th"]), batch.column(at["idh"])
        for i, asked in enumerate(batch.column(at["asked"]).to_pylist()):
            text = batch.column(at["text"])[i].as_py().encode()
            yield i, th[i].as_py(), idh[i].as_py(), text, asked


def _fetch(length):
    def fetch(batches):
        for batch in batches:
            rows = [(r["h"], th, idh, r["s"], r["n"], r["settled"], text[r["s"] : r["s"] + r["n"] - 1 + length]) for _, th, idh, text, asked in _asked([batch]) for r in asked]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["h", "th", "idh", "s", "n", "settled", "bytes"])

    return fetch


def _strings(length, parts):
    """Every string of the asked-for runs by itself, packed by the partition of its hash."""

    def strings(batches):
        for batch in batches:
            for _, th, idh, text, asked in _asked([batch]):
                sums = prefix_hash(np.frombuffer(text, np.uint8))
                for r in asked:
                    p = np.arange(r["s"], r["s"] + r["n"])
                    rows = np.zeros(len(p), RUN)
                    rows["h"], rows["th"], rows["idh"], rows["s"], rows["n"] = range_hash(sums, p, p + length), th, idh, p, 1
                    # a settled run occurs elsewhere too, so its strings count twice
                    rows["kind"] = 1 if r["settled"] else 0
                    yield _pack(rows, parts)

    return strings


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of t in order of their first depth bytes, by doubling ranks."""
    padded = np.r_[t, np.full(8, 0xFF, np.uint8)]
    key = np.zeros(len(t), U64)
    for k in range(8):
        key = key << U64(8) | padded[k : k + len(t)].astype(U64)
    have = 8
    while True:
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(len(t), U64)
        rank[order] = np.cumsum(np.r_[1, sorted_[1:] != sorted_[:-1]]).astype(U64)
        if have >= depth or int(rank.max(initial=0)) == len(t):
            return order
        ahead = np.zeros(len(t), U64)
        ahead[:-have] = rank[have:] if have < len(t) else ahead[:-have]
        key = rank << U64(32) | ahead
        have *= 2


def match_lengths(t: np.ndarray, most: int) -> np.ndarray:
    """For each place of t the length of its longest match elsewhere in t (exact up to most), from the
    run-length compressed Burrows-Wheeler transform with samples at the ends of its runs."""
    n = len(t)
    if n < 2:
        return np.zeros(n, np.int64)
    order = suffix_order(t, 2 * most)
    bwt = t[order - 1].astype(np.int16)
    bwt[order == 0] = -1
    edge = np.flatnonzero(bwt[1:] != bwt[:-1])  # the last row of each run but the last
    a, b = order[edge], order[edge + 1]
    sums = prefix_hash(t)
    low, high = np.zeros(len(edge), np.int64), np.minimum(n - np.maximum(a, b), 4 * most)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = sums_equal(sums, a, b, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    best = np.full(n, -1, np.int64)
    np.maximum.at(best, a, low + a)
    np.maximum.at(best, b, low + b)
    return np.maximum(np.maximum.accumulate(best) - np.arange(n), 0)


def sums_equal(sums, a, b, n):
    return range_hash(sums, a, a + n) == range_hash(sums, b, b + n)


def _index(length):
    """Marked byte ranges of the fetched runs; the rows of an anchor come together, pieces of INDEX bytes."""

    def index(batches):
        held, size, last = [], 0, None

        def out():
            text = np.frombuffer(b"".join(r[5] + b"\xff" for r in held), np.uint8)
            hit = match_lengths(text, 2 * length) >= length
            got, at = [], 0
            for th, idh, s, n, settled, raw in held:
                if not settled:
                    mine = np.r_[False, hit[at : at + n], False].astype(np.int8)
                    turn = np.diff(mine)
                    got += [(th, idh, s + a, s + b - 1 + length) for a, b in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True)]
                at += len(raw) + 1
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in range(4)], ["th", "idh", "a", "b"])

        for batch in batches:
            for h, *row in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("h", "th", "idh", "s", "n", "settled", "bytes")], strict=True):
                if size > INDEX and h != last:
                    yield out()
                    held, size = [], 0
                held.append(row)
                size += len(row[5]) + 1
                last = h
        if held:
            yield out()

    return index


def repeats(docs: DataFrame, text="text", doc_id="doc_id", length=LENGTH, k=K, hot=HOT, flush=FLUSH, piece=PIECE) -> DataFrame:
    """(th, idh, ranges): byte ranges (a, b) to remove from each text that has some; th and idh are xxhash64
    of the text and of the id. Ranges may overlap."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16)
    rows = docs.select(F.xxhash64(text).alias("th"), F.xxhash64(doc_id).alias("idh"), F.col(text).alias("text")).where(F.octet_length("text") >= length)
    flat = "th long, idh long, h long, s long, n long, ask int, settled boolean"
    packed = rows.mapInArrow(_cut(length, k, parts, flush, piece), "part int, blob binary").repartition(parts, "part").sortWithinPartitions("part")
    met = stash(packed.mapInArrow(_meet(hot), flat), "runs")
    asked = met.where("ask > 0").groupBy("th", "idh", "ask").agg(F.collect_list(F.struct("h", "s", "n", "settled")).alias("asked"))
    texts = stash(rows.dropDuplicates(["th", "idh"]).join(asked, ["th", "idh"]), "asked")
    fetched = texts.where("ask = 1").mapInArrow(_fetch(length), "h long, th long, idh long, s long, n long, settled boolean, bytes binary")
    fetched = fetched.repartition(parts, "h").sortWithinPartitions("h", "th", "s")
    indexed = fetched.mapInArrow(_index(length), "th long, idh long, a long, b long")
    single = texts.where("ask = 2").mapInArrow(_strings(length, parts), "part int, blob binary").repartition(parts, "part").sortWithinPartitions("part")
    whole = met.where("ask = 0").unionByName(single.mapInArrow(_meet(hot), flat).where("ask = 0"))
    whole = whole.select("th", "idh", F.col("s").alias("a"), (F.col("s") + F.col("n") - 1 + length).alias("b"))
    return whole.union(indexed).groupBy("th", "idh").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))


def _remove(doc_type):
    def remove(batches):
        for batch in batches:
            at = {c: batch.schema.get_field_index(c) for c in batch.schema.names}
            data, offsets = column(batch, "text")
            out = []
            for i, ranges in enumerate(batch.column(at["ranges"]).to_pylist()):
                one = data[offsets[i] : offsets[i + 1]]
                if not ranges:
                    out.append((len(one), 0, 0, one.tobytes()))
                    continue
                turn = np.zeros(len(one) + 1, np.int64)
                np.add.at(turn, [r["a"] for r in ranges], 1)
                np.add.at(turn, [r["b"] for r in ranges], -1)
                gone = np.cumsum(turn[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(one), int(gone.sum()), spans, one[~gone].tobytes()))
            cols = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
            digest = pa.array([hashlib.sha256(x[3]).hexdigest() for x in out], pa.string())
            left = pa.array([len(x[3]) for x in out], pa.int64())
            # a character is counted where its first byte is left
            chars = pa.array([int(np.count_nonzero(np.frombuffer(x[3], np.int8) >= -64)) for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(at["doc_id"]), *cols, pa.array([x[3] for x in out], pa.binary()), digest, left, chars], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "n_kept", "n_chars"])

    return remove


def dedup(docs: DataFrame, text="text", doc_id="doc_id", length=LENGTH, k=K, **more) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256, n_kept (bytes left) and n_chars (characters
    left) of every row. What was removed shows in n_removed, and in n_chars against the length of the text."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"), F.xxhash64(doc_id).alias("idh"))
    rows = rows.join(repeats(docs, text, doc_id, length, k, **more), ["th", "idh"], "left").select("doc_id", "text", "ranges")
    return rows.mapInArrow(_remove(kind), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, n_kept long, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
