"""Operator 3: Jaccard join of word n-gram sets by chosen paths.

1. Every text becomes the set of its five-word shingles (64-bit hashes). Rows with equal sets share one
   class, so copies are never paired. A set keeps a sketch: the least hash of each of BINS ranges.
2. Chosen paths: a run begins at a root; at each step the path so far picks one filled bin by a hash and the set
   goes on into the bucket of the token that it has there. Sets that share the tokens on a path meet in its
   bucket. A bucket of SMALL members or fewer is not split any more; larger ones are, with new tokens, LEVELS
   times at most. A pair of similarity s survives k steps with probability s**k, and runs are repeated until a
   pair at the threshold is missed with probability 1 - RECALL at most, the noise of the sketch and the cut of
   step 3 included: few runs are enough where buckets are small at once, and sets that have a larger one take
   as many as a pair needs that goes all LEVELS steps.
3. Buckets are brute-forced over sketches: pairs that agree in LOOSE of the bins join a candidate group.
   A bucket that is still above BLOCK members is dealt into blocks and every pair of blocks is one task's work.
4. The candidates' texts are read again, and within each candidate group all pairs are verified on the
   whole sets (blocks again). Only degrees and a spanning forest leave a block, never all pairs.
5. Verified links give the classes by connected components.

Defined cases: texts without words (null, empty, white space) have the empty set and so are copies of one
another; fewer than five words make one shingle; repeated rows and rows with equal sets are one class and link to each other;
null ids take part, and class_id is the least id that is not null; very long texts are used whole;
an empty table gives an empty result; other columns are ignored.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table
from .graph import block_pairs, components, stars
from .packed import U64, Union, column, mix, shingle_sets, slices

SHINGLE = 5
THRESHOLD = (4, 5)
BINS = 64
#: Steps of a run at most. Whatever their number, as many pairs of a large group of near copies meet at equal RECALL (more
#: steps need more runs: 7, 11, 18, 27 for 1 to 4), while the rows on the way grow, so few steps are taken; sets that share
#: a passage only are parted by the first two.
LEVELS = 3
RECALL = 0.9999
LOOSE = 0.55
#: Members of a bucket that is not split any more.
SMALL = 32
BLOCK = 256
#: Rows of buckets, and pairs of them, that are compared at once.
ROWS, PAIRS = 1 << 14, 1 << 17
U16_ONE = np.uint16(1)


def recall_of(runs: int, levels=LEVELS, threshold=THRESHOLD, bins=BINS, loose=LOOSE) -> float:
    """Chance that a pair at the threshold meets in a run and passes the cut; bins agree by binomial draws."""
    s, out = threshold[0] / threshold[1], 0.0
    for k in range(math.ceil(loose * bins), bins + 1):
        out += math.comb(bins, k) * s**k * (1 - s) ** (bins - k) * (1 - (1 - (k / bins) ** levels) ** runs)
    return out


def runs_needed(levels=LEVELS, threshold=THRESHOLD, recall=RECALL) -> int:
    return next(n for n in range(1, 1000) if recall_of(n, levels, threshold) >= recall)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS numbers for each set: its least hash in each range of hashes, 0 where it has none."""
    out = np.zeros((len(sets), BINS), U64)
    if not sum(map(len, sets)):
        return out
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    spot = row * BINS + (flat >> U64(58)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, spot[1:] != spot[:-1]])
    out.reshape(-1)[spot[first]] = flat[first] | U64(1)
    return out


_NAMES = mix(np.arange(1, BINS + 1, dtype=U64))


def step(path: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Where each set goes on from its path: into the bucket of its token in the filled bin that the path picks."""
    rank = mix(path[:, None] ^ _NAMES) | (marks == 0) * U64(0xFFFFFFFFFFFFFFFF)
    spot = rank.argmin(axis=1)
    return mix(path * U64(0x9E3779B97F4A7C15) + marks[np.arange(len(marks)), spot].astype(U64) * U64(BINS) + spot.astype(U64))


def first_step(marks: np.ndarray, runs: int) -> np.ndarray:
    """The bucket of each set in each run after one step."""
    return np.stack([step(np.full(len(marks), mix(U64(7919 + run)), U64), marks) for run in range(runs)], 1) if len(marks) else np.zeros((0, runs), U64)


def _split(batches):
    """One step more for rows (sid, key, marks)."""
    for batch in batches:
        at = {c: batch.schema.get_field_index(c) for c in batch.schema.names}
        marks = np.frombuffer(b"".join(batch.column(at["marks"]).to_pylist()), "<u2").reshape(-1, BINS)
        keys = step(batch.column(at["key"]).to_numpy().astype(U64), marks) if len(marks) else np.zeros(0, U64)
        yield pa.RecordBatch.from_arrays([batch.column(at["sid"]), pa.array(keys.astype(np.int64))], ["sid", "key"])


def set_id(one: np.ndarray) -> bytes:
    return np.array([one.sum(dtype=U64), mix(one ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)], ">u8").tobytes()


def _signer(runs: int):
    def sign(batches):
        for batch in batches:
            data, offsets = column(batch, "text")
            for lo, part, offs in slices(data, offsets):
                sets = shingle_sets(part, offs, SHINGLE)
                marks = sketch(sets)
                small = (marks >> U64(16)).astype("<u2") | U16_ONE
                small[marks == 0] = 0
                keys = first_step(small, runs).astype(np.int64)
                n = np.array([len(s) for s in sets], np.int32)
                rows = batch.slice(lo, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(rows.schema.get_field_index("doc_id")),
                        rows.column(rows.schema.get_field_index("th")),
                        pa.array(n),
                        pa.array([set_id(s) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, runs, dtype=np.int32)), pa.array(keys.reshape(-1))),
                        pa.array([x.tobytes() for x in small], pa.binary()),
                    ],
                    ["doc_id", "th", "n", "sid", "keys", "marks"],
                )

    return sign


def _groups(batches, names):
    """Consecutive rows with equal values of names, as one RecordBatch each; the input is sorted by them.
    A group is a pair of blocks, so its size is bounded."""
    held, key = [], None

    def flush():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            this = tuple(c[a] for c in cols)
            if held and this != key:
                yield flush()
                held = []
            key = this
            held.append(batch.slice(a, b - a))
    if held:
        yield flush()


def _forest(left, right, sid):
    """Links that join something not yet joined."""
    up = Union(len(sid))
    return [(a, b) for a, b in zip(left.tolist(), right.tolist(), strict=True) if up.join(a, b)]


def _pairs_of(hit, mine, x, y):
    """Row and column numbers of the links in a matrix: inside one block each pair once, else across."""
    if x == y:
        return np.nonzero(np.triu(hit, 1))
    return np.nonzero(hit & (mine == x)[:, None] & (mine == y)[None, :])


def _link(rows: pa.RecordBatch):
    """Links of whole groups (key, x, y, sorted by these and by mine) whose sketches agree in LOOSE of the bins that
    either fills: from each set to the least one that it reaches."""
    at = {c: rows.schema.get_field_index(c) for c in rows.schema.names}
    key, x, y, mine = (rows.column(at[c]).to_numpy() for c in ("key", "x", "y", "mine"))
    marks = np.frombuffer(b"".join(rows.column(at["marks"]).to_pylist()), "<u2").reshape(-1, BINS)
    sid = np.frombuffer(b"".join(rows.column(at["sid"]).to_pylist()), "S16")
    n = len(sid)
    begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    end = np.repeat(np.r_[begin[1:], n], np.diff(np.r_[begin, n]))
    # a block with itself: the rows after this one; a block with another: the rows of the other
    one = x == y
    second = np.r_[np.minimum.reduceat(np.where(mine == y, np.arange(n), n), begin)]
    start = np.where(one, np.arange(n) + 1, np.repeat(second, np.diff(np.r_[begin, n])))
    count = np.where(one | (mine == x), np.maximum(0, end - start), 0)
    full = marks != 0
    total, lo, left, right = np.cumsum(count), 0, [], []
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
        c = count[lo:hi]
        i = np.repeat(np.arange(lo, hi), c)
        j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c - start[lo:hi], c)
        agree = ((marks[i] == marks[j]) & full[i]).sum(1, dtype=np.int16)
        good = agree >= LOOSE * (full[i] | full[j]).sum(1, dtype=np.int16)
        left.append(i[good])
        right.append(j[good])
        lo = hi
    _, first, name = np.unique(sid, return_index=True, return_inverse=True)
    root = stars(name[np.concatenate(left)], name[np.concatenate(right)], len(first))
    node = np.flatnonzero(root != np.arange(len(first)))
    ids = rows.column(at["sid"])
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first[node])), ids.take(pa.array(first[root[node]]))], ["a", "b"])


def _link_sketches(batches):
    """Links of all groups, some thousand rows of whole groups at a time; a group is a pair of blocks at most."""
    held, size = [], 0
    for g in _groups(batches, ["key", "x", "y"]):
        if g.num_rows > 1:
            held.append(g)
            size += g.num_rows
        if size > ROWS:
            yield _link(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held, size = [], 0
    if held:
        yield _link(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _resign(batches):
    """The whole shingle sets of candidates."""
    for batch in batches:
        data, offsets = column(batch, "text")
        for lo, part, offs in slices(data, offsets):
            sets = shingle_sets(part, offs, SHINGLE)
            rows = batch.slice(lo, len(sets))
            got = pa.array([set_id(s) if len(s) else None for s in sets], pa.binary())
            cols = [rows.column(rows.schema.get_field_index(c)) for c in ("sid", "root", "size", "copies")]
            yield pa.RecordBatch.from_arrays([*cols, got, pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "root", "size", "copies", "got", "shingles"])


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over 4096 shingles at a time."""
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    name = np.cumsum(np.r_[0, flat[1:] != flat[:-1]])
    shared = np.bincount(name)[name] > 1
    name, row = np.unique(name[shared], return_inverse=True)[1], row[shared]
    out = np.zeros((m, m), np.float64)
    step = 4096
    for lo in range(0, int(name[-1]) + 1 if len(name) else 0, step):
        a, b = np.searchsorted(name, [lo, lo + step])
        dense = np.zeros((m, step), np.float32)
        dense[row[a:b], name[a:b] - lo] = 1
        out += dense @ dense.T
    return out.astype(np.int64)


def _verify(batches):
    """For each pair of blocks: links of every set (in documents), and a forest of the links."""
    a_, b_, w_ = [], [], []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(a_, pa.binary()), pa.array(b_, pa.binary()), pa.array(w_, pa.int64())], ["a", "b", "w"])

    for g in _groups(batches, ["root", "x", "y"]):
        at = {c: g.schema.get_field_index(c) for c in g.schema.names}
        sid, first = g.column(at["sid"]).to_pylist(), {}
        for i, s in enumerate(sid):  # repeated rows of one text
            first.setdefault(s, i)
        g = g.take(pa.array(sorted(first.values())))
        if g.num_rows < 2:
            continue
        sid = g.column(at["sid"]).to_pylist()
        sets = [np.frombuffer(s, U64) for s in g.column(at["shingles"]).to_pylist()]
        mine, x, y = g.column(at["mine"]).to_numpy(), g.column(at["x"])[0].as_py(), g.column(at["y"])[0].as_py()
        copies = g.column(at["copies"]).to_numpy()
        size = np.array([len(s) for s in sets])
        both = common_counts(sets)
        left, right = _pairs_of(THRESHOLD[1] * both >= THRESHOLD[0] * (size[:, None] + size - both), mine, x, y)
        w = np.bincount(left, copies[right], len(sid)) + np.bincount(right, copies[left], len(sid))
        for i in np.flatnonzero(w):
            a_.append(sid[i])
            b_.append(None)
            w_.append(int(w[i]))
        for i, j in _forest(left, right, sid):
            a_.append(sid[i])
            b_.append(sid[j])
            w_.append(0)
        if len(a_) > 5000:
            yield out()
            a_, b_, w_ = [], [], []
    yield out()


def join(docs: DataFrame, text="text", doc_id="doc_id", recall=RECALL) -> DataFrame:
    """(doc_id, th, n_shingles, sid, root, class_id, n_links) for every row; th is xxhash64 of the text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    few, runs = runs_needed(1, recall=recall), runs_needed(recall=recall)
    signed = stash(rows.mapInArrow(_signer(runs), f"doc_id {kind}, th long, n int, sid binary, keys array<bigint>, marks binary"), "signed")
    sets = stash(
        signed.groupBy("sid")
        .agg(
            F.count("*").alias("copies"),
            F.max("n").alias("n"),
            F.min("doc_id").alias("least_id"),
            F.min(F.struct("doc_id", "th")).alias("one"),
            F.first("keys").alias("keys"),
            F.first("marks").alias("marks"),
        ),
        "sets",
    )
    # buckets with two sets or more; those that are large are split, as often as LEVELS allows
    marks = sets.select("sid", "marks")
    entry = lambda keys: F.explode(keys).alias("key")
    entries = stash(sets.where("n > 0").select("sid", entry(F.slice("keys", 1, few))).distinct(), "entries")
    large = entries.groupBy("key").count().where(F.col("count") > SMALL)
    crowded = entries.join(large, "key").select("sid").distinct()
    entries = entries.union(sets.join(crowded, "sid", "left_semi").select("sid", entry(F.slice("keys", few + 1, runs))))
    dealt = None
    for level in range(1, LEVELS + 1):
        full = entries.groupBy("key").count().where("count > 1")
        members = entries.join(full, "key")
        last = level == LEVELS
        members = members if last else stash(members, "buckets")
        small = block_pairs(members if last else members.where(F.col("count") <= SMALL), "key", "count", "sid", BLOCK).select("key", "x", "y", "mine", "sid")
        dealt = small if dealt is None else dealt.union(small)
        if not last:
            large = members.where(F.col("count") > SMALL)
            if large.isEmpty():
                break
            entries = stash(large.select("sid", "key").join(marks, "sid").mapInArrow(_split, "sid binary, key long"), "paths")
    dealt = dealt.join(marks, "sid").select("key", "x", "y", "mine", "sid", "marks").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "mine")
    loose = components(dealt.mapInArrow(_link_sketches, "a binary, b binary"), "loose")
    # whole sets of the candidates
    sizes = loose.groupBy("root").agg(F.count("*").alias("size"))
    wanted = loose.join(sizes, "root").join(sets.select(F.col("sid").alias("node"), "copies", "one"), "node")
    wanted = wanted.select(F.col("node").alias("sid"), "root", "size", "copies", F.col("one.doc_id").alias("one_id"), F.col("one.th").alias("one_th"))
    texts = rows.join(wanted, (F.col("th") == F.col("one_th")) & F.col("doc_id").eqNullSafe(F.col("one_id")))
    whole = texts.select("sid", "root", "size", "copies", "text").mapInArrow(
        _resign, "sid binary, root binary, size long, copies long, got binary, shingles binary"
    )
    whole = block_pairs(whole.where("got = sid").drop("got"), "root", "size", "sid", BLOCK)
    whole = whole.select("root", "x", "y", "mine", "sid", "copies", "shingles").repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")
    found = stash(whole.mapInArrow(_verify, "a binary, b binary, w long"), "verified")
    degree = found.where("b is null").groupBy(F.col("a").alias("sid")).agg(F.sum("w").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"), "linked").withColumnRenamed("node", "sid")
    known = sets.select("sid", "copies", "least_id").join(roots, "sid", "left").join(degree, "sid", "left")
    known = known.withColumn("root", F.coalesce("root", "sid"))
    names = known.groupBy("root").agg(F.min("least_id").alias("class_id"))
    known = known.join(names, "root").select("sid", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    known = stash(known, "classes")
    out = signed.select("doc_id", "th", F.col("n").cast("long").alias("n_shingles"), "sid").join(known, "sid")
    return out.select("doc_id", "th", "n_shingles", "sid", "root", "class_id", F.col("links").cast("long").alias("n_links"))


def keep_one(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """The row with the least id of each class, with the columns of docs."""
    found = join(docs, text, doc_id)
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k"))
    keep = least.select(F.col("k.doc_id").alias("kept_id"), F.col("k.th").alias("kept_th"))
    # the row travels whole, so no column of docs can clash with these
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(f"`{text}`").alias("h"), F.col(f"`{doc_id}`").alias("id"))
    rows = rows.join(keep, (F.col("h") == F.col("kept_th")) & F.col("id").eqNullSafe(F.col("kept_id")))
    one = Window.partitionBy("h", "id").orderBy(F.xxhash64("row"))
    return rows.withColumn("no", F.row_number().over(one)).where("no = 1").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_shingles")


#: All pairs by their common shingles, and the classes by a recursive walk over the links.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT k, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS gram FROM g),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.k < b.k GROUP BY a.k, b.k),
l AS (SELECT a, b FROM c JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 5 * c >= 4 * (x.n + y.n - c)
      UNION ALL SELECT x.k, y.k FROM d x JOIN d y ON x.k < y.k AND len(x.w) = 0 AND len(y.w) = 0),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT r.a, min(x.doc_id) AS low FROM r JOIN d x ON x.k = r.b GROUP BY r.a),
f AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT d.doc_id, CASE WHEN m.low IS NULL THEN d.doc_id WHEN d.doc_id IS NULL THEN m.low ELSE least(m.low, d.doc_id) END AS class_id,
       coalesce(f.links, 0)::BIGINT AS n_links, coalesce(n.n, 0)::BIGINT AS n_shingles
FROM d LEFT JOIN m ON m.a = d.k LEFT JOIN f ON f.a = d.k LEFT JOIN n ON n.k = d.k"""
