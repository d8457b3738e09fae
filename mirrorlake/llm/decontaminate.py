"""Operator 4: benchmark decontamination by spaced-seed hashing.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. Each mask names the word
positions of a window that count and ignores the others, so a window still matches when an ignored word
was substituted. The masked hashes of all benchmark items are joined with those of every text; each hit
gives an offset diagonal, along which the item is compared with the text word by word. Its runs (a match
counts 1, a substitution -SUBSTITUTION) are those of positive score that cannot be made better; runs of WEIGHT
matching words or more count. Runs in order on diagonals up to NEAR apart add up, so words put in or left out do
not end an overlap. It is reported when a single run holds ENOUGH matching words, or when all of it holds
LEAST_SHARE of the item and LEAST_WORDS words, or the whole item where that is shorter.

The benchmark goes to the executors whole while what is built of it is below MOST_BYTES (at most BUILT bytes a
byte of text), and no text is shuffled. A larger one is joined: only a bitmap of its hashes, of fixed size, is
broadcast; windows of texts that it lets pass meet the items' windows in a shuffle join, and each pair of text and
item that meets is verified by the same code. Both ways give the same rows.

Defined cases: null or empty texts hold nothing; an item given twice counts once; items of fewer than WEIGHT words are never sought, nor runs
without a window of WEIGHT words in agreement with a mask; null
ids are returned as null; repeated rows are judged each; an item twice in a text is one row (the best
overlap, the first of equals); very long texts are scanned whole; empty tables give no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stash, table
from .packed import _STEPS, ALNUM, LOWER, U64, column, mix, prefix_hash, range_hash, slices, words

#: Window positions that count; all of WEIGHT ones. The first is the plain 6-gram.
MASKS = ("111111", "11011011", "1101100101", "1010111001", "1110010011")
WEIGHT = 6
SUBSTITUTION = 2
LEAST_WORDS = 8
LEAST_SHARE = 0.4
ENOUGH = 13
NEAR = 8
#: Most bytes of seeds that are broadcast, and bytes of seeds a byte of text: a word and its gap are two bytes or
#: more, and a word takes eight bytes of hash and three more such numbers for each mask.
MOST_BYTES = 512 << 20
BUILT = 64
#: Bits of the bitmap that a larger benchmark sends.
JOIN_BITS = 24
_FILTER_BITS = 22


def _masked(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    out = np.zeros(max(0, n), U64)
    if n > 0:
        for k, at in enumerate(i for i, x in enumerate(mask) if x == "1"):
            out += h[at : at + n] * (_STEPS[k] | U64(1))
    return mix(out)


def _hashes(data, offsets):
    data = LOWER[data]
    starts, ends, lo, hi = words(data, offsets, ALNUM)
    return (range_hash(prefix_hash(data), starts, ends) if len(starts) else np.zeros(0, U64)), lo, hi


def _runs(same: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, last, matches) of the best run, then of the best ones before and after it, of WEIGHT matches or more."""
    out, left = [], [(0, len(same))]
    while left:
        lo, hi = left.pop()
        if hi - lo < WEIGHT or np.count_nonzero(same[lo:hi]) < WEIGHT:
            continue
        total = np.cumsum(np.where(same[lo:hi], 1, -SUBSTITUTION))
        low = np.minimum.accumulate(np.r_[0, total])[:-1]
        end = int((total - low).argmax())
        begin = int(np.flatnonzero(np.r_[0, total][: end + 1] == low[end])[-1])
        found = int(np.count_nonzero(same[lo + begin : lo + end + 1]))
        if found >= WEIGHT:
            out.append((lo + begin, lo + end, found))
        # a run of few matches may score above one of WEIGHT with substitutions, so the search goes on
        left += [(lo, lo + begin), (lo + end + 1, hi)]
    return out


def _overlap(runs: list[tuple[int, int, int, int]], size: int) -> tuple[int, int, int] | None:
    """(matches, first, last word in the texts) of the best overlap that is to be reported, of runs (first, last word
    of the item, shift of the text, matches). Words that two runs share count once."""
    chains, best = {}, None
    for begin, end, shift, found in sorted(runs):
        got, start, most = found, begin + shift, found
        for other in range(shift - NEAR, shift + NEAR + 1):
            for b, e, total, at, longest in chains.get(other, ()):
                if b < begin and e < end and b + other < begin + shift and e + other < end + shift:
                    more = total + found - max(0, e + 1 - begin, e + other + 1 - begin - shift)
                    if (more, -at) > (got, -start):
                        got, start, most = more, at, max(found, longest)
        chains.setdefault(shift, []).append((begin, end, got, start, most))
        if most >= ENOUGH or (got >= min(LEAST_WORDS, size) and got >= LEAST_SHARE * size):
            if best is None or (-got, start) < (-best[0], best[1]):
                best = got, start, end + shift
    return best


class Seeds:
    """The items' word hashes and, for each mask, their sorted window hashes with a bit filter before them."""

    def __init__(self, items: list[tuple[int, str]], masks=MASKS, filter_bits=_FILTER_BITS):
        encoded = [(t or "").encode() for _, t in items]
        offsets = np.cumsum([0, *map(len, encoded)])
        self.ids, self.masks, self.shift = [i for i, _ in items], masks, U64(64 - filter_bits)
        self.hashes, self.lo, self.hi = _hashes(np.frombuffer(b"".join(encoded), np.uint8), offsets)
        self.tables = []
        owner = np.repeat(np.arange(len(items)), self.hi - self.lo)
        for mask in masks:
            h = _masked(self.hashes, mask)
            inside = owner[: len(h)] == owner[len(mask) - 1 :] if len(h) else np.zeros(0, bool)
            at = np.flatnonzero(inside)
            order = np.argsort(h[at], kind="stable")
            at, bits = at[order], np.zeros(1 << filter_bits, bool)
            bits[(h[at] >> self.shift).astype(np.int64)] = True
            self.tables.append((h[at], at, owner[at], bits))

    def find(self, data, offsets):
        """(row, item, matching words, first word, last word) of every verified overlap, best of each row and item."""
        h, lo, hi = _hashes(data, offsets)
        seen = []
        for mask, (keys, at, owner, bits) in zip(self.masks, self.tables, strict=True):
            if not len(keys):
                continue
            g = _masked(h, mask)
            p = np.flatnonzero(bits[(g >> self.shift).astype(np.int64)])
            a, b = np.searchsorted(keys, g[p], "left"), np.searchsorted(keys, g[p], "right")
            p, a, n = p[b > a], a[b > a], (b - a)[b > a]
            row = np.searchsorted(hi, p, "right")
            fits = p + len(mask) <= hi[row] if len(p) else np.zeros(0, bool)
            p, a, n, row = p[fits], a[fits], n[fits], row[fits]
            entry = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            seen.append(np.stack([np.repeat(row, n), owner[entry], np.repeat(p, n) - at[entry]], 1))
        runs = {}
        for row, item, shift in np.unique(np.concatenate(seen), axis=0).tolist() if seen else []:
            # words of the item that the text has room for on this diagonal
            first = max(self.lo[item], lo[row] - shift)
            last = min(self.hi[item], hi[row] - shift)
            same = self.hashes[first:last] == h[first + shift : last + shift]
            for begin, end, found in _runs(same):
                runs.setdefault((row, item), []).append((int(first) + begin, int(first) + end, shift, found))
        best = {}
        for (row, item), some in runs.items():
            size = int(self.hi[item] - self.lo[item])
            if got := _overlap(some, size):
                best[row, item] = got[0], int(got[1] - lo[row]), int(got[2] - lo[row])
        return [(r, i, *x) for (r, i), x in sorted(best.items())]


def _items(benchmark: DataFrame, text: str, item_id: str) -> DataFrame:
    return benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("item")).where("item is not null").distinct()


def _fits(items: DataFrame, most: int) -> bool:
    return BUILT * (items.agg(F.sum(F.octet_length("item"))).first()[0] or 0) <= most


def _whole(items: DataFrame):
    """The benchmark as seeds, in one broadcast; for benchmarks that fit."""
    rows = [(r.item_id, r.item) for r in items.collect()]
    return items.sparkSession.sparkContext.broadcast(Seeds(sorted(rows, key=lambda x: (x[0] is None, x))))


def _windows(data, offsets):
    """(row, hash) of the masked windows of all rows; the mask is part of the hash."""
    h, lo, hi = _hashes(data, offsets)
    owner = np.repeat(np.arange(len(lo)), hi - lo)
    for k, mask in enumerate(MASKS):
        g = mix(_masked(h, mask) ^ U64(k + 1))
        inside = owner[: len(g)] == owner[len(mask) - 1 :] if len(g) else np.zeros(0, bool)
        yield owner[: len(g)][inside], g[inside]


def _distinct_windows(name: str, bits=None):
    """Distinct (name, hash) of the texts in column text; with bits (a bitmap) of those hashes only that it holds."""

    def emit(batches):
        for batch in batches:
            data, offsets = column(batch, "text")
            key = batch.column(batch.schema.get_field_index(name))
            for lo, part, offs in slices(data, offsets):
                rows, hashes = (np.concatenate(x) for x in zip(*_windows(part, offs), strict=True))
                if bits is not None:
                    use = bits.value[(hashes >> U64(64 - JOIN_BITS)).astype(np.int64)]
                    rows, hashes = rows[use], hashes[use]
                if len(rows):
                    by = np.lexsort((hashes, rows))
                    rows, hashes = rows[by], hashes[by]
                    fresh = np.r_[True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])]
                    yield pa.RecordBatch.from_arrays([key.take(pa.array(lo + rows[fresh], pa.int64())), pa.array(hashes[fresh].astype(np.int64))], [name, "window"])

    return emit


def _or_bits(batches):
    """Bitmap of the hashes of a task's rows, in parts that are not empty."""
    bits = np.zeros(1 << JOIN_BITS, bool)
    for batch in batches:
        bits[(batch.column(0).to_numpy().astype(U64) >> U64(64 - JOIN_BITS)).astype(np.int64)] = True
    for k, part in enumerate(np.packbits(bits).reshape(1 << 6, -1)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "bits"])


def _join_parts(batches):
    held = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[k] = held.get(k, 0) | np.frombuffer(raw, np.uint8)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "bits"])


def _verify_pairs(batches):
    """Each text against the one item that it met."""
    for batch in batches:
        at = {c: batch.schema.get_field_index(c) for c in batch.schema.names}
        texts, items = batch.column(at["text"]).to_pylist(), batch.column(at["item"]).to_pylist()
        rows, got, size = [], [], []
        for k, (text, item) in enumerate(zip(texts, items, strict=True)):
            seeds = Seeds([(None, item)], filter_bits=12)
            raw = np.frombuffer((text or "").encode(), np.uint8)
            for found in seeds.find(raw, np.array([0, len(raw)])):
                rows.append(k)
                got.append(found)
                size.append(int(seeds.hi[0] - seeds.lo[0]))
        of = pa.array(rows, pa.int64())
        more = [pa.array([x[k] for x in got], pa.int64()) for k in (2, 3, 4)]
        share = pa.array([x[2] / n for x, n in zip(got, size, strict=True)], pa.float64())
        yield pa.RecordBatch.from_arrays([*(batch.column(at[c]).take(of) for c in ("th", "id_h", "doc_id", "item_id")), *more, share], ["th", "id_h", "doc_id", "item_id", "n_words", "first_word", "last_word", "share"])


def _joined(rows: DataFrame, items: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """overlaps by a shuffle join, one row a distinct text with its id, and item; with th and id_h (hashes of both)."""
    spark = rows.sparkSession
    items = stash(items.select("item_id", "item", F.xxhash64("item_id", "item").alias("item_h")), "items")
    seeds = items.select("item_h", F.col("item").alias("text")).mapInArrow(_distinct_windows("item_h"), "item_h long, window long")
    parts = seeds.select("window").mapInArrow(_or_bits, "part int, bits binary").repartition(64, "part").mapInArrow(_join_parts, "part int, bits binary")
    bits = np.zeros((1 << 6, (1 << JOIN_BITS) >> 9), np.uint8)
    for r in parts.collect():  # 2**JOIN_BITS bits in all
        bits[r.part] = np.frombuffer(r.bits, np.uint8)
    bits = spark.sparkContext.broadcast(np.unpackbits(bits.reshape(-1)).view(bool))
    texts = rows.select("doc_id", "text", F.xxhash64("text").alias("th"), F.xxhash64("doc_id").alias("id_h"))
    hits = texts.select("th", "text").mapInArrow(_distinct_windows("th", bits), "th long, window long")
    pairs = hits.join(seeds, "window").select("th", "item_h").distinct()
    met = texts.dropDuplicates(["th", "id_h"]).join(pairs, "th").join(items, "item_h").select("th", "id_h", "doc_id", "text", "item_id", "item")
    return met.mapInArrow(_verify_pairs, f"th long, id_h long, doc_id {kinds[0]}, item_id {kinds[1]}, n_words long, first_word long, last_word long, share double")


def overlaps(docs: DataFrame, benchmark: DataFrame, text="text", doc_id="doc_id", item_text="text", item_id="item_id", most=MOST_BYTES) -> DataFrame:
    """A row for each contaminated text and item: doc_id, item_id, n_words (matching), first_word, last_word, share."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    items = _items(benchmark, item_text, item_id)
    kinds = rows.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    out = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_words long, first_word long, last_word long, share double"
    if not _fits(items, most):
        found = _joined(rows, items, kinds)
        # repeated rows are judged each
        each = rows.select(F.xxhash64("text").alias("th"), F.xxhash64("doc_id").alias("id_h"))
        return each.join(found, ["th", "id_h"]).select("doc_id", "item_id", "n_words", "first_word", "last_word", "share")
    seeds, item_type = _whole(items), to_arrow_type(items.schema["item_id"].dataType)

    def scan(batches):
        s = seeds.value
        for batch in batches:
            data, offsets = column(batch, "text")
            for lo, part, offs in slices(data, offsets):
                got = s.find(part, offs)
                ids = batch.column(0).take(pa.array([lo + r for r, *_ in got], pa.int64()))
                size = [int(s.hi[i] - s.lo[i]) for _, i, *_ in got]
                more = [pa.array([x[k] for x in got], pa.int64()) for k in (2, 3, 4)]
                share = pa.array([x[2] / n for x, n in zip(got, size, strict=True)], pa.float64())
                yield pa.RecordBatch.from_arrays([ids, pa.array([s.ids[i] for _, i, *_ in got], item_type), *more, share], ["doc_id", "item_id", "n_words", "first_word", "last_word", "share"])

    return rows.mapInArrow(scan, out)


def clean(docs: DataFrame, benchmark: DataFrame, text="text", item_text="text", item_id="item_id", most=MOST_BYTES) -> DataFrame:
    """The rows of docs without an overlap, with its columns."""
    items = _items(benchmark, item_text, item_id)
    if not _fits(items, most):
        rows = docs.select(F.lit(0).alias("doc_id"), F.col(f"`{text}`").alias("text"))
        found = _joined(rows, items, ("int", items.schema["item_id"].dataType.simpleString())).select("th").distinct()
        whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(f"`{text}`").alias("th"))
        return whole.join(found, "th", "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    seeds = _whole(items)

    def keep(batches):
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            data, offsets = column(batch, text)
            for lo, part, offs in slices(data, offsets):
                good[[lo + r for r, *_ in seeds.value.find(part, offs)]] = False
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
