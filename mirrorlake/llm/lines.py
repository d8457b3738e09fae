"""Operator 9: line dedup by an exact set-similarity join over lines.

A line is the set of its words, one word or more (LEAST_TOKENS); blank lines stay. A line goes
when an earlier line, in order of (doc_id, hash of the text, line number) with null ids last, has a set
of Jaccard similarity THRESHOLD or more; the earlier line need not itself have stayed.

1. One pass counts the words of all lines (in COUNTERS hashed counters, so its size is fixed) and lists
   where each set stands. Equal sets become one, known by a 64-bit hash, with their first place.
2. A second pass orders the words of a line by rarity and sends its prefix, the first n - ceil(tn) + 1,
   to the partition of each prefix word, as packed arrays. Sets of up to three words match equal sets only,
   which step 1 has found, so they are not sent. There, sets that share a prefix word pass a
   length filter, a positional filter and one of parities: each word flips one of PARITY bits of its set, so two
   sets differ in at least as many words as bits.
   A line goes if any earlier one is near, so one such link is enough: under a word with more than Limits.big
   sets, each first meets a few of the earliest ones (in rounds, among those still open); only sets without
   a link go on to meet all others of the word. A few links of a set and word leave a partition, those
   of least bound first; where there are more, the set and the word are noted.
   The postings of noted words are kept.
3. One more pass reads the words of linked lines (bitmaps of bounded size tell the texts that they stand first in,
   and the lines), and each link is verified on whole sets and by order.
4. Sets that have no verified link but were noted meet all kept postings of their noted words, with GROWTH times
   as many links; and so on until none is noted. So nothing is left out, and a family of near copies costs in
   proportion to its size but for the few sets in it that stay.

Rarity only orders the words, so shared counters cost time, never results.

Defined cases: a null or empty text has no line to remove and stays as it is; repeated rows (same id and
text) are treated alike; very long texts and lines are used whole; ties in order cannot differ in
result; an empty table gives an empty result; other columns are ignored by the report and kept by dedup.
"""

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_rows, stash, table
from .packed import U64, column, mix, prefix_hash, range_hash, slices, words

LEAST_TOKENS = 1
THRESHOLD = (4, 5)
COUNTERS = 20
#: Kept postings in a row of their table; a Parquet page holds a hundred rows or more, so they are small.
KEPT = 1024
#: Bits of the bitmap that names sets whose words are read: 16 a set, within these powers of two (16 MB at most).
SLOTS = (20, 27)
#: Bytes of postings that a partition should hold.
PART_BYTES = 8 << 20


class Limits(NamedTuple):
    """A word with more sets than big tries leaders of them first, in rounds; few links of a set and word are sent;
    pairs are filtered at once. They set the order of the work, never the result."""

    big: int = 64
    leaders: int = 8
    rounds: int = 4
    few: int = 2
    pairs: int = 1 << 18


#: Posting: word, set, order of its document (ties are left open), parities of its words in PARITY bits, words in
#: it (MANY: that or more, no filter applies), place of the word.
PARITY = 192
POSTING = np.dtype([("word", "<u4"), ("sid", "<i8"), ("o", "<i8"), ("bits", "<u8", PARITY // 64), ("n", "<u2"), ("at", "<u2")])
MANY = 65535
#: By how much the links that are sent of a set and word grow from one round to the next.
GROWTH = 4096
#: Bits of a word hash within a line.
WORD = 44
_WORD = U64((1 << WORD) - 1)


def line_sets(data, offsets):
    """Distinct words of every line that counts: (line of each word, word hash), and of each line
    (row, line number in it, set hash, distinct words). Words stand grouped by line, sorted by hash."""
    none = np.zeros(0, np.int64), np.zeros(0, U64), *[np.zeros(0, np.int64)] * 4
    starts, ends, _, _ = words(data, offsets)
    if not len(starts):
        return none
    breaks = np.flatnonzero(data == 10)
    of_line = np.searchsorted(np.union1d(offsets[:-1], breaks + 1), starts, "right")
    first = np.flatnonzero(np.r_[True, of_line[1:] != of_line[:-1]])
    line = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(starts)]))
    h = range_hash(prefix_hash(data), starts, ends) >> U64(64 - WORD)
    if len(first) <= 1 << (64 - WORD):
        key = line.astype(U64) << U64(WORD) | h
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]]
        line, h = (key >> U64(WORD)).astype(np.int64), key & _WORD
    else:  # a single text of very many lines
        order = np.lexsort((h, line))
        line, h = line[order], h[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (line[1:] != line[:-1])]
        line, h = line[fresh], h[fresh]
    n = np.bincount(line, minlength=len(first))
    good = n >= LEAST_TOKENS
    if not good.any():
        return none
    h, n, first = h[np.repeat(good, n)], n[good], first[good]
    row = np.searchsorted(offsets, starts[first], "right") - 1
    sid = mix(np.add.reduceat(mix(h), np.r_[0, np.cumsum(n)[:-1]]) + n.astype(U64)).astype(np.int64)
    return np.repeat(np.arange(len(n)), n), h, row, np.searchsorted(breaks, starts[first]) - np.searchsorted(breaks, offsets[row]), sid, n


def _count_and_list(batches):
    counts = np.zeros(1 << COUNTERS, np.int64)
    schema = ["doc_id", "th", "line", "sid", "part", "blob"]
    doc = None
    for batch in batches:
        doc = batch.column(0).type
        data, offsets = column(batch, "text")
        for lo, part, offs in slices(data, offsets):
            _, h, row, number, sid, _ = line_sets(part, offs)
            counts += np.bincount((h >> U64(WORD - COUNTERS)).astype(np.int64), minlength=1 << COUNTERS)
            at = pa.array(row + lo, pa.int64())
            none = len(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(number.astype(np.int32)), pa.array(sid), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], schema
            )
    if doc is not None:
        parts = counts.astype("<i4").reshape(64, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(64, doc), *[pa.nulls(64, t) for t in (pa.int64(), pa.int32(), pa.int64())], pa.array(np.arange(64, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], schema
        )


def _add_up(batches):
    """Sums of the counters of one task's rows, by part."""
    sums = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = np.frombuffer(blob, "<i8" if len(blob) > 4 << (COUNTERS - 6) else "<i4").astype(np.int64)
            sums[part] = sums[part] + got if part in sums else got
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "blob"])


def rarity(counts: np.ndarray) -> np.ndarray:
    """Counts in 256 steps of a logarithm, rarest first."""
    return np.minimum(255, np.log2(np.maximum(1, counts)) * 8).astype(np.uint8)


def parities(h, n):
    """For each set of n words one after the other: PARITY bits, each the parity of the words that fall on it."""
    spot, begin = (h >> U64(WORD - 16)) % U64(PARITY), np.cumsum(n) - n
    one = U64(1) << (spot & U64(63))
    return np.stack([np.bitwise_xor.reduceat(np.where(spot >> U64(6) == k, one, U64(0)), begin) for k in range(PARITY // 64)], 1)


def _post(ranks, parts):
    """Prefix postings of the distinct sets of each slice, packed by partition of the word."""

    def post(batches):
        held = []

        def flush():
            rows, part = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
            blobs = [rows[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(blobs, pa.binary())], ["part", "blob"])

        for batch in batches:
            data, offsets = column(batch, "text")
            orders = batch.column(batch.schema.get_field_index("o")).to_numpy()
            for lo, piece, offs in slices(data, offsets):
                line, h, row, _, sid, n = line_sets(piece, offs)
                if not len(n):
                    continue
                o = orders[lo + row]
                rank = ranks.value[(h >> U64(WORD - COUNTERS)).astype(np.int64)]
                name = rank.astype(U64) << U64(WORD - 8) | h >> U64(8)
                at = np.lexsort((o, sid))
                one = np.sort(at[np.r_[True, sid[at][1:] != sid[at][:-1]]])
                chosen = np.zeros(len(n), bool)
                chosen[one] = True
                use = chosen[line]
                h, name, n, sid, o = h[use], name[use], n[one], sid[one], o[one]
                line = np.repeat(np.arange(len(n)), n)
                bits = parities(h, n)
                if len(n) <= 1 << (64 - WORD):
                    key = line.astype(U64) << U64(WORD) | name
                    key.sort()
                    name = key & _WORD
                else:
                    name = name[np.lexsort((name, line))]
                at = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
                prefix = n - (THRESHOLD[0] * n + THRESHOLD[1] - 1) // THRESHOLD[1] + 1
                # as the threshold has it, a set this small has no other set near it
                alone = (n * THRESHOLD[1] // THRESHOLD[0] == n) & ((THRESHOLD[0] * n + THRESHOLD[1] - 1) // THRESHOLD[1] == n)
                use = np.flatnonzero((at < prefix[line]) & ~alone[line])
                if not len(use):
                    continue
                name, line = mix(name[use]), line[use]
                rows, many = np.empty(len(line), POSTING), n >= MANY
                rows["word"], rows["sid"], rows["o"], rows["bits"] = name >> U64(32), sid[line], o[line], bits[line]
                rows["n"], rows["at"] = np.minimum(n, MANY)[line], np.where(many[line], 0, at[use])
                held.append((rows, (name % U64(parts)).astype(np.int32)))
                if sum(len(x) for x, _ in held) > 1 << 18:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return post


def set_slot(sid, bits: int):
    return (mix(sid.astype(U64)) >> U64(64 - bits)).astype(np.int64)


def near(rows, seekers=None, limits=Limits()):
    """Links of the sets that share a prefix word and pass the filters: yields (sets, earlier sets, None, None), then
    notes (sets, None, words, None) of those of which not all links were given, then all postings
    (None, None, words, blobs) of the noted words. With seekers (set ids), links and notes of these only, and no
    postings. Sets of one order are linked both ways."""
    # by word, then length; equal sets of a word stand together, so that one of them is left
    order = np.argsort(rows["word"].astype(U64) << U64(32) | rows["n"].astype(U64) << U64(16) | rows["sid"].astype(U64) & U64(0xFFFF))
    rows = rows[order]
    ids, name = np.unique(rows["sid"], return_inverse=True)
    o = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(o, name, rows["o"])
    fresh = np.r_[True, (rows["word"][1:] != rows["word"][:-1]) | (rows["sid"][1:] != rows["sid"][:-1])]
    rows, name = rows[fresh], name[fresh]
    # kept postings carry the first order of their set
    o = rows["o"] = o[name]
    end = np.flatnonzero(np.r_[rows["word"][1:] != rows["word"][:-1], True]) + 1
    held_by = np.diff(np.r_[0, end])
    word = np.repeat(np.arange(len(held_by)), held_by)
    n, at = rows["n"].astype(np.int32), rows["at"].astype(np.int32)
    # the longest that the length filter lets pass; MANY stands for all longer ones
    most = np.minimum(n.astype(np.int64) * THRESHOLD[1] // THRESHOLD[0], MANY).astype(np.int32)
    bits = np.ascontiguousarray(rows["bits"])
    after = n - at
    needs = (THRESHOLD[0] * np.arange(2 * MANY + 1) + THRESHOLD[0] + THRESHOLD[1] - 1) // (THRESHOLD[0] + THRESHOLD[1])
    needs = needs.astype(np.int32)

    def passing(left, right):
        """The pairs that the filters let pass, with a lower bound of the words that only one has."""
        long = np.maximum(n[left], n[right])
        fits = (np.minimum(most[left], most[right]) >= long) & (name[left] != name[right])
        left, right, many = left[fits], right[fits], long[fits] == MANY
        sum_n = n[left] + n[right]
        need = needs[sum_n]
        fits = (np.minimum(after[left], after[right]) + np.minimum(at[left], at[right]) >= need) | many
        left, right, many, spare = left[fits], right[fits], many[fits], (sum_n - 2 * need)[fits]
        apart = np.bitwise_count(bits[left] ^ bits[right]).sum(axis=1, dtype=np.int16)
        fits = (apart <= spare) | many
        return left[fits], right[fits], apart[fits]

    open_ = np.ones(len(rows), bool) if seekers is None else np.isin(ids, seekers)[name]
    more = np.zeros(len(rows), bool)
    found = []

    def cut():
        """Leave FEW links of each row, and note the rows that had more."""
        late, early, apart = (np.concatenate(x) for x in zip(*found, strict=True))
        # the same choice under every word
        by = np.lexsort((o[early], apart, late))
        late, early, apart = late[by], early[by], apart[by]
        begin = np.flatnonzero(np.r_[True, late[1:] != late[:-1]])
        keep = np.arange(len(late)) - np.repeat(begin, np.diff(np.r_[begin, len(late)])) < limits.few
        more[late[~keep]] = True
        found[:] = [(late[keep], early[keep], apart[keep])]

    for _ in range(limits.rounds if seekers is None else 0):
        busy = np.bincount(word[open_], minlength=len(held_by)) > limits.big
        act = np.flatnonzero(open_ & busy[word])
        if not len(act):
            break
        by = act[np.lexsort((o[act], word[act]))]
        begin = np.flatnonzero(np.r_[True, word[by][1:] != word[by][:-1]])
        lead = by[begin[:, None] + np.arange(limits.leaders)]
        mine = np.cumsum(busy)[word] - 1
        tried = 0
        for lo in range(0, len(act), limits.pairs // limits.leaders):
            some = act[lo : lo + limits.pairs // limits.leaders]
            left, right, apart = passing(np.repeat(some, limits.leaders), lead[mine[some]].reshape(-1))
            use = o[right] < o[left]
            found.append((left[use], right[use], apart[use]))
            tried += len(done := np.unique(left[use]))
            open_[done], more[done] = False, True
        if 8 * tried < len(act):
            break

    # those still open meet all others of the word: longer ones, then, where some are not open, shorter ones of these
    key = word.astype(np.int64) << 17
    rest = np.flatnonzero(open_)
    up = np.minimum(np.searchsorted(key + n, key[rest] + most[rest], "right"), end[word[rest]])
    mixed = np.bincount(word[~open_], minlength=len(held_by)) > 0
    low = rest[mixed[word[rest]]]
    down = np.searchsorted(key + most, key[low] + n[low], "left")
    row, fro, to = np.r_[rest, low], np.r_[rest + 1, down], np.r_[up, low]
    below = np.r_[np.zeros(len(rest), bool), np.ones(len(low), bool)]
    count = np.maximum(0, to - fro)
    row, fro, count, below = row[count > 0], fro[count > 0], count[count > 0], below[count > 0]
    lo, total, pool = 0, np.cumsum(count), 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + limits.pairs, "right")))
        c = count[lo:hi]
        left = np.repeat(row[lo:hi].astype(np.int32), c)
        right = (np.arange(len(left)) - np.repeat(np.cumsum(c) - c - fro[lo:hi], c)).astype(np.int32)
        if len(low):
            use = ~(np.repeat(below[lo:hi], c) & open_[right])
            left, right = left[use], right[use]
        left, right, apart = passing(left, right)
        fore, back = (o[left] >= o[right]) & open_[left], (o[right] >= o[left]) & open_[right]
        found.append((np.r_[left[fore], right[back]], np.r_[right[fore], left[back]], np.r_[apart[fore], apart[back]]))
        pool += len(found[-1][0])
        if pool > 8 * limits.pairs:
            cut()
            pool = len(found[0][0]) // 2
        lo = hi
    if found:
        cut()
        one = np.unique(name[found[0][0]].astype(np.int64) * len(ids) + name[found[0][1]])
        yield ids[one // len(ids)], ids[one % len(ids)], None, None
    if more.any():
        yield ids[name[more]], None, rows["word"][more], None
    if seekers is None:
        some = [(k, lo) for k in np.unique(word[more]).tolist() for lo in range(end[k] - held_by[k], end[k], KEPT)]
        for at in range(0, len(some), 64):
            part = some[at : at + 64]
            yield None, None, rows["word"][[lo for _, lo in part]], [rows[lo : min(end[k], lo + KEPT)].tobytes() for k, lo in part]


_MET = "a long, b long, word int, blob binary"


def _links(found):
    """What near yields as rows of _MET."""
    for a, b, word, blobs in found:
        n = len(word if a is None else a)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()) if a is None else pa.array(a), pa.nulls(n, pa.int64()) if b is None else pa.array(b), pa.nulls(n, pa.int32()) if word is None else pa.array(word.view(np.int32)),
             pa.nulls(n, pa.binary()) if blobs is None else pa.array(blobs, pa.binary())], ["a", "b", "word", "blob"]
        )


def _meet(limits):
    """Links, notes and kept postings of each partition of words; a task holds one partition's at a time."""

    def meet(batches):
        held, key = [], None
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and part != key:
                    yield from _links(near(np.concatenate(held), None, limits))
                    held = []
                key = part
                held.append(np.frombuffer(blob, POSTING))
        if held:
            yield from _links(near(np.concatenate(held), None, limits))

    return meet


def _meet_again(limits):
    """The same for noted sets (a) and the kept postings (blob) of a word, sorted by word."""

    def meet(batches):
        rows, seekers, size, last = [], [], 0, None
        for batch in batches:
            for word, a, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if size > 1 << 19 and word != last:
                    yield from _links(near(np.concatenate(rows), np.unique(seekers), limits))
                    rows, seekers, size = [], [], 0
                last = word
                if blob is None:
                    seekers.append(a)
                else:
                    rows.append(np.frombuffer(blob, POSTING))
                    size += len(rows[-1])
        if rows:
            yield from _links(near(np.concatenate(rows), np.unique(seekers), limits))

    return meet


def _bits(bits: int):
    """Bitmaps of a task's texts (th) and sets (sid) one after the other, in parts that are not empty."""

    def mark(batches):
        out = np.zeros((2, 1 << bits), bool)
        for batch in batches:
            for k in (0, 1):
                out[k][set_slot(batch.column(k).to_numpy(), bits)] = True
        for k, part in enumerate(np.packbits(out.reshape(-1)).reshape(64, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "blob"])

    return mark


def _or_bits(batches):
    held = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[k] = held.get(k, 0) | np.frombuffer(raw, np.uint8)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "blob"])


def _read_sets(bitmap, bits):
    """The words of the sets that the bitmap names, of the texts that it names, each once a slice."""

    def read(batches):
        for batch in batches:
            batch = batch.filter(pa.array(bitmap.value[0][set_slot(batch.column(0).to_numpy(), bits)]))
            data, offsets = column(batch, "text")
            for _, part, offs in slices(data, offsets):
                line, h, _, _, sid, n = line_sets(part, offs)
                good = np.flatnonzero(bitmap.value[1][set_slot(sid, bits)])
                good = good[np.unique(sid[good], return_index=True)[1]]
                if len(good):
                    use = np.zeros(len(n), bool)
                    use[good] = True
                    good = np.flatnonzero(use)
                    words = h[use[line]]
                    raw = pa.Array.from_buffers(pa.binary(), len(good), [None, pa.py_buffer(np.r_[0, np.cumsum(n[good] * 8)].astype(np.int32).tobytes()), pa.py_buffer(words.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(sid[good]), raw], ["sid", "tokens"])

    return read


def _verify(batches):
    """The sets whose linked set is near on all words."""
    for batch in batches:
        sets = [column(batch, c) for c in ("mine", "other")]
        size = [np.diff(offs) // 8 for _, offs in sets]
        pair = [np.repeat(np.arange(batch.num_rows), x) for x in size]
        word = [np.frombuffer(data[offs[0] : offs[-1]].tobytes(), U64) for data, offs in sets]
        pair, word = np.concatenate(pair), np.concatenate(word)
        by = np.lexsort((word, pair))
        pair, word = pair[by], word[by]
        both = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (word[1:] == word[:-1])], minlength=batch.num_rows)
        good = THRESHOLD[1] * both >= THRESHOLD[0] * (size[0] + size[1] - both)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("a")).filter(pa.array(good))], ["a"])


def _with_order(rows: DataFrame, kind: str) -> DataFrame:
    """rows with o, a long that orders as the ids do, null ids last. Ids that are no whole numbers are sorted in
    ranges and numbered."""
    last = F.lit((1 << 63) - 1)
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return rows.withColumn("o", F.coalesce(F.col("doc_id").cast("long"), last))
    ids = rows.where("doc_id is not null").select(F.col("doc_id").alias("id")).distinct().orderBy("id")
    ids = stash(ids.withColumn("o", F.monotonically_increasing_id()), "lineids")
    return rows.join(ids, F.col("doc_id") == F.col("id"), "left").drop("id").withColumn("o", F.coalesce("o", last))


def _near_earlier(rows: DataFrame, got: DataFrame, first: DataFrame) -> DataFrame:
    """The sets a of links (a, b) for which b is near and begins before a, as one column a."""
    spark = rows.sparkSession
    links = stash(got.where("b is not null").select("a", "b").distinct(), "pairs")
    wanted = stash(first.join(links.select(F.col("a").alias("sid")).union(links.select("b")).distinct(), "sid").select(F.col("first.th").alias("th"), "sid", F.col("first").alias("at")), "wanted")
    # the words of a set are the same wherever it stands, so no text is joined or shuffled
    bits = min(SLOTS[1], max(SLOTS[0], (16 * links.count()).bit_length()))
    parts = wanted.select("th", "sid").mapInArrow(_bits(bits), "part int, blob binary").repartition(64, "part").mapInArrow(_or_bits, "part int, blob binary")
    bitmap = np.zeros((64, 1 << (bits - 8)), np.uint8)
    for r in parts.collect():  # twice 2**bits bits in all
        bitmap[r.part] = np.frombuffer(r.blob, np.uint8)
    bitmap = spark.sparkContext.broadcast(np.unpackbits(bitmap.reshape(-1)).view(bool).reshape(2, -1))
    read = rows.select("th", "text").mapInArrow(_read_sets(bitmap, bits), "sid long, tokens binary")
    sets = stash(wanted.select("sid", "at").join(read.dropDuplicates(["sid"]), "sid"), "linesets")
    bitmap.unpersist()
    mine = sets.select(F.col("sid").alias("a"), F.col("at").alias("mine_at"), F.col("tokens").alias("mine"))
    other = sets.select(F.col("sid").alias("b"), F.col("at").alias("other_at"), F.col("tokens").alias("other"))
    both = links.join(mine, "a").join(other, "b").where("other_at < mine_at").select("a", "mine", "other")
    return stash(both.mapInArrow(_verify, "a long").distinct(), "near")


def removed(docs: DataFrame, text="text", doc_id="doc_id", limits=Limits()) -> DataFrame:
    """(doc_id, th, lines): the numbers of the lines to remove, from 0, of each text that loses any; th is
    xxhash64 of the text."""
    with few_rows(docs.sparkSession):
        return _removed(docs, text, doc_id, limits)


def _removed(docs: DataFrame, text: str, doc_id: str, limits: Limits) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    seen = stash(rows.mapInArrow(_count_and_list, f"doc_id {kind}, th long, line int, sid long, part int, blob binary"), "lines")
    # a task adds up its rows first, so one row a part and task is shuffled
    sums = seen.where("part is not null").select("part", "blob").mapInArrow(_add_up, "part int, blob binary")
    sums = sums.repartition(64, "part").mapInArrow(_add_up, "part int, blob binary").collect()
    counts = np.zeros((64, (1 << COUNTERS) // 64), np.int64)
    for r in sums:
        counts[r.part] = np.frombuffer(r.blob, "<i8")
    counts = counts.reshape(-1)
    places = seen.where("part is null").select("doc_id", "th", "line", "sid")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "line")
    first = stash(places.groupBy("sid").agg(F.min(place).alias("first"), F.count("*").alias("copies")), "first")
    ranks = rarity(counts)
    ranks = spark.sparkContext.broadcast(ranks)
    # about 16 bytes of postings a word
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16, math.ceil(16 * int(counts.sum()) / PART_BYTES))
    ordered = _with_order(rows, kind).select("text", "o")
    posted = ordered.mapInArrow(_post(ranks, parts), "part int, blob binary").repartition(parts, "part").sortWithinPartitions("part")
    got = stash(posted.mapInArrow(_meet(limits), _MET), "linelinks")
    kept = got.where("blob is not null").select("word", F.lit(None).cast("long").alias("a"), "blob")
    found = _near_earlier(rows, got, first)
    while True:
        noted = got.where("b is null and a is not null").join(found, "a", "left_anti").select("word", "a")
        if noted.isEmpty():
            break
        limits = limits._replace(few=limits.few * GROWTH)
        noted = stash(noted, "noted")
        some = kept.join(noted.select("word").distinct(), "word", "left_semi")
        some = some.unionByName(noted.withColumn("blob", F.lit(None).cast("binary"))).repartition("word").sortWithinPartitions("word")
        got = stash(some.mapInArrow(_meet_again(limits), _MET), "linelinks")
        found = found.union(_near_earlier(rows, got, first)).distinct()
    # a set that stands once and has no earlier one near it removes nothing
    bound = first.join(found.withColumn("near", F.lit(True)).withColumnRenamed("a", "sid"), "sid", "left").where("copies > 1 or near")
    bound = bound.select("sid", F.when(F.col("near").isNull(), F.col("first")).alias("bound"))
    gone = places.join(bound.hint("shuffle_hash"), "sid").where(F.col("bound").isNull() | (place > F.col("bound")))
    return gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def dedup(docs: DataFrame, text="text", doc_id="doc_id", limits=Limits()) -> DataFrame:
    """docs with the later lines taken out of the text; all rows and columns stay."""
    gone = removed(docs, text, doc_id, limits)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(f"`{text}`").alias("h"), F.col(f"`{doc_id}`").alias("id"))
    rows = rows.join(gone, (F.col("h") == F.col("th")) & F.col("id").eqNullSafe(F.col("doc_id")), "left")
    left = f"""case when lines is null then row.`{text}` else element_at(transform(array(split(row.`{text}`, '\\n')), x ->
        array_join(transform(array_except(sequence(0, size(x) - 1), lines), i -> x[i]), '\\n')), 1) end"""
    return rows.select(*[(F.expr(left) if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def report(docs: DataFrame, text="text", doc_id="doc_id", limits=Limits()) -> DataFrame:
    """doc_id, n_lines, n_removed and the removed line numbers of every row."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.expr(f"coalesce(octet_length(`{text}`) - octet_length(replace(`{text}`, '\\n', '')) + 1, 0)").cast("long").alias("n_lines"))
    gone = removed(docs, text, doc_id, limits).alias("g")
    out = slim.join(gone, (F.col("h") == F.col("g.th")) & slim["doc_id"].eqNullSafe(F.col("g.doc_id")), "left")
    lines = F.coalesce("lines", F.array().cast("array<int>"))
    return out.select(slim["doc_id"], "n_lines", F.size(lines).cast("long").alias("n_removed"), lines.alias("removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents")).withColumn("removed", F.array_join("removed", ","))


#: All pairs of lines by their common words.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT k, doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS l FROM d WHERE ls IS NOT NULL),
t AS (SELECT k, doc_id, line, list_sort(list_distinct(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))) AS w FROM u),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id, line) AS pos, dense_rank() OVER (ORDER BY w) AS s FROM t WHERE len(w) >= 1),
s AS (SELECT s, any_value(w) AS w, min(pos) AS lead FROM o GROUP BY s),
p AS (SELECT s, len(w) AS n, unnest(w) AS word FROM s),
c AS (SELECT a.s AS a, b.s AS b, a.n AS n, b.n AS m, count(*) AS c FROM p a JOIN p b ON a.word = b.word AND a.s <> b.s AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY ALL),
b AS (SELECT s.s, least(s.lead, coalesce(min(y.lead), s.lead)) AS bound FROM s LEFT JOIN c ON c.a = s.s AND 5 * c.c >= 4 * (n + m - c.c) LEFT JOIN s y ON y.s = c.b GROUP BY s.s, s.lead),
g AS (SELECT k, count(*) AS n, string_agg(line::VARCHAR, ',' ORDER BY line) AS removed FROM o JOIN b ON b.s = o.s WHERE pos > bound GROUP BY k)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed FROM d LEFT JOIN g ON g.k = d.k"""
