"""Exact Jaccard self-join of word n-gram sets by universe partition and the pigeonhole principle.

Two sets of sizes r and s with Jaccard similarity t or more differ in at most c (r + s) elements, c = (1 - t) / (1 + t).
Sizes fall into bands [l, u] with l >= t u, so partners lie in one band or in neighbouring ones. Each band has a scheme that
hashes the universe of n-grams into m segments, m being above the most elements in which partners can differ. A set is
indexed under its band's scheme; it probes that scheme for partners that are not larger, and the next band's for larger ones.
A probe gives each segment a threshold: 0 (not looked up), 1 (an equal segment is a match) or 2 (a segment that differs by
one element is a match as well; found by looking up one-deletion neighbourhoods on both sides). If the thresholds add up to
more than the most elements in which a partner can differ, some segment must match: the candidates hold every pair. Which
segments get 0 or 2 is decided by cost: how often short segments occur is counted over the whole corpus in a sketch of
fixed size, the dearest lookups (empty segments, frequent n-grams) are left out first, and where the slack is used up
further ones are traded for one-deletion lookups of cheap segments. Candidates are verified exactly on the sets.

A match counts only if the segments after it agree too (the pigeonring): differences and thresholds are compared around the ring
of segments, and somewhere on it a run begins whose differences stay below its thresholds' sums, however far it is followed. Each record
carries parity maps of the six segments that follow (maps never differ in more bits than the segments in elements); so almost every
false match is refuted where it is found, and only what is left is shuffled as a candidate and compared exactly.

Sets are equal if two independent 64-bit signatures of them are. All rows of equal sets are one class, named by its least doc_id;
classes are compared, never their members, so copies cost a group-by. Matches that join most of a set of texts with each other travel as
one group instead of its pairs. A key that very many records share (the sketch knows) is cut into a grid of cells by signature, so no task
holds all of them. No cap on partners exists.

Rows without a word (nulls and empty texts too) have no set and no partner; a text of fewer than n words is one n-gram. Very long texts
are one set like others. Rows that share a doc_id are one document, with all links of its texts; repeated rows are copies. A null doc_id
has no partner, no row in the results of ``classes`` and is never dropped. Ties: the least doc_id is kept. An empty table gives an empty
result. Of the frame only key and text are read, whatever its other columns are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import common, textops

N, THRESHOLD = 2, 0.75
#: Counters of the sketch; records of an index bucket on average; records that a task holds before it writes them.
SKETCH, BUCKET, HELD = 1 << 21, 250_000, 500_000
#: Records that share one key in one cell, about.
HOT = 20_000
#: Pairs that a task holds before it drops those that occur again.
PAIRS_HELD = 500_000
#: Cells of the matrix of wanted pairs that are held at once.
WANTED = 4 << 20
#: Elements of a matrix product that take the time of one element looked up; least number of sets; rows and columns at once.
PRODUCT, PRODUCT_LEAST, PRODUCT_ROWS, PRODUCT_COLUMNS = 40, 64, 128, 512
#: Elements, and sets, in a cell in which candidates are verified.
CELL_ELEMENTS, CELL = 1 << 20, 4096
#: Share of its pairs that must match for matching texts to be sent as a group.
DENSE = 0.25
#: Segments beyond the needed ones, as a share; share of segments that have one-deletion neighbourhoods.
SLACK, DELETIONS = 0.1, 0.03
#: A record names its set by REF bits of the signature (sets that share them are compared in any case), in ``low`` and the last 8 bits of ``rest``.
REF = 40
_RECORD = np.dtype([("key", "<u4"), ("low", "<u4"), ("rest", "<u8")])
#: The rest of ``rest``: roles; a probe's spare threshold (bit 2) and the thresholds of the next segments (2 bits each); their parity maps.
INDEX, PROBE, SPARE, NEXT, MAPS, WIDTHS = 1, 2, 4, 3, 15, (7, 7, 7, 7, 7, 6)
_DEAR = 1 << 30


def gram_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every text, one after another; where each begins, and the end."""
    h, at = textops.words(texts)
    size = np.diff(at)
    g = h.copy()
    if len(h):
        for j in range(1, n):
            nxt = np.zeros_like(h)
            nxt[: len(h) - j] = h[j:]
            g = textops.mix(g * np.uint64(0x9DDFEA08EB382D69) ^ nxt)
    out, where = [], np.zeros(len(texts) + 1, np.int64)
    for i, k in enumerate(size.tolist()):
        if k == 0:
            where[i + 1] = where[i]
            continue
        a = int(at[i])
        if k < n:
            x = textops.mix(np.array([np.bitwise_xor.reduce(textops.salted(h[a : a + k], k) * np.arange(1, k + 1, dtype=np.uint64))], np.uint64))
        else:
            x = np.sort(g[a : a + k - n + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        out.append(x)
        where[i + 1] = where[i] + len(x)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), where


def signatures(g: np.ndarray, at: np.ndarray, salt: int = 7) -> np.ndarray:
    """64-bit signature of each set (0 for none)."""
    sums = np.zeros(len(g) + 1, np.uint64)
    np.cumsum(textops.salted(g, salt), out=sums[1:])
    s = textops.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64))
    s[np.diff(at) == 0] = 0
    return s


class Schemes:
    """Bands of set sizes and their numbers of segments."""

    def __init__(self, threshold: float, largest: int):
        self.t, self.c, self.ref, self.hot = threshold, (1 - threshold) / (1 + threshold), REF, HOT
        low, self.low, self.high = 1, [], []
        while low <= max(largest, 1):
            high = max(low, int(low / threshold + 1e-9))
            self.low.append(low)
            self.high.append(high)
            low = high + 1
        self.low, self.high = np.array(self.low), np.array(self.high)
        most = np.floor(self.c * 2 * self.high + 1e-9).astype(np.int64) + 1
        self.m = np.ceil(most * (1 + SLACK)).astype(np.int64) + 1
        self.deletable = np.maximum(1, np.ceil(self.m * DELETIONS)).astype(np.int64)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.high, sizes), len(self.high) - 1)

    def segments(self, g: np.ndarray, at: np.ndarray, rows: np.ndarray, scheme: np.ndarray) -> dict[str, np.ndarray]:
        """All segments (empty ones too) of the sets ``rows`` under their schemes, row by row, and their elements."""
        sizes = at[rows + 1] - at[rows]
        m = self.m[scheme]
        first = np.concatenate(([0], np.cumsum(m)))  # of the row's segments
        owner = np.repeat(np.arange(len(rows)), sizes)
        elem = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(at[rows], sizes)
        x = g[elem]
        seg = first[owner] + ((x >> np.uint64(32)) * m[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        count = np.bincount(seg, minlength=first[-1])
        value = textops.salted(x, 11)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        ends = np.cumsum(count)
        total = sums[ends] - sums[ends - count]
        row = np.repeat(np.arange(len(rows)), m)
        number = np.arange(first[-1]) - first[row]
        where = textops.mix((scheme[row].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64))
        flips = np.zeros(len(x) + 1, np.uint8)
        np.bitwise_xor.accumulate(np.left_shift(np.uint8(1), (value % np.uint64(7)).astype(np.uint8)), out=flips[1:])
        parity = (flips[ends] ^ flips[ends - count]).astype(np.uint64)
        begin, wide, maps, shift = first[row], m[row], np.zeros(len(row), np.uint64), 0
        after = []  # the next segments on the ring
        for j, bits in enumerate(WIDTHS, 1):
            after.append(begin + (number + j) % wide)
            maps |= (parity[after[-1]] & np.uint64((1 << bits) - 1)) << np.uint64(shift)
            shift += bits
        return {"row": row, "number": number, "count": count, "total": total, "where": where, "seg": seg, "value": value, "after": after, "maps": maps << np.uint64(MAPS)}

    @staticmethod
    def keys(total: np.ndarray, where: np.ndarray, deleted: bool) -> np.ndarray:
        return textops.mix(total + where + np.uint64(0xA5A5A5A5 if deleted else 0))


def allocate(row: np.ndarray, number: np.ndarray, count: np.ndarray, cost: np.ndarray, need: np.ndarray, m: np.ndarray, deletable: np.ndarray) -> np.ndarray:
    """Threshold (0, 1 or 2) of every segment; those of a row add up to the row's ``need`` at least.

    The dearest segments beyond the need get 0. While a segment left is dearer than a one-deletion lookup of a deletable
    segment of four elements or more, the one gets 0 and the other 2.
    """
    order = np.lexsort((-cost, row))
    first = np.concatenate(([0], np.cumsum(m)))[:-1]
    rank = np.empty(len(row), np.int64)
    rank[order] = np.arange(len(row)) - first[row[order]]
    spare = np.maximum(m - need, 0)
    able = (number < deletable[row]) & (count >= 4) & (cost < 32) & (rank >= spare[row])
    heavy = (rank >= spare[row]) & (cost > 32)
    n = len(m)
    swaps = np.minimum(np.bincount(row, heavy, n), np.bincount(row, able, n)).astype(np.int64)
    v = (rank >= (spare + swaps)[row]).astype(np.int64)
    if swaps.any():
        nth = np.cumsum(able) - 1
        base = np.zeros(n, np.int64)
        begin = np.concatenate(([0], np.cumsum(np.bincount(row, able, n).astype(np.int64))))[:-1]
        base[:] = begin
        v[able & (nth - base[row] < swaps[row])] = 2
    return v


def short_keys(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Segments of one or two elements, and their counters in the sketch."""
    short = np.flatnonzero((s["count"] > 0) & (s["count"] <= 2))
    return short, (Schemes.keys(s["total"][short], s["where"][short], False) & np.uint64(SKETCH - 1)).astype(np.int64)


def records(schemes: Schemes, sketch: np.ndarray, g: np.ndarray, at: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index and probe entries of the sets: keys of 64 bits, and records (whose own key is filled in later)."""
    size = np.diff(at)
    some = np.flatnonzero(size > 0)
    if not len(some):
        return np.zeros(0, np.uint64), np.zeros(0, _RECORD)
    band = schemes.band(size[some])
    nxt = np.minimum(band + 1, len(schemes.high) - 1)
    larger = np.minimum(schemes.high[nxt], np.floor(size[some] / schemes.t + 1e-9).astype(np.int64))
    cross = (nxt > band) & (larger >= schemes.low[nxt])
    keys, metas, sigs = [], [], []
    mean = float(sketch.mean())
    chance = int(mean + 2 * mean**0.5)  # what keys share by chance in a large corpus

    def add(k: np.ndarray, rows: np.ndarray, meta: np.ndarray) -> None:
        keys.append(k)
        metas.append(meta.astype(np.uint64))
        sigs.append(sig[rows])

    for rows, scheme, need, own in (
        (some, band, np.floor(schemes.c * 2 * size[some] + 1e-9).astype(np.int64) + 1, True),
        (some[cross], nxt[cross], np.floor(schemes.c * (size[some] + larger)[cross] + 1e-9).astype(np.int64) + 1, False),
    ):
        if not len(rows):
            continue
        s = schemes.segments(g, at, rows, scheme)
        cost = np.zeros(len(s["row"]), np.int64)
        cost[s["count"] == 0] = _DEAR
        short, counter = short_keys(s)
        cost[short] = np.maximum(sketch[counter] - chance, 0)
        v = allocate(s["row"], s["number"], s["count"], cost, need, schemes.m[scheme], schemes.deletable[scheme])
        k = schemes.keys(s["total"], s["where"], False)
        maps, probe = s["maps"], s["maps"] | np.uint64(PROBE)
        for j, after in enumerate(s["after"]):
            probe = probe | v[after].astype(np.uint64) << np.uint64(NEXT + 2 * j)
        entry = np.where(v > 0, probe | np.where(v == 2, SPARE, 0).astype(np.uint64), maps) | np.uint64(INDEX if own else 0)
        used = np.arange(len(v)) if own else np.flatnonzero(v > 0)
        add(k[used], rows[s["row"][used]], entry[used])
        # one-deletion neighbourhoods: indexed for every deletable segment, looked up where the threshold is 2
        seg_row, seg_no = s["row"][s["seg"]], s["number"][s["seg"]]
        if own:
            e = np.flatnonzero(seg_no < schemes.deletable[scheme][seg_row])
            add(schemes.keys(s["total"][s["seg"][e]] - s["value"][e], s["where"][s["seg"][e]], True), rows[seg_row[e]], maps[s["seg"][e]] | np.uint64(INDEX))
        two = v == 2
        if two.any():
            add(schemes.keys(s["total"][two], s["where"][two], True), rows[s["row"][two]], probe[two])
            e = np.flatnonzero(two[s["seg"]])
            add(schemes.keys(s["total"][s["seg"][e]] - s["value"][e], s["where"][s["seg"][e]], False), rows[seg_row[e]], probe[s["seg"][e]])
    key, out = np.concatenate(keys), np.empty(sum(map(len, keys)), _RECORD)
    ref = np.concatenate(sigs) >> np.uint64(64 - schemes.ref)
    out["low"], out["rest"] = ref & np.uint64(0xFFFFFFFF), np.concatenate(metas) << np.uint64(8) | ref >> np.uint64(32)
    return spread(key, out, sketch, schemes.hot)


def refs(r: np.ndarray) -> np.ndarray:
    return r["low"].astype(np.uint64) | (r["rest"] & np.uint64(255)) << np.uint64(32)


def spread(key: np.ndarray, r: np.ndarray, sketch: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The records, those of hot keys once in each cell of a grid that has their signature's row or column: any two meet in one.

    How hot a key is depends on the key alone. The sketch's mean, which is what keys share by chance, doesn't count.
    """
    hot = np.maximum(sketch[(key & np.uint64(SKETCH - 1)).astype(np.int64)] - int(sketch.mean()), 0)
    hot = np.where(hot < _DEAR - 1, hot, 0)
    side = -(-hot // most)
    some = np.flatnonzero(side > 1)
    if not len(some):
        return key, r
    n = side[some]
    i = np.repeat(some, n)
    other = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    mine = (textops.mix(refs(r[i])) % side[i].astype(np.uint64)).astype(np.int64)
    cell = np.minimum(mine, other) * side[i] + np.maximum(mine, other)
    cold = np.flatnonzero(side <= 1)
    return np.concatenate((key[cold], textops.salted(key[i], 13) + textops.mix(cell.astype(np.uint64) + np.uint64(1)))), np.concatenate((r[cold], r[i]))


def _follows(x: np.ndarray, y: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """Whether the differences of the next segments (maps x, y) stay below the probe's thresholds."""
    d = x ^ y
    gone, below, shift = np.zeros(len(d), np.uint8), 1 + (probe >> np.uint64(2) & np.uint64(1)).astype(np.uint8), 0
    ok = np.ones(len(d), bool)
    for j, bits in enumerate(WIDTHS):
        gone = gone + np.bitwise_count(d >> np.uint64(shift) & np.uint64((1 << bits) - 1))
        below = below + (probe >> np.uint64(NEXT + 2 * j) & np.uint64(3)).astype(np.uint8)
        ok &= gone < below
        shift += bits
    return ok


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each of n nodes' components under the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == label[b]).all():
            return label
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]


def answered(r: np.ndarray) -> np.ndarray:
    """The records of the keys that have a probe, an index entry and more than one record; no other key has a candidate."""
    order = np.argsort(r["key"])
    key = r["key"][order]
    run = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))[: len(key)]
    role = (r["rest"] >> np.uint64(8))[order]
    many = np.bincount(run) > 1
    asked, held = (np.bincount(run, (role & np.uint64(bit)) > 0) > 0 for bit in (PROBE, INDEX))
    return r[order[(many & asked & held)[run]]]


def matches(r: np.ndarray, share: float = DENSE) -> list[np.ndarray]:
    """Distinct groups of references among the records of a bucket that hold all candidates.

    A candidate is an index and a probe entry with one key whose rings hold. Records of a key that have the same roles, thresholds and
    maps are one unit, since what one of them matches all do. Of connected units the members are one group if most of their pairs match;
    else each pair that matches is a group of two.
    """
    r = answered(r)
    sig, every, rest = refs(r).astype(np.int64), r["key"], r["rest"] >> np.uint64(8)
    order = np.lexsort((sig, rest, every))
    sig, every, rest = sig[order], every[order], rest[order]
    unlike = np.concatenate(([True], (every[1:] != every[:-1]) | (rest[1:] != rest[:-1])))[: len(every)]
    new = unlike | np.concatenate(([True], sig[1:] != sig[:-1]))[: len(every)]  # copies give equal records
    sig, every, rest, unlike = sig[new], every[new], rest[new], unlike[new]
    if not len(sig):
        return []
    first = np.flatnonzero(unlike)  # of the units
    size = np.diff(np.append(first, len(sig)))
    key, meta = every[first], rest[first]
    maps = meta >> np.uint64(MAPS)
    index, probing = (meta & np.uint64(INDEX)) > 0, (meta & np.uint64(PROBE)) > 0
    both = index & probing
    # each probe with the index entries of its key; those that nothing looks up are never compared with each other
    asks, holds = np.flatnonzero(probing), np.flatnonzero(index)
    begin = np.searchsorted(key[holds], key[asks])
    n = np.searchsorted(key[holds], key[asks], side="right") - begin
    upto, found, i = np.cumsum(n), [np.zeros(0, np.int64)], 0
    while i < len(asks):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] - n[i] + PAIRS_HELD, side="right")))
        reps = n[i:j]
        x = np.repeat(asks[i:j], reps)
        y = holds[np.repeat(begin[i:j] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())]
        near = np.flatnonzero((np.bitwise_count((maps[x] ^ maps[y]) & np.uint64(127)) < 4) & (x != y))  # no threshold is larger
        x, y = x[near], y[near]
        ok = _follows(maps[y], maps[x], meta[x])
        x, y = x[ok], y[ok]
        found.append(np.minimum(x, y) * len(key) + np.maximum(x, y))
        i = j
    both_ways = np.unique(np.concatenate(found))
    a, b = both_ways // max(1, len(key)), both_ways % max(1, len(key))
    unit = joined(len(key), a, b)
    # how many members and matching pairs each connected set has; a unit with both roles matches itself
    inside = np.where(both, size * (size - 1) // 2, 0)
    members, pairs = np.bincount(unit, size, len(key)), np.bincount(unit, inside, len(key)) + np.bincount(unit[a], size[a] * size[b], len(key))
    dense = (members > 1) & (pairs >= share * members * (members - 1) / 2)
    out: dict[bytes, np.ndarray] = {}

    def add(group: np.ndarray) -> None:
        if len(group) > 1:
            out.setdefault(group.tobytes(), group)

    of = np.repeat(unit, size)
    some = np.flatnonzero(dense[of])
    order = some[np.argsort(of[some], kind="stable")]
    for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        add(np.unique(sig[part]))
    for u in np.flatnonzero(both & (size > 1) & ~dense[unit]).tolist():
        add(np.unique(sig[first[u] : first[u] + size[u]]))
    rest = np.flatnonzero(~dense[unit[a]])
    a, b = a[rest], b[rest]
    # members of the one unit with those of the other
    reps = size[a] * size[b]
    at = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    x, y = sig[np.repeat(first[a], reps) + at // np.repeat(size[b], reps)], sig[np.repeat(first[b], reps) + at % np.repeat(size[b], reps)]
    two = np.stack((np.minimum(x, y), np.maximum(x, y)), 1)[x != y]
    return [*out.values(), *np.unique(two, axis=0)] if len(two) else list(out.values())


def _profile(docs: DataFrame, n: int, schemes: Schemes) -> tuple[DataFrame, np.ndarray]:
    """The stored table (id, sig, sig2, size) of all rows' sets, and the sketch of short segments. An empty set has size 0."""
    width = 1 << 14

    def run(batches):
        schema = pa.schema([("id", pa.int64()), ("sig", pa.int64()), ("sig2", pa.int64()), ("size", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])
        sketch = np.zeros(SKETCH, np.int64)
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            for a, b in textops.passes(texts):
                g, at = gram_sets(texts[a:b], n)
                sig, second, size = signatures(g, at), signatures(g, at, 17), np.diff(at)
                rows = np.unique(sig, return_index=True)[1]
                rows = np.sort(rows[size[rows] > 0])
                if len(rows):
                    sketch += np.bincount(short_keys(schemes.segments(g, at, rows, schemes.band(size[rows])))[1], minlength=SKETCH)
                k = b - a
                yield pa.RecordBatch.from_arrays([ids.slice(a, k), pa.array(sig.view(np.int64)), pa.array(second.view(np.int64)), pa.array(size, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
        filled = [i for i in range(SKETCH // width) if sketch[i * width : (i + 1) * width].any()]
        k = len(filled)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(k, f.type) for f in list(schema)[:4]), pa.array(filled, pa.int32()), pa.array([np.minimum(sketch[i * width : (i + 1) * width], 2**31 - 1).astype(np.int32).tobytes() for i in filled], pa.binary())], schema=schema)
        textops.tidy()

    made = common.stored(docs.select("id", "text").mapInArrow(run, "id long, sig long, sig2 long, size int, part int, counts binary"), "sets")

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[part] = total.get(part, 0) + np.frombuffer(x.as_buffer(), np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in total.values()], pa.binary())], schema=pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

    sketch = np.zeros(SKETCH, np.int64)
    for r in made.where("part is not null").select("part", "counts").repartition("part").mapInArrow(add, "part int, counts binary").collect():  # SKETCH counters in all
        sketch[r.part * width : (r.part + 1) * width] = np.frombuffer(r.counts, np.int32)
    return made.where("sig is not null").select("id", "sig", "sig2", "size"), sketch


def _candidates(docs: DataFrame, n: int, schemes: Schemes, sketch: np.ndarray, elements: int) -> DataFrame:
    """Stored groups (m: ascending signatures) that hold every pair of sets that match somewhere."""
    buckets = max(8, int(elements * 0.7 / BUCKET))
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(sketch, _DEAR - 1).astype(np.int32))  # fixed size

    def emit(batches):
        schema = pa.schema([("bucket", pa.int32()), ("records", pa.binary())])
        held: list[np.ndarray] = []
        at_bucket: list[np.ndarray] = []

        def flush():
            r, b = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((held, _RECORD), (at_bucket, np.int32)))
            held.clear()
            at_bucket.clear()
            order = np.argsort(b, kind="stable")
            r, b = r[order], b[order]
            cut = np.flatnonzero(np.diff(b, prepend=-1))
            ends = np.append(cut[1:], len(b))
            step = 64
            for i in range(0, len(cut), step):
                yield pa.RecordBatch.from_arrays([pa.array(b[cut[i : i + step]], pa.int32()), pa.array([r[x:y].tobytes() for x, y in zip(cut[i : i + step], ends[i : i + step])], pa.binary())], schema=schema)

        count, seen = 0, set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in textops.passes(texts):
                g, at = gram_sets(texts[a:b], n)
                sig = signatures(g, at)
                rows = np.sort(np.unique(sig, return_index=True)[1])  # copies in a task need one entry
                rows = np.array([i for i in rows.tolist() if int(sig[i]) not in seen], np.int64)
                seen.update(sig[rows].tolist())
                if len(rows) < len(sig):
                    sizes = np.diff(at)[rows]
                    g = g[np.repeat(at[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
                    at, sig = np.concatenate(([0], np.cumsum(sizes))), sig[rows]
                k, r = records(schemes, shared.value, g, at, sig)
                r["key"] = (k & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                held.append(r)
                at_bucket.append(((k >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32))
                count += len(r)
                if count >= HELD:
                    yield from flush()
                    count = 0
        yield from flush()
        textops.tidy()

    share = DENSE

    def join(table: pa.Table) -> pa.Table:
        groups = matches(np.frombuffer(b"".join(table.column("records").to_pylist()), _RECORD), share)
        offs = np.concatenate(([0], np.cumsum([len(g) for g in groups]))).astype(np.int32)
        textops.tidy()
        return pa.table({"m": pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([np.zeros(0, np.int64), *groups])))}, schema=pa.schema([("m", pa.list_(pa.int64()))]))

    made = common.stored(docs.select("text").mapInArrow(emit, "bucket int, records binary").groupBy("bucket").applyInArrow(join, "m array<long>"), "matches")
    shared.destroy()
    return made


def verified(sigs: np.ndarray, sets: list[np.ndarray], blocks: np.ndarray, groups: list[np.ndarray], cross: bool, threshold: float):
    """Arrays (i, j, jaccard) of the pairs of the sets (in order of ``sigs``) that stand in a group and are similar; if ``cross``, of the pairs of different blocks only.

    If the groups ask for most pairs of sets that have most elements in common, all pairs are compared by products of matrices; every
    similar pair stands in a group, so the results are the same.
    """
    size = np.array([len(x) for x in sets], np.int64)
    values = np.unique(np.concatenate(sets), return_inverse=True)[1]
    n, asked = len(sets), sum(len(g) ** 2 for g in groups)
    shared = np.bincount(values) > 1  # other elements are in no intersection
    if min(asked, n * n) * float(size.mean()) * PRODUCT > float(n) * n * int(shared.sum()) and n >= PRODUCT_LEAST:
        yield from _by_products(size, np.where(shared, np.cumsum(shared) - 1, -1)[values], int(shared.sum()), blocks, cross, threshold)
        return
    begin, mark = np.cumsum(size) - size, np.zeros(len(shared), bool)
    members = []
    for g in groups:
        low, high = np.searchsorted(sigs, g), np.searchsorted(sigs, g, side="right")
        members.append(np.repeat(low, high - low) + np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low))
    found, held = [], 0
    step = max(1, WANTED // n)
    for top in range(0, n, step):
        wanted = np.zeros((min(step, n - top), n), bool)
        for at in members:
            mine = at[np.searchsorted(at, top) : np.searchsorted(at, top + step)]
            if len(mine):
                wanted[np.ix_(mine - top, at)] = True
        for i in range(top, top + len(wanted)):
            ok = wanted[i - top] & (np.minimum(size, size[i]) >= threshold * np.maximum(size, size[i]) - 1e-9)
            ok[: i + 1] = False
            if cross:
                ok &= blocks != blocks[i]
            j = np.flatnonzero(ok)
            if not len(j):
                continue
            mine = values[begin[i] : begin[i] + size[i]]
            mark[mine] = True
            k = size[j]
            where = np.repeat(begin[j] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            same = np.add.reduceat(mark[values[where]].astype(np.int64), np.cumsum(k) - k)
            mark[mine] = False
            similar = same / (size[i] + k - same)
            ok = similar >= threshold - 1e-12
            if ok.any():
                found.append((np.full(int(ok.sum()), i), j[ok], similar[ok]))
                held += len(found[-1][0])
            if held >= PAIRS_HELD:
                yield tuple(map(np.concatenate, zip(*found)))
                found, held = [], 0
    if found:
        yield tuple(map(np.concatenate, zip(*found)))


def _by_products(size: np.ndarray, column: np.ndarray, width: int, blocks: np.ndarray, cross: bool, threshold: float):
    """As ``verified``, of all pairs: the sets' rows over the elements that several have, some rows and columns at a time."""
    n = len(size)
    order = np.argsort(blocks, kind="stable") if cross else np.arange(n)  # the first block's sets with the others'
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    row = np.repeat(place, size)[column >= 0]
    column = column[column >= 0]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    cuts = np.searchsorted(column, np.arange(0, width + PRODUCT_COLUMNS, PRODUCT_COLUMNS))
    first = int((blocks[order] == blocks[order[0]]).sum()) if cross else n
    large = size[order]
    for top in range(0, first, PRODUCT_ROWS):
        end, left = min(first, top + PRODUCT_ROWS), first if cross else top
        same = np.zeros((end - top, n - left), np.float32)  # exact: counts stay below 2^24
        for c, (a, b) in enumerate(zip(cuts, cuts[1:])):
            x = np.zeros((n, PRODUCT_COLUMNS), np.float32)
            x[row[a:b], column[a:b] - c * PRODUCT_COLUMNS] = 1
            same += x[top:end] @ x[left:].T
        similar = same.astype(np.float64)
        similar /= large[top:end, None] + large[None, left:] - similar
        i, j = np.nonzero(similar >= threshold - 1e-12)
        ok = np.flatnonzero(j + left > i + top)
        i, j = i[ok], j[ok]
        if len(i):
            x, y = order[i + top], order[j + left]
            yield np.minimum(x, y), np.maximum(x, y), similar[i, j]


def class_pairs(docs: DataFrame, n: int, threshold: float, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of the frame (id, text): members (id, node), node being the least id of the rows with an equal set; and the stored pairs (a, b, jaccard) of nodes, a < b.

    If ``counted``, instead of the pairs (of which n near copies have n^2 / 2) links (a, b, n): without b, n links of a; without n, a pair as above,
    once or several times; with both, nodes that pairs connect which are counted already.
    """
    common.bounded_batches()
    schemes = Schemes(threshold, 1 << 31)  # bands cost nothing until a set falls into them
    sets, sketch = _profile(docs, n, schemes)
    total = sets.agg(F.sum("size")).first()[0] or 0
    groups = matched = _candidates(docs, n, schemes, sketch, total)
    named = sets.where("id is not null and size > 0")
    classes = named.groupBy("sig", "sig2").agg(F.min("id").alias("node"), F.min("size").alias("size"))
    classes = common.stored(classes.withColumn("ref", F.shiftrightunsigned("sig", 64 - schemes.ref)), "classes")
    # nodes of several sets: their pairs can occur repeatedly and aren't counted in cells
    many = classes.groupBy("node").count().where("count > 1").select("node", F.lit(True).alias("many"))
    # Groups are verified in cells: what is connected is in one, and small connected sets share cells; a large one is cut into blocks, of
    # which each two meet in a cell. A set is sent once to each cell that needs it, not once for each of its pairs.
    twins = common.stored(classes.groupBy("ref").count().where("count > 1").select("ref"), "twins")  # different sets with one reference
    root = common.components(groups.select(F.explode("m").alias("u"), F.col("m")[0].alias("v")).where("u != v")).select(F.col("node").alias("ref"), "root")
    root = root.union(twins.join(root, "ref", "left_anti").select("ref", F.col("ref").alias("root")))
    groups = groups.union(twins.select(F.array("ref").alias("m")))
    used = classes.join(root, "ref").join(many, "node", "left")
    sums = used.groupBy("root").agg(F.sum("size").alias("elements"), F.count("*").alias("sets"))
    sides = common.stored(sums.select("root", F.greatest(F.ceil(F.col("elements") / CELL_ELEMENTS), F.ceil(F.col("sets") / CELL)).cast("int").alias("p"), "elements"), "sides")
    cells = max(1, (sides.agg(F.sum("elements")).first()[0] or 0) // CELL_ELEMENTS)
    alone = F.pmod(F.xxhash64("root"), F.lit(cells))
    block = "cast(pmod(xxhash64(ref), p) as int)"
    needed = used.join(sides.select("root", "p"), "root").withColumn("block", F.expr(block))
    every = F.expr("transform(sequence(0, p - 1), i -> xxhash64(root, least(i, block), greatest(i, block)))")
    needed = common.stored(needed.select(F.col("node").alias("id"), "sig", "ref", "block", F.coalesce("many", F.lit(False)).alias("many"), F.when(F.col("p") > 1, every).otherwise(F.array(alone)).alias("cells")), "needed")
    small = (needed.agg(F.sum(F.size("cells") + 4)).first()[0] or 0) <= common.BROADCAST_IDS

    def grams(texts: list) -> dict:
        g, at = gram_sets(texts, n)
        return {"own": signatures(g, at).view(np.int64), "grams": [g[at[i] : at[i + 1]].tobytes() for i in range(len(texts))]}

    of = docs.join(F.broadcast(needed) if small else needed, "id").select("id", "sig", "ref", "block", "many", "cells", common.text_udf("own long, grams binary", grams)("text").alias("x"))
    of = of.where("x.own = sig").select(F.explode("cells").alias("at"), "id", "ref", "block", "many", "x.grams")  # an id has several sets if its rows have different texts
    sent = groups.join(root.select(F.col("ref").alias("first"), "root"), F.col("m")[0] == F.col("first")).join(sides.select("root", "p"), "root")
    near_blocks = F.expr(f"array_distinct(transform(m, ref -> {block}))")
    two = "filter(m, ref -> cast(pmod(xxhash64(ref), p) as int) in (i, j))"
    several = F.expr(f"flatten(transform(b, i -> transform(filter(b, j -> j >= i), j -> named_struct('cell', xxhash64(root, i, j), 'cross', i != j, 'm', {two}))))")
    one = F.array(F.struct(alone.alias("cell"), F.lit(False).alias("cross"), F.col("m").alias("m")))
    placed = sent.withColumn("b", F.when(F.col("p") > 1, near_blocks)).select("root", F.explode(F.when(F.col("p") > 1, several).otherwise(one)).alias("x")).select("root", "x.*")

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n" if counted else "jaccard", pa.int64() if counted else pa.float64())])
        ids, sigs, blocks, many = (right.column(c).to_numpy() for c in ("id", "ref", "block", "many"))
        data = right.column("grams").to_pylist()
        rows = np.array(list({(k, x): i for i, (k, x) in enumerate(zip(ids.tolist(), data))}.values()), np.int64)  # repeated rows once
        rows = rows[np.argsort(sigs[rows], kind="stable")]
        known = sigs[rows]
        m = left.column("m").combine_chunks()
        members, ends = m.flatten().to_numpy(), np.cumsum(np.concatenate(([0], m.value_lengths().to_numpy())))
        by: dict[tuple[int, bool], list[int]] = {}
        for k, of in enumerate(zip(left.column("root").to_pylist(), left.column("cross").to_pylist())):
            by.setdefault(of, []).append(k)
        out = []
        for (_, cross), some in by.items():
            groups = list({members[ends[k] : ends[k + 1]].tobytes(): np.sort(members[ends[k] : ends[k + 1]]) for k in some}.values())
            use = rows[np.isin(known, np.concatenate(groups))]
            if len(use) < 2:
                continue
            name, label, links = ids[use], np.arange(len(use)), np.zeros(len(use), np.int64)
            for i, j, similar in verified(sigs[use], [np.frombuffer(data[k], np.uint64) for k in use.tolist()], blocks[use], groups, cross, threshold):
                other = name[i] != name[j]
                if counted:
                    each = other & (many[use[i]] | many[use[j]])
                    plain = other & ~each
                    links += np.bincount(i[plain], minlength=len(use)) + np.bincount(j[plain], minlength=len(use))
                    new = np.flatnonzero(plain & (label[i] != label[j]))
                    if len(new):
                        label = joined(len(use), np.concatenate((np.arange(len(use)), i[new])), np.concatenate((label, j[new])))
                    i, j = i[each], j[each]
                else:
                    i, j, similar = i[other], j[other], similar[other]
                x, y = name[i], name[j]
                out.append((pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.nulls(len(x), pa.int64()) if counted else pa.array(np.round(similar, 6))))
            if counted:
                has, tied = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(use)))
                out.append((pa.array(name[has]), pa.nulls(len(has), pa.int64()), pa.array(links[has])))
                out.append((pa.array(name[tied]), pa.array(name[label[tied]]), pa.array(np.zeros(len(tied), np.int64))))
        textops.tidy()
        return pa.table([pa.concat_arrays([pa.array([], f.type), *(x[i] for x in out)]) for i, f in enumerate(schema)], schema=schema)

    found = placed.groupBy("cell").cogroup(of.groupBy("at")).applyInArrow(verify, "a long, b long, n long" if counted else "a long, b long, jaccard double")
    near = common.stored(found if counted else found.groupBy("a", "b").agg(F.max("jaccard").alias("jaccard")), "pairs")
    for done in (matched, twins, sides, needed):
        common.discard(done)
    members = named.select("id", "sig", "sig2").join(classes.select("sig", "sig2", "node"), ["sig", "sig2"]).select("id", "node")
    return members.union(sets.where("id is not null and size = 0").select("id", F.col("id").alias("node"))), near


def _as_input(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))


def pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_a, doc_b, jaccard) of all pairs of classes whose similarity is the threshold at least, each class being its least doc_id; doc_a < doc_b."""
    return class_pairs(_as_input(docs, key, text), n, threshold)[1].toDF("doc_a", "doc_b", "jaccard")


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document (doc_id, class_id, copy_of, n_links).

    ``class_id``: the least doc_id that it is connected with by links; ``copy_of``: the least doc_id with an equal set; ``n_links``: how
    many other sets are similar to its own. A document without partners is a class of its own.
    """
    members, near = class_pairs(_as_input(docs, key, text), n, threshold, counted=True)
    members = common.stored(members.groupBy("id").agg(F.collect_set("node").alias("nodes")), "members")
    same = members.where(F.size("nodes") > 1).select(F.array_min("nodes").alias("u"), F.explode("nodes").alias("v")).where("u != v")  # texts of one document
    root = common.components(near.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")).union(same))
    each = near.where("n is null").select("a", "b").distinct()
    links = near.where("b is null").select(F.col("a").alias("node"), "n").union(each.select("a", F.lit(1))).union(each.select("b", F.lit(1))).groupBy("node").agg(F.sum("n").alias("n"))
    by = common.stored(root.join(links, "node", "left").select("node", "root", F.coalesce("n", F.lit(0)).alias("n")), "linked")
    found = members.select("id", F.explode("nodes").alias("node")).join(by, "node", "left")
    found = found.groupBy("id").agg(F.min(F.coalesce("root", "node")).alias("class_id"), F.min("node").alias("copy_of"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_links"))
    return found.withColumnRenamed("id", "doc_id")


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the documents that have an earlier one (by id) in their class."""
    gone = common.stored(classes(docs, n, threshold, key, text).where("doc_id != class_id").select(F.col("doc_id").alias("id")), "copies")
    return common.by_ids(docs.withColumn(key, F.col(key)), gone, key, "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.documents(spark, sf_dir))


SQL = f"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS g FROM w WHERE len(ws) > 0),
c AS (SELECT doc_id, g, min(doc_id) OVER (PARTITION BY md5(array_to_string(g, ','))) AS node FROM s),
r AS (SELECT node, len(g) AS n, unnest(g) AS t FROM c WHERE doc_id = node),
p AS (SELECT a.node AS x, b.node AS y FROM r a JOIN r b ON a.t = b.t AND a.node < b.node AND least(a.n, b.n) >= {THRESHOLD} * greatest(a.n, b.n)
      GROUP BY a.node, b.node, a.n, b.n HAVING count(*) >= {THRESHOLD} * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
reach AS (SELECT x AS node, x AS root FROM e UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.node),
root AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
l AS (SELECT x AS node, count(*) AS n FROM e GROUP BY x)
SELECT d.doc_id, coalesce(root.root, c.node, d.doc_id) AS class_id, coalesce(c.node, d.doc_id) AS copy_of, coalesce(l.n, 0) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN root ON root.node = c.node LEFT JOIN l ON l.node = c.node
"""
