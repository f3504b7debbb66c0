"""HyperMinHash sketches, banding, verification and linking, for any kind of set.

A sketch has one register per bucket: of the values that hash into a bucket the
smallest is kept, as its count of leading zeros and the ten bits behind them.
Empty buckets borrow from filled ones in a fixed random order, so that a bucket
of two sets agrees with the probability of their Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dealt_by_part, each_part, materialise, mix, release, rows_of, small, tidy

MANTISSA_BITS = 10
#: Probability that two unrelated registers agree: a fixed value of the published
#: analysis of these sketches, for registers that saw many values.
CHANCE = 0.169919487159739 / 2**MANTISSA_BITS
#: Pairs whose estimate is this far below the threshold aren't verified. It is over
#: five standard deviations of the estimate with 100 registers.
MARGIN = 0.25
#: (key, id) pairs that a task holds before it hands them on, and that a packed part
#: holds, about.
HELD_PAIRS, PART_PAIRS = 1 << 19, 1 << 20
#: Members of one key that a task hands on to meet those of other tasks.
SENT = 3
#: Members of one key, and values of their sets, that are compared in one block.
BLOCK_MEMBERS, BLOCK_VALUES = 2_000, 400_000
#: Members of a key, and their values, that are few enough to be packed in one row;
#: values that are compared at once.
SMALL_MEMBERS, SMALL_VALUES, AT_ONCE = 256, 30_000, 1 << 19
#: Registers that are filled at once: a register takes some 60 bytes meanwhile.
SLAB = 1 << 18
_EMPTY = np.uint32(0xFFFFFFFF)


@cache
def _orders(buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the order in which it borrows, and each bucket's place in it."""
    rng = np.random.default_rng(20240229)
    order = np.argsort(rng.random((buckets, buckets)), axis=1).astype(np.int32)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(buckets, dtype=np.int32)[None, :], axis=1)
    return order, place


def least_in_buckets(values: np.ndarray, sizes: np.ndarray, buckets: int) -> np.ndarray:
    """The smallest upper half of the values in each bucket of each set; sets lie one after another, none empty."""
    n = len(sizes)
    low = values & np.uint64(0xFFFFFFFF)
    low *= np.uint64(buckets)
    low >>= np.uint64(32)
    at = low.astype(np.int64)
    at += np.repeat(np.arange(n, dtype=np.int64) * buckets, sizes)
    least = np.full(n * buckets, _EMPTY, np.uint32)
    np.minimum.at(least, at, (values >> np.uint64(32)).astype(np.uint32))
    return least


def registers(values: np.ndarray, sizes: np.ndarray, buckets: int) -> np.ndarray:
    """Registers (uint16) of sets that lie one after another in ``values``, none empty."""
    return filled(least_in_buckets(values, sizes, buckets), buckets)


def filled(least: np.ndarray, buckets: int) -> np.ndarray:
    """Registers from the least values of buckets: empty ones borrow, and all are compressed, some sets at a time."""
    step = max(SLAB // buckets, 1) * buckets
    return np.concatenate([_filled(least[i : i + step], buckets) for i in range(0, len(least), step)]) if len(least) else np.empty((0, buckets), np.uint16)


def _filled(least: np.ndarray, buckets: int) -> np.ndarray:
    order, place = _orders(buckets)
    full = least.copy()
    empty = np.flatnonzero(least == _EMPTY)
    row, own = empty // buckets, empty % buckets
    for t in range(min(16, buckets)):
        if not len(empty):
            break
        got = least[row * buckets + order[own, t]]
        full[empty] = got
        left = got == _EMPTY
        empty, row, own = empty[left], row[left], own[left]
    if len(empty):
        for r, first, last in zip(*_runs(row), strict=True):
            some = np.flatnonzero(least[r * buckets : (r + 1) * buckets] != _EMPTY)
            pick = some[place[own[first:last]][:, some].argmin(axis=1)]
            full[empty[first:last]] = least[r * buckets + pick]
    return _compressed(full).reshape(-1, buckets)


def _runs(a: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    return a[first].tolist(), first.tolist(), np.r_[first[1:], len(a)].tolist()


def _compressed(least: np.ndarray) -> np.ndarray:
    wide = least.astype(np.float64)
    zeros = 31 - np.floor(np.log2(np.maximum(wide, 1))).astype(np.int64)
    shifted = (least.astype(np.uint64) << (zeros + 1).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    mantissa = shifted >> np.uint64(32 - MANTISSA_BITS)
    return ((zeros.astype(np.uint64) << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, corrected for chance agreement."""
    return ((a == b).mean(axis=-1) - CHANCE) / (1 - CHANCE)


def band_keys(regs: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch, as signed integers."""
    n, rows = len(regs), regs.shape[1] // bands
    part = regs[:, : bands * rows].reshape(n, bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
    for r in range(0, rows, 3):
        for k in range(r, min(r + 3, rows)):
            key = (key << np.uint64(16)) ^ part[:, :, k] if k > r else key ^ part[:, :, k]
        key = mix(key, r + 1)
    return key.view(np.int64)


class Dealer:
    """Gathers (key, id) pairs and deals them out in packed rows (part, own, pairs) by key.

    Of the ids that a key has in one task's share, only SENT go on to meet those of
    other tasks; the rest are tied to the smallest of them here and go out as
    finished members (own), to parts in turn. So a key that very many ids share sends
    a bounded number of rows from each share to the part of the key.
    """

    def __init__(self, parts: int):
        self.parts, self.keys, self.ids, self.n, self.turn = parts, [], [], 0, 0

    def add(self, keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys.ravel())
        self.ids.append(np.repeat(ids, keys.shape[1]))
        self.n += keys.size
        if self.n >= HELD_PAIRS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        keys, ids = np.concatenate(self.keys), np.concatenate(self.ids)
        self.keys, self.ids, self.n = [], [], 0
        # Ordered by their bits without sign, keys are ordered by part as well.
        order = np.argsort(keys.view(np.uint64))
        keys, ids = keys[order], ids[order]
        again = keys[1:] == keys[:-1]
        met = np.r_[again, False] | np.r_[False, again]
        key, own, rank, lo, _ = _ranked(keys[met], ids[met])
        sent = rank < SENT
        keys, ids = np.r_[keys[~met], key[sent]], np.r_[ids[~met], own[sent]]
        order = np.argsort(keys.view(np.uint64))
        keys, ids = keys[order], ids[order]
        part, first, last = _runs((((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(self.parts)) >> np.uint64(32)).astype(np.int32))
        packed = [np.concatenate([keys[a:b], ids[a:b]]).astype("<i8").tobytes() for a, b in zip(first, last, strict=True)]
        flags = [False] * len(part)
        if not sent.all():
            self.turn += 1
            part.append(int((int(key[0]) + self.turn) % self.parts))
            packed.append(np.concatenate([key[~sent], own[~sent], lo[~sent]]).astype("<i8").tobytes())
            flags.append(True)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(flags), pa.array(packed, pa.binary())], ["part", "own", "pairs"])


def _ranked(key: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, id) pairs in order, each with its rank in its key, the key's smallest id and number of ids."""
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    once = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])][: len(key)]
    key, own = key[once], own[once]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    count = np.diff(np.r_[first, len(key)])
    return key, own, np.arange(len(key)) - np.repeat(first, count), np.repeat(own[first], count), np.repeat(count, count)


DEALT = "part int, own boolean, pairs binary"


def members(dealt: DataFrame, parts: int) -> DataFrame:
    """(key, id, lo): ties of each id of a key to a smaller id of it, so that they join all ids of the key.

    A key of two ids has one tie, and nothing else to compare; its key is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in each_part(batches):
            keys, ids = [], []
            for batch in part:
                for own, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    table = np.frombuffer(blob.as_buffer(), "<i8").reshape(3 if own else 2, -1)
                    if own:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in table], ["key", "id", "lo"])
                    else:
                        keys.append(table[0])
                        ids.append(table[1])
            if keys:
                yield from _ties(np.concatenate(keys), np.concatenate(ids))
        tidy()

    return dealt_by_part(dealt, parts).mapInArrow(run, "key long, id long, lo long")


def _ties(key: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(key)
    key, own = key[order], own[order]
    again = key[1:] == key[:-1]
    met = np.r_[again, False] | np.r_[False, again]
    key, own, rank, lo, count = _ranked(key[met], own[met])
    tied = rank > 0
    key, own, lo, count = key[tied], own[tied], lo[tied], count[tied]
    for a in range(0, len(key), 1 << 16):
        cut = slice(a, a + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(key[cut], pa.int64(), mask=count[cut] == 2), pa.array(own[cut], pa.int64()), pa.array(lo[cut], pa.int64())], ["key", "id", "lo"])


#: Makes the values of sets, one after another and perhaps repeated, and their numbers,
#: of the items that stand for them.
Values = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def similar(x: np.ndarray, sizes_x: np.ndarray, y: np.ndarray, sizes_y: np.ndarray, percent: int) -> np.ndarray:
    """Whether each pair of up to 512 sets has 100 * intersection >= percent * union.

    One sort brings together what is equal: a value's upper 54 bits, then the pair,
    then its side.
    """
    n = len(sizes_x)
    side = np.r_[np.repeat(np.arange(n) * 2, sizes_x), np.repeat(np.arange(n) * 2 + 1, sizes_y)].astype(np.uint64)
    w = (np.concatenate([x, y]) & ~np.uint64(1023)) | side
    w.sort()
    w = w[np.r_[True, w[1:] != w[:-1]][: len(w)]]
    side = (w & np.uint64(1023)).astype(np.int64)
    w >>= np.uint64(1)
    sizes = np.bincount(side, minlength=2 * n)
    shared = np.bincount(side[:-1][w[1:] == w[:-1]] >> 1, minlength=n)
    return 100 * shared >= percent * (sizes[::2] + sizes[1::2] - shared)


def _slices(sizes: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """First and last row, exclusive, of slices that hold about ``most`` and ``rows`` rows at most."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = int(ends[start - 1]) if start else 0
        stop = min(max(start + 1, int(np.searchsorted(ends, before + most, "right"))), start + rows, len(sizes))
        yield start, stop
        start = stop


def verify(pairs: DataFrame, sets: DataFrame, percent: int, values: Values) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union.

    ``sets`` has id, n, regs and item, of which ``values`` makes 64-bit values, n at
    most. Pairs whose corrected estimate is far below the threshold are left out
    first; regs may be null, which leaves none out.
    """
    least = percent / 100 - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, last in _slices(whole.column(2).to_numpy(), AT_ONCE, 512):
                batch = whole.slice(first, last - first)
                if not batch.column(3).null_count:
                    left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (3, 4))
                    batch = batch.take(pa.array(np.flatnonzero(estimate(left, right) >= least)))
                near = similar(*values(batch.column(5).to_pylist()), *values(batch.column(6).to_pylist()), percent)
                yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
        tidy()

    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"), F.col("item").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"), F.col("item").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "ra", "rb", "sa", "sb")
    return joined.mapInArrow(run, "a long, b long")


def _sets(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct values of each set."""
    return [np.unique(x) for x in np.split(flat, np.cumsum(sizes)[:-1])] if len(sizes) else []


def _across(percent: int, values: Values):
    """Links between two blocks of one key's members that join components.

    Each member of the first block counts, by one look-up of its values among the
    second's, what it shares with every member of that. A link of each pair of
    components is enough, so few rows leave the block.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        of = table.filter(pa.array(side == 0)), table.filter(pa.array(side == (1 if (side == 1).any() else 0)))
        (ids, comps, sets), (others, their, known) = ((t["id"].to_numpy(), t["c"].to_numpy(), _sets(*values(t["item"].to_pylist()))) for t in of)
        sizes = np.array([len(x) for x in known], np.int64)
        owner = np.repeat(np.arange(len(known), dtype=np.int32), sizes)
        flat = np.concatenate([np.empty(0, np.uint64), *known])
        order = np.argsort(flat)
        flat, owner = flat[order], owner[order]
        parent = {c: c for c in [*comps.tolist(), *their.tolist()]}

        def root(x: int) -> int:
            while parent[x] != x:
                x = parent[x]
            return x

        a, b = [], []
        for i, own in enumerate(sets):
            first, last = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            many = last - first
            at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
            shared = np.bincount(owner[at], minlength=len(known))
            near = np.flatnonzero((100 * shared >= percent * (sizes + len(own) - shared)) & (their != comps[i]))
            for c, k in zip(*np.unique(their[near], return_index=True), strict=True):
                x, y = root(int(comps[i])), root(int(c))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    a.append(max(ids[i], others[near[k]]))
                    b.append(min(ids[i], others[near[k]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _across_small(percent: int, values: Values):
    """The same for many small groups: rows hold a key's members as lists.

    What two members share is a product of the group's table of members by values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, last in _slices(whole.column(0).to_numpy(), AT_ONCE, 1 << 30):
                lists = whole.column(1).slice(first, last - first)
                flat = lists.flatten()
                ids, comps = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                found, sizes = values(flat.field(2).to_pylist())
                ends, at = np.r_[0, np.cumsum(sizes)], np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
                a, b = [], []
                for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    for i, j in _links(found[ends[x] : ends[y]], sizes[x:y], comps[x:y], percent):
                        a.append(max(ids[x + i], ids[x + j]))
                        b.append(min(ids[x + i], ids[x + j]))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        tidy()

    return run


def _links(flat: np.ndarray, sizes: np.ndarray, comps: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of members of different components, as many as join these."""
    n = len(sizes)
    _, value = np.unique(flat, return_inverse=True)
    table = np.zeros((n, value.max() + 1), np.float32)
    table[np.repeat(np.arange(n), sizes), value] = 1
    shared = (table @ table.T).astype(np.int64)
    size = np.diag(shared)
    near = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
    near &= comps[:, None] != comps[None, :]
    out, label = [], comps.copy()
    for i, j in zip(*np.nonzero(np.triu(near)), strict=True):
        if label[i] != label[j]:
            label[label == label[i]] = label[j]
            out.append((int(i), int(j)))
    return out


def _component(df: DataFrame, of: str, groups: DataFrame, name: str) -> DataFrame:
    """``df`` with the component of column ``of``, itself if it has none."""
    named = small(groups).select(F.col("node").alias(of), F.col("component").alias(name))
    return df.join(named, of, "left").withColumn(name, F.coalesce(name, of))


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) of two components."""
    return _component(_component(pairs, "a", groups, "c"), "b", groups, "d").filter("c <> d").select("a", "b")


def _blocks(rest: DataFrame) -> DataFrame:
    """(key, i, j, side, id, c): which members of a key are compared in which pair of blocks.

    The members of a key's largest component, which need no comparison with one
    another, lie in blocks of one kind, all others in blocks of the other kind; each
    block of others meets each block of the largest, and each block of others.
    """
    per = rest.groupBy("key", "c").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    key = per.groupBy("key").agg(F.max(F.struct("m", "c")).alias("top"), F.sum("m").alias("m"), F.sum("total").alias("total"), F.sum(F.lit(1)).alias("comps"), F.max_by("total", F.struct("m", "c")).alias("top_total"))

    def number(m, total):
        return F.greatest(F.ceil(m / BLOCK_MEMBERS), F.ceil(total / BLOCK_VALUES), F.lit(1)).cast("int")

    wide = number(F.col("top.m"), F.col("top_total")).alias("wide")
    others = number(F.col("m") - F.col("top.m"), F.col("total") - F.col("top_total")).alias("others")
    keys = key.filter("comps > 1 AND m > 2").select("key", F.col("top.c").alias("top"), wide, others, ((F.col("total") <= SMALL_VALUES) & (F.col("m") <= SMALL_MEMBERS)).alias("small"))
    rows = rest.join(keys, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("c") == F.col("top"), F.col("wide")).otherwise(F.col("others"))).cast("int"))
    # Blocks of others are numbered from 0, those of the largest component from -1 down.
    every = F.sequence(F.lit(0), F.col("others") - 1)
    least, greatest = F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j")
    top = rows.filter("NOT small AND c = top").select("key", "id", "c", F.explode(every).alias("i"), (-1 - F.col("own")).alias("j"), F.lit(1).alias("side"))
    to_top = rows.filter("NOT small AND c <> top").select("key", "id", "c", F.col("own").alias("i"), F.explode(F.sequence(F.lit(-1), -F.col("wide"))).alias("j"), F.lit(0).alias("side"))
    among = rows.filter("NOT small AND c <> top").withColumn("x", F.explode(every)).select("key", "id", "c", least, greatest, (F.col("own") > F.col("x")).cast("int").alias("side"))
    # Small groups are known by their members: the same under many keys are compared once.
    each = rows.filter("small").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "c"))).alias("all")).select("all").distinct()
    each = each.select(F.xxhash64("all").alias("key"), F.explode("all").alias("x"))
    few = each.select("key", "x.id", "x.c", F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j"), F.lit(0).alias("side"))
    return top.union(to_top).union(among).union(few)


def linked(dealt: DataFrame, parts: int, sets_of: Callable[[DataFrame], DataFrame], values: Values, percent: int, name: str) -> DataFrame:
    """(node, component) of every id that has a link, from packed band pairs.

    First each id is verified against one other, the smallest it is tied to; that
    settles groups of copies with one pair a member. Next come its other ties, where
    they are of another component. Then, wherever a key still holds several
    components, the members of these are verified against each other in blocks of
    bounded size, which give only the links that join components; so no link that
    banding finds is lost. ``sets_of`` gives (id, n, regs, item) of ids: a bound of a
    set's size, its sketch, and what ``values`` makes its values of.
    """
    found = materialise(members(dealt, parts), f"{name}-members")
    # At most a tie for each band and share of a task that an id is in.
    ties = materialise(found.groupBy(F.col("id").alias("a")).agg(F.array_sort(F.collect_set("lo")).alias("los")), f"{name}-ties")
    pairs = ties.select("a", F.col("los")[0].alias("b"))
    every = ties.select("a", F.explode("los").alias("b"))
    ids = materialise(ties.select("a").union(every.select("b").distinct()).distinct().toDF("id"), f"{name}-ids")
    sets = materialise(sets_of(ids), f"{name}-sets")
    edges = materialise(verify(pairs, sets, percent, values), f"{name}-edges")
    groups = components(edges, f"{name}-groups")

    def joined(more: DataFrame, groups: DataFrame) -> DataFrame:
        if not rows_of(more):
            return groups
        both = materialise(groups.filter("node <> component").toDF("a", "b").union(more), f"{name}-edges")
        out = components(both, f"{name}-groups")
        release(both, groups)
        return out

    others = ties.filter("size(los) > 1").select("a", F.explode(F.slice("los", 2, 1 << 30)).alias("b"))
    more = materialise(verify(_apart(others, groups), sets, percent, values), f"{name}-more")
    release(edges)
    groups = joined(more, groups)
    release(more)
    failed = materialise(_apart(every, groups), f"{name}-failed")
    if rows_of(failed):
        keyed = found.filter("key IS NOT NULL").withColumnsRenamed({"id": "a", "lo": "b"})
        mixed = materialise(keyed.join(small(failed), ["a", "b"], "left_semi").select("key").distinct(), f"{name}-mixed")
        ends = keyed.join(small(mixed), "key", "left_semi")
        rest = ends.select("key", F.col("a").alias("id")).union(ends.select("key", F.col("b").alias("id"))).distinct()
        rest = materialise(_component(rest, "id", groups, "c").join(sets.select("id", "n"), "id"), f"{name}-rest")
        blocks = materialise(_blocks(rest), f"{name}-blocks")
        rows = blocks.join(sets.select("id", "n", "item"), "id")
        packed = rows.filter("i IS NULL").groupBy("key").agg(F.sum("n").alias("n"), F.collect_list(F.struct("id", "c", "item")).alias("members")).select("n", "members")
        large = rows.filter("i IS NOT NULL").groupBy("key", "i", "j").applyInArrow(_across(percent, values), "a long, b long")
        across = materialise(packed.mapInArrow(_across_small(percent, values), "a long, b long").union(large), f"{name}-across")
        groups = joined(across, groups)
        release(mixed, rest, blocks, across)
    release(found, ties, ids, sets, failed)
    return groups
