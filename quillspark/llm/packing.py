"""Best-fit packing of token sequences by a grouping genetic algorithm.

A document's tokens and one end token form an item; an item longer than a
sequence is cut into whole sequences and a rest. The rests are dealt to groups of
bounded size. A group's first packing is by best fit; where that has more sequences
than its tokens need at least, the group evolves on several islands, tasks with
populations of their own: crossover injects whole well-filled bins of one parent into
another, removes the documents they repeat, dissolves what that broke, and best-fits
the displaced documents, small ones of a bin giving way to larger ones that fill it
better. After each epoch the elite of an island, its best packing, migrates to the
next island, and its bins are injected there. The best packing of all islands counts.

Of that, bins that are full enough are settled; the documents of the others are dealt
anew with those of other groups, on fewer, equally bounded groups, until few enough
remain. How long the search goes on is bounded by the constants below; a packing with
as few sequences as its tokens need is the best there is, and ends it at once.

Defined results: a null text counts as empty and gives a piece with the end token
alone; rows with equal or null ids are packed each for itself; an empty table
gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec, read_spec
from .common import bounded_batches, materialise, pieces, release, rows_of, tidy

#: Items of a group, about; it bounds a task's work and memory.
GROUP_ITEMS = 1_500
#: Times that documents are dealt to groups; islands of a group; epochs on them.
ROUNDS, ISLANDS, EPOCHS = 3, 2, 2
POPULATION, GENERATIONS = 4, 8
#: Share of the room that a bin must fill to be settled before the last round.
ELITE_FILL = 0.998


def cut(df: DataFrame, vocabulary: str, room: int, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt): the items, cut to ``room``."""
    bounded_batches(df.sparkSession)
    spec = df.sparkSession.sparkContext.broadcast(read_spec(vocabulary))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value)
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                of, piece, length, crc = [], [], [], []
                for i, ids in enumerate(own.encode_batch(texts)):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * room)):
                        chunk = ids[a : a + 4 * room]
                        of.append(i)
                        piece.append(k)
                        length.append(len(chunk) // 4)
                        crc.append(zlib.crc32(chunk))
                k, n = np.array(piece, np.int32), np.array(length, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of, pa.int64())), pa.array(k), pa.array(k.astype(np.int64) * room), pa.array(n), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        own.rest()
        tidy()

    found = df.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
    # The marker tells equal rows apart, so that copies spread over the groups.
    return found.withColumn("salt", F.xxhash64(F.monotonically_increasing_id(), "ids_crc32"))


# -- one group ---------------------------------------------------------------

Bins = list[list[int]]


def best_fit(items: list[int], length: list[int], room: int, bins: Bins | None = None) -> Bins:
    """Puts items, the longest first, each where it leaves the least room."""
    bins = [list(b) for b in bins or []]
    free = sorted((room - sum(length[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: -length[i]):
        at = bisect_left(free, (length[i], -1))
        if at < len(free):
            left, k = free.pop(at)
            bins[k].append(i)
        else:
            left, k = room, len(bins)
            bins.append([i])
        if left > length[i]:
            insort(free, (left - length[i], k))
    return bins


def fitness(bins: Bins, length: list[int], room: int) -> tuple[int, float]:
    """Fewer bins first, then those that leave the room in fewer places."""
    return -len(bins), sum((sum(length[i] for i in b) / room) ** 2 for b in bins)


def refit(loose: list[int], length: list[int], room: int, bins: Bins) -> Bins:
    """Best-fits loose items; before that, one that fills a bin better takes the place of one or two of it."""
    bins, loose = [list(b) for b in bins], sorted(loose, key=lambda i: -length[i])
    for b in bins:
        free = room - sum(length[i] for i in b)
        if not free or not loose:
            continue
        # Of all exchanges the one that leaves the bin fullest; what gives way is smaller.
        sizes = [-length[i] for i in loose]
        best = (0, None, ())
        for out in [(i,) for i in b] + [(i, j) for n, i in enumerate(b) for j in b[:n] if len(b) <= 8]:
            given = sum(length[i] for i in out)
            k = bisect_left(sizes, -(free + given))
            if k < len(loose) and length[loose[k]] - given > best[0]:
                best = (length[loose[k]] - given, k, out)
        if best[1] is not None:
            taken = loose.pop(best[1])
            b[:] = [i for i in b if i not in best[2]] + [taken]
            for i in best[2]:
                loose.insert(bisect_left([-length[x] for x in loose], -length[i]), i)
    return best_fit(loose, length, room, bins)


def crossover(a: Bins, b: Bins, length: list[int], room: int, rng: np.random.Generator) -> Bins:
    """Injects some of b's best-filled bins into a, and repairs a."""
    filled = sorted(b, key=lambda x: -sum(length[i] for i in x))
    injected = [filled[k] for k in range(len(filled)) if k < 2 or rng.random() < 0.5 and k < len(filled) // 2]
    taken = {i for x in injected for i in x}
    whole, displaced = [], []
    for x in a:
        if taken.isdisjoint(x):
            whole.append(x)
        else:
            displaced += [i for i in x if i not in taken]
    return refit(displaced, length, room, injected + whole)


def mutate(bins: Bins, length: list[int], room: int, rng: np.random.Generator) -> Bins:
    """Dissolves the emptiest bins and a few others, and fits their items anew."""
    order = sorted(range(len(bins)), key=lambda k: sum(length[i] for i in bins[k]))
    gone = set(order[: max(1, len(bins) // 20)]) | set(rng.integers(0, len(bins), max(1, len(bins) // 20)).tolist())
    loose = [i for k in gone for i in bins[k]]
    return refit(loose, length, room, [b for k, b in enumerate(bins) if k not in gone])


def fewest(length: list[int], room: int) -> int:
    """No packing has fewer bins."""
    return max(-(-sum(length) // room), sum(2 * n > room for n in length))


def evolve(length: list[int], room: int, seed: int, elites: list[Bins], generations: int = GENERATIONS) -> Bins:
    """The best packing found from ``elites``, which may be of other islands; no packing is worse than theirs."""
    least, rng = fewest(length, room), np.random.default_rng(seed)
    people = list(elites)
    while len(people) < POPULATION:
        people.append(mutate(elites[0], length, room, rng))
    scored = sorted(((fitness(p, length, room), k, p) for k, p in enumerate(people)), key=lambda x: x[:2], reverse=True)
    for g in range(generations):
        if -scored[0][0][0] <= least:
            break
        mother, father = scored[0][2], scored[int(rng.integers(1, len(scored)))][2]
        for k, child in enumerate((crossover(mother, father, length, room, rng), mutate(crossover(father, mother, length, room, rng), length, room, rng))):
            scored.append((fitness(child, length, room), POPULATION + 2 * g + k, child))
        scored = sorted(scored, key=lambda x: x[:2], reverse=True)[:POPULATION]
    return scored[0][2]


def _ordered(table: pa.Table) -> tuple[pa.Table, list[int]]:
    """A group's rows in an order of their own, and their lengths."""
    table = table.take(pa.array(np.lexsort((table["salt"].to_numpy(), table["length"].to_numpy()))))
    return table, table["length"].to_pylist()


def _bins(numbers: np.ndarray) -> Bins:
    order = np.argsort(numbers, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1)]


def _placed(bins: Bins, length: list[int]) -> dict[str, pa.Array]:
    """For each item the number of its bin, its place there, and what the bin holds."""
    out = np.zeros((3, len(length)), np.int64)
    for k, b in enumerate(bins):
        at = 0
        for i in b:
            out[:2, i] = k, at
            at += length[i]
        out[2, b] = at
    return dict(zip(("bin", "offset", "fill"), map(pa.array, out), strict=True))


def _first(room: int):
    """A group's packing by best fit, and by how many bins it may be too large."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table, length = _ordered(table)
        bins = best_fit(list(range(len(length))), length, room)
        excess = pa.array(np.full(len(length), len(bins) - fewest(length, room)))
        columns = dict(zip(table.column_names, table.columns, strict=True))
        return pa.table(columns | {"excess": excess} | _placed(bins, length))

    return run


def _epoch(room: int, epoch: int):
    """Evolves an island's packing (bin) with that of another (guest)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table, length = _ordered(table)
        elites = [_bins(table[c].to_numpy()) for c in ("bin", "guest")]
        bins = evolve(length, room, derived(key[0].as_py(), key[1].as_py(), epoch), elites)
        few, full = fitness(bins, length, room)
        columns = {c: table[c] for c in ("group", "island", "salt", "at", "length")}
        return pa.table(columns | {"few": pa.array([-few] * len(length), pa.int64()), "full": pa.array([full] * len(length))} | _placed(bins, length))

    return run


def derived(*parts: int) -> int:
    """A seed for an island's epoch."""
    return zlib.crc32("/".join(map(str, parts)).encode())


def _evolved(packed: DataFrame, room: int, tasks: int) -> tuple[DataFrame, DataFrame]:
    """(group, salt, at, bin, offset, fill) of a better packing of each group, from several islands; and the table it reads."""
    schema = "group long, island int, salt long, at long, length long, few long, full double, bin long, offset long, fill long"
    island = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
    people, evolved = packed.select("group", island, "salt", "at", "length", "bin", F.col("bin").alias("guest")), None
    for epoch in range(EPOCHS):
        before = evolved
        # Few bytes but much work: the number of tasks is given, so that they aren't merged.
        dealt = people.repartition(tasks, "group", "island").groupBy("group", "island")
        evolved = materialise(dealt.applyInArrow(_epoch(room, epoch), schema), f"islands-{epoch}")
        if before is not None:
            release(before)
        # The elite of each island migrates to the next.
        guests = evolved.select("group", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), "salt", "at", F.col("bin").alias("guest"))
        people = evolved.select("group", "island", "salt", "at", "length", "bin").join(guests, ["group", "island", "salt", "at"])
    best = evolved.groupBy("group").agg(F.max_by("island", F.struct(-F.col("few"), "full", -F.col("island"))).alias("island"))
    return evolved.join(best, ["group", "island"], "left_semi").select("group", "salt", "at", "bin", "offset", "fill"), evolved


def pack(items: DataFrame, room: int) -> DataFrame:
    """``items`` with sequence_id and offset: as few sequences as the islands find."""
    spark = items.sparkSession
    columns = items.columns
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = items.filter(F.col("length") == room).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    left = materialise(items.filter(F.col("length") < room).withColumn("at", F.monotonically_increasing_id()), "items")
    schema = left.withColumn("group", F.lit(0).cast("long")).schema
    for name in ("excess", "bin", "offset", "fill"):
        schema = schema.add(name, "long")
    settled = [whole]
    for turn in range(ROUNDS):
        groups = max(1, round(rows_of(left) / GROUP_ITEMS))
        last = turn == ROUNDS - 1 or groups == 1
        dealt = left.withColumn("group", F.pmod(F.xxhash64("salt", F.lit(turn)), F.lit(groups)))
        tasks = max(1, min(groups, most))
        out = materialise(dealt.repartition(tasks, "group").groupBy("group").applyInArrow(_first(room), schema), f"packed-{turn}")
        release(left)
        open_groups = out.filter("excess > 0")
        if not open_groups.isEmpty():
            (better, islands), first = _evolved(open_groups, room, tasks), out
            best = open_groups.drop("excess", "bin", "offset", "fill").join(better, ["group", "salt", "at"])
            out = materialise(first.filter("excess = 0").drop("excess").unionByName(best), f"placed-{turn}")
            release(first, islands)
        # Ids of sequences: the round and the group above, the bin below.
        placed = out.withColumn("sequence_id", F.lit(turn << 60) + F.col("group") * (1 << 24) + F.col("bin"))
        done = F.lit(True) if last else F.col("fill") >= ELITE_FILL * room
        settled.append(placed.filter(done).select(*columns, "sequence_id", "offset"))
        if last:
            break
        left = materialise(placed.filter(~done).select(*columns, "at"), "items")
    return reduce(DataFrame.union, settled)


def pack_documents(df: DataFrame, vocabulary: str, room: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    return pack(materialise(cut(df, vocabulary, room, end_id), "pieces"), room).drop("salt")
