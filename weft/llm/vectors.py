"""Most similar vectors by cross-polytope hashing with multiprobe tables.

Equal vectors form a class; only classes are hashed and compared. A pseudo-rotation H D3 H D2 H D1 (H
the Hadamard matrix, applied as a fast transform, D random signs) is applied to the unit vector, and the
vector is assigned to the nearest signed axis. A table's key joins several such assignments, the last of
them over fewer axes, so that a key has a number of bits that grows with the logarithm of the group's
size and a cell holds about ``FILL`` classes at every size. Each query also probes the cells that lose
least by taking farther axes; their number grows with a power below 1 of the group's size, which keeps
the recall while the share of the collection that is compared falls.

All bits of a key but the last seven route a row to a task, and the last seven (the fine code) say which
of the task's cells are compared. A query travels once to each routed cell with a bitmap of the fine
codes it probes there. 8-bit copies of the vectors are compared, each with a scale of its own and the
length of its rounding error. The product of two copies differs from that of the vectors by at most the
sum of the two errors and their product, so each query keeps all that can be among its k best, without
loss, and these are ranked exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from weft.runtime import stage

#: Classes a cell is meant to hold.
FILL = 10
#: Stored vectors of a routed cell that one task compares with the cell's queries; fuller ones are split.
CELL = 4096
#: Split cells whose list may be broadcast; a longer list is joined by a shuffle.
FEW = 10_000
#: Bits of one assignment: 64 signed axes at most.
WIDEST = 7
#: More than the error of sums in single precision, for vectors of up to 1,000 numbers.
ROUNDING = 1e-4


def _radices(d: int) -> list[int]:
    out = []
    while d > 1:
        out.append(min(8, d))
        d //= out[-1]
    return out


def _matrix(r: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < r:
        h = np.block([[h, h], [h, -h]])
    return (h / np.sqrt(r)).astype(np.float32)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis, scaled to keep lengths, by factors of up to 8:
    d (8 + 8 + ...) operations a vector instead of d * d."""
    shape, d = x.shape, x.shape[-1]
    for r in _radices(d):  # each step transforms the last factor and turns it to the front
        x = (x.reshape(-1, r) @ _matrix(r)).reshape(-1, d // r, r).swapaxes(1, 2)
        x = np.ascontiguousarray(x)
    return x.reshape(shape)


def key_bits(group_size: int) -> int:
    """Bits of a table's key for a group of so many classes."""
    return max(1, round(math.log2(max(2, group_size / FILL))))


class CrossPolytope:
    """``tables`` hash tables over unit vectors of ``dim`` numbers.

    A query probes ``probes`` cells of a table with keys of 14 bits and 2^``growth`` times as many with
    each further bit (as many fewer with each bit less, but not below four).
    """

    def __init__(self, dim: int, tables: int, probes: int, growth: float, seed: int = 3) -> None:
        self.dim, self.tables, self.probes, self.growth, self.seed = dim, tables, probes, growth, seed
        self.axes = 1 << max(0, dim - 1).bit_length()

    def parts(self, bits: int) -> list[int]:
        """Bits of a key's assignments; the last one is the fine code."""
        widest = min(WIDEST, self.axes.bit_length())
        fine = min(widest, bits)
        coarse, left = [], bits - fine
        while left > 0:
            coarse.append(min(widest, left))
            left -= coarse[-1]
        return [*coarse, fine]

    def n_probes(self, bits: int) -> int:
        return max(4, round(self.probes * 2 ** (self.growth * (bits - 14))))

    def n_routes(self, bits: int) -> int:
        """Routed cells of a table that a query travels to; its probes lie in these."""
        return max(6, self.n_probes(bits) // 64)

    def turned(self, unit: np.ndarray, part: int, bits: int) -> np.ndarray:
        """(n, tables, signed axes): the coordinates that the part's assignment looks at."""
        signs = np.random.default_rng([self.seed, part]).choice(np.array([-1, 1], np.float32), (3, self.tables, self.axes))
        x = np.zeros((len(unit), 1, self.axes), np.float32)
        x[:, 0, : self.dim] = unit
        for s in signs:
            x = hadamard(x * s)
        x = x[:, :, : max(1, 1 << bits - 1)]
        return np.concatenate((x, -x), 2)

    def keys(self, unit: np.ndarray, bits: int, fine: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(n, tables) coarse and fine codes of stored vectors."""
        key, code = np.zeros((len(unit), self.tables), np.int64), None
        parts = self.parts(bits)
        for p, b in enumerate(parts if fine else parts[:-1]):
            code = self.turned(unit, p, b).argmax(-1)
            if p < len(parts) - 1:
                key = key << b | code
        return key, code

    def probed(self, unit: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(n, tables, probes) coarse and fine codes of the cells that lose least, in no order."""
        n, parts = len(unit), self.parts(bits)
        key = fine = np.zeros((n, self.tables, 1), np.int64)
        loss = np.zeros((n, self.tables, 1), np.float32)
        for p, b in enumerate(parts):
            y, most = self.turned(unit, p, b), self.n_probes(bits) if p == len(parts) - 1 else self.n_routes(bits)
            near = min(y.shape[-1], most)
            code = np.argpartition(-y, near - 1, -1)[..., :near] if near < y.shape[-1] else np.broadcast_to(np.arange(near), y.shape)
            size = np.take_along_axis(y, code, -1)
            lost = (y.max(-1, keepdims=True) - size) ** 2
            wide = lambda a, b: (a[..., :, None] + b[..., None, :]).reshape(n, self.tables, -1)
            loss = wide(loss, lost)
            if p < len(parts) - 1:
                key = wide(key << b, code)
            else:
                key, fine = wide(key, np.zeros_like(code)), wide(np.zeros_like(key), code)
            if loss.shape[-1] > most:
                keep = np.argpartition(loss, most - 1, -1)[..., :most]
                key, loss = np.take_along_axis(key, keep, -1), np.take_along_axis(loss, keep, -1)
                fine = np.take_along_axis(fine, keep, -1) if fine.shape[-1] > 1 else fine
        return key, fine


def _mixed(group: np.ndarray, table: np.ndarray, bits: np.ndarray, code: np.ndarray) -> np.ndarray:
    """One 64-bit key for a routed cell of a group."""
    h = group.astype(np.uint64)
    for part in (table * 64 + bits, code):
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def _unit(column: pa.ListArray, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def small_copies(unit: np.ndarray) -> np.ndarray:
    """8-bit copies of unit vectors as bytes, with scale and error: n rows of d + 8 bytes."""
    scale = (np.abs(unit).max(1) / 127).astype(np.float32)
    copy = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((copy * scale[:, None].astype(np.float64) - unit) ** 2).sum(1)).astype(np.float32)
    return np.concatenate((copy.view(np.uint8), scale[:, None].view(np.uint8), error[:, None].view(np.uint8)), 1)


def from_copies(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors and the errors of copies."""
    d = rows.shape[1] - 8
    scale, error = (np.ascontiguousarray(rows[:, a : a + 4]).view(np.float32)[:, 0] for a in (d, d + 4))
    return np.ascontiguousarray(rows[:, :d]).view(np.int8).astype(np.float32) * scale[:, None], error


def _packed(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    data = np.ascontiguousarray(rows)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.py_buffer(data)])


def _unpacked(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(column), -1)


_ROUTED = "key long, role int, cid long, fine int, probes binary, vec binary"
_NOTHING = np.zeros(16, np.uint8)


def _route(index: CrossPolytope, counting: bool):
    """Rows of the routed cells. role: 0 stored, 1 query, 2 both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_bits = batch.column("bits").to_numpy()
            for bits in np.unique(all_bits).tolist():
                part = batch.filter(pa.array(all_bits == bits))
                unit, group = _unit(part.column("embedding"), index.dim), part.column("group").to_numpy()
                n, tables = len(unit), np.arange(index.tables)
                coarse, fine = index.keys(unit, bits, not counting)
                key = _mixed(group[:, None], tables, np.int64(bits), coarse)
                if counting:
                    yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1))], ["key"])
                    continue
                vec, cid = small_copies(unit), part.column("cid").to_numpy()
                asks = np.flatnonzero(part.column("asks").to_numpy(zero_copy_only=False))
                probes = np.zeros((n, index.tables, 16), np.uint8)
                role = np.zeros((n, index.tables), np.int32)
                if len(asks):
                    k, f = index.probed(unit[asks], bits)
                    row = np.broadcast_to(np.arange(len(asks))[:, None, None], k.shape).reshape(-1)
                    table = np.broadcast_to(tables[:, None], k.shape).reshape(-1)
                    k, f = k.reshape(-1), np.broadcast_to(f, k.shape).reshape(-1)
                    order = np.lexsort((k, table, row))
                    row, table, k, f = row[order], table[order], k[order], f[order]
                    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (table[1:] != table[:-1]) | (k[1:] != k[:-1])])
                    maps = np.zeros((len(first), 16), np.uint8)
                    of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(k)]))
                    np.bitwise_or.at(maps, (of, f >> 3), (1 << (f & 7)).astype(np.uint8))
                    row, table, k = asks[row[first]], table[first], k[first]
                    home = k == coarse[row, table]
                    probes[row[home], table[home]] = maps[home]
                    role[row[home], table[home]] = 2
                    away = ~home
                    if away.any():
                        yield _rows(_mixed(group[row[away]], table[away], np.int64(bits), k[away]), np.ones(away.sum(), np.int32), cid[row[away]], np.zeros(away.sum(), np.int32), maps[away], vec[row[away]])
                own = np.repeat(np.arange(n), index.tables)
                yield _rows(key.reshape(-1), role.reshape(-1), cid[own], fine.reshape(-1).astype(np.int32), probes.reshape(-1, 16), vec[own])

    return run


def _rows(key, role, cid, fine, probes, vec) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(role, pa.int32()), pa.array(cid, pa.int64()), pa.array(fine, pa.int32()), _packed(probes), _packed(vec)],
        ["key", "role", "cid", "fine", "probes", "vec"],
    )


class _Cell:
    """The stored vectors of one routed cell, in the order of their fine codes."""

    #: Queries that are compared at once.
    MANY = 4096

    def __init__(self, k: int, least: float) -> None:
        self.k, self.least = k, least
        self.stored: list[tuple] = []
        self.asking: list[tuple] = []
        self.waiting = 0
        self.vec = None

    def add(self, vec, cid, fine) -> None:
        self.stored.append((vec, cid, fine))

    def ask(self, vec, cid, probes) -> Iterator[tuple]:
        """Queries wait until there are many, or until all stored vectors are here."""
        self.asking.append((vec, cid, probes))
        self.waiting += len(cid)
        if self.vec is not None and self.waiting >= self.MANY:
            yield from self.answer()

    def settle(self) -> None:
        """All stored vectors are here."""
        if self.vec is None and self.stored:
            vec, cid, fine = (np.concatenate(x) for x in zip(*self.stored))
            order = np.lexsort((cid, fine))
            order = order[np.r_[True, cid[order][1:] != cid[order][:-1]]] if len(order) else order
            self.cid = cid[order]
            self.vec, self.error = from_copies(vec[order])
            self.begin = np.searchsorted(fine[order], np.arange(129))
            self.stored = []

    def answer(self) -> Iterator[tuple]:
        if self.asking and self.vec is not None:
            vec, cid, probes = (np.concatenate(x) for x in zip(*self.asking))
            for i in range(0, len(cid), self.MANY):
                part = slice(i, i + self.MANY)
                yield self.best(*from_copies(vec[part]), cid[part], probes[part])
        self.asking, self.waiting = [], 0

    def best(self, queries: np.ndarray, error: np.ndarray, asked: np.ndarray, probes: np.ndarray) -> tuple:
        """Pairs of a query and a stored vector that can be among the query's k best, with the least and
        the greatest similarity they can have."""
        fine, own = np.nonzero(np.unpackbits(probes, axis=1, bitorder="little").T)
        edge = np.searchsorted(fine, np.arange(129))
        found = []
        for f in range(128):
            at, to = self.begin[f], self.begin[f + 1]
            rows = own[edge[f] : edge[f + 1]]
            if at == to or not len(rows):
                continue
            s = queries[rows] @ self.vec[at:to].T
            off = error[rows][:, None] * (1 + self.error[at:to]) + self.error[at:to] + ROUNDING
            s[asked[rows][:, None] == self.cid[at:to]] = -9
            floor = np.full(len(s), max(self.least, -8.0), np.float32)
            if to - at > self.k:
                floor = np.maximum(floor, np.partition(s - off, to - at - self.k, axis=1)[:, to - at - self.k])
            q, t = np.nonzero(s + off >= floor[:, None])
            found.append((rows[q], t + at, s[q, t], off[q, t]))
        if not found:
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.float32),) * 2
        q, t, s, off = (np.concatenate(x) for x in zip(*found))
        return _reduced([(asked[q], self.cid[t], s - off, s + off)], self.k)


def _compare(k: int, least: float):
    """Groups arrive sorted by (key, salt), stored vectors before pure queries; the queries are
    compared as they stream past, so only one cell's stored vectors are held. What a query found in
    several cells of a task is reduced to its best before it leaves, in portions of ``_HELD`` pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, _Cell(k, least)
        kept: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, salt, role, cid, fine = (batch.column(c).to_numpy() for c in ("key", "salt", "role", "cid", "fine"))
            vec, probes = _unpacked(batch.column("vec")), _unpacked(batch.column("probes"))
            cut = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1
            out: list[tuple] = []
            for begin, end in zip([0, *cut], [*cut, len(key)]):
                if (key[begin], salt[begin]) != now:
                    cell.settle()
                    out.extend(cell.answer())
                    now, cell = (key[begin], salt[begin]), _Cell(k, least)
                pure = begin + int((role[begin:end] != 1).sum())
                if pure > begin:
                    cell.add(vec[begin:pure], cid[begin:pure], fine[begin:pure])
                    both = begin + np.flatnonzero(role[begin:pure] == 2)
                    if len(both):
                        out.extend(cell.ask(vec[both], cid[both], probes[both]))
                if pure < end:
                    cell.settle()
                    out.extend(cell.ask(vec[pure:end], cid[pure:end], probes[pure:end]))
            kept += out
            if sum(len(x[0]) for x in kept) > _HELD:
                kept = [_reduced(kept, k)]
                if len(kept[0][0]) > _HELD // 2:
                    yield _pairs(*kept.pop())
        cell.settle()
        kept += cell.answer()
        if kept:
            yield _pairs(*_reduced(kept, k))

    return run


_HELD = 1_000_000


def _reduced(found: list[tuple], k: int) -> tuple:
    """The pairs once each, and of each query only those that can be among its k best."""
    a, b, low, high = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((b, a))
    order = order[np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]] if len(order) else order
    order = order[np.lexsort((-low[order], a[order]))]
    a, b, low, high = a[order], b[order], low[order], high[order]
    if not len(a):
        return a, b, low, high
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    size = np.diff(np.r_[first, len(a)])
    kth = np.where(size >= k, low[np.minimum(first + k - 1, len(a) - 1)], -9)
    keep = high >= np.repeat(kth, size)
    return a[keep], b[keep], low[keep], high[keep]


def _pairs(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(low, pa.float32()), pa.array(high, pa.float32())], ["a", "b", "low", "high"])


def _cosine(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cos = (_unit(batch.column("x"), dim) * _unit(batch.column("y"), dim)).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("q"), pa.array(cos)], ["p", "q", "similarity"])

    return run


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows with an id and a group whose embedding has exactly ``dim`` finite numbers, not all zero."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return vectors.select(
        F.col("id").cast("string").alias("id"), F.col("grp").cast("string").alias("grp"), F.col("embedding").cast("array<float>").alias("embedding")
    ).filter(F.col("id").isNotNull() & F.col("grp").isNotNull() & (F.size("embedding") == dim) & ~bad & some)


def _spread(cells: DataFrame, hot: DataFrame, few: int) -> DataFrame:
    """The rows with a salt: stored rows of a split cell go to one of its parts, queries to all."""
    cells = cells.join(F.broadcast(hot) if few <= FEW else hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    at, every = F.pmod("cid", F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    one = lambda salt, role: F.array(F.struct(salt.alias("salt"), role.alias("role")))
    asked = F.transform(every, lambda s: F.struct(s.alias("salt"), F.lit(1).alias("role")))
    spread = (
        F.when(F.col("parts") == 1, one(F.lit(0), F.col("role")))
        .when(F.col("role") == 0, one(at, F.lit(0)))
        .when(F.col("role") == 1, asked)
        .otherwise(F.concat(one(at, F.lit(0)), asked))
    )
    return cells.select("key", "cid", "fine", "probes", "vec", F.explode(spread).alias("s")).select("key", "s.salt", "s.role", "cid", "fine", "probes", "vec")


def similar_vectors(
    vectors: DataFrame, k: int, dim: int = 64, least: float = -1.0, tables: int = 8, probes: int = 200, growth: float = 0.5, asks=None
) -> DataFrame:
    """(a, b, similarity, rank): the k vectors b of the same group most similar to each vector a.

    ``vectors`` has id, grp and embedding. Only pairs of cosine similarity ``least`` or more count.
    ``asks`` is a column on id that says which vectors are queries (all of them if None). Rank is from
    1, ties are by id. Null or unusable vectors are left out; of several rows of an id the one with the
    least group and vector hash stands; an empty table gives an empty result.

    Of a class of equal vectors only the k + 1 least ids can be among the most similar to anything, so
    the output grows with the number of queries however many copies there are.
    """
    both = ["cid", "check"]
    rows = usable(vectors, dim).withColumns({"cid": F.xxhash64("grp", "embedding"), "check": F.xxhash64(F.lit(7), "embedding", "grp")})
    # An id with vectors of its own is the rule; the least of late rows with other values stands.
    ids = rows.groupBy("id").agg(F.min(F.struct(*both)).alias("c")).select("id", *(F.col(f"c.{x}").alias(x) for x in both))
    ids = stage(ids.withColumn("asks", F.lit(True) if asks is None else asks), "ids")
    place = F.row_number().over(W.partitionBy(*both).orderBy("id"))
    heads = ids.withColumn("place", place).filter(F.col("place") <= k + 1).select(*both, "id")
    owned = ids.groupBy(*both).agg(F.count("*").alias("copies"), F.max("asks").alias("asks"))
    classes = rows.groupBy(*both).agg(F.min("grp").alias("grp"), F.first("embedding").alias("embedding"))  # equal in all rows
    classes = stage(classes.join(owned, both), "classes")

    sizes = classes.groupBy("grp").agg(F.count("*").alias("size"))
    bits = F.greatest(F.lit(1), F.round(F.log2(F.greatest(F.lit(2.0), F.col("size") / FILL)))).cast("int")
    sizes = stage(sizes.select("grp", bits.alias("bits"), "size"), "sizes")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    index = CrossPolytope(dim, tables, probes, growth)
    narrow = classes.join(sizes.select("grp", "bits"), "grp").select("cid", "bits", F.xxhash64("grp").alias("group"), "embedding", "asks")
    counts = narrow.mapInArrow(_route(index, True), "key long").groupBy("key").count()
    hot = stage(counts.filter(F.col("count") > CELL).select("key", F.ceil(F.col("count") / CELL).cast("int").alias("parts")), "hot")
    few = hot.limit(FEW + 1).count()
    cells = narrow.mapInArrow(_route(index, False), _ROUTED)
    cells = _spread(cells, hot, few) if few else cells.select("key", F.lit(0).alias("salt"), "role", "cid", "fine", "probes", "vec")
    # About 100,000 routed rows a task at every size.
    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), total * tables * 2 // 100_000)
    cells = cells.repartition(tasks, "key", "salt").sortWithinPartitions("key", "salt", F.col("role") == 1)
    pairs = cells.mapInArrow(_compare(k, least), "a long, b long, low float, high float").groupBy("a", "b").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    # Only classes that can be among a query's k best are ranked exactly.
    own = W.partitionBy("a")
    pairs = pairs.withColumn("place", F.row_number().over(own.orderBy(F.col("low").desc())))
    kth = F.max(F.when(F.col("place") == k, F.col("low"))).over(own)
    pairs = pairs.withColumn("kth", kth).filter(F.coalesce(F.col("high") >= F.col("kth"), F.lit(True)))
    pairs = pairs.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct()
    held = classes.select("cid", "embedding")
    pairs = pairs.join(held.toDF("p", "x"), "p").join(held.toDF("q", "y"), "q")
    scored = stage(pairs.mapInArrow(_cosine(dim), "p long, q long, similarity double").filter(F.col("similarity") >= least), "scored")

    ends = scored.select("similarity", F.explode(F.array(F.struct(F.col("p").alias("a"), F.col("q").alias("b")), F.struct(F.col("q").alias("a"), F.col("p").alias("b")))).alias("e"))
    ends = ends.select("e.a", "e.b", "similarity").unionByName(classes.filter("copies > 1").select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(1.0).alias("similarity")))
    ends = ends.join(classes.filter("asks").select(F.col("cid").alias("a")), "a", "left_semi")
    ends = ends.join(heads.select(F.col("cid").alias("b"), "id"), "b")
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.col("similarity").desc(), "id"))
    best = ends.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    lists = best.groupBy(F.col("a").alias("cid")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "similarity"))).alias("near"))
    # A row of the class list meets all copies; a class with very many is split by the adaptive skew join.
    asked = ids.filter("asks").select(F.col("id").alias("a"), "cid").join(lists, "cid")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("a")), 1, k)
    return asked.select("a", F.posexplode(others).alias("no", "e")).select("a", F.col("e.id").alias("b"), "e.similarity", (F.col("no") + 1).alias("rank"))


def recall(ranked: DataFrame, exact: DataFrame) -> DataFrame:
    """(grp, queries, recall): the share of the exact neighbours (a, b, grp) that ``ranked`` (a, b) has."""
    found = exact.join(ranked.select("a", "b").withColumn("found", F.lit(1)), ["a", "b"], "left")
    return found.groupBy("grp").agg(F.countDistinct("a").alias("queries"), F.avg(F.coalesce("found", F.lit(0))).alias("recall"))


def mutual_pairs(ranked: DataFrame) -> DataFrame:
    """(a, b), a < b, of which each is among the other's most similar."""
    back = ranked.select(F.col("a").alias("b"), F.col("b").alias("a"))
    return ranked.filter("a < b").select("a", "b").join(back.filter("a < b"), ["a", "b"]).distinct()
