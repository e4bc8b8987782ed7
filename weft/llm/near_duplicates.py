"""Near-duplicate records by pivot distance tables.

Each record is its set of word shingles. Its fingerprint has a bit for every possible shingle hash, so the
Hamming distance of two fingerprints is the symmetric difference of the sets, and Jaccard similarity s or
more means a distance of at most (1 - s) / (1 + s) * (|A| + |B|). The pivots are ``PIVOTS`` reference
fingerprints that hold each hash with chance 1/2; the distance of a fingerprint to a pivot, less the
pivot's own weight, is the number of its shingles that the pivot lacks less those it has.

1. Records with equal sets fall into one class; only classes are compared.
2. The range of hashes is cut into blocks, about 3 shingles in each, as many as the record's length class
   says. A row of the pivot table holds a block's distances to all pivots. Wherever the sets agree in a
   block, the maximum coordinate difference of its rows is zero, so classes that have the same row in two
   of ``ROWS`` blocks (short ones in one) are candidates (equi-join on the row's hash, with class and block). Rows of a single
   shingle are left out. Sets of fewer blocks are cut several times over, by other hashes. Each class is
   cut in the ways of its own and of the next length class; so of two similar sets, the smaller is also
   cut in the larger one's way. A block has two shingles or more and is untouched by the differences of a
   pair at the threshold with a chance of 0.24 or more, and fewer than two of 52 are with a chance below 1e-5.
3. A coarser table, of blocks of about 40 shingles at every length, gives a lower bound of the distance:
   by the triangle inequality a block's largest coordinate difference is at most the block's distance, and
   the differences of all blocks add up. Pairs above the allowed distance are discarded. This is free of losses.
4. The survivors' sets are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from weft.llm.components import connected_components
from weft.llm.shingles import _mix, digest, grouped, jaccard, shingles
from weft.runtime import stage

PIVOTS, ROWS = 32, 52
#: Rows that candidates share at least; sets of fewer than ``SHORT`` shingles one.
SHARED, SHORT = 2, 20
FINE, COARSE = 2.5, 35
#: Members of a class are compared in blocks of about this many, so no task writes all pairs of a large one.
BLOCK = 1000
#: Words of 64 bits, at most, in the marks that keep unneeded rows out of a shuffle.
WORDS = 1 << 18
#: Sizes that the rows tell apart, in 16 bits; longer sets pass as this long.
LONGEST = (1 << 16) - 1

# Which pivots have a shingle: bits of its hash, mixed. A row's hash is linear in its coordinates.
_WEIGHTS = np.random.default_rng(20).integers(0, 2**64, PIVOTS, dtype=np.uint64)


class PivotTables:
    """How sets are cut into blocks, and the pivot distances of the blocks, for a threshold."""

    def __init__(self, threshold: float) -> None:
        self.threshold, self.step = threshold, math.log(1 / min(threshold, 0.95))

    def way(self, n: int) -> int:
        """The length class: one more for each factor 1 / threshold."""
        return max(0, int(math.log(max(n, 3) / 3) / self.step + 1e-9))

    def blocks(self, way: int, size: float) -> int:
        return max(2, int(3 * math.exp(self.step * way) / size))

    def cuts(self, way: int) -> int:
        return max(1, -(-ROWS // self.blocks(way, FINE)))

    @staticmethod
    def coordinates(flat: np.ndarray, of: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(set, block, size, coordinates) of the non-empty blocks of sets laid end to end: ``of`` is the set of
        each shingle, ``blocks`` the number of blocks of each shingle's set."""
        place = ((flat >> np.uint64(32)) * blocks.astype(np.uint64)) >> np.uint64(32)
        where = of.astype(np.int64) << 32 | place.astype(np.int64)
        order = np.argsort(where, kind="stable")
        where = where[order]
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        bits = np.unpackbits((_mix(flat[order]) >> np.uint64(32)).astype(np.uint32)[:, None].view(np.uint8), axis=1).astype(np.int16)
        sums = np.add.reduceat(1 - 2 * bits, first, axis=0, dtype=np.int16)
        return where[first] >> 32, where[first] & 0xFFFFFFFF, np.diff(np.r_[first, len(where)]), sums

    def rows(self, sets: list[np.ndarray], ways: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, key) of the fine rows of each set in the given way."""
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        blocks, cuts = np.array([self.blocks(w, FINE) for w in ways]), np.array([self.cuts(w) for w in ways])
        out = []
        for cut in range(cuts.max()):
            now = cuts[of] > cut
            own, number = flat[now], of[now]
            if cut:
                own = _mix(own + np.uint64(cut * 0x9E3779B97F4A7C15 % 2**64))
            early = ((own >> np.uint64(32)) * blocks[number].astype(np.uint64)) >> np.uint64(32) < ROWS
            if not early.any():
                continue
            which, block, size, sums = self.coordinates(own[early], number[early], blocks[number[early]])
            full = size >= 2  # a single shingle is too common
            which, block, sums = which[full], block[full], sums[full]
            key = (sums.astype(np.int64).view(np.uint64) * _WEIGHTS).sum(1, dtype=np.uint64)
            place = _mix((block.astype(np.uint64) << np.uint64(16)) + (np.uint64(cut) << np.uint64(8)) + ways[which].astype(np.uint64))
            out.append((which, _mix(key ^ place).view(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2

    def tables(self, sets: list[np.ndarray], ways: np.ndarray) -> list[bytes]:
        """The coarse table of each set in the given way, a row of ``PIVOTS`` bytes a block. Coordinates
        beyond a byte are cut off, which can only lower the differences."""
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        blocks = np.array([self.blocks(w, COARSE) for w in ways])
        which, block, _, sums = self.coordinates(flat, of, blocks[of])
        begin = np.concatenate(([0], np.cumsum(blocks)))
        table = np.zeros((begin[-1], PIVOTS), np.int8)
        table[begin[which] + block] = np.clip(sums, -127, 127)
        return [table[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])]


def distance_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Lower bound of the Hamming distance from two tables: maximum differences, summed over blocks."""
    return int(np.abs(a.astype(np.int16) - b.astype(np.int16)).reshape(-1, PIVOTS).max(1).sum())


def _sketch(width: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = PivotTables(threshold)
        for batch in batches:
            kinds, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sets, kept, texts = [], [], []
            for i, text in enumerate(batch.column(2)):
                s = shingles(text.as_py(), width)
                if len(s):
                    sets.append(s)
                    kept.append(i)
                    texts.append(hash_of(text.as_py()))
            if not kept:
                continue
            ways = np.array([cut.way(len(s)) for s in sets])
            which, keys, tables = [], [], [[], []]
            for i, j in grouped(sets):
                for after in (0, 1):
                    w, k = cut.rows(sets[i:j], ways[i:j] + after)
                    which.append(w + i)
                    keys.append(k)
                    tables[after] += cut.tables(sets[i:j], ways[i:j] + after)
            which, keys = np.concatenate(which), np.concatenate(keys)
            order = np.argsort(which, kind="stable")
            which, keys = which[order], keys[order]
            for name in {kinds[k] for k in kept} - {"span"}:  # kinds never meet
                keys[np.array([kinds[k] == name for k in kept])[which]] ^= hash_of(name)
            at = np.searchsorted(which, np.arange(len(kept) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([kinds[k] for k in kept], pa.string()),
                    pa.array([ids[k] for k in kept], pa.string()),
                    pa.array([digest(s) for s in sets], pa.int64()),
                    pa.array(texts, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(ways, pa.int32()),
                    pa.ListArray.from_arrays(at, pa.array(keys)),
                    pa.array(tables[0], pa.binary()),
                    pa.array(tables[1], pa.binary()),
                ],
                ["kind", "id", "cid", "text_id", "n", "way", "keys", "own_table", "next_table"],
            )

    return run


def hash_of(text: str) -> np.int64:
    return np.array(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")), np.uint64).view(np.int64)[()]


def _discard(threshold: float):
    slack = (1 - threshold) / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            most = np.floor(slack * total + 1e-9)
            keep = [
                distance_bound(np.frombuffer(a, np.int8), np.frombuffer(b, np.int8)) <= d
                for a, b, d in zip(batch.column("table_a").to_pylist(), batch.column("table_b").to_pylist(), most)
            ]
            yield batch.select(["kind", "cid_a", "cid_b", "rep_a", "rep_b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(width: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, np.ndarray] = {}

            def get(key: str, text: str) -> np.ndarray:
                if key not in known:
                    known[key] = shingles(text, width)
                return known[key]

            keep, share = [], []
            for a, b, ta, tb in zip(*(batch.column(n) for n in ("rep_a", "rep_b", "text_a", "text_b"))):
                both, union = jaccard(get(a.as_py(), ta.as_py()), get(b.as_py(), tb.as_py()))
                keep.append(both >= threshold * union - 1e-9)
                share.append(both / max(union, 1))
            out = batch.select(["kind", "cid_a", "cid_b"]).append_column("similarity", pa.array(share, pa.float64()))
            yield out.filter(pa.array(keep, pa.bool_()))

    return run


def marked(rows: DataFrame, wanted: DataFrame, *on: str, how: str = "left_semi") -> DataFrame:
    """The rows whose columns ``on`` have the hash of a row of ``wanted``, or with "left_anti" the others.

    Hashes are bits of a table of ``WORDS`` rows at most, which is broadcast, so that wide rows needn't be
    shuffled to be told apart. All rows of equal columns are kept or left out together; no wanted row is
    lost, and where the wanted are very many, more of the unwanted are kept.
    """
    word = F.pmod(F.xxhash64(*on), F.lit(WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(*on), 58).cast("int"))
    marks = wanted.select(word.alias("_word"), bit.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    return rows.join(F.broadcast(marks), (word == F.col("_word")) & (bit.bitwiseAND(F.col("_bits")) != 0), how)


def _one_of_each(sketch: DataFrame, many: DataFrame, *columns: str) -> DataFrame:
    """Kind, cid and ``columns`` of one record of each class, the one of least id. Nearly all classes have
    one row, which needn't be shuffled to know that: only those of ``many`` are grouped."""
    rows = sketch.select("kind", "cid", *columns)
    least = (F.min(c).alias(c) if c == "id" else F.first(c).alias(c) for c in columns)  # all but the id are equal in a class
    several = marked(rows, many, "kind", "cid").groupBy("kind", "cid").agg(*least)
    return marked(rows, many, "kind", "cid", how="left_anti").unionByName(several)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("kind", F.explode(F.array("cid_a", "cid_b")).alias("cid"))


class NearDuplicates:
    """Links between all records of ``records`` (kind, id, text) with shingle similarity >= threshold.

    Kinds are compared apart. Rows with a null kind, id or text and texts of fewer words than a shingle
    link to nothing.
    Records given twice count once; equal sets form a class. Extra columns are ignored.
    """

    def __init__(self, records: DataFrame, width: int = 5, threshold: float = 0.8) -> None:
        records = records.select(
            F.col("kind").cast("string").alias("kind"), F.col("id").cast("string").alias("id"), F.col("text").cast("string").alias("text")
        ).filter("kind is not null and id is not null and text is not null")
        shape = "kind string, id string, cid long, text_id long, n int, way int, keys array<long>, own_table binary, next_table binary"
        self.sketch = stage(records.mapInArrow(_sketch(width, threshold), shape), "sketch")
        one = ["kind", "cid"]
        #: Classes: kind, cid, length class, and how many rows of the sketch they have.
        self.classes = classes = stage(self.sketch.groupBy(*one).agg(F.first("way").alias("way"), F.count("*").alias("copies")), "classes")
        many = classes.filter("copies > 1")
        # Row keys of 48 bits, below them the size of the set: chance meetings of keys only add candidates.
        size = F.least("n", F.lit(LONGEST)).cast("long")
        rows = _one_of_each(self.sketch, many, "n", "keys").select("cid", size.alias("n"), F.explode("keys").alias("key"))
        rows = rows.select("cid", F.col("key").bitwiseAND(F.lit(~LONGEST)).bitwiseOR(F.col("n")).alias("key"))
        # The two sides are one exchange, used twice; a key with very many rows is split by the adaptive skew
        # join. Keys hold the kind, so kinds do not meet here.
        a, b = (rows.select(*(F.col(c).alias(f"{c}_{s}") for c in ("cid", "key"))) for s in "ab")
        n_a, n_b = (F.col(f"key_{s}").bitwiseAND(F.lit(LONGEST)) for s in "ab")
        near = F.least(n_a, n_b) >= F.ceil(threshold * F.greatest(n_a, n_b) - 1e-9)
        pairs = a.join(b, (F.shiftrightunsigned("key_a", 16) == F.shiftrightunsigned("key_b", 16)) & (F.col("cid_a") < F.col("cid_b")) & near)
        shared = F.when(F.least(n_a, n_b) < SHORT, SHARED).otherwise(1)  # of short sets, one row will do
        pairs = pairs.groupBy("cid_a", "cid_b").agg(F.sum(shared).alias("k")).filter(F.col("k") >= SHARED).select("cid_a", "cid_b")
        # Two sets that both kinds have are candidates in both: only the sets decide.
        for s, key in (("a", ["cid_a"]), ("b", ["kind", "cid_b"])):
            pairs = pairs.join(classes.select("kind", *(F.col(c).alias(f"{c}_{s}") for c in ("cid", "way"))), key)
        #: Candidate pairs of classes: kind, cid_a, cid_b and their length classes.
        self.candidates = pairs = stage(pairs.select("kind", "cid_a", "cid_b", "way_a", "way_b"), "candidates")
        tables = stage(_one_of_each(marked(self.sketch, _ends(pairs), *one), many, "id", "n", "own_table", "next_table").withColumnRenamed("id", "rep"), "tables")
        for s in "ab":
            pairs = pairs.join(tables.select("kind", *(F.col(c).alias(f"{c}_{s}") for c in ("cid", "rep", "n", "own_table", "next_table"))), ["kind", f"cid_{s}"])
            table = F.when(F.col(f"way_{s}") >= F.greatest("way_a", "way_b"), F.col(f"own_table_{s}")).otherwise(F.col(f"next_table_{s}"))
            pairs = pairs.withColumn(f"table_{s}", table).drop(f"own_table_{s}", f"next_table_{s}")
        #: What the pivot tables leave: kind, cid_a, cid_b, rep_a, rep_b.
        self.left = stage(pairs.mapInArrow(_discard(threshold), "kind string, cid_a long, cid_b long, rep_a string, rep_b string"), "left")
        wanted = self.left.select("kind", F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct()
        texts = stage(marked(records, wanted, "kind", "id").join(wanted, ["kind", "id"], "left_semi").distinct(), "texts")
        both = self.left
        for s in "ab":
            both = both.join(texts.select("kind", F.col("id").alias(f"rep_{s}"), F.col("text").alias(f"text_{s}")), ["kind", f"rep_{s}"])
        links = both.mapInArrow(_verify(width, threshold), "kind string, cid_a long, cid_b long, similarity double").dropDuplicates(["kind", "cid_a", "cid_b"])
        #: Links between classes: kind, cid_a, cid_b, similarity.
        self.links = stage(links, "links")

    def steps(self) -> DataFrame:
        """(kind, candidates, kept, links): pairs of classes that share a row of the pivot table, those
        that the coarse table leaves, and those that are similar."""
        parts = [df.groupBy("kind").agg(F.count("*").alias("n")).withColumn("step", F.lit(s)) for df, s in ((self.candidates, "candidates"), (self.left, "kept"), (self.links, "links"))]
        both = parts[0].unionByName(parts[1]).unionByName(parts[2])
        return both.groupBy("kind").agg(*(F.coalesce(F.sum(F.when(F.col("step") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("candidates", "kept", "links")))

    def members(self) -> DataFrame:
        """(kind, id, cid) of all records that have shingles."""
        return self.sketch.select("kind", "id", "cid").distinct()

    def pairs(self, expand: int | None = None) -> DataFrame:
        """(kind, id_a, id_b), id_a < id_b, of all similar records.

        With ``expand``, the records of one text (equal in every byte) that are more than that many are
        paired among themselves only with their least id. Records of different texts always come out as
        pairs, and without ``expand`` those of equal ones do too.
        """
        # Only of classes in a link or with copies: all others' records are in no pair.
        meeting = _ends(self.links).unionByName(self.classes.filter("copies > 1").select("kind", "cid"))
        members = marked(self.sketch.select("kind", "id", "cid"), meeting, "kind", "cid").distinct()
        sizes = members.groupBy("kind", "cid").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK))
        same = sizes.filter("size > 1").select("kind", F.col("cid").alias("cid_a"), F.col("cid").alias("cid_b"), F.col("blocks").alias("blocks_a"), F.col("blocks").alias("blocks_b"))
        links = self.links.select("kind", "cid_a", "cid_b")
        for s in "ab":
            links = links.join(sizes.select("kind", F.col("cid").alias(f"cid_{s}"), F.col("blocks").alias(f"blocks_{s}")), ["kind", f"cid_{s}"])
        meet = links.unionByName(same)
        for s in "ab":
            meet = meet.withColumn(f"block_{s}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"blocks_{s}") - 1)))
        meet = meet.drop("blocks_a", "blocks_b").filter("cid_a <> cid_b or block_a <= block_b")
        members = members.join(sizes, ["kind", "cid"]).select("kind", "cid", "id", F.pmod(F.xxhash64("id"), "blocks").alias("block"))
        a, b = (meet.join(members.select("kind", *(F.col(c).alias(f"{c}_{s}") for c in ("cid", "block", "id"))), ["kind", f"cid_{s}", f"block_{s}"]) for s in "ab")
        out = a.join(b, ["kind", "cid_a", "cid_b", "block_a", "block_b"]).filter("id_a <> id_b and (cid_a <> cid_b or block_a < block_b or id_a < id_b)")
        out = out.select("kind", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
        if expand is None:
            return out
        copies = self.sketch.select("kind", "text_id", "id").distinct()
        large = copies.groupBy("kind", "text_id").agg(F.count("*").alias("size"), F.min("id").alias("rep")).filter(F.col("size") > expand)
        copies = copies.join(large, ["kind", "text_id"]).filter("id <> rep")
        for s in "ab":
            out = out.join(copies.select("kind", F.col("id").alias(f"id_{s}"), F.col("text_id").alias(f"text_{s}")), ["kind", f"id_{s}"], "left")
        return out.filter("not coalesce(text_a = text_b, false)").select("kind", "id_a", "id_b").distinct()

    def groups(self) -> DataFrame:
        """(kind, id, class_id, group_id, n_links) of every record that has shingles.

        class_id is the least id of the records with the same set, group_id that of the connected
        group; n_links counts the similar records, equal ones included.
        """
        members = self.members()
        sizes = members.groupBy("kind", "cid").agg(F.count("*").alias("size"), F.min("id").alias("class_id"))
        node = F.concat_ws("/", "kind", F.col("cid").cast("string"))
        found = connected_components(
            self.links.select(F.concat_ws("/", "kind", F.col("cid_a").cast("string")).alias("u"), F.concat_ws("/", "kind", F.col("cid_b").cast("string")).alias("v"))
        )
        ends = self.links.select("kind", F.col("cid_a").alias("cid"), F.col("cid_b").alias("other")).unionByName(
            self.links.select("kind", F.col("cid_b").alias("cid"), F.col("cid_a").alias("other"))
        )
        links = ends.join(sizes.select("kind", F.col("cid").alias("other"), "size"), ["kind", "other"]).groupBy("kind", "cid").agg(F.sum("size").alias("links"))
        classes = sizes.join(links, ["kind", "cid"], "left").join(found.withColumnRenamed("node", "key"), node == F.col("key"), "left")
        classes = classes.withColumn("component", F.coalesce("component", node))
        least = classes.groupBy("component").agg(F.min("class_id").alias("group_id"))
        classes = classes.join(least, "component")
        return members.join(classes, ["kind", "cid"]).select(
            "kind", "id", "class_id", "group_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links")
        )


def span_and_artifact_records(spans: DataFrame, artifacts: DataFrame) -> DataFrame:
    return spans.select(F.lit("span").alias("kind"), "id", "text").unionByName(
        artifacts.select(F.lit("artifact").alias("kind"), "id", F.col("content").alias("text"))
    )
