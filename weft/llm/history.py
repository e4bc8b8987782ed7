"""Deduplicating new batches against all history with an appendable segment index for edit distance.

The string of a content is the ascending row of its distinct shingle hashes. The edit distance of two
such strings, with insertions and deletions, is the number of symbols that are in one only, and Jaccard
similarity t or more means a distance of at most (1 - t) / (1 + t) times the sum of their lengths: the
bound of ``bounded_distance``.

A string is cut into segments: the range of hashes is divided into equal parts, by the string's length
class, and a segment is the substring of the symbols in one part. Insertions and deletions elsewhere
leave it as it is, and shift no other segment, because segments begin at values, not at counts. The first
``SEGMENTS`` segments are stored under length class, position and contents. A new string could match
stored ones of all lengths within the threshold, so for each of these length classes it is cut in the
class's way, and the substrings at the stored positions are probed. Strings that share two segments (one,
if they are short) are verified by their edit distance. A part has at most 3.6 symbols on average; at the
threshold it is left whole with a chance of at least 0.2, so a pair shares about 13 of 64 segments or more,
and fewer than two with a chance below 1e-5.

Segments, digests, paths and contents are stored in buckets, segments also by length class; a batch reads
only the buckets its own keys fall into. What ``screen`` accepts can be appended at once.

The turn of each item is respected without a loop over items: an item is a case as soon as an accepted
earlier record matches it, and is accepted as soon as no earlier undecided one does. Matches run through
keys (a digest, a path, a class of equal contents), and only the least accepted and the least undecided
turn of each key is looked at, so copies in any number cost no more than their own rows. After ``ROUNDS``
rounds the chains that are still undecided are followed one component at a time, each in a single pass.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weft.llm.components import connected_components
from weft.llm.shingles import _mix, digest as set_digest, shingles
from weft.runtime import shared_dir, stage

SEGMENTS, SYMBOLS = 64, 2.5
#: Strings share so many segments at least; shorter strings than ``SHORT`` one.
SHARED, SHORT = 2, 20
ROUNDS = 6
BUCKETS = 8
_BLANKS = r"(?U)^\s+|\s+$"
_LABEL = r"^(?:[a-z][a-z0-9_-]*[:=]|(?:sha-?(?:1|224|256|384|512)|md5|blake[23]\w?)[\s-]+)\s*"


def clean_digest(content_hash: Column, content: Column) -> Column:
    """The digest without outer blanks, letter case and algorithm label; that of the content if null."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(content_hash, _BLANKS, "")), _LABEL, "")
    return F.coalesce(F.when(plain != "", plain), F.sha2(content, 256))


def clean_path(path: Column) -> Column:
    """The path from the project root in one spelling; null for null and empty paths."""
    raw = F.regexp_replace(path, _BLANKS, "")
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    parts = F.split(F.lower(F.replace(F.regexp_replace(decoded, _BLANKS, ""), F.lit("\\"), F.lit("/"))), "/")
    parts = F.filter(parts, lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    solved = F.aggregate(parts, none, lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))
    joined = F.array_join(solved, "/")
    return F.when(joined != "", joined)


class Segments:
    """How strings of shingle hashes are cut, for a similarity threshold."""

    def __init__(self, threshold: float) -> None:
        self.threshold, self.step, self.small = threshold, math.log(1 / threshold), SEGMENTS * SYMBOLS

    def length_class(self, n: int) -> int:
        """0 for lengths with at most SEGMENTS parts, then one more for each factor 1 / threshold."""
        return 0 if n < self.small else 1 + int(math.log(n / self.small) / self.step + 1e-9)

    def parts(self, length_class: int) -> int:
        return SEGMENTS if not length_class else int(SEGMENTS / self.threshold ** (length_class - 1))

    def classes(self, n: int) -> range:
        """The length classes of all strings that can be similar to one of n symbols."""
        return range(self.length_class(math.ceil(n * self.threshold - 1e-9)), self.length_class(math.floor(n / self.threshold + 1e-9)) + 1)

    def keys(self, string: np.ndarray, length_class: int) -> np.ndarray:
        """Keys of the string's non-empty stored segments in the way of a length class."""
        parts = np.uint64(self.parts(length_class))
        place = ((string >> np.uint64(32)) * parts) >> np.uint64(32)
        end = int(np.searchsorted(place, np.uint64(SEGMENTS)))
        if not end:
            return np.empty(0, np.int64)
        place = place[:end]
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        body = np.add.reduceat(_mix(string[:end]), first)
        return _mix(body + _mix(place[first] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(length_class))).view(np.int64)


def bounded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Insertions and deletions between two ascending strings; ``most`` + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return min(len(b), most + 1)
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return min(len(a) + len(b) - 2 * both, most + 1)


def _sketch(width: int, cut: Segments, buckets: int, probing: bool):
    """Segments of each content in its own way, or its probes in all ways, with their parts of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, cids, sizes, own, keys, parts = [], [], [], [], [], []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(text.as_py(), width)
                if not len(s):
                    continue
                ways = cut.classes(len(s)) if probing else [cut.length_class(len(s))]
                found = [cut.keys(s, c) for c in ways]
                rids.append(rid)
                cids.append(set_digest(s))
                sizes.append(len(s))
                own.append(cut.length_class(len(s)))
                keys.append(np.concatenate(found))
                parts.append(np.concatenate([c * buckets + k % buckets for c, k in zip(ways, found)]).astype(np.int32))
            if rids:
                at = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rids, pa.string()), pa.array(cids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(own, pa.int32()), pa.ListArray.from_arrays(at, pa.array(np.concatenate(keys))), pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts)))],
                    ["rid", "cid", "n", "way", "keys", "parts"],
                )

    return run


_SKETCH = "rid string, cid long, n int, way int, keys array<long>, parts array<int>"


def _verify(width: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slack = (1 - threshold) / (1 + threshold)
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            keep = []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                for cid, text in ((a, ta), (b, tb)):
                    if cid not in known:
                        known[cid] = shingles(text.as_py(), width)
                x, y = known[a], known[b]
                most = math.floor(slack * (len(x) + len(y)) + 1e-9)
                keep.append(bounded_distance(x, y, most) <= most)
            yield batch.select(["cid", "other"]).filter(pa.array(keep, pa.bool_()))

    return run


def _array(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


class SegmentIndex:
    """Segments, digests, paths and contents of all accepted records, in a folder that all executors
    share. A folder keeps the number of buckets it was begun with; give the same again. More buckets make
    small batches read less of a large history."""

    _TABLES = {"segments": "cid long, n int, key long", "digests": "digest string", "places": "place string", "contents": "cid long, content string"}

    def __init__(self, spark: SparkSession, folder: str | None = None, width: int = 3, threshold: float = 0.7, buckets: int = BUCKETS) -> None:
        self.spark, self.width, self.threshold, self.buckets, self.cut = spark, width, threshold, buckets, Segments(threshold)
        self.folder = folder or f"{shared_dir(spark)}/weft-history-{uuid.uuid4().hex}"
        if folder is None:
            self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(self._path(""))

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))

    def records(self, rows: DataFrame) -> DataFrame:
        """(rid, digest, place, content, bare) of rows (rid, path, content, content_hash); of several rows
        of a rid the least stands."""
        rows = rows.select(
            F.col("rid").cast("string").alias("rid"), clean_digest(F.col("content_hash"), F.col("content")).alias("digest"), clean_path(F.col("path")).alias("place"),
            "content", (F.col("content").isNull() & F.col("content_hash").isNull()).alias("bare"),
        ).filter("rid is not null")
        return rows.groupBy("rid").agg(F.min(F.struct("digest", "place", "content", "bare")).alias("r")).select("rid", "r.*")

    def sketch(self, records: DataFrame, probing: bool) -> DataFrame:
        rows = records.filter("content is not null").select("rid", "content")
        return stage(rows.mapInArrow(_sketch(self.width, self.cut, self.buckets, probing), _SKETCH), "segments")

    def _bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def _digest_bucket(self) -> Column:
        """By the first two characters: a digest and one that it begins are in one bucket. Those of one
        character are in a bucket of their own, which every batch reads."""
        return F.when(F.length("digest") < 2, -1).otherwise(self._bucket(F.left("digest", F.lit(2))))

    def append(self, rows: DataFrame) -> None:
        """Accept rows (rid, path, content, content_hash): their keys, segments and contents are added."""
        self._accept(stage(self.records(rows), "accepted"))

    def _accept(self, records: DataFrame) -> None:
        sketch = self.sketch(records, False)
        first = stage(sketch.groupBy("cid").agg(F.min("rid").alias("rid")), "first")
        own = sketch.join(first, ["cid", "rid"], "left_semi")
        self._add("segments", own.select("cid", "n", F.explode(F.arrays_zip("keys", "parts")).alias("s")).select("cid", "n", F.col("s.keys").alias("key"), F.col("s.parts").alias("part")))
        self._add("digests", records.filter("digest is not null").select("digest", self._digest_bucket().alias("part")).distinct())
        self._add("places", records.filter("place is not null").select("place", self._bucket(F.col("place")).alias("part")).distinct())
        self._add("contents", records.select("rid", "content").join(first, "rid").select("cid", "content", self._bucket(F.col("cid")).alias("part")))

    def _add(self, name: str, rows: DataFrame) -> None:
        rows.repartition("part").write.mode("append").option("compression", "zstd").partitionBy("part").parquet(f"{self.folder}/{name}")

    def _get(self, name: str, parts: DataFrame) -> DataFrame:
        """The rows of a table in the parts that ``parts`` (part) names: at most the number of buckets
        times that of length classes, so the list is short at every size."""
        at = self._path(name)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self._TABLES[name] + ", part int").drop("part")
        wanted = [r[0] for r in parts.select("part").distinct().collect()]
        return self.spark.read.schema(self._TABLES[name] + ", part int").parquet(f"{self.folder}/{name}").filter(F.col("part").isin(wanted)).drop("part")

    def _links(self, sketch: DataFrame, records: DataFrame) -> DataFrame:
        """(cid, other, old, new): similar classes of the batch and of history (old) or of the batch (new)."""
        first = stage(sketch.groupBy("cid").agg(F.min("rid").alias("rid")), "first")
        sketch = stage(sketch.join(first, ["cid", "rid"], "left_semi"), "own")
        probes = sketch.select("cid", "n", "way", F.explode(F.arrays_zip("keys", "parts")).alias("s")).select("cid", "n", "way", F.col("s.keys").alias("key"), F.col("s.parts").alias("part"))
        own = probes.filter(F.floor(F.col("part") / self.buckets) == F.col("way"))
        shape = ["key", F.col("cid").alias("other"), F.col("n").alias("m")]
        rest = self._get("segments", probes).select(*shape, F.lit(True).alias("old")).unionByName(own.select(*shape, F.lit(False).alias("old")))
        near = F.least("n", "m") >= F.ceil(self.threshold * F.greatest("n", "m") - 1e-9)
        pairs = probes.drop("part", "way").join(rest, "key").filter(near & (F.col("cid") != F.col("other")))
        shared = F.when(F.least("n", "m") < SHORT, 1).otherwise(SHARED)
        pairs = pairs.groupBy("cid", "other", "old").agg(F.count("*").alias("k"), F.first(shared).alias("least")).filter("k >= least")
        swapped = ~F.col("old") & (F.col("cid") > F.col("other"))  # pairs of the batch once
        pairs = pairs.select(F.when(swapped, F.col("other")).otherwise(F.col("cid")).alias("cid"), F.when(swapped, F.col("cid")).otherwise(F.col("other")).alias("other"), "old")
        pairs = stage(pairs.groupBy("cid", "other").agg(F.max("old").alias("old"), F.max(~F.col("old")).alias("new")), "pairs")
        wanted = stage(pairs.select("cid").unionByName(pairs.select(F.col("other").alias("cid"))).distinct(), "wanted")
        mine = first.join(wanted, "cid", "left_semi").join(records.select("rid", "content"), "rid").select("cid", "content")
        held = self._get("contents", wanted.select(self._bucket(F.col("cid")).alias("part"))).join(wanted, "cid", "left_semi")
        texts = held.unionByName(mine).groupBy("cid").agg(F.min("content").alias("content"))
        texts = stage(texts, "texts")
        both = pairs.select("cid", "other").join(texts.withColumnRenamed("content", "text_a"), "cid").join(texts.select(F.col("cid").alias("other"), F.col("content").alias("text_b")), "other")
        kept = both.select("cid", "other", "text_a", "text_b").mapInArrow(_verify(self.width, self.threshold), "cid long, other long")
        return stage(kept.join(pairs, ["cid", "other"]), "links")

    def screen(self, rows: DataFrame, append: bool = False) -> DataFrame:
        """(rid, turn, is_case) of each row of a batch (rid, turn, path, content, content_hash).

        A row is a case if an accepted record has the same digest (a shortened digest is the same as
        any that it begins), or similar content, or, for a row with neither content nor content_hash,
        the same path. Accepted are all indexed records and the rows of lesser turn that are no cases.
        ``turn`` is any orderable column and unique to a row; repeated rows count once. With ``append``
        the rows that are no cases are appended to the index.
        """
        records = stage(self.records(rows), "batch")
        turns = rows.select(F.col("rid").cast("string").alias("rid"), "turn").filter("rid is not null").groupBy("rid").agg(F.min("turn").alias("turn"))
        sketch = self.sketch(records, True)
        links = self._links(sketch, records)
        digest_parts = records.select(self._digest_bucket().alias("part")).unionByName(self.spark.range(1).select(F.lit(-1).alias("part")))
        if records.filter("length(digest) = 1").limit(1).count():  # may begin any digest
            digest_parts = self.spark.range(-1, self.buckets).select(F.col("id").cast("int").alias("part"))
        digests = self._get("digests", digest_parts)
        places = self._get("places", records.filter("bare and place is not null").select(self._bucket(F.col("place")).alias("part")))
        # The lengths of digests in use: as many as the longest digest has characters, at most.
        lengths = sorted(r[0] for r in records.select(F.length("digest").alias("k")).union(digests.select(F.length("digest"))).filter("k is not null").distinct().collect())
        every = F.lit(lengths) if lengths else _array("int")
        key = lambda kind, k, text: F.concat(F.lit(kind), k.cast("string"), F.lit(":"), text)
        begin = lambda kind, test: F.coalesce(F.transform(F.filter(every, test), lambda k: key(kind, k, F.substr(F.col("digest"), F.lit(1), k))), _array("string"))
        prefixes = begin("p", lambda k: F.length("digest") >= k)
        exact, whole = (key(kind, F.length("digest"), F.col("digest")) for kind in "ep")
        shorter = begin("e", lambda k: F.length("digest") > k)
        place = F.concat(F.lit("h:"), F.col("place"))
        content = sketch.select("rid", F.concat(F.lit("c:"), F.col("cid").cast("string")).alias("key"))
        told = F.explode(F.filter(F.concat(prefixes, F.array(exact)), lambda x: x.isNotNull())).alias("key")
        heard = F.explode(F.filter(F.concat(shorter, F.array(whole, F.when(F.col("bare"), place))), lambda x: x.isNotNull())).alias("key")
        new_links = links.filter("new")
        around = new_links.select("cid", "other").unionByName(new_links.select(F.col("other").alias("cid"), F.col("cid").alias("other")))
        around = sketch.select("rid", "cid").join(around, "cid").select("rid", F.concat(F.lit("c:"), F.col("other").cast("string")).alias("key"))
        emits = records.select("rid", told).unionByName(records.filter("place is not null").select("rid", place.alias("key"))).unionByName(content)
        listens = stage(records.select("rid", heard).unionByName(content).unionByName(around), "listens")
        # What history says: digests, paths and equal or similar contents.
        mine = sketch.select("cid").distinct()
        same = self._get("contents", mine.select(self._bucket(F.col("cid")).alias("part"))).select("cid").join(mine, "cid", "left_semi")
        known = digests.select(told).unionByName(places.select(place.alias("key"))).unionByName(same.select(F.concat(F.lit("c:"), F.col("cid").cast("string")).alias("key")))
        like = sketch.select("rid", "cid").join(links.filter("old").select("cid").distinct(), "cid", "left_semi").select("rid")
        cases = stage(listens.join(known, "key", "left_semi").select("rid").unionByName(like).distinct(), "cases")
        out = self._by_turn(turns, emits, listens, cases)
        if append:
            out = stage(out, "verdict")
            self._accept(stage(records.join(out.filter("not is_case").select("rid"), "rid", "left_semi"), "accepted"))
        return out

    def _by_turn(self, turns: DataFrame, emits: DataFrame, listens: DataFrame, cases: DataFrame) -> DataFrame:
        left = turns.join(cases, "rid", "left_anti")
        emits = emits.join(left, "rid").select("rid", "key", "turn")
        listens = listens.join(left, "rid").select("rid", "key", "turn")
        # Keys that several of the remaining rows share; a row without any is accepted.
        shared = emits.groupBy("key").agg(F.min("turn").alias("a"), F.max("turn").alias("b")).join(listens.groupBy("key").agg(F.max("turn").alias("c")), "key").filter("a < c").select("key")
        shared = stage(shared, "shared")
        emits = stage(emits.join(shared, "key", "left_semi"), "emits")
        listens = stage(listens.join(shared, "key", "left_semi"), "heard")
        state = stage(listens.select("rid").distinct().withColumn("accepted", F.lit(None).cast("boolean")), "state")
        for _ in range(ROUNDS):
            if not state.filter("accepted is null").limit(1).count():
                break
            first = _first(emits, state)
            seen = listens.join(state.filter("accepted is null").select("rid"), "rid", "left_semi").join(first, "key", "left")
            verdict = seen.groupBy("rid").agg(F.max(F.coalesce(F.col("taken") < F.col("turn"), F.lit(False))).alias("hit"), F.max(F.coalesce(F.col("open") < F.col("turn"), F.lit(False))).alias("wait"))
            news = verdict.select("rid", F.when(F.col("hit"), False).when(~F.col("wait"), True).alias("news"))
            state = stage(state.join(news, "rid", "left").select("rid", F.coalesce("accepted", "news").alias("accepted")), "state")
        else:
            if state.filter("accepted is null").limit(1).count():
                state = state.filter("accepted is not null").unionByName(_followed(emits, listens, state.filter("accepted is null").select("rid")))
        rejected = cases.unionByName(state.filter("not accepted").select("rid"))
        return turns.join(rejected.withColumn("is_case", F.lit(True)), "rid", "left").select("rid", "turn", F.coalesce("is_case", F.lit(False)).alias("is_case"))


def _followed(emits: DataFrame, listens: DataFrame, waiting: DataFrame) -> DataFrame:
    """(rid, accepted) of the rows still undecided: each component is read once in the order of its
    turns, and only the keys of its accepted rows are held. No earlier accepted row outside matters:
    it would have decided."""
    emits, listens = (x.join(waiting, "rid", "left_semi") for x in (emits, listens))
    both = emits.withColumn("hears", F.lit(False)).unionByName(listens.withColumn("hears", F.lit(True)))
    part = connected_components(both.select(F.concat(F.lit("r"), "rid").alias("u"), F.concat(F.lit("k"), "key").alias("v")))
    rows = both.join(part.select(F.expr("substr(node, 2)").alias("rid"), "component").filter("node like 'r%'"), "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken = (None, None), set()
        hit, tells = False, []
        for batch in batches:
            rids, out = [], []
            for component, rid, key, hears in zip(*(batch.column(c).to_pylist() for c in ("component", "rid", "key", "hears"))):
                if (component, rid) != now:
                    if now[1] is not None:
                        rids.append(now[1])
                        out.append(not hit)
                        taken.update(() if hit else tells)
                    if component != now[0]:
                        taken = set()
                    now, hit, tells = (component, rid), False, []
                if hears:
                    hit = hit or key in taken
                else:
                    tells.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.string()), pa.array(out, pa.bool_())], ["rid", "accepted"])
        if now[1] is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[1]], pa.string()), pa.array([not hit], pa.bool_())], ["rid", "accepted"])

    rows = rows.repartition("component").sortWithinPartitions("component", "turn", "rid", F.col("hears").desc()).select("component", "rid", "key", "hears")
    return stage(rows.mapInArrow(run, "rid string, accepted boolean"), "followed")


def _first(emits: DataFrame, state: DataFrame) -> DataFrame:
    """(key, taken, open): the least turn of an accepted and of an undecided row that has the key.
    Rows that are not in the state hear of nobody, so they are accepted."""
    now = emits.join(state.withColumn("listed", F.lit(True)), "rid", "left")
    undecided = F.col("listed").isNotNull() & F.col("accepted").isNull()
    taken = F.col("listed").isNull() | F.coalesce("accepted", F.lit(False))
    return now.groupBy("key").agg(F.min(F.when(taken, F.col("turn"))).alias("taken"), F.min(F.when(undecided, F.col("turn"))).alias("open"))


def _screened(index: SegmentIndex, items: DataFrame, append: bool) -> DataFrame:
    turn = F.struct(F.coalesce("batch_id", F.lit(-(2**63))).alias("batch_id"), F.col("item_id").alias("item_id"))
    rows = items.filter("item_id is not null").select(F.concat_ws("/", turn["batch_id"].cast("string"), turn["item_id"].cast("string")).alias("rid"), turn.alias("turn"), "path", "content", "content_hash")
    return index.screen(rows, append).select("turn.batch_id", "turn.item_id", "is_case")


def screen_items(artifacts: DataFrame, items: DataFrame) -> DataFrame:
    """(batch_id, item_id, is_case) of every item, all artifacts being accepted before.

    Items without an item_id are left out; a null batch_id comes before all others. Any number of batches
    can be screened together: turns decide as if they came one after the other.
    """
    index = SegmentIndex(artifacts.sparkSession)
    index.append(artifacts.select(F.col("id").alias("rid"), "path", "content", "content_hash"))
    return _screened(index, items, False)


def screen_increment(artifacts: DataFrame, items: DataFrame) -> DataFrame:
    """The same of the last batch only, the index being built in two appends before: all artifacts, then
    what is accepted of the earlier batches."""
    index = SegmentIndex(artifacts.sparkSession)
    index.append(artifacts.select(F.col("id").alias("rid"), "path", "content", "content_hash"))
    last = items.agg(F.max("batch_id")).first()[0]
    _screened(index, items.filter(~F.coalesce(F.col("batch_id") == F.lit(last), F.lit(False))), True)
    return _screened(index, items.filter(F.col("batch_id") == F.lit(last)), True)
