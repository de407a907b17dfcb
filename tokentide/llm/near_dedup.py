"""Near-duplicate documents by circulant MinHash, confirmed on full shingle sets.

Two permutations make the whole signature: the first scatters the shingles over a ring of
2^32 places, the second, shifted by k, gives coordinate k its minimum. Coordinates are banded; documents
that share a band are candidates, and a link needs a Jaccard similarity of full sets.

Documents with equal sets are one class, and one document stands for it. In each bucket
every class is first compared with its leader, which joins large groups without
expanding them into pairs. Where large buckets stay mixed, what lies outside of their largest
component is compared with the nearest of some of its members and with a leader of its own. Only
classes of a bucket that are still apart are then compared with each other; a bucket with many of them is
first split by further coordinates. Two copies of one leader are decided where they meet, by how
each differs from it; other pairs only come out where long sketches do not tell them apart. So
the rows made do not grow with the square of a group's size, and every pair that shares a bucket is decided.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tokentide.llm.components import components, ends
from tokentide.llm.frames import column, slices
from tokentide.llm.token_counts import LONGEST, Memory
from tokentide.llm.worker import kept
from tokentide.session import materialize, ship_package

WORDS = 5  # words of a shingle
BANDS, ROWS = 48, 5  # a pair at 0.75 shares no band with probability 2e-6
# Odd factors of the two permutations of a ring of 2^32 places; values that are worked on at once.
SCATTER, TURNED = (0x7FEB352D, 0x846CA68B), (0x21F0AAAD, 0xD35A2D97)
CHUNK = 1 << 14
PERCENT = 75
# Where groups stay apart, one bit of so many coordinates tells which pairs need a full look.
# Of two sets at 0.75 an eighth of the bits differs on average, 256; the limit lies more than
# five deviations above, which a pair that must be linked passes with probability 1e-7.
BITS, DIFFERENT = 2048, 340
# A bucket with more classes than this outside its largest component is split by keys of so many
# further coordinates each; a pair at 0.75 shares none of the keys with probability 5e-8, one at
# 0.3 shares one with probability 0.01.
CROWD, SPLITS, SPLIT_ROWS = 256, 160, 8
# Members of a large component that what is left outside is compared with, where the pairs of mixed
# buckets are more than so many times their rows.
MEMBERS, FEW = 16, 4
# How a class differs from its leader is kept of those at 0.5 and more, up to so many shingles.
DIFFERS = 512
_NO_ID = -(1 << 63)


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes, with a bounded memory of words."""

    def __init__(self) -> None:
        self.known = Memory()

    @staticmethod
    def _hash(word: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct shingles of words between ASCII white space, A-Z in lower case."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        found = {word: self._hash(word) for word in self.known.missing(set(words))}
        self.known.update({word: number for word, number in found.items() if len(word) <= LONGEST})
        young = self.known.young
        hashes = np.array([young[w] if w in young else found[w] for w in words], np.uint64)
        self.known.age()
        span = min(WORDS, len(words))
        mixed = np.full(len(words) - span + 1, span, np.uint64)
        for at in range(span):
            mixed = (mixed ^ hashes[at : len(words) - span + 1 + at]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def _permuted(values: np.ndarray, spare: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of the ring by two odd factors, in place: no two places get the same number."""
    for shift, factor in ((16, first), (15, second), (16, 1)):
        np.right_shift(values, np.uint32(shift), out=spare)
        np.bitwise_xor(values, spare, out=values)
        if factor > 1:
            np.multiply(values, np.uint32(factor), out=values)
    return values


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Coordinates 0 to size - 1: the minimum over the set of the second permutation shifted by k.

    The ring has 2^32 places, so that sets of many million shingles still leave most of it
    empty and disjoint sets seldom share a coordinate.
    """
    at = (shingles >> np.uint64(32)).astype(np.uint32)
    at = _permuted(at, np.empty_like(at), *SCATTER)
    turns = np.arange(size, dtype=np.uint32)
    least = np.full(size, (1 << 32) - 1, np.uint32)
    rows = max(1, CHUNK // size)
    values, spare = np.empty((2, min(rows, len(at)), size), np.uint32)
    for start in range(0, len(at), rows):
        part = at[start : start + rows, None]
        own, free = values[: len(part)], spare[: len(part)]
        np.add(part, turns, out=own)  # past the last place the ring begins again
        np.minimum(least, _permuted(own, free, *TURNED).min(axis=0), out=least)
    return least


def bands(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, its number included."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for row in coordinates.astype(np.uint64).reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The last bit of ``BITS`` coordinates, packed into longs."""
    return _last_bits(signature(shingles, BITS))


def _last_bits(coordinates: np.ndarray) -> np.ndarray:
    return np.packbits(coordinates.astype(np.uint8) & 1).view(np.int64)


def splits(coordinates: np.ndarray) -> np.ndarray:
    """Keys of ``SPLIT_ROWS`` coordinates each, from those that no band uses."""
    keys = np.zeros(SPLITS, np.uint64)
    for row in coordinates[BANDS * ROWS :][: SPLITS * SPLIT_ROWS].astype(np.uint64).reshape(SPLITS, SPLIT_ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def _shingler() -> Shingler:
    return kept("shingler", Shingler)


_FEATURES = "doc_id long, text_hash long, n long, class binary, bands array<long>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingle = _shingler()
    for batch in slices(batches):
        rows = []
        for text in batch.column("text").to_pylist():
            found = shingle(text)
            if len(found):
                name = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                rows.append((len(found), name, bands(signature(found))))
            else:
                rows.append((0, None, None))
        sizes, names, keys = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_hash"),
                pa.array(sizes, pa.int64()),
                pa.array(names, pa.binary()),
                pa.array(keys, pa.list_(pa.int64())),
            ],
            ["doc_id", "text_hash", "n", "class", "bands"],
        )


def _short(key: Column) -> Column:
    """31 bits of a band key, which tell whether two classes share the band."""
    return key.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingle = _shingler()
    parts = (_last_bits, splits, lambda own: bands(own[: BANDS * ROWS]))
    for batch in slices(batches):
        long = [signature(shingle(text), BITS) for text in batch.column("text").to_pylist()]
        arrays = [pa.array([part(own) for own in long], pa.list_(pa.int64())) for part in parts]
        given = [batch.column(name) for name in ("node", "lead", "differ")]
        yield pa.RecordBatch.from_arrays([*given, *arrays], ["node", "lead", "differ", "bits", "splits", "bands"])


def _distance() -> Column:
    """In how many bits the sketches of s and r differ."""
    distance = F.lit(0)
    for i in range(BITS // 64):
        distance = distance + F.bit_count(F.col(f"s.s{i}").bitwiseXOR(F.col(f"r.s{i}")))
    return distance


def _apart() -> Column:
    """Whether s and r of one bucket lie in components of their own, each pair in one order alone."""
    once = (F.col("r.root") == F.col("r.main")) | (F.col("s.node") < F.col("r.node"))
    return (F.col("s.bucket") == F.col("r.bucket")) & (F.col("s.root") != F.col("r.root")) & once & _alike(F.col("s.n"), F.col("r.n"))


def _may_link() -> Column:
    """Whether s and r may be linked, by their sketches; exact where one leader's copies meet.

    ``differ`` holds the shingles that only one of a class and its leader ``lead`` has. Two sets
    differ in what only one of their ``differ`` holds. Leaders themselves were tried before.
    """
    unlike = F.size("s.differ") + F.size("r.differ") - 2 * F.size(F.array_intersect("s.differ", "r.differ"))
    both = F.col("s.n") + F.col("r.n")
    exact = 100 * (both - unlike) >= PERCENT * (both + unlike)
    led = F.coalesce((F.col("s.lead") == F.col("r.node")) | (F.col("r.lead") == F.col("s.node")), F.lit(False))
    return (_distance() <= DIFFERENT) & ~led & F.when(F.col("s.lead") == F.col("r.lead"), exact).otherwise(True)


def split_pairs(apart: DataFrame, keys: DataFrame, linked: Callable[[], Column] | None = None) -> DataFrame:
    """(a, b) of classes that are apart in their buckets and share one of ``keys`` (node, splits), for each they share.

    ``linked`` is a further condition on s and r, which hold all columns of ``keys``.
    """
    nodes = apart.groupBy("node").agg(F.min("n").alias("n"), F.min("root").alias("root"))  # they are the same in all buckets
    placed = nodes.join(keys, "node").select("*", F.posexplode("splits").alias("at", "split")).drop("splits")
    s, r = placed.alias("s"), placed.alias("r")
    same = (F.col("s.at") == F.col("r.at")) & (F.col("s.split") == F.col("r.split"))
    ordered = (F.col("s.root") != F.col("r.root")) & (F.col("s.node") < F.col("r.node")) & _alike(F.col("s.n"), F.col("r.n"))
    pairs = s.join(r, same & ordered & linked() if linked else same & ordered)
    return pairs.select(F.col("s.node").alias("a"), F.col("r.node").alias("b"))


def _alike(left: Column, right: Column) -> Column:
    """Whether set sizes allow the similarity."""
    return F.least(left, right) * 100 >= F.greatest(left, right) * PERCENT


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough; pairs come in order of a, whose set is kept."""
    shingle, held, first = _shingler(), None, np.empty(0, np.uint64)
    for batch in slices(batches):
        links = []
        columns = (batch.column(name).to_pylist() for name in ("a", "b", "text_a", "text_b"))
        for a, b, text_a, text_b in zip(*columns, strict=True):
            if a != held:
                held, first = a, shingle(text_a)
            second = shingle(text_b)
            shared = len(np.intersect1d(first, second, assume_unique=True))
            if 100 * shared >= PERCENT * (len(first) + len(second) - shared):
                links.append((a, b))
        arrays = list(zip(*links, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()) for values in arrays], ["a", "b"])


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each pair's full sets are similar enough, and the shingles that only one of them has.

    Pairs below a similarity of 0.5 are left out; more than ``DIFFERS`` shingles are null.
    """
    shingle, held, first = _shingler(), None, np.empty(0, np.uint64)
    for batch in slices(batches):
        told = []
        columns = (batch.column(name).to_pylist() for name in ("a", "b", "text_a", "text_b"))
        for a, b, text_a, text_b in zip(*columns, strict=True):
            if a != held:
                held, first = a, shingle(text_a)
            second = shingle(text_b)
            differ = np.setxor1d(first, second, assume_unique=True)
            both = len(first) + len(second)
            if 3 * len(differ) <= both:
                linked = 100 * (both - len(differ)) >= PERCENT * (both + len(differ))
                told.append((a, b, linked, differ.view(np.int64) if len(differ) <= DIFFERS else None))
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
        arrays = list(zip(*told, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(arrays, types, strict=True)], ["a", "b", "linked", "differ"])


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    side = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Confirmed pairs of ``pairs`` (a, b), each decided on whole texts."""
    return materialize(_with_texts(pairs, texts).mapInArrow(_confirm, "a long, b long"), "confirmed")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links, from those found so far."""
    return components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))


def led_pairs(places: DataFrame, company: DataFrame) -> DataFrame:
    """(a, b) of each class and the leader it shares most buckets with, of a size that allows the link.

    A bucket is led by the class with the most company over all its buckets: the text that copies vary.
    """
    leaders = places.join(company, "node").groupBy("bucket").agg(
        F.max(F.struct("company", -F.col("node"), "node", "n")).alias("leader")
    )
    leaders = materialize(
        leaders.select("bucket", F.col("leader.node").alias("leader"), F.col("leader.n").alias("leader_n")), "leaders"
    )
    led = places.join(leaders, "bucket")
    led = led.where((F.col("node") != F.col("leader")) & _alike(F.col("n"), F.col("leader_n")))
    met = led.groupBy("node").agg(F.collect_list("leader").alias("met"))  # no more than a class has bands
    buckets = lambda leader: F.size(F.filter("met", lambda other: other == leader))
    best = F.array_max(F.transform(F.array_distinct("met"), lambda leader: F.struct(buckets(leader).alias("buckets"), (-leader).alias("leader"))))
    return met.select((-best["leader"]).alias("a"), F.col("node").alias("b"))


def _split(crowded: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of buckets that hold several components, and those buckets (bucket, main, total, outside)."""
    labelled = crowded.select("bucket", "band", "node", "n").join(found, "node", "left")
    labelled = materialize(labelled.withColumn("root", F.coalesce("root", "node")), "labelled")
    parts = labelled.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("size"))
    mixed = parts.groupBy("bucket").agg(
        F.max(F.struct("size", "root")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("size").alias("total")
    )
    outside = (F.col("total") - F.col("main.size")).alias("outside")
    mixed = mixed.where("parts > 1").select("bucket", F.col("main.root").alias("main"), "total", outside)
    mixed = materialize(mixed, "mixed-buckets")
    rows = labelled.join(mixed, "bucket").withColumn("crowd", F.col("outside") > CROWD)
    return materialize(rows, "apart"), mixed


def nearest_pairs(apart: DataFrame, company: DataFrame, keys: DataFrame, tried: DataFrame, low: int, high: int) -> DataFrame:
    """(a, b) of each class outside a bucket's largest component and the nearest of some of its members.

    Asked are members ``low`` + 1 to ``high`` of one bucket, most company first, without pairs of
    ``tried``; the nearest shares most bands. So there are as many pairs as classes and components; two classes may
    ask for each other.
    """
    order = W.partitionBy("bucket").orderBy(F.desc("company"), "node")
    members = apart.where("root = main").join(company, "node").join(keys, "node")
    members = members.withColumn("place", F.row_number().over(order)).where((F.col("place") > low) & (F.col("place") <= high))
    members = members.select("bucket", F.col("node").alias("member"), F.col("n").alias("member_n"), F.col("keys").alias("others"))
    asking = apart.where("root != main").join(keys, "node").groupBy("node", "n", "main")
    asking = asking.agg(F.max(F.struct("total", "bucket"))["bucket"].alias("bucket"), F.first("keys").alias("keys"))
    met = asking.join(members, "bucket").where(_alike(F.col("n"), F.col("member_n")))
    shared = F.size(F.filter(F.zip_with("keys", "others", lambda one, other: one == other), lambda same: same))
    met = met.select(
        "main", "node", "member", shared.alias("shared"), F.least("node", "member").alias("a"), F.greatest("node", "member").alias("b")
    )
    both = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    met = met.join(both, ["a", "b"], "left_anti")
    best = met.groupBy("node", "main").agg(F.max(F.struct("shared", -F.col("member"), "a", "b")).alias("best"))
    return best.select("best.a", "best.b")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", roots: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``, by an integer key.

    A set holds the distinct shingles of five words, or the whole sequence of fewer; a text
    without words, or null, has the empty set and is linked with nothing. Sets are linked
    at a Jaccard similarity of 0.75 or more. component_id is the smallest id reachable over
    links, kept whether it is the row's own.

    Repeated rows each get a row and are one class; an id with two texts belongs to the
    component of each in its own row. A row without id gets the smallest id of its
    component, or null if there is none, and is kept then. An empty table gives an empty
    result. Other columns are left out. ``docs`` is read twice.

    ``roots`` adds text_hash (xxhash64 of the text) and root, which tells components apart
    whose smallest ids are equal or null; it is null for a text without words.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(
        column(key).cast("long").alias("doc_id"), F.xxhash64(column(text)).alias("text_hash"), column(text).alias("text")
    )
    features = rows.mapInArrow(_features, _FEATURES).withColumn("row", F.monotonically_increasing_id())
    features = materialize(features, "features")
    held = features.where("n > 0")
    classes = materialize(
        held.groupBy("class").agg(
            F.min("doc_id").alias("doc"),
            F.min(F.struct("row", "doc_id", "text_hash", "n", "bands")).alias("first"),
        ),
        "classes",
    ).select("class", "doc", F.col("first.row").alias("node"), "first.doc_id", "first.text_hash", "first.n", "first.bands")
    nodes = classes.select("node", "doc_id", "text_hash", "class", "doc")

    # Every class in its buckets; buckets of one class are done.
    places = classes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    shared = materialize(shared.where("size > 1"), "shared-buckets")
    crowded = materialize(places.join(shared, "bucket"), "crowded")
    company = crowded.groupBy("node").agg(F.sum("size").alias("company")).join(nodes.drop("class", "doc"), "node")
    company = materialize(company, "company")
    needed = company.select("node", "doc_id", "text_hash")
    match = (F.coalesce(rows["doc_id"], F.lit(_NO_ID)) == F.coalesce(needed["doc_id"], F.lit(_NO_ID))) & (
        rows["text_hash"] == needed["text_hash"]
    )
    texts = materialize(rows.join(needed, match).select("node", "text"), "texts")

    # First round: each class and the leader it shares most buckets with.
    company = company.select("node", "company")
    tried = materialize(led_pairs(crowded, company), "tried")
    led = _with_texts(tried, texts).mapInArrow(_led, "a long, b long, linked boolean, differ array<long>")
    led = materialize(led, "led")
    # A leader has more company, or as much and the smaller number: leaders of leaders come to an end.
    # Repeated rows of an id and text repeat its pairs.
    found = ends(led.where("linked").select(F.col("b").alias("node"), F.col("a").alias("root")).distinct())

    keys = classes.select("node", F.transform("bands", _short).alias("keys"))
    # Second round, where large buckets would give many pairs: what lies outside of a bucket's largest
    # component is compared with the nearest of some of its members, and with a leader among its own.
    apart, mixed = _split(crowded, found)
    many = mixed.agg(F.sum(F.col("outside") * F.col("total"))).first()[0] or 0
    if many > FEW * crowded.count():
        nearest = nearest_pairs(apart, company, keys, tried, 0, MEMBERS)
        own = led_pairs(apart.where("root != main").select("bucket", "node", "n"), company)
        fresh = materialize(nearest.union(own).distinct(), "nearest")
        links, tried = _links(fresh, texts), tried.union(fresh)
        if not links.isEmpty():
            found = _joined(found, links)
            apart, _ = _split(apart, found)  # buckets of one component stay so

    # Last round: all pairs of a bucket that are still apart, at least one of them outside
    # the bucket's largest component.
    asked = apart.select("node").distinct()
    known = led.where("differ IS NOT NULL").select(F.col("b").alias("node"), F.col("a").alias("lead"), "differ").dropDuplicates(["node"])
    sketched = texts.join(asked, "node", "left_semi").join(known, "node", "left").select("node", "lead", "differ", "text")
    sketched = sketched.mapInArrow(
        _sketches, "node long, lead long, differ array<long>, bits array<long>, splits array<long>, bands array<long>"
    )
    words = [F.col("bits")[i].alias(f"s{i}") for i in range(BITS // 64)]
    short = F.transform("bands", _short).alias("keys")
    sketched = materialize(sketched.select("node", "splits", "lead", "differ", short, *words), "sketches")
    few = apart.where("NOT crowd").join(sketched.drop("splits"), "node")
    few = materialize(few, "apart-sketches")
    s, r = few.where("root != main").alias("s"), few.alias("r")
    same = F.zip_with("s.keys", "r.keys", lambda one, other: one == other)
    pairs = s.join(r, _apart() & (F.array_position(same, True) == F.col("s.band") + 1) & _may_link())
    pairs = pairs.select(F.least("s.node", "r.node").alias("a"), F.greatest("s.node", "r.node").alias("b"))
    pairs = pairs.union(split_pairs(apart.where("crowd"), sketched.drop("keys"), _may_link))
    both = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    fresh = materialize(pairs.distinct().join(both, ["a", "b"], "left_anti"), "pairs")
    links = _links(fresh, texts)
    if not links.isEmpty():
        found = _joined(found, links)

    joined = nodes.select("node", "class", "doc").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    joined = materialize(joined, "joined")
    more = ["text_hash", "root"] if roots else []
    least = materialize(joined.groupBy("root").agg(F.min("doc").alias("component")), "least-ids")
    named = materialize(joined.join(least, "root").select("class", "component", *more[1:]), "named")
    told = features.select("doc_id", "n", "class", *more[:1]).join(named, "class", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return told.select(
        F.col("doc_id").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        *more,
    )
