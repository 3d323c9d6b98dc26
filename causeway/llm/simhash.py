"""SimHash near-duplicates with a pigeonring filter.

A fingerprint of 64 bits is cut into a ring of four segments of 16. If two fingerprints differ in at most
three bits, some segment starts a chain whose first l segments together differ in at most floor(3 l / 4)
bits, for each l: 0, 1, 2, 3. The first two conditions make the join key (an equal segment, and a next one
that differs in one bit at most); the third prunes what the join finds; the fourth is the full check.

Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 differ in about ten of 64 bits, some of
them in sixteen. No chain of segments has a key that is equal, or nearly, at such distances; keep_first(similarity)
therefore looks at pairs within three bits and, besides, at pairs that share one of KEYS small shingle hashes (all
do but one in ten million). Fingerprints of 128 bits and the LOW smallest hashes prune these, and the sets decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm.common import Scratch, small_batches
from causeway.llm.graph import components

SEED = 42
SHINGLE = 3
SEGMENTS, WIDTH, DISTANCE = 4, 16, 3
#: A bucket of more fingerprints than this takes the way of crowded().
CROWD = 4096
#: For texts by similarity: words of a shingle, the least similarity as a fraction, smallest hashes kept of a text, and how many
#: of them it is found by.
WORDS, OVER, UNDER, LOW, KEYS = 5, 4, 5, 32, 10
#: How many of 128 bits may differ (at 0.8 it is 19 on average, with a deviation of 4), and the share of the smallest hashes
#: that two texts must have in common (at 0.8 it is 0.8, with a deviation of 0.07).
APART, SHARED = 40, 0.4
#: Hashes that many texts have are used last, as far as so many of them go: they cost work, and miss nothing otherwise.
COMMON = 1 << 20
#: Where more texts than MANY share a hash, each is compared with one of them first, STARS times over with another one.
MANY, STARS = 64, 4
#: Pairs in such buckets, for each row of all buckets, below which they are compared without more turns.
PAIRS = 32
#: Words of 64 bits that tell of how many shingles of a set, odd or even, fall on each bit: as many bits as differ between
#: two sets, at least, shingles are in one of them only.
ODD = 16
#: Hashes of shingles that a worker holds while it compares texts.
HELD = 1 << 22
_TURN = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_PART = 1 << 16


def _hashes(text: str | None, shingle: int, seed: int = SEED) -> np.ndarray:
    """A hash for each shingle, repeats included; a shorter text is one shingle, one without words has none."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, max(1, len(words) - shingle + 1))


def _print(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed number; 0 without hashes."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, _PART):
        part = hashes[i : i + _PART]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit number; 0 without words."""
    return _print(_hashes(text, shingle, seed))


@F.pandas_udf(T.LongType())
def simhash_udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series([simhash(x) for x in texts], dtype="int64")


def _turned(fp: Column, start: int) -> Column:
    """The fingerprint, turned so that segment `start` stands lowest."""
    k = WIDTH * start
    return F.shiftrightunsigned(fp, k).bitwiseOR(F.shiftleft(fp, 64 - k)) if k else fp


def _keys(fp: Column) -> list[Column]:
    """For each start of a chain: its number, the segment and the next one in one long."""
    return [_turned(fp, i).bitwiseAND(F.lit((1 << 2 * WIDTH) - 1)).bitwiseOR(F.lit(i << 2 * WIDTH)) for i in range(SEGMENTS)]


def _linked(a: Column, b: Column, start: Column) -> Column:
    """The rest of the chain that begins at start, and the full distance."""
    diff = a.bitwiseXOR(b)
    third = F.lit(False)
    for i in range(SEGMENTS):
        third = third | ((start == i) & (F.bit_count(_turned(diff, i).bitwiseAND(F.lit((1 << 3 * WIDTH) - 1))) <= 2))
    return third & (F.bit_count(diff) <= DISTANCE)


def _start(key: Column) -> Column:
    return F.shiftright(key, 2 * WIDTH)


def links(prints: DataFrame, scratch: Scratch, crowd: int = CROWD) -> DataFrame:
    """Distinct fingerprints (fp) -> (a, b): links that leave the same components as all pairs within three bits.

    Every pair within three bits is among them, but for buckets of more than `crowd` fingerprints, where pairs
    that crowded() has connected already are left out. A fingerprint makes 4 rows to be found by and 4 + one
    for each zero bit of its segments to look with: one of two fingerprints that differ in a bit has the zero.
    """
    index = prints.select("fp", F.explode(F.array(*_keys(F.col("fp")))).alias("key"))
    flips = lambda key: F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.when(F.getbit(key, i + WIDTH) == 0, key.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i + WIDTH)))),
        lambda x: x.isNotNull(),
    )
    probe = index.select(F.col("fp").alias("a"), F.col("key").alias("own"), F.explode(F.concat(F.array("key"), flips(F.col("key")))).alias("key"))
    index = index.withColumnRenamed("fp", "b")
    sizes = scratch.write(index.groupBy("key").count().where(F.col("count") > crowd).select("key"))
    full = not sizes.isEmpty()
    found = (F.col("own") != F.col("key")) | (F.col("a") < F.col("b"))
    if full:
        thin = index.join(sizes, "key", "left_anti")
    else:
        thin = index
    out = probe.join(thin, "key").where(found & _linked(F.col("a"), F.col("b"), _start(F.col("key")))).select("a", "b")
    return out.unionByName(crowded(probe, index, sizes, scratch)) if full else out


def crowded(probe: DataFrame, index: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links within buckets of very many fingerprints, without all their pairs.

    First each fingerprint meets those within two bits at the strings one bit away from it, each of which at
    most 65 fingerprints share: rows in proportion to the fingerprints. Then only buckets that still hold
    several components are joined, and only pairs across components are checked.
    """
    index, probe = index.join(sizes, "key", "left_semi"), probe.join(sizes, "key", "left_semi")
    own = scratch.write(index.select(F.col("b").alias("a")).union(probe.select("a")).distinct())
    near = own.select("a", F.explode(F.array(F.col("a"), *[F.col("a").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])).alias("v"))
    stars = scratch.write(near.join(near.groupBy("v").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").select("v", "b"), "v").where("a <> b").select("a", "b").distinct())
    labels = components(stars, scratch)
    a = own.join(labels, own.a == labels.node, "left").select("a", F.coalesce("component", "a").alias("ca"))
    b = a.toDF("b", "cb")
    index, probe = index.join(b, "b"), probe.join(a, "a")
    mixed = index.select("key", F.col("cb").alias("c")).union(probe.select("key", "ca")).groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    probe = probe.join(mixed, "key", "left_semi")
    across = probe.join(index, "key").where((F.col("ca") != F.col("cb")) & _linked(F.col("a"), F.col("b"), _start(F.col("key"))))
    return stars.unionByName(across.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """A row for each input row: id_col, fingerprint (16 hex digits), component_id.

    component_id is the smallest id of all rows whose fingerprints are connected by links of three bits or
    fewer. Null and empty texts have fingerprint zero and are linked like any other. Rows with a null id
    get the component of their fingerprint; it is null if no row of the component has an id. Repeated rows
    stay. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "simhash")
    rows = scratch.write(docs.select(F.col(id_col).alias("id"), simhash_udf(F.col(text_col)).alias("fp")))
    groups = scratch.write(rows.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(links(groups.select("fp"), scratch, crowd), scratch)
    joined = groups.join(found, groups.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    ids = scratch.write(joined.groupBy("root").agg(F.min("least").alias("component_id")))  # apart, so that a hot root's rows can be split
    classes = joined.join(ids, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(_hashes(text, shingle))


def _odd(hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64(64 * ODD - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=64 * ODD) & 1).view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int = WORDS, low: int = LOW) -> DataFrame:
    """id, key (a digest of the set of shingles), n (its size), fp and more (128 bits of fingerprint), low (its smallest hashes)."""
    kind = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("more", T.LongType()), T.StructField("low", T.ArrayType(T.LongType()))])

    @F.pandas_udf(kind)
    def sketch(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            out = []
            for t in texts:
                h = _set(t, shingle)
                turned = (h ^ (h >> np.uint64(29))) * _TURN
                out.append((hashlib.sha256(h.tobytes()).digest(), len(h), _print(h), _print(turned ^ (turned >> np.uint64(32))), h[:low].view(np.int64)))
            yield pd.DataFrame(out, columns=["key", "n", "fp", "more", "low"])

    return docs.select(F.col(id_col).cast("long").alias("id"), sketch(F.col(text_col)).alias("s")).select("id", "s.*")


def _keys_of(nodes: DataFrame, many: int):
    """What picks the KEYS hashes that a text is found by: its smallest ones, those that more than `many` texts have last."""
    often = nodes.select(F.explode("low").alias("key")).groupBy("key").count().where(F.col("count") > many)
    common = np.array([r.key for r in often.orderBy(F.desc("count"), "key").limit(COMMON).select("key").collect()], np.int64)  # 8 MB at most

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def pick(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in parts:
            out = []
            for low in rows:
                late = np.isin(low, common)
                out.append(np.concatenate([low[~late], low[late]])[:KEYS])
            yield pd.Series(out, dtype=object)

    return pick


def similar_links(docs: DataFrame, nodes: DataFrame, scratch: Scratch, id_col: str, text_col: str, shingle: int = WORDS, over: int = OVER, under: int = UNDER, many: int = MANY) -> DataFrame:
    """(node, n, fp, more, low), a row for each distinct set of shingles -> (a, b): links that leave the same components as all similar pairs.

    In each bucket, all are first compared with one member; then pairs are compared that are still in different
    components. In buckets of more than `many`, that is done only after some more turns, with the members whose
    shingles are most common there, and only for texts that can have a link: what no other text in such buckets has
    is no part of any overlap, and a large group of copies that were each changed in places of their own has many
    pairs but few links.
    """

    @F.pandas_udf(T.BooleanType())
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        out, kept, size = [], {}, 0
        for x, y in zip(left, right, strict=True):
            for t in (x, y):
                if t not in kept:
                    kept[t] = _set(t, shingle)
                    size += len(kept[t])
            a, b = kept[x], kept[y]
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(under * both >= over * (len(a) + len(b) - both))
            if size > HELD:
                kept, size = {}, 0
        return pd.Series(out, dtype=bool)

    def checked(pairs: DataFrame, done: list[DataFrame]) -> DataFrame:
        """Of the candidate pairs, those that are similar."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        for d in done:
            pairs = pairs.join(d, ["a", "b"], "left_anti")
        lows = nodes.select("node", "low")
        pairs = scratch.write(pairs)
        done.append(pairs)
        both = pairs.join(lows.toDF("a", "la"), "a").join(lows.toDF("b", "lb"), "b")
        pairs = scratch.write(both.where(F.size(F.array_intersect("la", "lb")) >= F.least(F.size("la"), F.size("lb")) * SHARED).select("a", "b"))
        wanted = pairs.select("a").union(pairs.select("b")).distinct().toDF("id")
        some = scratch.write(texts.join(wanted, "id", "left_semi"))
        both = pairs.join(some.toDF("a", "ta"), "a").join(some.toDF("b", "tb"), "b")
        found = scratch.write(both.where(similar("ta", "tb")).select("a", "b"))
        scratch.discard(some)
        return found

    def near(x: str, y: str):
        """What sizes, shingles that other texts have too, and fingerprints say of two rows."""
        apart = F.bit_count(F.col(f"{x}.fp").bitwiseXOR(F.col(f"{y}.fp"))) + F.bit_count(F.col(f"{x}.more").bitwiseXOR(F.col(f"{y}.more")))
        return (F.least(f"{x}.shared", f"{y}.shared") * (over + under) >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * over) & (apart <= APART)

    me = F.struct("node", "n", "shared", "fp", "more", "comp").alias("me")
    # what stands within three bits: one node stands for each fingerprint
    prints = scratch.write(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    same = nodes.join(prints, "fp").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near_prints = links(prints.select("fp"), scratch).toDF("x", "y").join(prints.toDF("x", "a"), "x").join(prints.toDF("y", "b"), "y").select("a", "b")
    met = nodes.select("node", "n", "fp", "more", F.explode(_keys_of(nodes, many)("low")).alias("key"))
    crowds = met.groupBy("key").count().where("count > 1")
    met = scratch.write(met.join(crowds, "key"))
    by_print = scratch.write(same.unionByName(near_prints).where("a <> b"))
    # only these can be in pairs: all texts move once
    able = met.select("node").union(by_print.select("a")).union(by_print.select("b")).distinct().toDF("id")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    texts = scratch.write(texts.join(able, "id", "left_semi").dropDuplicates(["id"]))

    def middles(rows: DataFrame) -> DataFrame:
        """Of each bucket, a member whose shingles are common there."""
        return rows.groupBy("key").agg(F.max_by(me, F.struct(F.col("shared") / F.col("n"), F.xxhash64("node"))).alias("x"))

    def stars(rows: DataFrame, middle: DataFrame) -> DataFrame:
        met = rows.select("key", me.alias("y")).join(middle, "key")
        return met.where((F.col("x.comp") != F.col("y.comp")) & near("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    def across(rows: DataFrame, odd: int = 0) -> DataFrame:
        """Pairs of different components; with `odd` columns of parities, no more shingles may be in one set only than links allow."""
        told = F.struct("node", "n", "shared", "fp", "more", "comp", *(f"o{i}" for i in range(odd)))
        x, y = rows.select("key", told.alias("x")), rows.select("key", told.alias("y"))
        good = (F.col("x.comp") < F.col("y.comp")) & near("x", "y")
        if odd:
            differ = sum((F.bit_count(F.col(f"x.o{i}").bitwiseXOR(F.col(f"y.o{i}"))) for i in range(odd)), F.lit(0))
            good = good & (differ * (over + under) <= (F.col("x.n") + F.col("y.n")) * (under - over))
        met = x.join(y, "key").where(good)
        return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    def mixed(rows: DataFrame, found: DataFrame) -> DataFrame:
        """The rows of buckets that hold several components."""
        labels = components(found, scratch).toDF("node", "comp")
        here = rows.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        several = here.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        return scratch.write(here.join(several, "key", "left_semi"))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def parities(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in parts:
            yield pd.Series([_odd(_set(t, shingle)) for t in some], dtype=object)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def grams(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in parts:
            yield pd.Series([_set(t, shingle).view(np.int64) for t in some], dtype=object)

    def linkable(rows: DataFrame, sets: DataFrame) -> DataFrame:
        """The rows with how many shingles of each node other nodes have too, by the nodes' sets; without nodes that have too few for any link."""
        lone = sets.groupBy("gram").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1").groupBy("node").agg(F.count("*").alias("lone"))
        told = rows.join(lone, "node", "left").withColumn("shared", F.col("n") - F.coalesce("lone", F.lit(0))).drop("lone")
        return scratch.write(told.where(F.col("shared") * under >= F.col("n") * over))

    done: list[DataFrame] = []
    alone = met.withColumn("comp", F.col("node")).withColumn("shared", F.col("n").cast("long"))
    found = checked(by_print.unionByName(stars(alone, middles(alone))), done)
    here = mixed(alone, found)
    found = scratch.write(found.unionByName(checked(across(here.where(F.col("count") <= many)), done)))
    crowded = mixed(here.where(F.col("count") > many), found)
    if crowded.isEmpty():
        return found
    mine = texts.withColumnRenamed("id", "node").join(crowded.select("node").distinct(), "node", "left_semi")
    sets = scratch.write(mine.select("node", F.explode(grams("t")).alias("gram")))
    most, counted = PAIRS * met.count(), 0

    def pruned(rows: DataFrame, turn: int) -> DataFrame:
        """linkable(), worked out anew only where half of the nodes have gone: what was shared then is no less than what is now, and
        all turns together read no more than twice the first one's shingles."""
        nonlocal counted
        now = rows.select("node").distinct().count()
        if turn and 2 * now > counted:
            return rows
        counted = now
        return linkable(rows, sets.join(rows.select("node").distinct(), "node", "left_semi") if turn else sets)

    for turn in range(STARS):
        crowded = pruned(mixed(crowded, found) if turn else crowded, turn)
        pairs = crowded.groupBy("key").agg((F.count("*") * (F.count("*") - 1) / 2).alias("n")).agg(F.sum("n")).first()[0] or 0
        if turn and pairs <= most:
            break
        middle = scratch.write(middles(crowded))
        found = scratch.write(found.unionByName(checked(stars(crowded, middle), done)))
        # a middle has met all others of its bucket
        crowded = scratch.write(crowded.join(middle.select("key", F.col("x.node").alias("node")), ["key", "node"], "left_anti"))
    else:
        crowded = pruned(mixed(crowded, found), STARS)
    mine = mine.join(crowded.select("node").distinct(), "node", "left_semi").select("node", parities("t").alias("o"))
    crowded = scratch.write(crowded.join(mine.select("node", *(F.col("o")[i].alias(f"o{i}") for i in range(ODD))), "node"))
    return scratch.write(found.unionByName(checked(across(crowded, ODD), done)))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] | None = None, shingle: int = WORDS, many: int = MANY) -> DataFrame:
    """The input rows without near-duplicates: of each component the row with the smallest id, one row of each repeated id.

    Without similarity, fingerprints of three words link within three bits, as near_duplicates() says. With it,
    as a fraction such as (4, 5), texts link whose sets of `shingle` words have that Jaccard similarity or more;
    a text of fewer words is one shingle, and texts without words, null ones among them, are alike. Ids are whole
    numbers then. Rows without an id can't be told apart and stay. All columns stay, whatever their names; an
    empty table stays empty.
    """
    named = docs.where(F.col(id_col).isNotNull())
    if similarity is None:
        kept = near_duplicates(named, id_col, text_col).where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    else:
        spark = docs.sparkSession
        small_batches(spark)
        scratch = Scratch(spark, "similar")
        rows = sketches(named, id_col, text_col, shingle)
        # sketches depend on the key alone
        nodes = scratch.write(rows.groupBy("key").agg(F.min("id").alias("node"), *(F.first(c).alias(c) for c in ("n", "fp", "more", "low"))).drop("key"))
        found = components(similar_links(named, nodes, scratch, id_col, text_col, shingle, *similarity, many), scratch).toDF("node", "component")
        kept = nodes.select("node").join(found, "node", "left").where(F.coalesce("component", "node") == F.col("node")).select(F.col("node").cast(docs.schema[id_col].dataType).alias(id_col))
    return named.join(kept, id_col, "left_semi").dropDuplicates([id_col]).select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
