"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard links.

One permutation (a 64-bit mix, cut to 32 bits) maps shingles to the circle of
2**32 places; a second one, shifted round that circle for each coordinate,
gives all coordinates of the signature. Bands of it make buckets; links are
confirmed on full shingle sets; components come from confirmed links only.

Words are white-space separated with A-Z lower-cased. Documents of equal word
sequences are one class, represented by its smallest doc_id. In every bucket
each class is first paired with one centre, so a bucket of n classes gives n
pairs. Classes that links haven't yet joined are then paired across components:
all of them in buckets of at most ``LEAF`` members, and through lists of the rarest
shingles that set them apart in larger ones (see ``crowds``), which lose no link. With 40 bands of 5 coordinates, a pair of
similarity 0.8 shares no bucket once in 7 million cases.

Defined results: null, empty and blank texts have an empty set and are linked
with nothing; a text of fewer words than a shingle is one shingle; for the links
of ``near_duplicates`` rows with one doc_id are one document, for those of
``drop_near_duplicates`` each row is a document of its own, whatever its doc_id;
a null doc_id counts as the smallest id; extra columns are ignored, or carried
by ``drop_near_duplicates``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, discard, given_back, text_of, written
from .crowds import LEAF, crowd_pairs
from .hashing import BASE, LOWER, batches, mix
from .minhash import shingle_sets, signatures

BANDS, ROWS = 40, 5
NO_ID = -(1 << 63)
#: Any long; a bucket's centre is the smallest id after one of these masks.
MASKS = (0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: Coordinates in a long of a sketch, which keeps two bits of each.
PACKED = 32
PAIRS_OF_BITS = 0x5555555555555555
SIGNED = "class binary, n_shingles long, bands array<long>, sketch array<long>"


def band_keys(signs: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(sets, bands) of 64-bit keys; equal coordinates of another band have another key."""
    rows = signs.shape[1] // bands
    keys = np.zeros((len(signs), bands), np.uint64)
    for r in range(rows):
        keys = mix(keys * BASE + signs[:, r::rows][:, :bands])
    return mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * BASE).view(np.int64)


def sketches(signs: np.ndarray) -> np.ndarray:
    """The low two bits of every coordinate, 32 coordinates in a long."""
    wide = np.zeros((len(signs), -(-signs.shape[1] // PACKED) * PACKED), np.uint64)
    wide[:, : signs.shape[1]] = signs & np.uint32(3)
    wide = wide.reshape(len(signs), -1, PACKED) << np.arange(0, 64, 2, dtype=np.uint64)
    return np.bitwise_or.reduce(wide, axis=2).view(np.int64)


def alike(x: Column, y: Column, percent: int, size: int = BANDS * ROWS) -> Column:
    """Whether two sketches may belong to sets that similar.

    Coordinates of equal bits are counted; a pair of the asked similarity has
    too few of them, six standard deviations below the mean, once in a billion.
    """
    unequal = 0.75 * (100 - percent) / 100
    most = math.ceil(size * unequal + 6 * math.sqrt(size * unequal * (1 - unequal)))
    count = F.lit(0)
    for k in range(-(-size // PACKED)):
        both = F.get(x, k).bitwiseXOR(F.get(y, k))
        count = count + F.bit_count(both.bitwiseOR(F.shiftrightunsigned(both, 1)).bitwiseAND(F.lit(PAIRS_OF_BITS)))
    return count <= most


def _signed(width: int, keys: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [(t or "").encode().translate(LOWER) for t in frame["text"]]
            for part in batches(texts):
                sets = shingle_sets(texts[part], width)
                some = [k for k, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                bits: list = [None] * len(sets)
                if some:
                    signs = signatures([sets[k] for k in some], BANDS * ROWS)
                    for k, row, sketch in zip(some, band_keys(signs), sketches(signs), strict=True):
                        bands[k], bits[k] = row, sketch
                yield pd.DataFrame({
                    **{k: frame[k].to_numpy()[part] for k in keys},
                    "class": [hashlib.md5(b" ".join(t.split())).digest() for t in texts[part]],
                    "n_shingles": [len(s) for s in sets], "bands": bands, "sketch": bits,
                })

    return given_back(run)


def _shingles(text: str, width: int) -> set:
    words = text.encode().translate(LOWER).split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width)), strict=False))


def _confirmed(width: int, percent: int):
    """Pairs (a, b, text_a, text_b) whose full sets are similar enough."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: OrderedDict[str, set] = OrderedDict()

        def of(text: str) -> set:
            if text not in known:
                known[text] = _shingles(text, width)
                if len(known) > 64:
                    known.popitem(last=False)
            known.move_to_end(text)
            return known[text]

        for frame in frames:
            rows = []
            for a, b, x, y in zip(frame["a"], frame["b"], frame["text_a"], frame["text_b"], strict=True):
                s, t = of(x or ""), of(y or "")
                both = len(s & t)
                if both and 100 * both >= percent * (len(s) + len(t) - both):
                    rows.append((a, b))
            yield pd.DataFrame(rows, columns=["a", "b"]).astype("int64")

    return given_back(run)


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, checked on the texts of (doc_id, text)."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInPandas(
        _confirmed(width, percent), "a long, b long"
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the links (a, b); nodes without links don't appear.

    The graph is contracted: every node goes to the neighbour whose hash is
    smallest, if it is smaller than its own, and links are carried over to what
    is left, so groups collapse at once and chains in a logarithmic number of
    rounds. Each round is written to the shared folder.
    """
    ends = lambda c: F.struct(F.xxhash64(c), F.col(c).alias("node"))
    edges, moves = written(links.select("a", "b").where("a <> b").distinct(), "links"), []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        to = both.groupBy("a").agg(F.least(ends("a"), F.min(ends("b")))["node"].alias("to")).withColumnRenamed("a", "node")
        moves.append(written(to, "moves"))
        move = lambda c: moves[-1].select(F.col("node").alias(c), F.col("to").alias(f"to_{c}"))  # noqa: B023, E731
        moved = edges.join(move("a"), "a").join(move("b"), "b")
        less, more = F.least("to_a", "to_b"), F.greatest("to_a", "to_b")
        left = written(moved.where("to_a <> to_b").select(less.alias("a"), more.alias("b")).distinct(), "links")
        discard(edges)
        edges = left
    discard(edges)
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    out = moves[0]
    for later in moves[1:]:
        out = out.join(later.select(F.col("node").alias("to"), F.col("to").alias("end")), "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    smallest = out.groupBy("to").agg(F.min("node").alias("component"))
    found = written(out.join(smallest, "to").select("node", "component"), "components")
    discard(*moves)
    return found


def joined_further(joined: DataFrame, more: DataFrame) -> DataFrame:
    """The components (node, component) when the links (a, b) are added."""
    known = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    over = more.join(known("a"), "a", "left").join(known("b"), "b", "left")
    merged = components(over.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    new = merged.select("node").join(joined, "node", "left_anti").select("node", F.col("node").alias("component"))
    final = merged.select(F.col("node").alias("component"), F.col("component").alias("final"))
    return joined.union(new).join(final, "component", "left").select("node", F.coalesce("final", "component").alias("component"))


def _signed_classes(slim: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows signed, each class with its rep (the smallest doc_id) and one signed row of each rep, where the doc_id is the document."""
    signed = written(slim.mapInPandas(_signed(width, ["doc_id"]), f"doc_id long, {SIGNED}"), "signed")
    classes = signed.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("rep"))
    heads = signed.where("n_shingles > 0").join(classes.withColumnRenamed("class", "_ik_class"), (F.col("class") == F.col("_ik_class")) & (F.col("doc_id") == F.col("rep")))
    return signed, classes, heads.dropDuplicates(["class", "doc_id"])


def _signed_rows(slim: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``_signed_classes``, where doc_id and text (``own``, its hash) are the document.

    A class is represented by its first row in order of doc_id and own (head_id,
    head_own); its rep is a number of its own that keeps this order.
    """
    signed = written(slim.mapInPandas(_signed(width, ["doc_id", "own"]), f"doc_id long, own binary, {SIGNED}"), "signed")
    some = signed.where("n_shingles > 0")
    first = some.groupBy("class").agg(F.min(F.struct("doc_id", "own")).alias("head"))
    first = first.select("class", F.col("head.doc_id").alias("head_id"), F.col("head.own").alias("head_own"))
    ordered = first.repartitionByRange("head_id", "head_own").sortWithinPartitions("head_id", "head_own")
    classes = written(ordered.withColumn("rep", F.monotonically_increasing_id()), "classes")
    heads = some.join(classes.withColumnRenamed("class", "_ik_class"), (F.col("class") == F.col("_ik_class")) & (F.col("doc_id") == F.col("head_id")) & (F.col("own") == F.col("head_own")))
    return signed, classes, heads.dropDuplicates(["class"])


def _components_of(heads: DataFrame, texts_of, width: int, percent: int) -> DataFrame:
    """(node, component) of the reps that are linked; ``texts_of`` gives (doc_id, text) of a table of reps."""
    keyed = heads.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))

    masks = F.array(*[F.lit(m) for m in MASKS])
    mask = F.get(masks, F.pmod("key", F.lit(len(MASKS))).cast("int"))
    centres = keyed.groupBy("key").agg(F.min(F.col("rep").bitwiseXOR(mask)).alias("masked"), F.count("*").alias("members")).where("members > 1")
    crowded = written(
        keyed.join(centres, "key").select("key", "rep", "n", F.col("masked").bitwiseXOR(mask).alias("centre")), "crowded"
    )
    texts = written(texts_of(crowded.select("rep").distinct()), "texts")

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = written(crowded.where("rep <> centre").select(*pair("rep", "centre")).distinct(), "pairs")
    joined = components(confirm(first, texts, width, percent))

    # Members of a bucket that are still apart. A doc_id with two texts has two sketches; each of them stands for it.
    member = crowded.join(joined, crowded["rep"] == joined["node"], "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("part"))
    parts = member.groupBy("key").agg(F.count("*").alias("members"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    apart = written(member.join(parts.select("key", "members"), "key"), "apart")

    sketch = heads.select(F.col("rep").alias("_ik_rep"), "sketch", "bands")
    few = apart.where(F.col("members") <= LEAF)
    few = few.join(sketch, few["rep"] == sketch["_ik_rep"]).drop("_ik_rep", "members")
    other = few.select("key", *[F.col(c).alias(f"{c}_b") for c in ("rep", "n", "part", "sketch", "bands")])
    # Of the buckets that a pair shares, the first gives it, if it isn't a crowd's.
    fits = (
        (F.col("part") < F.col("part_b")) & (100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b"))
        & alike(F.col("sketch"), F.col("sketch_b"), percent)
    )
    second = few.join(other, "key").where(fits).select(*pair("rep", "rep_b"))

    # Buckets of more members: a crowd is all that such buckets connect.
    crowd = apart.where(F.col("members") > LEAF)
    if not crowd.isEmpty():
        ahead = crowd.join(crowd.groupBy("key").agg(F.min("rep").alias("first")), "key")
        crowds = components(ahead.where("rep <> first").select(*pair("rep", "first")).distinct())
        members = crowd.select(F.col("rep").alias("node"), "part").distinct().join(crowds, "node")
        second = second.union(crowd_pairs(members.select(F.col("component").alias("crowd"), F.col("node").alias("rep"), "part"), texts, width, percent))

    second = written(second.distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    more = written(confirm(second, texts, width, percent), "links")
    if not more.isEmpty():
        joined = joined_further(joined, more)
    discard(crowded, texts, first, apart, second, more)
    return joined


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept, class.

    Documents are linked with percent * union <= 100 * intersection, and have the
    smallest doc_id that links and equal texts reach.
    """
    slim = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    signed, classes, heads = _signed_classes(slim, width)
    texts_of = lambda reps: slim.join(reps.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    joined = _components_of(heads, texts_of, width, percent)
    owned = signed.select("doc_id", "class", "n_shingles").join(classes, "class", "left")
    out = owned.join(joined, owned["rep"] == joined["node"], "left")
    component = F.coalesce("component", "rep", "doc_id")
    known = lambda c: F.when(c != NO_ID, c)
    return out.select(
        known(F.col("doc_id")).alias("doc_id"), "n_shingles", known(component).alias("component_id"),
        (F.col("doc_id") == component).alias("kept"), F.hex("class").alias("class"),
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component (the first by doc_id and hash of the text), and all rows without words.

    Rows are told apart by doc_id and text, so null or reused ids don't join what
    isn't alike. Of rows with words that are equal in both, any one stands for all.
    """
    own = F.unhex(F.md5(text_of(F.col("text"))))
    identified = docs.select(F.struct("*").alias("_ik_row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), own.alias("own"), "text")
    slim = identified.select("doc_id", "own", "text")
    signed, classes, heads = _signed_rows(slim, width)

    def texts_of(reps: DataFrame) -> DataFrame:
        wanted = classes.join(reps, "rep").select(F.col("head_id").alias("doc_id"), F.col("head_own").alias("own"), "rep")
        return slim.dropDuplicates(["doc_id", "own"]).join(wanted, ["doc_id", "own"]).select(F.col("rep").alias("doc_id"), "text")

    joined = _components_of(heads, texts_of, width, percent)
    owned = signed.where("n_shingles > 0").select("doc_id", "own", "class").join(classes, "class")
    owned = owned.join(joined, owned["rep"] == joined["node"], "left")
    stays = (F.coalesce("component", "rep") == F.col("rep")) & (F.col("doc_id") == F.col("head_id")) & (F.col("own") == F.col("head_own"))
    gone = owned.where(~stays).select("doc_id", "own", F.lit(0).cast("long").alias("tie"), F.lit(True).alias("_ik_gone")).distinct()

    # Rows without words are equal to none. An outer join isn't pushed below the
    # window, so equal rows are thinned before they are dealt out.
    blank = F.trim(text_of(F.col("text")), F.lit(WHITE)) == ""
    rows = identified.select("_ik_row", "doc_id", "own", F.when(blank, F.monotonically_increasing_id() + 1).otherwise(0).alias("tie"))
    once = Window.partitionBy("doc_id", "own", "tie").orderBy("tie")
    rows = rows.withColumn("_ik_n", F.row_number().over(once)).where("_ik_n = 1").drop("_ik_n")
    return rows.join(gone, ["doc_id", "own", "tie"], "left").where("_ik_gone IS NULL").select("_ik_row.*")
