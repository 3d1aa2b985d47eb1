"""Near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: in each round every shingle of a set is hashed to a bin and a value; a bin
keeps the smallest value of the first round that reaches it. After as many rounds as
bins, bin j takes the smallest value of round t + j from all shingles, so every bin
fills however small the set. Two sketches agree in a bin with probability J, and the
number of agreeing bins concentrates as if the bins were independent.

Documents with the same words are one class. Classes that agree in a band of bins share
a bucket. Before anything is compared, each class counts the shingles that no other class in a bucket has. They bound
its similarity with any other one, so texts that only share a passage with many others take part in no pair at all.

Every class is compared with the pivot of each of its buckets, the class with the most company, on full sets. That
settles buckets whose classes then are one component, whatever their size. In the stars of the other pivots any two
classes of different components may still be linked. They are named by how they differ from the pivot: with D the symmetric
difference of a class and the pivot, two classes differ by the symmetric difference of their Ds, so a link needs
(size of D + size of the other D - most) / 2 common elements, where ``most`` is how far linked sets of their sizes may differ. One of two classes is not
linked with the pivot, which makes this number positive, so the two share one of the first elements of their Ds in any common order.
Rare elements come first: those of a class alone, which nothing can share, fill the prefix of a text that was changed
on its own, and texts made from one template do not meet by the template, which is in no D. Only classes that share a
prefix element of the same star, with room behind it for all the common elements they need, are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import release, stored, with_small_batches

#: 45 bands of 5 bins: a pair at J = 0.8 shares no bucket with probability (1 - 0.8**5)**45 < 2e-8.
BANDS, ROWS = 45, 5
BINS = BANDS * ROWS
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: Hash evaluations of one step of a sketch.
STEP = 2048


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; of all words as one if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    rolled = hashes[: len(words) - span + 1].copy()
    for offset in range(1, span):
        rolled = mixed(rolled) + hashes[offset : len(words) - span + 1 + offset]
    return np.unique(mixed(rolled + np.uint64(span)))


SEEDS = mixed(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * MULTIPLY)


def sketch(items: np.ndarray) -> np.ndarray:
    """BINS values (round in the high half, hash in the low) of a set that is not empty."""
    bins = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, STEP // len(items))
    for first in range(0, BINS, step):
        rounds = np.arange(first, min(first + step, BINS))
        hashes = mixed(items[None, :] ^ SEEDS[rounds][:, None])
        spots = ((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
        values = (hashes & np.uint64(0xFFFFFFFF)) | (rounds.astype(np.uint64) << np.uint64(32))[:, None]
        np.minimum.at(bins, spots.ravel().astype(np.int64), values.ravel())
        if bins.max() < np.iinfo(np.uint64).max:
            return bins
    for place in np.flatnonzero(bins == np.iinfo(np.uint64).max):
        late = BINS + int(place)
        bins[place] = (mixed(items ^ SEEDS[late]) & np.uint64(0xFFFFFFFF)).min() | np.uint64(late << 32)
    return bins


def bands(bins: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band."""
    grid = bins.reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * MULTIPLY
    for column in range(ROWS):
        keys = mixed(keys ^ grid[:, column])
    return keys.view(np.int64)


def sketched(texts: DataFrame, width: int) -> DataFrame:
    """Rows (doc, number, n_shingles, h1, h2, bands) of (doc, number, text); h1 and h2 name the sequence of words, bands are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, high, low, keys = [], [], [], []
            for content in batch["text"]:
                words = words_of(content.as_py())
                items = shingles(words, width)
                name = xxhash.xxh3_128_intdigest(b" ".join(words))
                sizes.append(len(items))
                high.append((name >> 64) - (1 << 63))
                low.append((name & (1 << 64) - 1) - (1 << 63))
                keys.append(bands(sketch(items)) if len(items) else None)
            yield pa.RecordBatch.from_arrays([
                batch["doc"], batch["number"], pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
            ], ["doc", "number", "n_shingles", "h1", "h2", "bands"])

    return texts.mapInArrow(run, "doc long, number long, n_shingles long, h1 long, h2 long, bands array<long>")


def sets_of(texts: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """Rows (cls, items): the full set of each class of (cls, number), read from the text of the row with that number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [shingles(words_of(content.as_py()), width).tobytes() for content in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["cls"], pa.array(items, pa.binary())], ["cls", "items"])

    return texts.join(classes, "number").select("cls", "text").mapInArrow(run, "cls long, items binary")


def _items(sets: DataFrame) -> DataFrame:
    """Rows (cls, item) of the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, items in zip(batch["cls"].to_pylist(), batch["items"]):
                found = np.frombuffer(items.as_py(), np.int64)
                yield pa.RecordBatch.from_pydict({"cls": np.full(len(found), cls, np.int64), "item": found})

    return sets.mapInArrow(run, "cls long, item long")


def own_items(sets: DataFrame) -> DataFrame:
    """Rows (cls, own): how many shingles of a class no other class has."""
    single = _items(sets).groupBy("item").agg(F.min("cls").alias("cls"), F.max("cls").alias("most")).where("cls = most")
    return single.groupBy("cls").agg(F.count("*").alias("own"))


#: Bits of a ranked element that are hash; above them stands how many sets hold it, up to 127.
HASH_BITS = 56


def ranked_sets(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (cls, ranked): sets of the wanted classes as longs that hold, above ``HASH_BITS`` of an item, how many of these sets it is in."""
    chosen = sets.join(wanted.select("cls"), "cls", "left_semi")
    places = _items(chosen)
    counts = places.groupBy("item").agg(F.count("*").alias("n"))
    packed = F.shiftleft(F.least("n", F.lit(127)).cast("long"), HASH_BITS).bitwiseOR(F.col("item").bitwiseAND((1 << HASH_BITS) - 1))
    return places.join(counts, "item").groupBy("cls").agg(F.collect_list(packed).alias("ranked"))


def difference_prefixes(stars: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """Rows (pivot, cls, out, root, items, apart, at, item): first elements of how classes differ from their pivot.

    ``stars`` holds (pivot, cls, root, out, company): ``out`` marks classes of another component than the pivot, ``company`` counts the star.
    ``apart`` is the size of the difference, ``at`` the place of ``item`` in it. What only one class has comes
    first and is left out, since no other one can share it. Sets are taken apart in the JVM, so only differences reach Python.
    """
    kinds = "pivot long, cls long, out boolean, root long, items int, apart int, at int, item long"
    names = ["pivot", "cls", "out", "root", "items", "apart", "at", "item"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = [[] for _ in names]
            facts = zip(*(batch[c].to_pylist() for c in ("pivot", "cls", "out", "root", "company", "n", "m")))
            for row, (pivot, cls, out, root, company, n, m) in enumerate(facts):
                added, removed = (np.asarray(batch[c][row].values).astype(np.int64) for c in ("added", "removed"))
                items = np.concatenate([added, removed])
                # about how many of the star differ from the pivot in it: those that have it, or those that have not
                sharing = np.concatenate([added >> HASH_BITS, np.maximum(company - (removed >> HASH_BITS), 1)])
                alone = np.concatenate([added >> HASH_BITS == 1, np.zeros(len(removed), bool)])
                order = np.lexsort((items, np.where(alone, 0, sharing)))
                if out:  # a class that is not linked with the pivot shares all but this many at least
                    last = n * (100 - percent) // percent
                else:  # its partner is not, and differs from the pivot by more than linked sets may
                    last = (len(items) + max(0, n - m) * (100 - percent) // (100 + percent) + 3) // 2
                spots = np.flatnonzero(~alone[order][: last + 1])
                for values, value in zip(found, (pivot, cls, out, root, n, len(items), spots, items[order][spots])):
                    values.append(value if isinstance(value, np.ndarray) else np.full(len(spots), value))
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)).cast(t) for v, t in zip(found, types)], names)

    x = ranked.select("cls", F.col("ranked").alias("x"))
    y = ranked.select(F.col("cls").alias("pivot"), F.col("ranked").alias("y"))
    both = stars.join(x, "cls").join(y, "pivot").select(
        "pivot", "cls", "root", "out", "company", F.size("x").alias("n"), F.size("y").alias("m"),
        F.array_except("x", "y").alias("added"), F.array_except("y", "x").alias("removed"),
    )
    return both.mapInArrow(run, kinds)


def prefix_pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different components that share a prefix element of a star and have room for a link behind it."""
    x, y = prefixes.where("out").alias("x"), prefixes.alias("y")
    both = F.col("x.items") + F.col("y.items")
    apart = both - 2 * F.ceil(both * percent / (100 + percent))
    common = (F.col("x.apart") + F.col("y.apart") - apart) / 2
    room = F.least(F.col("x.apart") - F.col("x.at"), F.col("y.apart") - F.col("y.at"))
    once = ~F.col("y.out") | (F.col("x.cls") < F.col("y.cls"))
    near = F.least("x.items", "y.items") * 100 >= F.greatest("x.items", "y.items") * percent
    met = x.join(y, (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.item") == F.col("y.item")) & (F.col("x.root") != F.col("y.root")) & once & near & (room >= common))
    return met.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()


def may_link(n: Column, own: Column, other: Column, other_own: Column, percent: int) -> Column:
    """Whether two sets can be linked, given their sizes and how many items are theirs alone."""
    shared = F.least(n - own, other - other_own)
    return shared * 100 >= (n + other - shared) * percent


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    linked.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    left = sets.select(F.col("cls").alias("b"), F.col("items").alias("y"))
    right = sets.select(F.col("cls").alias("a"), F.col("items").alias("x"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean").where("linked").select("a", "b")


def connected(edges: DataFrame) -> DataFrame | None:
    """Rows (node, root): the smallest node of each connected component; None without edges.

    Alternating stars: the large star ties a node's larger neighbours to its smallest one, the
    small star its smaller ones; both keep components whole and end in stars around the roots.
    State between rounds is a table in the shared folder; two equal states, by count and
    checksum, end the rounds.
    """
    links = stored(edges.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).where("high <> low").distinct())
    state = _state(links)
    if not state[0]:
        release(links)
        return None
    while True:
        both = links.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(links.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low"))
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        tied = large.join(least, "high")
        small = tied.select(F.col("low").alias("high"), F.col("m").alias("low")).unionByName(least.select("high", F.col("m").alias("low"))).where("high <> low").distinct()
        small = stored(small)
        release(links)
        links, before, state = small, state, _state(small)
        if state == before:
            roots = links.select(F.col("high").alias("node"), F.col("low").alias("root"))
            roots.stored_path = links.stored_path
            return roots


def joined_by(labels: DataFrame, links: DataFrame) -> DataFrame:
    """A stored table of ``labels`` (cls, root) whose components are joined where links (a, b) run between classes of theirs."""
    named = labels.select(F.col("cls").alias("a"), F.col("root").alias("ra"))
    ends = links.join(named, "a").join(named.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b")
    roots = connected(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    if roots is None:
        return stored(labels)
    moved = labels.join(roots, labels["root"] == roots["node"], "left")
    found = stored(moved.select("cls", F.coalesce(roots["root"], labels["root"]).alias("root")))
    release(roots)
    return found


def _state(links: DataFrame) -> tuple[int, int | None]:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first())


def components(
    docs: DataFrame, *, doc: str = "doc_id", text: str = "text", number: str | None = None, width: int = 5, percent: int = 80
) -> DataFrame:
    """Near-duplicate groups: (doc, n_shingles, component_id, kept), one row per row of ``docs``.

    Words are lower-cased by A-Z. Two documents are linked if ``100 * intersection >= percent * union`` of their sets of
    ``width``-word shingles; a document with fewer words has them all as its one shingle; one without words or with a null text
    has an empty set and stays alone. ``component_id`` is the smallest id that links reach; ``kept`` marks it.

    Rows of equal text share a component; rows that repeat an id are kept or not together. A null id counts as larger than every
    number: its component has the smallest number in it, or null if there is none, and it is never kept unless alone.
    ``number`` names a column of ``docs`` that numbers its rows and is stored with them; without it the texts are stored with such a
    number. An empty table gives an empty result.
    """
    with_small_batches(docs.sparkSession)
    texts = docs.select(F.col(doc).cast("long").alias("doc"), (F.col(number) if number else F.monotonically_increasing_id()).alias("number"), F.col(text).alias("text"))
    if not number:
        texts = stored(texts)
    rows = stored(sketched(texts, width))
    filled = rows.where("n_shingles > 0")
    classes = filled.groupBy("h1", "h2").agg(F.min("doc").alias("rep"), F.min("number").alias("number"), F.min("n_shingles").alias("items"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()))
    firsts = filled.join(classes, ["h1", "h2", "number"]).select("cls", "items", F.explode("bands").alias("bucket"))
    crowded = firsts.groupBy("bucket").agg(F.min("cls").alias("least"), F.max("cls").alias("most"), F.count("*").alias("size"))
    crowded = crowded.where("least <> most").select("bucket", "size")
    members = stored(firsts.join(crowded, "bucket"))
    wanted = members.select("cls").distinct()
    sets = stored(sets_of(texts, classes.select("cls", "number").join(wanted, "cls"), width))
    if not number:
        release(texts)
    # a text that others were made from meets them in more and larger buckets than they meet each other
    known = members.groupBy("cls").agg(F.sum("size").alias("company"), F.first("items").alias("items")).join(own_items(sets), "cls", "left")
    known = known.withColumn("own", F.coalesce("own", F.lit(0))).where((F.col("items") - F.col("own")) * 100 >= F.col("items") * percent)
    known = stored(known)
    placed = stored(members.select("bucket", "cls").join(known.select("cls", "company"), "cls"))
    release(members)
    pivots = placed.groupBy("bucket").agg(F.max_by("cls", F.struct("company", -F.col("cls"))).alias("pivot"), F.count("*").alias("n")).where("n > 1")
    stars = stored(placed.select("bucket", "cls").join(pivots.select("bucket", "pivot"), "bucket").select("pivot", "cls").distinct())
    release(placed)
    facts = known.select("cls", "items", "own")
    arms = stars.where("pivot <> cls").join(facts, "cls").join(facts.select(*[F.col(c).alias(f"pivot_{c}") for c in facts.columns]).withColumnRenamed("pivot_cls", "pivot"), "pivot")
    arms = arms.where(may_link(F.col("items"), F.col("own"), F.col("pivot_items"), F.col("pivot_own"), percent))
    labels = joined_by(known.select("cls", F.col("cls").alias("root")), confirmed(arms.select(F.col("pivot").alias("a"), F.col("cls").alias("b")), sets, percent))
    # of the stars whose other classes are not one component: who differs how from the pivot
    rooted = stars.join(labels, "cls").join(labels.select(F.col("cls").alias("pivot"), F.col("root").alias("pivot_root")), "pivot")
    others = F.when(F.col("cls") != F.col("pivot"), F.col("root"))
    mixed_ = rooted.groupBy("pivot").agg(F.min(others).alias("least"), F.max(others).alias("most"), F.count("*").alias("company")).where("least <> most")
    open_stars = stored(
        rooted.where("cls <> pivot").join(mixed_.select("pivot", "company"), "pivot").select("pivot", "cls", "root", (F.col("root") != F.col("pivot_root")).alias("out"), "company")
    )
    wanted = open_stars.select("cls").union(open_stars.select("pivot")).distinct()
    ranked = stored(ranked_sets(sets, wanted))
    prefixes = stored(difference_prefixes(open_stars, ranked, percent))
    links = confirmed(prefix_pairs(prefixes, percent), sets, percent)
    final = joined_by(labels, links)
    release(known, stars, open_stars, ranked, prefixes, sets)
    first = classes.join(final, "cls", "left").select("h1", "h2", "rep", F.coalesce("root", "cls").alias("root"))
    lowest = first.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = first.join(lowest, "root").select("h1", "h2", "component_id")
    joined = filled.select("doc", "n_shingles", "h1", "h2").join(named, ["h1", "h2"]).select("doc", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0").select("doc", "n_shingles", F.col("doc").alias("component_id"))
    every = joined.unionByName(alone)
    found = stored(every.withColumn("kept", F.col("doc").eqNullSafe(F.col("component_id"))))
    release(rows, classes, labels, final)
    return found
