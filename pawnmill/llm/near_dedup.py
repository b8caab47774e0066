"""Near-duplicate classes: BagMinHash, banding, and verified multiset overlap.

1. Each whole text becomes a bag of five-word shingles; texts with equal bags form one set,
   which its digest names; a number for it, ``rep``, goes on. One pass yields the bag's
   digest and its band keys (BANDS bands of ROWS signature components).
2. Sets that share a band key are candidates. Their bags are read again, for
   candidates only, and each gets the weight ``own`` of shingles that no other candidate has.
   own bounds the similarity with anyone: at most min(|x| - own_x, |y| - own_y) can be
   common. Entries that cannot reach the threshold with any member of their bucket leave it.
3. Each entry is compared with its bucket's pivot, the member with the least own weight;
   verified links give components. That is linear in the entries, whatever a bucket's size.
4. What the pivots did not settle is settled exactly: members outside a bucket's largest
   component are compared with the bucket's members in other components, as far as the bound
   allows, in cells of bounded size. So no link between candidates that could join two
   classes goes unseen, and a group of copies is never expanded into pairs.
5. Classes are components; a class is named by its least document.

Tables by bucket, class or component are written before rows look them up, so the sides of
those joins are plain shuffles, which Spark splits where one key is hot. The number of
candidates' entries bounds the tables of ids that follow: where it is small, they go on in few
partitions and are broadcast.

Two bags of similarity 0.8 share a band with probability 1 - (1 - 0.8^ROWS)^BANDS, which is
0.9999 for the constants below.

Defined results: words are lower-cased and parted by white space; a text of fewer than five
words is one shingle; rows that share an id but not their text are classed each by its own
text; texts without words, null ones among them, are one class; a class without any id has
the class id null; repeated rows share a class, and each says the same, but
``drop_near_duplicates`` keeps one of them; of the rows with a class's id, those with the least
hash of their text are kept; an empty table gives no rows; extra columns are ignored by
``near_classes`` and passed through, whatever their names, by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bag_minhash import band_keys, signatures
from .common import col, gathered, keep_one_each, looked_up, materialise, parts, text_or_empty
from .components import components
from .shingles import WORDS, overlap, shingle_bag
from .slots import slot_map

BANDS, ROWS, THRESHOLD = 24, 5, 0.8
#: Members of a bucket that one cell holds of either side, and rows that are unpacked together.
CELL, CHUNK = 256, 256


def _digests(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.array([np.frombuffer(xxhash.xxh3_128_digest(b[0].tobytes() + b[1].tobytes()), dtype="<i8") for b in bags]).reshape(-1, 2)


def text_hash(text_col: str) -> Column:
    return F.xxhash64(text_or_empty(text_col)).alias("text_hash")


def _sketch(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, text_hash, set_hi, set_lo, mass (shingles with repeats) and bands of every row."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                bags = [shingle_bag(t, words) for t in part.column(1).to_pylist()]
                sizes = np.array([len(b[0]) for b in bags])
                owner = np.repeat(np.arange(len(bags)), sizes)
                sig = signatures(owner, np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]), len(bags), BANDS * ROWS)
                keys = band_keys(sig, BANDS, ROWS)
                names = _digests(bags)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(names[:, 0].copy()),
                        pa.array(names[:, 1].copy()),
                        pa.array([int(b[1].sum()) for b in bags], pa.int64()),
                        pa.array([k.tolist() if n else [] for k, n in zip(keys, sizes)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "set_hi", "set_lo", "mass", "bands"],
                )

    return df.select(col(id_col).alias("id"), text_or_empty(text_col).alias("text"), text_hash(text_col)).mapInArrow(run, f"doc_id {id_type}, text_hash bigint, set_hi bigint, set_lo bigint, mass bigint, bands array<bigint>")


def _bags(df: DataFrame, wanted: DataFrame, text_col: str, words: int) -> DataFrame:
    """rep, shingles, counts (packed) for the sets in wanted (rep, set_hi, set_lo, and text_hash of a member).

    The map of hash slots of those texts (2 MiB) lets others leave before any shuffle; the
    digest decides.
    """
    slots = slot_map(wanted.select(F.col("text_hash").alias("h")))
    shared = df.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .slots import in_slots

        for batch in batches:
            rows = np.flatnonzero(in_slots(shared.value, batch.column(1).to_numpy()))
            for part in parts(batch.take(pa.array(rows)), text=0) if len(rows) else ():
                bags = [shingle_bag(t, words) for t in part.column(0).to_pylist()]
                names = _digests(bags)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array([b[0].tobytes() for b in bags], pa.binary()), pa.array([b[1].astype("<i4").tobytes() for b in bags], pa.binary())],
                    names=["set_hi", "set_lo", "shingles", "counts"],
                )

    some = df.select(text_or_empty(text_col).alias("text"), text_hash(text_col).alias("h"))
    found = some.mapInArrow(run, "set_hi bigint, set_lo bigint, shingles binary, counts binary")
    # copies of a text leave one row a task
    met = found.dropDuplicates(["set_hi", "set_lo"]).join(wanted.select("set_hi", "set_lo", "rep"), ["set_hi", "set_lo"])
    return met.select("rep", "shingles", "counts")


def _own_mass(bags: DataFrame) -> DataFrame:
    """rep, own: the weight of its shingles that no other bag has."""
    id_type = bags.schema["rep"].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                h = np.frombuffer(batch.column(1)[k].as_py(), dtype="<i8")
                n = np.frombuffer(batch.column(2)[k].as_py(), dtype="<i4")
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(h), k, dtype=np.int32))), pa.array(h), pa.array(n)], names=["rep", "shingle", "n"])

    lone = bags.select("rep", "shingles", "counts").mapInArrow(spread, f"rep {id_type}, shingle bigint, n int").groupBy("shingle").agg(F.count(F.lit(1)).alias("bags"), F.min("rep").alias("rep"), F.max("n").alias("n"))
    return lone.where("bags = 1").groupBy("rep").agg(F.sum("n").alias("own"))


def _verify(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """a, b of those pairs whose bags overlap by the threshold or more."""
    id_type = bags.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                raw = [batch.column(c)[k].as_py() for c in range(2, 6)]
                x = np.frombuffer(raw[0], dtype="<u8"), np.frombuffer(raw[1], dtype="<i4")
                y = np.frombuffer(raw[2], dtype="<u8"), np.frombuffer(raw[3], dtype="<i4")
                if overlap(x, y) >= threshold:
                    keep.append(k)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    x = bags.select(F.col("rep").alias("a"), F.col("shingles").alias("xs"), F.col("counts").alias("xn"))
    y = bags.select(F.col("rep").alias("b"), F.col("shingles").alias("ys"), F.col("counts").alias("yn"))
    joined = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "xs", "xn", "ys", "yn")
    return joined.mapInArrow(run, f"a {id_type}, b {id_type}")


def _settle(open_entries: DataFrame, bands: DataFrame, bags: DataFrame, threshold: float, most: int) -> DataFrame:
    """a, b of every link between different components of a bucket, by comparing all that may be one; there are at most ``most`` open entries.

    Buckets of one largest component hold much the same members, so they are taken together:
    each member comes once, not once a band. The members outside the component (side 0) and
    all members (side 1) are dealt by hash into groups of about CELL; each pair of groups is a
    cell with its own task slot, so neither a task nor a row holds a whole bucket. Rows meet
    sorted by cell; two members are compared if they share a band key and the bound allows,
    and pairs exist only while they are compared.
    """
    id_type = open_entries.schema["rep"].dataType.simpleString()
    members = materialise(gathered(open_entries.select("largest", "rep", "mass", "rest", "root").distinct(), most))
    minor = F.col("root") != F.col("largest")
    sizes = members.groupBy("largest").agg(F.count_if(minor).alias("minors"), F.count(F.lit(1)).alias("members"))
    groups = materialise(gathered(sizes, most)).select("largest", F.ceil(F.col("minors") / CELL).cast("int").alias("rows"), F.ceil(F.col("members") / CELL).cast("int").alias("columns"))
    dealt = members.join(looked_up(groups, most), "largest").join(bands, "rep").join(bags, "rep")
    mine = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    fields = ["largest", "i", "j", "side", "rep", "root", "minor", "mass", "rest", "bands", "shingles", "counts"]
    left = dealt.where(minor).withColumns({"side": F.lit(0), "minor": F.lit(True), "i": mine(F.col("rows")), "j": F.explode(every(F.col("columns")))})
    right = dealt.withColumns({"side": F.lit(1), "minor": minor, "j": mine(F.col("columns")), "i": F.explode(every(F.col("rows")))})
    rows = left.select(*fields).unionByName(right.select(*fields)).repartition("largest", "i", "j").sortWithinPartitions("largest", "i", "j", "side")
    need, slack = threshold / (1 + threshold), 1e-9

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, firsts, table = None, [], None
        for batch in batches:
            a, b = [], []
            for r in (r for at in range(0, batch.num_rows, CHUNK) for r in batch.slice(at, CHUNK).to_pylist()):
                here = r["largest"], r["i"], r["j"]
                if here != cell:
                    cell, firsts, table = here, [], None
                bag = np.frombuffer(r["shingles"], dtype="<u8"), np.frombuffer(r["counts"], dtype="<i4")
                if r["side"] == 0:
                    firsts.append((r["rep"], r["root"], r["mass"], r["rest"], r["bands"], bag))
                    continue
                if table is None and firsts:
                    table = np.array([f[4] for f in firsts]), np.array([f[2] for f in firsts]), np.array([f[3] for f in firsts])
                if not firsts:
                    continue
                may = (table[0] == np.array(r["bands"])).any(axis=1) & (np.minimum(table[2], r["rest"]) + slack >= need * (table[1] + r["mass"]))
                for k in np.flatnonzero(may).tolist():
                    rep, root, _, _, _, other = firsts[k]
                    if root != r["root"] and (not r["minor"] or rep < r["rep"]) and overlap(other, bag) >= threshold:
                        a.append(rep)
                        b.append(r["rep"])
            yield pa.RecordBatch.from_arrays([pa.array(a, batch.schema.field("rep").type), pa.array(b, batch.schema.field("rep").type)], names=["a", "b"])

    return rows.mapInArrow(compare, f"a {id_type}, b {id_type}")


def near_classes(df: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, class_size and kept for every row of df."""
    return _classes(df, threshold, words, id_col, text_col).select("doc_id", "class_id", "class_size", "kept")


def _classes(df: DataFrame, threshold: float, words: int, id_col: str, text_col: str) -> DataFrame:
    """The columns of near_classes, and text_hash."""
    sketch = materialise(_sketch(df, id_col, text_col, words))
    # the least member decides: null ids last, then by the text's hash
    member = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    sets = materialise(
        sketch.groupBy("set_hi", "set_lo").agg(F.min(member).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("mass").alias("mass"), F.first("bands").alias("bands")).withColumn("rep", F.monotonically_increasing_id())
    )
    entries = sets.select("rep", "mass", F.posexplode("bands").alias("band", "key"))
    crowded = entries.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("mass").alias("smallest")).where("n > 1").select("band", "key", "smallest")
    entries = materialise(entries.join(materialise(crowded), ["band", "key"]))
    most = entries.count()
    few, small = lambda t: gathered(t, most), lambda t: looked_up(t, most)
    entries = few(entries)
    candidates = few(entries.select("rep").distinct())
    wanted = few(materialise(sets.join(small(candidates), "rep", "left_semi").select("rep", "set_hi", "set_lo", "first.text_hash")))  # sets are read by all tasks
    bags = materialise(_bags(df, wanted, text_col, words))
    own = materialise(few(_own_mass(bags)))

    # common <= least of (mass - own); the threshold t asks for common >= t / (1 + t) * (mass_x + mass_y)
    need = threshold / (1 + threshold)
    slack = 1e-9
    entries = entries.join(small(own), "rep", "left").withColumn("own", F.coalesce("own", F.lit(0))).withColumn("rest", F.col("mass") - F.col("own"))
    entries = materialise(few(entries.where(F.col("rest") + slack >= need * (F.col("mass") + F.col("smallest"))).drop("smallest")))

    central = F.struct((F.col("own") / F.col("mass")).alias("share"), F.col("rep").alias("rep"), F.col("mass").alias("mass"), F.col("rest").alias("rest"))
    pivots = materialise(few(entries.groupBy("band", "key").agg(F.min(central).alias("pivot"))))
    possible = lambda x_mass, x_rest, y_mass, y_rest: F.least(x_rest, y_rest) + slack >= need * (x_mass + y_mass)
    stars = (
        entries.join(small(pivots), ["band", "key"])
        .where(F.col("rep") != F.col("pivot.rep"))
        .where(possible(F.col("mass"), F.col("rest"), F.col("pivot.mass"), F.col("pivot.rest")))
        .select(F.col("rep").alias("a"), F.col("pivot.rep").alias("b"))
        .distinct()
    )
    links = materialise(_verify(materialise(few(stars)), bags, threshold))
    roots = components(links)

    marked = materialise(few(entries.join(small(roots.withColumnRenamed("node", "rep")), "rep", "left").withColumn("root", F.coalesce("root", "rep"))))
    sizes = few(marked.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n")))
    several = sizes.groupBy("band", "key").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).alias("largest")).where("roots > 1")
    several = materialise(few(several.select("band", "key", F.col("largest.root").alias("largest"))))
    open_entries = marked.join(small(several), ["band", "key"]).select("rep", "mass", "rest", "root", "largest")
    more = materialise(_settle(open_entries, sets.select("rep", "bands"), bags, threshold, most))
    if more.limit(1).count():
        roots = components(links.unionByName(more))

    classes = sets.select("set_hi", "set_lo", "rep", "first", "copies").join(small(roots.withColumnRenamed("node", "rep")), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    classes = materialise(classes.select("set_hi", "set_lo", "root", "first", "copies"))
    whole = materialise(classes.groupBy("root").agg(F.min("first").alias("least"), F.sum("copies").alias("class_size")))
    named = materialise(classes.select("set_hi", "set_lo", "root").join(whole, "root").select("set_hi", "set_lo", "least", "class_size"))
    found = sketch.select("doc_id", "text_hash", "set_hi", "set_lo").join(named, ["set_hi", "set_lo"])
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    return found.select("doc_id", "text_hash", F.col("least.doc_id").alias("class_id"), "class_size", kept.alias("kept"))


def drop_near_duplicates(df: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, one document of each class, with df's columns."""
    rows = materialise(_classes(df, threshold, words, id_col, text_col).where("class_size > 1").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("mark"), "kept"))
    repeated = materialise(rows.where("kept").groupBy("id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "mark"))
    return keep_one_each(df, id_col, text_hash(text_col), rows.where("NOT kept").select("id", "mark").distinct(), repeated)
