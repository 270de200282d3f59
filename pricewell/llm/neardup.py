"""Near-duplicates: MinHash samples folded into odd sketches, banded candidates, exact confirmation, components.

1. One pass over the texts gives each document's set size, set digest, band keys and odd sketch (parity bitmap of its MinHash samples).
2. Documents of equal sets form a class; only its least doc_id goes on, so exact copies cost nothing.
3. Classes that share a band key are candidates.  A key of few classes gives its pairs; a key of many links each to its hub (the class that shares most hot
   keys), so that a hot key gives as many pairs as it has classes.
4. The XOR population count of two odd sketches estimates their similarity; clear misses go, the rest are confirmed on full sets.
5. Components by label propagation with pointer jumping.
6. A star leaves open whether two classes that it did not join are alike.  Classes of hot keys that lie in several components are compared exactly by prefix
   filtering: shingles are ordered from rare to frequent and alike sets must share one of the first size - ceil(0.8 size) + 1.  Inside that join the odd
   sketches of the sets themselves are compared: their XOR population count never exceeds the symmetric difference.  Then step 5 again.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, release
from .textarrays import mix, runs, shingles, span_hashes, text_bytes, word_spans

SIMILAR = Fraction(4, 5)
# 32 bands of 5 samples: two sets of similarity 0.8 share no band once in 300,000.
BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
BITS = 1024
# Sketches are noisy: a pair goes only if its estimate is this far below the threshold, over five standard errors of 160 samples at 0.8.
SLACK = 0.2
# A band key of more classes is hot.
STAR = 12
# Words of 64 bits of the odd sketch of a whole set.
PARITY = 16

_A = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
_B = mix(np.arange(1001, 1001 + SAMPLES, dtype=np.uint64))


def document_sets(column, n: int):
    """The sorted distinct shingle hashes of each text of a column, one run of rows at a time: (first row, list of arrays)."""
    buf, off = text_bytes(column)
    for i, j in runs(off):
        part, at = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, first = word_spans(part, at)
        hashes, rows = shingles(span_hashes(part, starts, ends), first, n)
        yield i, [np.unique(hashes[rows[r] : rows[r + 1]]) for r in range(j - i)]


def min_hashes(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, SAMPLES) least hash values of the rows' sets; every row is non-empty."""
    out = np.empty((SAMPLES, len(first)), np.uint64)
    work = np.empty_like(flat)
    for k in range(SAMPLES):
        np.multiply(flat, _A[k], out=work)
        work += _B[k]
        out[k] = np.minimum.reduceat(work, first)
    return out.T


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """(rows, BITS / 8) parity bitmaps: each sample flips one bit."""
    rows = len(samples)
    bit = (mix(samples + _A[None, :]) >> np.uint64(32)).astype(np.int64) % BITS
    flips = np.bincount((np.arange(rows)[:, None] * BITS + bit).ravel(), minlength=rows * BITS).reshape(rows, BITS)
    return np.packbits((flips & 1).astype(np.uint8), axis=1)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of pairs of odd sketches from the population count of their XOR."""
    odd = np.unpackbits(a ^ b, axis=1).sum(1)
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * odd / BITS, 1e-9))


def band_keys(samples: np.ndarray) -> np.ndarray:
    part = samples.reshape(len(samples), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :], part.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key ^ part[:, :, r])
    return key.view(np.int64)


def _signer(n: int):
    def sign(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for i, sets in document_sets(batch.column("text"), n):
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                bands = [None] * len(sets)
                odd = [None] * len(sets)
                digest = [None] * len(sets)
                # Sets are cut into stretches that stay in the cache while all samples pass over them.
                stretch, held = [], 0
                for r in [*full, -1]:
                    if stretch and (r < 0 or held + size[r] > 20_000):
                        flat = np.concatenate([sets[x] for x in stretch])
                        samples = min_hashes(flat, np.concatenate([[0], np.cumsum(size[stretch])[:-1]]))
                        for x, key, bits in zip(stretch, band_keys(samples), odd_sketches(samples), strict=True):
                            bands[x], odd[x] = key, bits.tobytes()
                            digest[x] = hashlib.blake2b(sets[x].tobytes(), digest_size=16).digest()
                        stretch, held = [], 0
                    if r >= 0:
                        stretch.append(r)
                        held += size[r]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, len(sets)), pa.array(size), pa.array(digest, pa.binary()), pa.array(odd, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "digest", "odd", "bands"],
                )

    return sign


def _estimated(batches):
    for batch in batches:
        bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BITS // 8) for c in ("odd_a", "odd_b")]
        near = estimate(*bits) >= float(SIMILAR) - SLACK if batch.num_rows else np.zeros(0, bool)
        yield batch.select(["a", "b"]).filter(pa.array(near))


def set_parities(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, PARITY) odd sketches of whole sets: each member flips one bit."""
    bits = 64 * PARITY
    out = np.empty((len(sets), bits), np.uint8)
    for r, s in enumerate(sets):
        out[r] = np.bincount((s >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(out, axis=1).view(np.uint64)


def _set_maker(n: int):
    def make(batches):
        for batch in batches:
            for i, sets in document_sets(batch.column("text"), n):
                parity = [p.view(np.int64) for p in set_parities(sets)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, len(sets)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64()))],
                    ["id", "set", "parity"],
                )

    return make


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are alike."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    union = F.size("set_a") + F.size("set_b") - common
    return both.where(common * SIMILAR.denominator >= union * SIMILAR.numerator).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): least id reachable over undirected edges (a, b), for every id that has an edge.

    In each round every component hooks onto its least neighbour, chains of hooks are halved twice, and the graph shrinks to the components and the
    edges between them, so the rounds follow the logarithm of the longest path.
    """
    between = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    between = cut_lineage(between.where("a <> b").distinct())
    comp = between.select(F.col("a").alias("id")).distinct().withColumn("comp", F.col("id"))
    while not between.isEmpty():
        hook = between.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("h"))
        for _ in range(2):
            jump = hook.select(F.col("a").alias("h"), F.col("h").alias("next"))
            hook = cut_lineage(hook.join(jump, "h").select("a", F.col("next").alias("h")))
        comp = cut_lineage(comp.join(hook.withColumnRenamed("a", "comp"), "comp", "left").select("id", F.coalesce("h", "comp").alias("comp")))
        other = hook.select(F.col("a").alias("b"), F.col("h").alias("hb"))
        between = between.join(hook, "a").join(other, "b").where("h <> hb")
        between = cut_lineage(between.select(F.col("h").alias("a"), F.col("hb").alias("b")).distinct())
    return comp


def may_be_alike(odd, size) -> Column:
    """Whether sets of together ``size`` members whose parities differ in ``odd`` bits may be alike.

    Alike sets differ in at most size / 9 members, and no more bits can be odd.  So many members flip fewer bits; six standard deviations are allowed.
    """
    bits = 64 * PARITY
    most = size * float((1 - SIMILAR) / (1 + SIMILAR))
    return (odd <= most + 1e-6) & (odd <= bits / 2 * (1 - F.exp(-2 * most / bits)) + 3 * bits**0.5)


def rest_pairs(sets: DataFrame, comp: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components that may be alike, by prefix filtering over ``sets`` (id, set, parity).

    The parities stand inside the join on the shingle: compared after it, the pairs that meet would grow with the square of a hot shingle's sets.
    """
    n = F.size("set")
    one = sets.join(comp, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"), n.alias("n"), F.explode("set").alias("s"))
    often = one.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    # A shingle of one set cannot be shared, yet it takes a place in the prefix: sets keep the places of their own shingles.
    shared = one.join(often, "s")
    order = Window.partitionBy("id").orderBy("df", "s")
    own = F.col("n") - F.count("*").over(Window.partitionBy("id"))
    head = shared.withColumns({"place": own + F.row_number().over(order), "need": F.ceil(F.col("n") * SIMILAR.numerator / SIMILAR.denominator)})
    head = head.where(F.col("place") <= F.col("n") - F.col("need") + 1).select("s", "id", "comp", "n")
    many = head.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("s")
    bits = sets.select("id", *[F.col("parity")[k].alias(f"p{k}") for k in range(PARITY)])
    head = cut_lineage(head.join(many, "s").join(bits, "id"))
    other = head.select("s", *[F.col(c).alias(f"{c}_b") for c in head.columns if c != "s"])
    odd = sum((F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"p{k}_b"))) for k in range(1, PARITY)), F.bit_count(F.col("p0").bitwiseXOR(F.col("p0_b"))))
    alike = (head["s"] == other["s"]) & (F.col("id") < F.col("id_b")) & (F.col("comp") != F.col("comp_b")) & may_be_alike(odd, F.col("n") + F.col("n_b"))
    met = cut_lineage(head.join(other, alike).select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct())
    release(head)
    return met


def near_duplicates(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text; other columns are ignored).

    A text's set holds the distinct runs of ``n`` words (A-Z lower-cased); with fewer words the whole sequence.  Two rows are linked if their sets' Jaccard
    similarity is 0.8 or more; ``component_id`` is the least doc_id reachable and ``kept`` says that it is the row's own.  Null and wordless texts have the
    empty set and are linked with nothing.  Repeated rows fall in one class (each repetition is returned); rows of a null id keep a null component.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut_lineage(docs.mapInArrow(_signer(n), "doc_id long, n_shingles long, digest binary, odd binary, bands array<long>"))
    alike = cut_lineage(signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep")))
    classes = signed.join(alike, "digest").where("doc_id = rep").select("rep", "odd", "bands")
    keys = classes.select(F.explode("bands").alias("key"), "rep")
    stats = cut_lineage(keys.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"))
    keys = cut_lineage(keys.join(stats, "key"))

    few = keys.where(F.col("many") <= STAR).groupBy("key").agg(F.array_sort(F.collect_set("rep")).alias("m"))
    later = lambda x, i: F.transform(F.slice(F.col("m"), i + 2, STAR), lambda y: F.struct(x.alias("a"), y.alias("b")))
    few = few.select(F.explode(F.flatten(F.transform("m", later))).alias("p")).select("p.*")
    hot = keys.where(F.col("many") > STAR)
    hot = hot.join(hot.groupBy("rep").agg(F.sum("many").alias("weight")), "rep")
    hubs = hot.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("hub"))).alias("top")).select("key", (-F.col("top.hub")).alias("hub"))
    hot = cut_lineage(hot.join(hubs, "key").select("key", "rep", "hub"))
    star = hot.where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
    pairs = cut_lineage(few.union(star).distinct())

    odd = classes.select("rep", "odd")
    sketched = pairs.join(odd.select(F.col("rep").alias("a"), F.col("odd").alias("odd_a")), "a").join(odd.select(F.col("rep").alias("b"), F.col("odd").alias("odd_b")), "b")
    likely = cut_lineage(sketched.mapInArrow(_estimated, "a long, b long"))
    release(stats, keys, pairs)

    # Full sets of the classes that are to be compared, from their texts.
    ids = likely.select(F.col("a").alias("id")).union(likely.select("b")).union(hot.select("rep")).distinct()
    texts = docs.join(ids, docs["doc_id"] == ids["id"], "left_semi")
    sets = cut_lineage(texts.mapInArrow(_set_maker(n), "id long, set array<long>, parity array<long>"))
    edges = cut_lineage(confirmed(likely, sets))
    release(likely)
    comp = components(edges)

    # Hot keys whose classes lie in several components.
    hot = hot.join(comp, hot["rep"] == comp["id"], "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    open_keys = hot.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    rest = cut_lineage(hot.join(open_keys, "key").select(F.col("rep").alias("id")).distinct())
    if not rest.isEmpty():
        sets = sets.join(rest, "id", "left_semi")
        more = confirmed(rest_pairs(sets, comp), sets)
        comp = components(edges.union(more))

    whole = alike.join(comp, alike["rep"] == comp["id"], "left").select("digest", F.coalesce("comp", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "digest").join(whole, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, n: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of the least doc_id, and one of each repeated doc_id; rows of a null id stay."""
    got = cut_lineage(near_duplicates(docs, n).where("doc_id IS NOT NULL").select("doc_id", "kept"))
    dropped = got.where("NOT kept").select("doc_id").distinct()
    out = docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    again = got.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.isEmpty():
        # Rows that share an id: the one of the least text hash stays.
        first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
        rows = out.join(again, "doc_id", "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        out = out.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(rows)
    return out
