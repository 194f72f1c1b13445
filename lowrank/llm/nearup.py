"""Near-duplicate groups by consistent weighted sampling (operator 5).

A text is a weighted set of five-word shingles: term frequency times
``log(1 + N / df)``, N and df counted over different texts in ``2^FEATURE_BITS``
hashed features (a vector of fixed size), so copies of a text lower no weight.  Improved consistent weighted sampling
draws ``BANDS * ROWS`` samples; for sample ``d`` and shingle ``k`` with weight w:
r, c ~ Gamma(2, 1) and b ~ U(0, 1) are functions of (d, k),
``t = floor(log w / r + b)``, ``log a = log c - r (t - b) - r``, and the
smallest a wins; two sets share a sample with the probability of their weighted
Jaccard similarity.  Equal samples in one band of rows make a bucket.

Exact copies are put together first, by digest, so links are sought between
different texts only.  Members of a bucket are compared with its smallest and
its largest member (two rows a member), exactly, by weighted Jaccard on whole
texts, unless their total weights alone put them below the threshold.  Verified
links give components by label propagation with pointer jumping; then, in buckets that
still hold several components, the smallest members of the two outermost ones
are compared with the members of the others, until no new link appears.  What
is left in such mixed buckets is compared exactly: members are put in blocks by
level of total weight and a salt, and every pair of members of different
components is tested in the one pair of blocks that holds it; levels too far
apart for the threshold never meet.  So each pair of texts that share a bucket
lies in one component or was compared.  Pairs, links and labels stay
distributed.

Defined cases: null text is empty; texts without words are alike only to
equal ones (exact copies); a document is an id with a text, so rows repeated
with one doc_id (null included) are one document when their texts are equal and
separate ones otherwise; a null id is the smallest id; the class is the smallest
id of the group, of several texts under that id the one with the smallest
digest is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowrank.llm.common import Powers, by_value, mix64, read_table, save_table, shingle_hashes, text_blocks

by_value(__name__)

BANDS, ROWS = 10, 4
THRESHOLD = 0.8
FEATURE_BITS = 18
KEY_BITS = 44                          # of a shingle's hash: its identity within the kernels
BROADCAST_IDS = 200_000                # texts up to this count may be broadcast by id and digest (8 MB)
_BLOCK = 256 << 10
BLOCK_TEXTS, BLOCK_WEIGHT = 256, 1e6   # of a block of a mixed bucket: about so many texts and so much total weight
_LOWEST = -(1 << 63)
NODE = "struct<id:bigint,digest:binary>"        # a different text: the smallest id that holds it, and its digest
_LOG = -np.log((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)    # exponential variates by 16-bit index


def weighted_shingles(arr, powers: Powers, idf: np.ndarray | None):
    """(text number, key, weight) of the distinct shingles of each text,
    sorted; the weight is the count when there is no idf."""
    h, offs = shingle_hashes(arr, powers)
    doc = np.repeat(np.arange(len(arr), dtype=np.uint64), np.diff(offs))
    both, count = np.unique((doc << np.uint64(KEY_BITS)) | (h >> np.uint64(64 - KEY_BITS)), return_counts=True)
    key = both & np.uint64((1 << KEY_BITS) - 1)
    weight = count.astype(np.float64)
    if idf is not None:
        weight *= idf[(key >> np.uint64(KEY_BITS - FEATURE_BITS)).astype(np.int64)]
    return (both >> np.uint64(KEY_BITS)).astype(np.int64), key, weight


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers, total, n = Powers(), np.zeros(1 << FEATURE_BITS, np.int64), 0
    for _, texts in text_blocks(batches, "text"):
        doc, key, _ = weighted_shingles(texts, powers, None)
        feature = (key >> np.uint64(KEY_BITS - FEATURE_BITS)).astype(np.int64)
        once = np.unique(doc << FEATURE_BITS | feature) & ((1 << FEATURE_BITS) - 1)
        total += np.bincount(once, minlength=len(total))
        n += len(texts)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(total[used], n))], names=["feature", "n"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """log(1 + N / df) of each hashed feature, over all rows of ``text``,
    which are to be different texts."""
    counts = texts.select("text").mapInArrow(_features, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    counts = counts.toArrow()                   # at most 2^FEATURE_BITS + 1 rows
    df, at = np.zeros((1 << FEATURE_BITS) + 1), counts.column("feature").to_numpy()
    df[at] = counts.column("n").to_numpy()      # -1, the last: the number of texts
    return np.log1p(df[-1] / np.maximum(df[:-1], 1))


def samples(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, count: int) -> np.ndarray:
    """n x count sample identities of the weighted sets (0: an empty set)."""
    out = np.zeros((n, count), np.uint32)
    if not len(key):
        return out
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    log_w = np.log(weight).astype(np.float32)
    low = np.uint64(0xFFFF)
    for d in range(count):
        z = mix64(key + np.uint64((d + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        r = _LOG[z & low] + _LOG[(z >> np.uint64(16)) & low]
        c = _LOG[(z >> np.uint64(32)) & low] + _LOG[z >> np.uint64(48)]
        b = ((z * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0 ** -24)
        a = np.log(c) - r * (np.floor(log_w / r + b) - b + np.float32(1))
        # The least value of a is, but for rounding, one (shingle, t) pair's own.
        out[doc[first], d] = np.minimum.reduceat(a, first).view(np.uint32)
    return out


def _signatures(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for rows, texts in text_blocks(batches, "text", _BLOCK):
            doc, key, weight = weighted_shingles(texts, powers, idf.value)
            s = samples(doc, key, weight, len(texts), BANDS * ROWS).reshape(len(texts), BANDS, ROWS).astype(np.uint64)
            band = np.zeros((len(texts), BANDS), np.uint64)
            for i in range(ROWS):
                band = mix64(band + s[:, :, i] + np.uint64(1))
            total = np.bincount(doc, weights=weight, minlength=len(texts))
            some = total > 0
            bands = pa.array([x.tolist() if y else [] for x, y in zip(band.view(np.int64), some)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("place"), pa.array(total), bands], names=["place", "total", "bands"])
    return run


def weighted_jaccard(ka, wa, kb, wb) -> float:
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum()
    either = wa.sum() + wb.sum() - both
    return float(both / either) if either > 0 else 0.0


def _verify(idf, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            for rows, left in text_blocks([b], "ta"):
                right = rows.column("tb").cast(pa.large_string())
                sides = []
                for x in (left, right):
                    doc, key, weight = weighted_shingles(x, powers, idf.value)
                    sides.append((key, weight, np.searchsorted(doc, np.arange(len(x) + 1))))
                (ka, wa, oa), (kb, wb, ob) = sides
                sim = np.array([weighted_jaccard(ka[oa[i]:oa[i + 1]], wa[oa[i]:oa[i + 1]], kb[ob[i]:ob[i + 1]], wb[ob[i]:ob[i + 1]])
                                for i in range(len(left))])
                ok = pa.array(np.flatnonzero(sim >= threshold))
                yield pa.RecordBatch.from_arrays([rows.column("a").take(ok), rows.column("b").take(ok)], names=["a", "b"])
    return run


def verify(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs (a, b) of a stored table whose weighted Jaccard similarity
    reaches the threshold; only texts that are in a pair move."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("place")).distinct()
    # A checked count decides: few ids are broadcast, many are joined by shuffle.
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    used = texts.join(F.broadcast(ids) if small else ids, "place", "left_semi")
    first = used.select(F.col("place").alias("a"), F.col("text").alias("ta"))
    second = used.select(F.col("place").alias("b"), F.col("text").alias("tb"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(idf, threshold), f"a {NODE}, b {NODE}")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component of every node in the
    stored table of links; each round is written, and only counts come back."""
    both = save_table(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = save_table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m")))
        step = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = save_table(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"),
                                                                (F.least("next", F.coalesce("far", "next")) < F.col("label")).alias("changed")), "labels")
        labels = new.select("node", "label")
        if new.where("changed").isEmpty():
            return labels


def _mixed_pairs(idf, threshold: float):
    """Links between texts of different components in one pair of blocks."""
    def run(table: pa.Table) -> pa.Table:
        powers, names = Powers(), {}
        table = table.combine_chunks()
        places, side = table.column("place"), table.column("side").to_numpy()
        label = np.array([names.setdefault(str(x), len(names)) for x in table.column("label").to_pylist()])
        doc, key, weight = weighted_shingles(table.column("text").cast(pa.large_string()).combine_chunks(), powers, idf.value)
        code = np.unique(key, return_inverse=True)[1]
        total = np.bincount(doc, weights=weight, minlength=len(label))
        offs = np.searchsorted(doc, np.arange(len(label) + 1))
        at, both, a, b = np.zeros(int(code.max(initial=-1)) + 1), (side == 2).any(), [], []
        for i in np.flatnonzero(side == 1):
            able = (label != label[i]) & (np.minimum(total, total[i]) >= np.maximum(total, total[i]) * (threshold - 1e-9))
            able &= side == 2 if both else np.arange(len(label)) > i
            if not able.any():
                continue
            own = slice(offs[i], offs[i + 1])
            at[code[own]] = weight[own]
            common = np.bincount(doc, weights=np.minimum(at[code], weight), minlength=len(label))
            at[code[own]] = 0
            found = np.flatnonzero(able & (common >= threshold * (total + total[i] - common)))
            a.extend([i] * len(found))
            b.extend(found.tolist())
        take = lambda x: places.take(pa.array(x, pa.int64()))
        return pa.table({"x": take(a), "y": take(b)})
    return run


def mixed_links(named: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """(a, b): all links between members of one bucket that have different
    labels, from the stored table (place, total, band, value, label)."""
    step = -math.log(max(threshold, 0.01) - 1e-6)       # totals more than one level apart differ too much
    levels = named.withColumn("level", F.floor(F.log("total") / step).cast("int"))
    sizes = save_table(levels.groupBy("band", "value", "level").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.greatest(
        F.count("*") / BLOCK_TEXTS, F.sum("total") / BLOCK_WEIGHT)).alias("n")), "levels")
    mixed = sizes.groupBy("band", "value").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("band", "value")
    sizes = save_table(sizes.join(mixed, ["band", "value"]).select("band", "value", "level", "n"), "mixed")
    blocked = save_table(levels.join(sizes, ["band", "value", "level"])
                         .select("place", "label", "band", "value", "level", F.pmod(F.xxhash64("place", "band"), "n").alias("salt")), "blocked")
    blocks = save_table(blocked.groupBy("band", "value", "level", "salt").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), "blocks")
    one, two = (blocks.select("band", "value", *[F.col(c).alias(f"{c}{i}") for c in ("level", "salt", "lo", "hi")]) for i in (1, 2))
    meet = (one.join(two, ["band", "value"])
            .where("(level2 = level1 and salt2 >= salt1) or level2 = level1 + 1").where("least(lo1, lo2) < greatest(hi1, hi2)")
            .select("band", "value", "level1", "salt1", "level2", "salt2"))
    meet = save_table(meet, "meet")
    by = ["band", "value", "level1", "salt1", "level2", "salt2"]

    def sides(i: int) -> DataFrame:
        rows = blocked.withColumnsRenamed({"level": f"level{i}", "salt": f"salt{i}"})
        some = meet if i == 1 else meet.where("level1 <> level2 or salt1 <> salt2")     # a block meets itself once
        return rows.join(some, ["band", "value", f"level{i}", f"salt{i}"]).select(*by, F.lit(i).alias("side"), "place", "label")

    rows = save_table(sides(1).union(sides(2)), "sides").join(texts.select("place", "text"), "place")
    found = rows.groupBy(*by).applyInArrow(_mixed_pairs(idf, threshold), f"x {NODE}, y {NODE}")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _id(place):
    return F.when(place != _LOWEST, place)


def _document(id_col: str, text_col: str):
    """The columns (id, digest) that tell documents apart."""
    return (F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)), F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, class, n_tested_links) of every row; ``class`` is the (id,
    digest) of the document of its group that is kept."""
    spark = docs.sparkSession
    id_, digest = _document(id_col, text_col)
    hashed = docs.select(id_.alias("id"), digest.alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # One row per different text, named by the smallest id that holds it.
    texts = hashed.groupBy("digest").agg(F.min("id").alias("id"), F.first("text").alias("text")).select(F.struct("id", "digest").alias("place"), "text")
    texts = save_table(texts, "texts")
    idf = spark.sparkContext.broadcast(inverse_frequencies(texts))      # 2 MiB whatever the corpus
    # What is grouped is stored before it is joined: both sides are plain shuffles then, which AQE splits at a hot key.
    members = save_table(hashed.select("id", "digest"), "members")
    signed = texts.mapInArrow(_signatures(idf), f"place {NODE}, total double, bands array<long>")
    bands = save_table(signed.select("place", "total", F.posexplode("bands").alias("band", "value")).distinct(), "bands")
    ends = bands.groupBy("band", "value").agg(F.count("*").alias("n"), F.min(F.struct("place", "total")).alias("lo"), F.max(F.struct("place", "total")).alias("hi"))
    buckets = save_table(bands.join(save_table(ends.where("lo.place < hi.place"), "ends"), ["band", "value"]), "buckets")

    def tidy(pairs: DataFrame) -> DataFrame:
        # The similarity is at most the ratio of the total weights.
        able = F.least("tx", "ty") >= F.greatest("tx", "ty") * (threshold - 1e-9)
        return pairs.where(able & (F.col("x") != F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    to = lambda c: buckets.select(F.col("place").alias("x"), F.col("total").alias("tx"), F.col(f"{c}.place").alias("y"), F.col(f"{c}.total").alias("ty"))
    pairs = save_table(tidy(to("lo").union(to("hi"))), "pairs")
    tried, links = pairs, save_table(verify(pairs, texts, idf, threshold), "links")
    labels = components(links)
    while True:
        named = buckets.join(labels.select(F.col("node").alias("place"), "label"), "place", "left").withColumn("label", F.coalesce("label", "place"))
        named = save_table(named.select("place", "total", "band", "value", "label"), "named")
        # Of the outermost components in a bucket the smallest members meet the other components' members.
        parts = named.groupBy("band", "value", "label").agg(F.min(F.struct("place", "total")).alias("y"))
        outer = parts.groupBy("band", "value").agg(F.min(F.struct("label", "y")).alias("c1"), F.max(F.struct("label", "y")).alias("c2"))
        met = named.join(save_table(outer.where("c1.label < c2.label"), "outer"), ["band", "value"])
        meets = lambda c: met.where(F.col("label") != F.col(f"{c}.label")).select(
            F.col("place").alias("x"), F.col("total").alias("tx"), F.col(f"{c}.y.place").alias("y"), F.col(f"{c}.y.total").alias("ty"))
        pairs = save_table(tidy(meets("c1").union(meets("c2"))).join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            break
        tried = tried.union(pairs)
        found = save_table(verify(pairs, texts, idf, threshold), "links")
        if found.isEmpty():
            break                               # the components stay as they are
        links = links.union(found)
        labels = components(links)
    rest = save_table(mixed_links(named, texts, idf, threshold), "links")
    if not rest.isEmpty():
        links = links.union(rest).distinct()
        labels = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_tested_links"))
    known = texts.select("place").join(labels.join(degree, "node"), F.col("place") == F.col("node"), "left")
    known = save_table(known.select(F.col("place.digest").alias("digest"), F.coalesce("label", "place").alias("class"),
                                    F.coalesce("n_tested_links", F.lit(0)).cast("long").alias("n_tested_links")), "known")
    return members.join(known, "digest").select("id", "digest", "class", "n_tested_links")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_tested_links, kept) of every row: the smallest id of
    its group, how many of the pairs compared link its text to a different one
    (pairs within one component need no comparison), and whether it is the
    document of its group that is kept."""
    return classes(docs, threshold, id_col, text_col).select(
        _id(F.col("id")).alias("doc_id"), _id(F.col("class.id")).alias("class_id"), "n_tested_links",
        ((F.col("id") == F.col("class.id")) & (F.col("digest") == F.col("class.digest"))).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group of ``docs``, that of the document ``classes`` names."""
    first = classes(docs, threshold).select(F.col("class.id").alias("__id"), F.col("class.digest").alias("__digest")).distinct()
    id_, digest = _document("doc_id", "text")
    marked = docs.withColumns({"__id": id_, "__digest": digest})
    kept = marked.join(first, ["__id", "__digest"], "left_semi")
    repeated = marked.groupBy("__id", "__digest").count().where("count > 1")
    # Only documents that come in several rows need a choice among them.
    kept = kept if repeated.isEmpty() else kept.dropDuplicates(["__id", "__digest"])
    return kept.select(*[kept[f"`{n}`"] for n in docs.columns])


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read_table(spark, sf_dir, "documents"))
