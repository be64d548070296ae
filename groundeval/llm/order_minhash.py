"""Near-duplicate classes by Order MinHash.

Sketch.  A document's ``k``-word shingles are labelled with their occurrence number, so that
repeats count.  Each of ``sketches`` hash functions takes the ``sample`` labelled shingles of
smallest hash and keeps them in text order; the hash of that sequence is a bucket key.
Equal sets in another order get another key, so keys follow edit similarity.  Documents
under ``short`` shingles also get ``short_sketches`` keys of two shingles each.

Verification.  Two documents are linked if the longest common subsequence ``m`` of their
shingle sequences (``a`` and ``b`` long) has ``m / (a + b - m) >= threshold``: the Jaccard
similarity of an order-keeping alignment.  Since that allows only
``(a + b) (1 - threshold) / (1 + threshold)`` insertions and deletions, the alignment is
computed in a band of that half-width, bit-parallel; it is skipped where the number of
common shingles already rules the pair out, or where they are unique and in one order.

Pairs.  Equal texts are one node.  In each bucket the node that shares most buckets with
others is compared to the rest, so a group of thousands of copies costs one comparison
each, and components are formed.  Centres whose nodes are all in one component are settled.
Around the others, nodes of different components are compared in blocks, exactly
(``block_links``), so no link between nodes that share a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundeval.llm.common import WordHasher, as_bytes, cut_lineage, fresh, mix
from groundeval.llm.components import connected
from groundeval.llm.substring_dedup import BASES, window_hashes

U64 = np.uint64


def words_of(text: str | None, hasher: WordHasher) -> np.ndarray:
    """64-bit hashes of the text's words: runs of characters but ASCII white space, A-Z
    lower-cased."""
    return hasher(as_bytes(text).lower())


def short_hashes(words: np.ndarray) -> np.ndarray:
    """The 32 bits of each word hash that shingles are made of."""
    return (words >> U64(32)).astype(np.uint32)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k`` consecutive word hashes; a shorter text is one shingle, an empty
    one none."""
    if not len(words):
        return np.zeros(0, dtype=U64)
    return mix(window_hashes(words.astype(U64), min(k, len(words)), BASES[0]))


def label_occurrences(sh: np.ndarray) -> np.ndarray:
    """Each shingle hashed with the number of equal ones before it."""
    order = np.argsort(sh, kind="stable")
    s = sh[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, int)
    if len(first) == len(s):
        return mix(sh)
    rank = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    out = np.empty_like(sh)
    out[order] = mix(s + mix(rank.astype(U64)))
    return out


def order_keys(sh: np.ndarray, sample: int, sketches: int, seed: int) -> np.ndarray:
    """One key per sketch: the ``sample`` labelled shingles of smallest hash, in text order."""
    if not len(sh):
        return np.zeros(0, U64)
    labelled = label_occurrences(sh)
    seeds = mix(np.arange(1, sketches + 1, dtype=U64) + U64(seed * 1000))
    sample = min(sample, len(sh))
    rows = max(1, 200_000 // len(sh))
    keys = []
    for lo in range(0, sketches, rows):
        h = mix(labelled[None, :] ^ seeds[lo : lo + rows, None])
        at = np.argpartition(h, sample - 1, axis=1)[:, :sample] if sample < len(sh) else np.tile(np.arange(len(sh)), (len(h), 1))
        at.sort(axis=1)
        key = seeds[lo : lo + rows] + U64(sample)
        for j in range(sample):
            key = mix(key + sh[at[:, j]])
        keys.append(key)
    return np.concatenate(keys)


def common_subsequence(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence within ``band`` diagonals of the main one."""
    where: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    strip = (1 << (2 * band + 1)) - 1
    v = full
    for i, x in enumerate(a.tolist()):
        match = where.get(x, 0)
        if match:
            shift = i - band
            match &= strip << shift if shift >= 0 else strip >> -shift
            u = v & match
            if u:
                v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Alignment similarity of two shingle sequences, or an upper bound of it below
    ``threshold``.  Two empty texts are alike."""
    na, nb = len(a), len(b)
    if not na or not nb:
        return float(na == nb)
    if min(na, nb) < threshold * max(na, nb):
        return min(na, nb) / max(na, nb)
    ua, ia, ca = np.unique(a, return_index=True, return_counts=True)
    ub, ib, cb = np.unique(b, return_index=True, return_counts=True)
    _, xa, xb = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    m = int(np.minimum(ca[xa], cb[xb]).sum())
    bound = m / (na + nb - m)
    if bound < threshold:
        return bound
    if (ca[xa] == 1).all() and (cb[xb] == 1).all():
        order = np.argsort(ia[xa])
        if (np.diff(ib[xb][order]) > 0).all():
            return bound
    band = int((na + nb) * (1 - threshold) / (1 + threshold)) + 1
    m = common_subsequence(a, b, band)
    return m / (na + nb - m)


def text_digest(text: Column) -> Column:
    """SHA-256 of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def sketch_table(docs: DataFrame, id_col: str, text_col: str, k: int, sample: int, sketches: int, short: int, short_sketches: int) -> DataFrame:
    """``(id, digest, n, keys, text_digest)`` per row: digest of the words, shingles, bucket
    keys, digest of the text as it is."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            digests, sizes, keys = [], [], []
            for text in b.column(1):
                words = words_of(text.as_py(), hasher)
                digests.append(xxhash.xxh3_128_digest(words.tobytes()))
                sh = shingles(short_hashes(words), k)
                sizes.append(len(sh))
                got = order_keys(sh, sample, sketches, 1)
                if len(sh) < short:
                    got = np.concatenate([got, order_keys(sh, 2, short_sketches, 2)])
                keys.append(np.unique(got).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), b.column(2)],
                names=["id", "digest", "n", "keys", "text_digest"],
            )

    text = F.col(text_col).cast("string")
    flat = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), text_digest(text).alias("text_digest"))
    return flat.mapInArrow(sketch, "id bigint, digest binary, n int, keys array<bigint>, text_digest binary")


def word_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, digest, words)``: the word hashes (32 bits each) of each row's text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            digests, words = [], []
            for text in b.column(1):
                found = words_of(text.as_py(), hasher)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                words.append(short_hashes(found).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(words, pa.binary())], names=["id", "digest", "words"])

    flat = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return flat.mapInArrow(hashed, "id bigint, digest binary, words binary")


def verified(pairs: DataFrame, words: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose alignment reaches the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (shingles(np.frombuffer(t.as_buffer(), dtype=np.uint32), k) for t in (x, y))
                ok.append(similarity(x, y, threshold) >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = words.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    two = words.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "wa", "wb")
    return both.mapInArrow(check, "a bigint, b bigint")


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Common shingles of every ``x`` with every ``y`` (no repeats inside a list), by matrix
    products over slices of the vocabulary."""
    out = np.zeros((len(xs), len(ys)), dtype=np.float32)
    vocab = np.unique(np.concatenate(xs))
    sides = []
    for docs in (xs, ys):
        rows, flat = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate(docs)
        at = np.searchsorted(vocab, flat)
        known = vocab[np.minimum(at, len(vocab) - 1)] == flat
        order = np.argsort(at[known], kind="stable")
        sides.append((rows[known][order], at[known][order]))
    for lo in range(0, len(vocab), 4096):
        parts = []
        for docs, (rows, at) in zip((xs, ys), sides, strict=True):
            i, j = np.searchsorted(at, (lo, lo + 4096))
            part = np.zeros((len(docs), min(4096, len(vocab) - lo)), dtype=np.float32)
            part[rows[i:j], at[i:j] - lo] = 1.0
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def block_links(stars: DataFrame, words: DataFrame, k: int, threshold: float, block: int = 256) -> DataFrame:
    """Links ``(a, b)`` between nodes of different labels around one centre, in blocks.

    ``stars(at, node, n, label)`` lists each centre's nodes.  Those outside the centre's most
    frequent label, in blocks of about ``block``, meet all its nodes, in blocks; a task holds
    two blocks, finds all overlaps by matrix products and aligns the pairs that can be
    alike.  No pair becomes a row, a label of thousands of nodes is never compared to
    itself, and one link between two labels in a task is enough."""
    sizes = stars.groupBy("at", "label").agg(F.count("*").alias("c"))
    sizes = sizes.groupBy("at").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.sum("c").alias("all"), F.max("c").alias("most"))
    sizes = sizes.where("all > most")
    n_few, n_all = F.ceil((F.col("all") - F.col("most")) / block), F.ceil(F.col("all") / block)
    rows = stars.join(sizes, "at").withColumn("few_n", n_few).withColumn("all_n", n_all)
    few = rows.where("label != major").withColumn("left", F.pmod(F.xxhash64("node"), F.col("few_n")))
    few = few.withColumn("right", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("all_n") - 1))).withColumn("side", F.lit(0))
    every = rows.withColumn("right", F.pmod(F.xxhash64("node", F.lit(1)), F.col("all_n")))
    every = every.withColumn("left", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("few_n") - 1))).withColumn("side", F.lit(1))
    cols = ["at", "left", "right", "side", "node", "label"]
    met = few.select(*cols).unionByName(every.select(*cols)).join(words, "node")

    def compare(group):
        side = group["side"].to_numpy()
        node, label = group["node"].to_numpy(), group["label"].to_numpy()
        seqs = [shingles(np.frombuffer(w.as_buffer(), dtype=np.uint32), k) for w in group["words"]]
        bags = [label_occurrences(x) for x in seqs]
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links = []
        if len(x) and len(y) and sum(len(bags[i]) for i in x):
            size = np.array([len(b) for b in bags], dtype=np.float32)
            common = overlaps([bags[i] for i in x], [bags[j] for j in y])
            alike = common >= threshold * (size[x][:, None] + size[y][None, :] - common) - 1e-3
            alike &= label[x][:, None] != label[y][None, :]
            done = set()
            for i, j in zip(*np.nonzero(alike), strict=True):
                a, b = x[i], y[j]
                if (label[a], label[b]) not in done and similarity(seqs[a], seqs[b], threshold) >= threshold:
                    done.add((label[a], label[b]))
                    links.append((node[a], node[b]))
        return pa.table({"a": pa.array([v[0] for v in links], pa.int64()), "b": pa.array([v[1] for v in links], pa.int64())})

    return met.groupBy("at", "left", "right").applyInArrow(compare, "a bigint, b bigint")


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    threshold: float = 0.8,
    sample: int = 4,
    sketches: int = 20,
    short: int = 64,
    short_sketches: int = 12,
) -> DataFrame:
    """One row per document: ``(<id_col>, class_id, class_size, kept)``.

    A class is a component of the links between documents; ``class_id`` is its smallest
    identifier (null only if it has no other) and ``kept`` marks one row of it, the one with
    that identifier.  Null and empty texts have no words and form one class; texts below
    ``k`` words are one shingle.  Repeated rows are in one class, as all equal texts are;
    whole texts are used, however long.  An empty table gives an empty result; other columns
    are not read.  With the default parameters a pair at similarity 0.8 is missed by all
    buckets with probability below 1e-4, one at 0.9 below 1e-9.
    """
    marks = classes_of_rows(docs, id_col, text_col, k, threshold, sample, sketches, short, short_sketches)
    return marks.select(F.col("id").alias(id_col), "class_id", "class_size", "kept")


def classes_of_rows(
    docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float, sample: int, sketches: int, short: int, short_sketches: int
) -> DataFrame:
    """``near_classes`` with the text's digest: ``(id, text_digest, class_id, class_size, kept)``."""
    rows = sketch_table(docs, id_col, text_col, k, sample, sketches, short, short_sketches)
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    nodes = rows.groupBy("digest").agg(F.min("row").alias("node"))
    of_row = rows.select("id", "digest", "row", "text_digest").join(nodes, "digest")
    reps = rows.join(nodes.select(F.col("node").alias("row")), "row")
    keyed = reps.select(F.explode("keys").alias("key"), F.col("row").alias("node"), "n")
    crowded = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    active = keyed.join(crowded, "key")
    # a bucket's centre is its node with the most company in all its buckets: of edited copies
    # that is the one closest to the others
    company = active.groupBy("node").agg(F.sum("c").alias("company"))
    active = cut_lineage(active.join(company, "node").select("key", "node", "n", "company"))
    best = active.groupBy("key").agg(F.max(F.struct("company", (-F.col("node")).alias("last"))).alias("best")).select("key", (-F.col("best.last")).alias("centre"))
    active = active.drop("company").join(best, "key")  # key, node, n, centre
    wanted = active.select("node").distinct()
    texts = reps.select("id", "digest", F.col("row").alias("node")).join(wanted, "node")
    words = word_table(docs, id_col, text_col).withColumnsRenamed({"id": "wid", "digest": "wd"})
    words = words.join(texts, F.col("wid").eqNullSafe(F.col("id")) & (F.col("wd") == F.col("digest")))
    words = cut_lineage(words.dropDuplicates(["id", "digest", "node"]).select("node", "words"))

    stars = cut_lineage(active.select(F.col("centre").alias("at"), "node", "n").distinct())
    size = stars.where("node = at").select("at", F.col("n").alias("at_n"))
    pairs = stars.where("node != at").join(size, "at").where(F.least("n", "at_n") >= threshold * F.greatest("n", "at_n"))
    pairs = cut_lineage(pairs.select(F.least("at", "node").alias("a"), F.greatest("at", "node").alias("b")).distinct())
    links = cut_lineage(verified(pairs, words, k, threshold))
    labels = connected(links)

    # centres whose nodes are all in one component are settled; around the others, components
    # are compared in blocks
    stars = stars.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = stars.groupBy("at").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("at")
    found = cut_lineage(block_links(stars.join(open_, "at"), words, k, threshold))
    if not found.isEmpty():
        stars_of = labels.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = connected(stars_of.unionByName(found))

    label = F.coalesce("label", "node").alias("label")
    of_row = of_row.join(labels, "node", "left").select("id", "row", "text_digest", label)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))).alias("best")
    classes = of_row.groupBy("label").agg(best, F.count("*").alias("class_size"))
    out = of_row.join(classes, "label")
    return out.select("id", "text_digest", F.col("best.id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept"))


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    threshold: float = 0.8,
    sample: int = 4,
    sketches: int = 20,
    short: int = 64,
    short_sketches: int = 12,
) -> DataFrame:
    """The rows of ``docs`` that ``near_classes`` keeps, all columns unchanged.

    Rows to go are found by identifier (null equals null) and text digest, so identifiers may
    be null or repeat; of rows that repeat an identifier and a text one is left.
    """
    marks = classes_of_rows(docs, id_col, text_col, k, threshold, sample, sketches, short, short_sketches)
    flags = (
        marks.groupBy(F.col("id").alias("f_id"), F.col("text_digest").alias("f_digest"))
        .agg(F.max("kept").alias("f_kept"), F.count("*").alias("f_n"))
        .where(~F.col("f_kept") | (F.col("f_n") > 1))
    )
    digest, f_id, f_digest, kept = (fresh(docs, c) for c in ("near_text_digest", "f_id", "f_digest", "f_kept"))
    tagged = docs.withColumn(digest, text_digest(F.col(text_col).cast("string")))
    flags = cut_lineage(flags.select("f_id", "f_digest", "f_kept")).toDF(f_id, f_digest, kept)
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col(f_id)) & (F.col(digest) == F.col(f_digest))
    clean = tagged.join(flags, same, "left_anti")
    once = tagged.join(flags.where(F.col(kept)), same, "left_semi").dropDuplicates([id_col, digest])
    return clean.unionByName(once).select(*docs.columns)
