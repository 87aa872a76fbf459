"""Near copies by b-bit MinHash.

A document is the set of its distinct windows of ``SHINGLE`` lower-cased words (all its
words, if fewer), kept as 64-bit hashes. Documents with equal sets form a class, found by
a digest of the set; from there on only the smallest document of a class takes part.

Of each set ``MINIMA`` minima are taken under as many hash functions. Bands of ``ROWS``
minima are the keys for candidates: a pair with similarity 0.8 shares none of the
``BANDS`` keys with a probability of 3e-7. Of the minima themselves only two low bits are
kept, packed into six 64-bit words. Two sets agree in a field with probability
``R + (1 - R) / 4``, so that the share of equal fields, counted by bit operations and
corrected for these collisions, estimates the similarity R; candidates estimated
``MARGIN`` below the threshold (6.3 standard deviations, with a probability of 4e-9 at
similarity 0.8) are dropped, so that both together miss such a pair with 2.9e-7. The others
are confirmed on their full sets, which are made anew for just these documents.

Pairs are never formed within a whole group. First every member of a bucket is compared
with the bucket's smallest member. This links nearly all there is to link. Where the
members of a bucket then still lie in several components, these are compared by estimate
in blocks of at most ``BLOCK`` by ``BLOCK`` signatures: members outside the largest
component with all others. A block returns only which components are near each other, at
most one pair for each component. Components brought together so form a cluster, and its
members are compared once more in the same way on their full sets, in blocks of
``EXACT_BLOCK``; again only links that join components leave a block. Links inside a
component change nothing and are not looked for.

Nulls and repeats: a text that is null or has no words has an empty set and is linked
with nothing. A null doc_id is never linked, its component is null and it is kept. Rows
that repeat a doc_id count as one document. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffline.llm.components import components
from staffline.llm.words import as_bytes, buffers, mix, stream
from staffline.session import released, staged

SHINGLE = 4
PERCENT = 80
BANDS, ROWS = 38, 5
MINIMA = 192
FIELD_BITS = 2
WORDS = MINIMA // 64
MARGIN = 0.22
BLOCK, EXACT_BLOCK = 1024, 256
#: Minima are taken over this many set members at a time.
TILE = 256

_MULTIPLY = (stream(101, MINIMA) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (stream(202, MINIMA) >> np.uint64(32)).astype(np.uint32)
_BAND = stream(303, BANDS)
PLANES = [f"p{bit}{word}" for bit in range(FIELD_BITS) for word in range(WORDS)]


def shingle_sets(texts: list[bytes], size: int):
    """The sorted distinct shingle hashes of each text, in order."""
    for _, words in buffers(texts, lower=True):
        keys, first = words.windows(size)
        counts = words.per_doc(words.doc[first])
        n_words = words.per_doc(words.doc)
        until = np.cumsum(n_words)
        at = 0
        for doc in range(words.n_docs):
            if counts[doc]:
                yield np.unique(keys[at : at + counts[doc]])
                at += counts[doc]
            elif n_words[doc]:
                whole = np.uint64(n_words[doc])
                for h in words.hashes[until[doc] - n_words[doc] : until[doc]]:
                    whole = mix(np.array([whole ^ h]))[0]
                yield np.array([whole])
            else:
                yield np.zeros(0, np.uint64)


def minima(members: np.ndarray) -> np.ndarray:
    short = (members >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), TILE):
        hashed = np.multiply.outer(_MULTIPLY, short[at : at + TILE])
        hashed += _ADD[:, None]
        np.minimum(out, hashed.min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    parts = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = _BAND.copy()
    for row in range(ROWS):
        key = mix(key ^ parts[:, row])
    return key.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima: one plane of bits after the other."""
    planes = [np.packbits((least >> np.uint32(bit)).astype(np.uint8) & 1).view(np.int64) for bit in range(FIELD_BITS)]
    return np.concatenate(planes)


def similarity_of(equal: float) -> float:
    chance = 2.0**-FIELD_BITS
    return (equal - chance) / (1 - chance)


def most_unequal(percent: int) -> int:
    """How many fields of a candidate may differ."""
    chance = 2.0**-FIELD_BITS
    return int(MINIMA * (1 - (chance + (1 - chance) * (percent / 100 - MARGIN))))


_SIGNED = ", ".join(
    ["n_shingles bigint", "digest binary", "bands array<bigint>", *(f"{p} bigint" for p in PLANES)]
)


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, n_shingles, a digest of the set, band keys and packed minima
    (the last three null for an empty set)."""

    def sign(batches):
        for batch in batches:
            texts = as_bytes(batch.column(1))
            counts, digests, bands, planes = [], [], [], np.zeros((len(texts), len(PLANES)), np.int64)
            for at, members in enumerate(shingle_sets(texts, size)):
                counts.append(len(members))
                if not len(members):
                    digests.append(None)
                    bands.append(None)
                    continue
                digests.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest())
                least = minima(members)
                bands.append(band_keys(least))
                planes[at] = packed(least)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), *(pa.array(planes[:, i].copy()) for i in range(len(PLANES)))],
                names=["doc_id", "n_shingles", "digest", "bands", *PLANES],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, f"doc_id bigint, {_SIGNED}")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    def make(batches):
        for batch in batches:
            sets = [x.view(np.int64) for x in shingle_sets(as_bytes(batch.column(1)), size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "members"])

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id bigint, members array<bigint>")


def _unequal(left: str, right: str) -> Column:
    """Number of fields in which two signatures differ."""
    total = F.lit(0)
    for word in range(WORDS):
        differs = F.lit(0).cast("long")
        for bit in range(FIELD_BITS):
            name = PLANES[bit * WORDS + word]
            differs = differs.bitwiseOR(F.col(f"{left}.{name}").bitwiseXOR(F.col(f"{right}.{name}")))
        total = total + F.bit_count(differs)
    return total


def _estimated(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose estimated similarity is not too low."""
    near = pairs.join(signs.alias("x"), F.col("a") == F.col("x.doc_id")).join(signs.alias("y"), F.col("b") == F.col("y.doc_id"))
    return near.where(_unequal("x", "y") <= most_unequal(percent)).select("a", "b")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that are similar by their full sets."""
    wanted = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct()
    # A row may be repeated, and an id may have several texts; each set of an id is there once.
    sets = staged(full_sets(_texts(docs, wanted), size).dropDuplicates(["doc_id", "members"]))
    x = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("of_a"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - both
    found = staged(pairs.join(y, "b").join(x, "a").where(100 * both >= percent * either).select("a", "b").distinct())
    released(sets)
    return found


def _spanning(block: pd.DataFrame, allowed: int, percent: int | None) -> pd.DataFrame:
    """Links between the components of a block, no more than needed to join them: by
    estimate alone, given as pairs of roots, or, with ``percent``, by the full sets, given
    as pairs of documents. Each probe row is compared with all others."""
    probe = block["probe"].to_numpy()
    bits = block[PLANES].to_numpy(np.int64).view(np.uint64)
    ids = block["doc_id"].to_numpy()
    roots, root = np.unique(block["root"].to_numpy(), return_inverse=True)
    group = np.arange(len(roots))
    others = np.flatnonzero(~probe)
    if percent is not None:
        sizes = block["members"].map(len).to_numpy()
        begin = np.cumsum(sizes) - sizes
        _, member = np.unique(np.concatenate(block["members"].to_list()), return_inverse=True)
        marked = np.zeros(member.max(initial=0) + 1, bool)
    found: list[tuple[int, int]] = []
    for at in np.flatnonzero(probe):
        near = others[group[root[others]] != group[root[at]]]
        unequal = np.zeros(len(near), np.int64)
        for word in range(WORDS):
            differs = np.zeros(len(near), np.uint64)
            for column in range(word, len(PLANES), WORDS):
                differs |= bits[near, column] ^ bits[at, column]
            unequal += np.bitwise_count(differs)
        near = near[unequal <= allowed]
        if percent is not None and len(near):
            own = member[begin[at] : begin[at] + sizes[at]]
            marked[own] = True
            n = sizes[near]
            until = np.cumsum(n)
            places = np.repeat(begin[near] - until + n, n) + np.arange(until[-1])
            both = np.add.reduceat(marked[member[places]].astype(np.int64), until - n)
            marked[own] = False
            near = near[100 * both >= percent * (sizes[at] + n - both)]
        for other in near:
            mine, theirs = group[root[at]], group[root[other]]
            if mine != theirs:
                group[group == theirs] = mine
                pair = (ids[at], ids[other]) if percent is not None else (roots[root[at]], roots[root[other]])
                found.append((min(pair), max(pair)))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _between_components(rows: DataFrame, percent: int, exact: bool) -> DataFrame:
    """``_spanning`` over all members of each key, in blocks. ``rows``: key, doc_id, root,
    the packed minima and, if exact, the sets. Every member outside a key's largest
    component meets every other member in some block."""
    size = EXACT_BLOCK if exact else BLOCK
    carried = ["key", "doc_id", "root", *PLANES, *(["members"] if exact else [])]
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("total"), F.max("n").alias("most"))
    parts = lambda n: F.ceil(n / size).cast("int")
    marked = rows.join(main.where("most < total"), "key").select(
        *carried, (F.col("root") != F.col("main")).alias("minor"),
        parts(F.col("total")).alias("n_all"), parts(F.col("total") - F.col("most")).alias("n_minor"),
    )
    spot = lambda n, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    all_rows = marked.select(*carried, spot(F.col("n_all"), 1).alias("j"), every(F.col("n_minor")).alias("i"), F.lit(False).alias("probe"))
    probes = marked.where("minor").select(
        *carried, every(F.col("n_all")).alias("j"), spot(F.col("n_minor"), 2).alias("i"), F.lit(True).alias("probe"))
    allowed = most_unequal(percent)
    # Dealt by block and to a given number of tasks: left to itself, Spark keeps the dealing
    # by key that the joins have left, and folds blocks, which are few bytes and much work.
    n_tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = all_rows.unionByName(probes).repartition(n_tasks, "key", "i", "j").groupBy("key", "i", "j")
    return blocks.applyInPandas(lambda block: _spanning(block, allowed, percent if exact else None), "a bigint, b bigint").distinct()


def _rest(buckets: DataFrame, roots: DataFrame, signs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The links that comparing with each bucket's smallest member has missed."""
    labelled = buckets.join(roots, F.col("doc_id") == F.col("node"), "left").select(
        "key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    split = labelled.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n"))
    # A pair in a bucket of two has been compared.
    split = split.where("r0 < r1 and n > 2").select("key")
    rows = staged(labelled.join(split, "key", "left_semi").join(signs, "doc_id"))
    # Components that the estimate brings together form a cluster; a cluster's members
    # are then compared once, whatever the number of buckets they share.
    clusters = components(_between_components(rows, percent, exact=False))
    labels = clusters.select("node", F.col("root").alias("key")).unionAll(
        clusters.select(F.col("root").alias("node"), F.col("root").alias("key"))).distinct()
    members = rows.drop("key").dropDuplicates(["doc_id"]).join(labels, F.col("root") == F.col("node")).drop("node")
    members = staged(members)
    sets = full_sets(_texts(docs, members.select("doc_id")), size).dropDuplicates(["doc_id"])
    found = staged(_between_components(members.join(sets, "doc_id"), percent, exact=True))
    released(rows, members)
    return found


def near_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    signed = staged(signatures(docs, size))
    classes = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    member = signed.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    # A document is a class representative once, even if its row is repeated.
    first = signed.join(classes, "digest").where("doc_id = first_id").dropDuplicates(["doc_id", "digest"])
    first = staged(first.select("doc_id", "bands", *PLANES))
    signs = first.select("doc_id", *PLANES)

    entries = first.select("doc_id", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest")).where("least < greatest")
    buckets = staged(entries.join(shared.select("key", "least"), "key"))
    stars = staged(_estimated(
        buckets.where("doc_id > least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct(), signs, percent))
    same = member.where("first_id < doc_id").select(F.col("first_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = _confirmed(stars, docs, size, percent).unionAll(same)
    released(stars)
    roots = components(links)

    late = _rest(buckets, roots, signs, docs, size, percent)
    if late.take(1):
        roots = components(links.unionAll(late))
    released(first, buckets)

    by_row = member.join(roots, F.col("first_id") == F.col("node"), "left")
    # A row repeated under one doc_id may hold several texts; its component is the least.
    component = F.coalesce(F.col("root"), F.col("first_id"), F.col("doc_id"))
    out = by_row.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, with its own columns."""
    gone = near_copies(docs).where("not kept").select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("_gone_id"), "left_anti")
