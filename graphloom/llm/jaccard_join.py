"""N-gram Jaccard join by MinHash banding.

A text's set is its distinct n-grams of words (all its words as one gram if it has fewer).
Texts with equal sets are one member, with a count of copies.  Each member's MinHash
signature is cut into bands; members that share a band's hash, a bucket, may be similar.  Pairs
are verified on the full sets, in three steps, none of which puts out pairs.

1. Each member meets the least member, the head, of each of its buckets.  Verified ties make
   clusters, so members that merely share a bucket by chance never chain clusters together.
2. In buckets where members besides the head belong to two or more clusters, those of
   different clusters meet; a pair is counted in the first bucket it shares.  What links here joins
   the clusters to classes.
3. Within a cluster every pair is verified, shared bucket or not.

Before full sets travel, one byte of each MinHash value does (320 bytes a member): ties, and members of shared
buckets, of which no pair agrees in ``AGREE`` of them are dropped.  A pair of similarity 0.8 agrees in 0.8 on average, and
in less than 0.6 with a probability below 10^-15.

Members meet in blocks of bounded size, two blocks to a task; only counts and one link per member
leave it, so a large group costs work but no rows.  A hub, a full bucket and a head of many members are
split over tasks.

With the default bands and rows a pair of similarity 0.8 is missed with probability 0.0006
(less, since clusters hold more pairs than the buckets), and one of 0.3 is tried with 0.0026.

Defined cases: a text without words, or null, has no set and no links; texts with equal sets
are linked; repeated rows are copies; null ids are never a class's id unless all its ids are;
an empty table gives no rows; long texts are taken whole; other columns are not read.  Ids are
whole numbers (or text that casts to them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import connected_components
from graphloom.llm.shared import join_per_key, row_key, small, table
from graphloom.llm.wordhash import hash_words, shingles, split_words

GRAM = 5
#: Similarity as a fraction, so that ties are exact.
THRESHOLD = (4, 5)
BANDS, ROWS = 40, 8

#: Share of equal MinHash bytes below which a pair is not verified.
AGREE = 0.6

#: Size of a block of a cluster.
BLOCK_GRAMS, BLOCK_MEMBERS = 300_000, 1_500
#: N-grams in at least so many members of a block are counted by a matrix product.
DENSE = 24
CHUNK = 1024

_seeds = np.random.default_rng(20_240_501).integers(1, 2**32, (2, BANDS * ROWS), dtype="u8").astype("u4")


def signature(grams: np.ndarray, permutations: int) -> np.ndarray:
    """The least value of each hash function over the grams."""
    low = (grams ^ (grams >> np.uint64(32))).astype("u4")
    out = np.full(permutations, 0xFFFFFFFF, "u4")
    for i in range(0, len(low), 2048):
        x = (low[i : i + 2048, None] ^ _seeds[1, :permutations]) * (_seeds[0, :permutations] | np.uint32(1))
        x ^= x >> np.uint32(15)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band, different for equal rows in different bands."""
    cut = sig.reshape(bands, rows)
    return np.array([xxhash.xxh3_64_intdigest(cut[b].tobytes(), b) for b in range(bands)], "u8").view("i8")


def sketch(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int) -> DataFrame:
    """rid, doc_id, key, n (size of the set), set_key and bands of each row, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, cut = [], [], []
            for t in batch.column("text").to_pylist():
                grams = shingles(hash_words(split_words(t)), GRAM)
                n.append(len(grams))
                keys.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                cut.append(band_hashes(signature(grams, bands * rows), bands, rows) if len(grams) else np.empty(0, "i8"))
            at = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype("int32")
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("rid", "doc_id", "key")),
                    pa.array(n, "int64"),
                    pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, "i8"), *cut]))),
                ],
                ["rid", "doc_id", "key", "n", "set_key", "bands"],
            )

    rows_in = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).alias("text")
    )
    return table(rows_in.mapInArrow(run, "rid long, doc_id long, key long, n long, set_key binary, bands array<long>"), "jaccard-sketch")


def _buckets(members: DataFrame) -> DataFrame:
    """bucket, n, head and last (the least and greatest sid) of the buckets of two members or more."""
    entries = members.select("sid", F.explode("bands").alias("bucket"))
    grouped = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("head"), F.max("sid").alias("last"))
    return grouped.where("head < last")


def _ties(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """sid and head: each member with the least member of each of its buckets."""
    entries = members.select("sid", F.explode("bands").alias("bucket"))
    met = join_per_key(entries, buckets.select("bucket", "n", "head"), "bucket", "n")
    return met.where("sid != head").select("sid", "head").distinct()


def intersections(codes: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
    """m x m counts of shared codes; each owner's codes are distinct."""
    shared = np.zeros((m, m), "f4")
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    df = np.diff(np.r_[starts, len(codes)])
    for f in np.unique(df[(df > 1) & (df < DENSE)]):
        own = owner[starts[df == f][:, None] + np.arange(f)]
        i, j = np.triu_indices(f, 1)
        np.add.at(shared, (own[:, i].ravel(), own[:, j].ravel()), 1)
    shared += shared.T
    dense = np.flatnonzero(df >= DENSE)
    for c in range(0, len(dense), CHUNK):
        part = dense[c : c + CHUNK]
        hot = np.zeros((m, len(part)), "f4")
        for k, d in enumerate(part):
            hot[owner[starts[d] : starts[d] + df[d]], k] = 1
        shared += hot @ hot.T
    return shared


def similar(block: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """(m x m matrix of linked pairs, the block's rows): rows that come more than once are taken once."""
    sid = block.column("sid").to_numpy()
    _, keep = np.unique(sid, return_index=True)
    block = block.take(pa.array(keep))
    sets = [np.frombuffer(g, "u8") for g in block.column("grams").to_pylist()]
    n = np.array([len(s) for s in sets], "f8")
    m = len(sets)
    shared = intersections(np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets]), m).astype("f8")
    above, below = THRESHOLD
    linked = below * shared >= above * (n[:, None] + n[None, :] - shared)
    np.fill_diagonal(linked, False)
    return linked, block


def verify_ties(block: pa.Table) -> pa.Table:
    """sid and head of the verified ties of one head."""
    head = block.column("head")[0].as_py()
    sid = block.column("sid").to_numpy()
    above, below = THRESHOLD
    sets = [np.frombuffer(g, "u8") for g in block.column("grams").to_pylist()]
    own = sets[int(np.flatnonzero(sid == head)[0])]
    n = np.array([len(s) for s in sets])
    shared = np.add.reduceat(np.isin(np.concatenate(sets), own), np.r_[0, np.cumsum(n)[:-1]], dtype="i8")
    keep = (sid != head) & (below * shared >= above * (len(own) + n - shared))
    return pa.table({"sid": sid[keep], "head": np.full(int(keep.sum()), head, "i8")})


def count_within(block: pa.Table) -> pa.Table:
    """sid and links of the members of two blocks of a cluster: linked copies of other members."""
    first, second = (int(block.column(c)[0].as_py()) for c in ("i", "j"))
    linked, block = similar(block)
    if first != second:
        own = block.column("b").to_numpy()
        linked &= own[:, None] != own[None, :]
    has = linked.any(axis=1)
    return pa.table({"sid": block.column("sid").to_numpy()[has], "links": (linked @ block.column("copies").to_numpy()).astype("i8")[has]})


def count_across(block: pa.Table) -> pa.Table:
    """sid, links, cluster and other (the least linked cluster) of members of two blocks of a bucket.

    Only pairs of different clusters count, and only in the first bucket that they share.
    """
    first, second = (int(block.column(c)[0].as_py()) for c in ("i", "j"))
    bucket = block.column("bucket")[0].as_py()
    linked, block = similar(block)
    cluster, own, bands = block.column("cluster").to_numpy(), block.column("b").to_numpy(), block.column("bands").combine_chunks()
    linked &= cluster[:, None] != cluster[None, :]
    if first != second:
        linked &= own[:, None] != own[None, :]
    cut = bands.values.to_numpy().reshape(len(own), -1)
    for band in range(int(np.flatnonzero(cut[0] == bucket)[0])):
        linked &= cut[:, band][:, None] != cut[:, band][None, :]
    has = linked.any(axis=1)
    least = np.where(linked, cluster[None, :], np.iinfo("i8").max).min(axis=1, initial=np.iinfo("i8").max)
    return pa.table(
        {
            "sid": block.column("sid").to_numpy()[has],
            "links": (linked @ block.column("copies").to_numpy()).astype("i8")[has],
            "cluster": cluster[has],
            "other": least[has],
        }
    )


def near_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sid and head of the ties whose MinHash bytes agree well enough."""
    for batch in batches:
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "u1").reshape(-1, BANDS * ROWS) for c in ("mini", "head_mini"))
        near = (one == two).mean(axis=1) >= AGREE
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("sid", "head")], ["sid", "head"])


def near_across(block: pa.Table) -> pa.Table:
    """sid of the members of two blocks of a bucket that may be similar to one of another cluster."""
    sid = block.column("sid").to_numpy()
    _, keep = np.unique(sid, return_index=True)
    block, sid = block.take(pa.array(keep)), sid[keep]
    cluster = block.column("cluster").to_numpy()
    mini = np.frombuffer(b"".join(block.column("mini").to_pylist()), "u1").reshape(len(sid), -1)
    near = np.zeros(len(sid), bool)
    for i in range(len(sid)):
        agree = (mini[i + 1 :] == mini[i]).mean(axis=1) >= AGREE
        agree &= cluster[i + 1 :] != cluster[i]
        near[i] |= agree.any()
        near[i + 1 :] |= agree
    return pa.table({"sid": sid[near]})


def gram_sets(members: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """sid, grams (the full set) and mini (a byte of each MinHash value) of the given members (sid, doc_id, key), as a written table; texts are read where they lie."""
    wanted = members.select("sid", F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    found = texts.join(small(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("sid", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # rows with equal ids and texts bring a member more than once
        for batch in batches:
            sid, sets, minis = [], [], []
            for i, t in zip(batch.column("sid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if i not in done:
                    done.add(i)
                    sid.append(i)
                    own = shingles(hash_words(split_words(t)), GRAM)
                    sets.append(own.tobytes())
                    minis.append(signature(own, BANDS * ROWS).astype("u1").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sid, "int64"), pa.array(sets, pa.binary()), pa.array(minis, pa.binary())], ["sid", "grams", "mini"])

    return table(found.mapInArrow(grams, "sid long, grams binary, mini binary").dropDuplicates(["sid"]), "jaccard-grams")


def _n_blocks() -> Column:
    """How many blocks a group of members needs, from their number and the size of their sets."""
    return F.greatest(F.ceil(F.sum("n") / BLOCK_GRAMS), F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS)).cast("int").alias("blocks")


def _in_blocks(placed: DataFrame) -> DataFrame:
    """placed with the block pairs (i, j) of its group that each row's own block b belongs to."""
    own = placed.withColumn("b", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    spread = own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other"))
    return spread.select("*", F.least("b", "_other").alias("i"), F.greatest("b", "_other").alias("j")).drop("_other", "blocks")


def _near_ties(ties: DataFrame, grams: DataFrame) -> DataFrame:
    """The ties that may be similar, by the bytes of their MinHash values."""
    heads = ties.groupBy("head").agg(F.count(F.lit(1)).alias("tied"))
    heads = heads.join(grams.select(F.col("sid").alias("head"), F.col("mini").alias("head_mini")), "head")
    met = join_per_key(ties.join(grams.select("sid", "mini"), "sid"), heads, "head", "tied")
    return met.select("sid", "head", "mini", "head_mini").mapInArrow(near_ties, "sid long, head long")


def _verified_ties(ties: DataFrame, members: DataFrame, grams: DataFrame) -> DataFrame:
    """The ties whose pairs are similar; a head comes to every block of its members."""
    sizes = ties.join(members.select("sid", "n"), "sid").groupBy("head").agg(_n_blocks(), F.count(F.lit(1)).alias("tied"))
    sizes = table(sizes, "jaccard-heads")
    dealt = join_per_key(ties, sizes, "head", "tied").select("head", "sid", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("b"))
    heads = sizes.select("head", F.col("head").alias("sid"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    met = dealt.unionByName(heads).join(grams.select("sid", "grams"), "sid")
    return met.select("head", "sid", "b", "grams").groupBy("head", "b").applyInArrow(verify_ties, "sid long, head long")


def _cross_links(members: DataFrame, buckets: DataFrame, clusters: DataFrame, grams: DataFrame) -> DataFrame:
    """sid, links, cluster and other: links between clusters, from the buckets in which they meet besides the head."""
    placed = members.join(clusters, F.col("sid") == F.col("node"), "left").select("sid", "n", "copies", "bands", F.coalesce("root", "sid").alias("cluster"))
    placed = table(placed, "jaccard-placed")
    entries = placed.select("sid", "n", "copies", "cluster", F.explode("bands").alias("bucket"))
    crowded = buckets.where("n > 2").select("bucket", F.col("n").alias("size"), "head")
    rest = table(join_per_key(entries, crowded, "bucket", "size").where("sid != head").select("bucket", "sid", "n", "copies", "cluster"), "jaccard-rest")
    mixed = rest.groupBy("bucket").agg(_n_blocks(), F.count(F.lit(1)).alias("size"), F.min("cluster").alias("one"), F.max("cluster").alias("two"))
    mixed = mixed.where("one < two").select("bucket", "blocks", "size")
    meeting = table(_in_blocks(join_per_key(rest, mixed, "bucket", "size")).select("bucket", "i", "j", "b", "sid", "copies", "cluster"), "jaccard-meeting")
    minis = meeting.join(grams.select("sid", "mini"), "sid").select("bucket", "i", "j", "sid", "cluster", "mini")
    near = table(minis.groupBy("bucket", "i", "j").applyInArrow(near_across, "sid long").distinct(), "jaccard-near")
    sets = grams.select("sid", "grams").join(placed.select("sid", "bands"), "sid").join(near, "sid", "left_semi")
    met = meeting.join(sets, "sid").select("bucket", "i", "j", "b", "sid", "copies", "cluster", "bands", "grams")
    return met.groupBy("bucket", "i", "j").applyInArrow(count_across, "sid long, links long, cluster long, other long")


def _links_within(members: DataFrame, clusters: DataFrame, grams: DataFrame) -> DataFrame:
    """sid and links of each member of a cluster, by its block pairs."""
    placed = members.join(clusters, F.col("sid") == F.col("node")).select("sid", "n", "copies", F.col("root").alias("cluster"))
    sizes = placed.groupBy("cluster").agg(_n_blocks(), F.count(F.lit(1)).alias("size"))
    own = join_per_key(placed, sizes, "cluster", "size").select("sid", "copies", "cluster", "blocks")
    met = _in_blocks(own.join(grams.select("sid", "grams"), "sid")).select("cluster", "i", "j", "b", "sid", "copies", "grams")
    return met.groupBy("cluster", "i", "j").applyInArrow(count_within, "sid long, links long")


def join_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """rid, doc_id, key, root, class_id, class_size and n_links of each row of docs.

    A class is a component of the links; its id is its least doc_id.  n_links counts the other
    rows whose set is similar enough, copies included.
    """
    drawn = sketch(docs, doc_id, text, bands, rows)
    sets = drawn.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(
        F.min("rid").alias("sid"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")
    )
    sets = table(sets, "jaccard-sets")
    members = drawn.join(sets.select("sid", "copies"), F.col("rid") == F.col("sid")).select("sid", "doc_id", "key", "n", "copies", "bands")
    buckets = table(_buckets(members), "jaccard-buckets")
    ties = table(_ties(members, buckets), "jaccard-ties")
    tied = ties.select("sid").unionByName(ties.select(F.col("head").alias("sid"))).distinct()
    members = table(members.join(small(tied), "sid"), "jaccard-tied")
    grams = gram_sets(members, docs, doc_id, text)
    near = table(_near_ties(ties, grams), "jaccard-near-ties")
    verified = table(_verified_ties(near, members, grams), "jaccard-verified")
    clusters = connected_components(verified, "sid", "head")
    across = table(_cross_links(members, buckets, clusters, grams), "jaccard-across")
    within = table(_links_within(members, clusters, grams), "jaccard-within")
    links = within.unionByName(across.select("sid", "links")).groupBy("sid").agg(F.sum("links").alias("links"))
    joined = connected_components(across, "cluster", "other").select(F.col("node").alias("_cluster"), F.col("root").alias("_class"))
    own = F.coalesce("root", "sid")
    placed = sets.join(clusters.withColumnRenamed("node", "sid"), "sid", "left").withColumn("own", own)
    placed = (
        placed.join(small(joined), F.col("own") == F.col("_cluster"), "left")
        .join(links, "sid", "left")
        .select("set_key", F.coalesce("_class", "own").alias("root"), "least_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    placed = table(placed, "jaccard-classes")
    classes = placed.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("sets"))
    named = join_per_key(placed, classes, "root", "sets").select(F.col("set_key").alias("_set"), "class_id", "class_size", "n_links", "root", "copies")
    found = join_per_key(
        drawn.where(F.col("set_key").isNotNull()).select("rid", "doc_id", "key", F.col("set_key").alias("_set")), named, "_set", "copies"
    )
    alone = drawn.where(F.col("set_key").isNull())
    return found.select(
        "rid", "doc_id", "key", "root", "class_id", F.col("class_size").cast("long").alias("class_size"), F.col("n_links").cast("long").alias("n_links")
    ).unionByName(
        alone.select(
            "rid", "doc_id", "key", F.col("rid").alias("root"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links")
        )
    )


def filter_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, its columns unchanged: the one with the least id (null comes last; then the least hash of id and text).

    What goes is broadcast up to a checked number of rows and otherwise shuffled.
    """
    found = table(join_documents(docs, doc_id, text), "jaccard-classes")
    large = found.where("class_size > 1")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "rid"))
    keepers = large.groupBy("root").agg(first.alias("keep"), F.count(F.lit(1)).alias("held"))
    rest = join_per_key(large, keepers, "root", "held").where("rid != keep.rid")
    same = (F.col("doc_id").eqNullSafe(F.col("keep.doc_id"))) & (F.col("key") == F.col("keep.key"))
    gone = rest.where(~same).select(F.col("doc_id").alias("_gone_id"), F.col("key").alias("_gone_key")).distinct()
    twins = rest.where(same).select(F.col("doc_id").alias("_twin_id"), F.col("key").alias("_twin_key")).distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("_id"), row_key(doc_id, text).alias("_key"))
    kept = row.join(small(gone), F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_key") == F.col("_gone_key")), "left_anti")
    if twins.isEmpty():
        return kept.select("row.*")
    twin = small(twins)
    equal = F.col("_id").eqNullSafe(F.col("_twin_id")) & (F.col("_key") == F.col("_twin_key"))
    once = kept.join(twin, equal, "left_semi").groupBy("_id", "_key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.join(twin, equal, "left_anti").select("row").unionByName(once.select("row")).select("row.*")
