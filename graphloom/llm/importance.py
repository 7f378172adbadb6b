"""Target-distribution importance resampling over hashed word runs.

Features of a text are its runs of one and two words, hashed into ``BUCKETS`` buckets.  A bucket's gain says how
much more often the target corpus holds it than the documents do; a document's weight is the mean gain of
its features, and a draw without replacement adds a Gumbel number from a hash to each weight.

1. Both corpora count their features by bucket, a vector a task, and the counts meet by bucket.
2. The documents' postings (bucket, document, count) are inverted and packed by Arrow batch, bucket group and
   salt, and dealt by (group, salt); the group's counts in both corpora travel to each of its salts
   and stand first there.  So a task computes the gains of its buckets itself and turns
   postings into contributions (document, sum) in one pass, and a bucket that every document has is
   spread over all salts of its group.
3. Contributions are added up by document, and the best are ranked by ranges, not in one task.

The number of groups is fixed, so a document's contributions are at most so many at any scale; more data
means more salts.  A row is named by its id and a hash of id and text; equal rows are counted.

Defined cases: a null or empty text has no words and weight 0; a null id is drawn as an empty one
and stands before all others among equal scores; equal rows have equal weights and scores and get ranks of their
own; texts are taken whole; an empty target counts nothing; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import input_partitions, measured_table, row_key, table
from graphloom.operators.ranking import ranked

BUCKETS = 10_000
#: Groups of buckets; the bound on a document's contributions.
GROUPS = 16
SEED, PERCENT, LEAST_WORDS = 7, 25, 20

#: A-Z become a-z, other ASCII that is no letter or digit becomes a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

COUNTS, POSTINGS = 0, 1
_ROWS = (
    "part int, kind int, own array<long>, target array<long>, all_own long, all_target long, "
    "ids array<long>, keys array<long>, n_rows array<long>, n_words array<long>, n_features array<long>, postings binary"
)
_PARTS = "doc_id long, key long, gains long, n_rows long, n_words long, n_features long"


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def feature_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    """The bucket of every run of one or two words: a pair's crc goes on from that of its first word and a space."""
    if not words:
        return np.empty(0, "i8")
    single = list(map(crc32, words))
    pairs = map(crc32, words[1:], map(crc32, repeat(b" "), single))
    return np.fromiter(chain(single, pairs), "i8", 2 * len(words) - 1) % buckets


def corpus_counts(docs: DataFrame, text: str, name: str, buckets: int) -> DataFrame:
    """bucket and its count in the corpus, one row a task and bucket."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, "i8")
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    total += np.bincount(feature_buckets(split(t), buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", name])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(counts, f"bucket long, {name} long")


def _pack(doc: np.ndarray, bucket: np.ndarray, n: np.ndarray, size: int) -> bytes:
    """Postings sorted by (bucket, doc): how many each bucket has, steps between documents (back at the next bucket), counts."""
    steps = np.diff(doc, prepend=0)
    return zlib.compress(np.concatenate([np.bincount(bucket, minlength=size), steps, n]).astype("i4").tobytes(), 1)


def _unpack(packed: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.frombuffer(zlib.decompress(packed), "i4").astype("i8")
    n = (len(values) - size) // 2
    return np.cumsum(values[size : size + n]), np.repeat(np.arange(size), values[:size]), values[size + n :]


def _postings(docs: DataFrame, doc_id: str, text: str, buckets: int, groups: int, salts: int) -> DataFrame:
    """A batch's postings, one row a bucket group; group 0 names all documents and their sizes."""
    width = -(-buckets // groups)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place: dict[tuple, int] = {}
            rows, words, features, held = [], [], [], []
            for d, k, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at = place.setdefault((d, k), len(place))
                if at < len(rows):
                    rows[at] += 1
                    continue
                found = split(t)
                bucket, n = np.unique(feature_buckets(found, buckets), return_counts=True)
                rows.append(1)
                words.append(len(found))
                features.append(int(n.sum()))
                held.append(np.stack([np.full(len(bucket), at), bucket, n]))
            if not place:
                continue
            doc, bucket, n = np.concatenate(held, axis=1)
            group = bucket % groups
            order = np.lexsort((doc, bucket, group))
            doc, bucket, n, group = doc[order], bucket[order], n[order], group[order]
            cut = np.searchsorted(group, np.arange(groups + 1))
            names = list(place)
            salt = names[0][1] % salts
            out = []
            for g in range(groups):
                here = slice(cut[g], cut[g + 1])
                if g and cut[g] == cut[g + 1]:
                    continue
                own, local = (np.arange(len(names)), doc[here]) if g == 0 else np.unique(doc[here], return_inverse=True)
                row = {"part": g * salts + salt, "kind": POSTINGS, "ids": [names[i][0] for i in own], "keys": [names[i][1] for i in own]}
                row |= {"n_rows": [rows[i] for i in own], "postings": _pack(local, bucket[here] // groups, n[here], width)}
                out.append(row | ({"n_words": words, "n_features": features} if g == 0 else {}))
            yield pa.RecordBatch.from_pylist(out, _schema())

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(doc_id, text).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return read.mapInArrow(invert, _ROWS)


def _schema() -> pa.Schema:
    longs = pa.list_(pa.int64())
    kinds = [pa.int32(), pa.int32(), longs, longs, pa.int64(), pa.int64(), longs, longs, longs, longs, longs, pa.binary()]
    return pa.schema(list(zip([c.split()[0] for c in _ROWS.split(", ")], kinds, strict=True)))


def gain(own: int, target: int, all_own: int, all_target: int, buckets: int) -> int:
    """Thousandths of the logarithm of how much likelier the target is to hold a bucket, with one count added to each."""
    return math.floor(1000 * math.log((target + 1.0) * (all_own + float(buckets)) / ((own + 1.0) * (all_target + float(buckets)))))


def _contributions(dealt: DataFrame, buckets: int, groups: int) -> DataFrame:
    """Rows of each part in order, its counts first: every posting becomes its bucket's gain times its count."""
    width = -(-buckets // groups)

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = np.zeros(width, "i8")
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == COUNTS:
                    gains = np.array([gain(s, t, row["all_own"], row["all_target"], buckets) for s, t in zip(row["own"], row["target"], strict=True)], "i8")
                    continue
                doc, bucket, n = _unpack(row["postings"], width)
                size, rows = len(row["ids"]), np.array(row["n_rows"], "i8")
                sums = np.zeros(size, "i8")
                np.add.at(sums, doc, gains[bucket] * n)
                first = row["n_words"] is not None
                none = np.zeros(size, "i8")
                columns = [pa.array(row["ids"], pa.int64()), pa.array(row["keys"], pa.int64()), sums * rows]
                columns += [rows, np.array(row["n_words"]), np.array(row["n_features"])] if first else [none, none, none]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in _PARTS.split(", ")])

    return dealt.mapInArrow(contribute, _PARTS)


def weigh_documents(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, groups: int = GROUPS) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean gain, in thousandths) of each row of docs."""
    salts = -(-input_partitions(docs) // groups)
    width = -(-buckets // groups)
    both = corpus_counts(docs, text, "own", buckets).withColumn("target", F.lit(0).cast("long"))
    both = both.unionByName(corpus_counts(target, target_text, "target", buckets).withColumn("own", F.lit(0).cast("long")))
    met = table(both.groupBy("bucket").agg(F.sum("own").alias("own"), F.sum("target").alias("target")), "importance-counts")
    totals = met.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("all_own"), F.coalesce(F.sum("target"), F.lit(0)).alias("all_target"))
    every = docs.sparkSession.range(width * groups).select(F.col("id").alias("_b")).join(F.broadcast(met), F.col("_b") == F.col("bucket"), "left")  # as many rows as buckets
    by_group = every.groupBy((F.col("_b") % groups).cast("int").alias("g")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_b"), F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("target", F.lit(0)).alias("target")))).alias("c")
    )
    counts = by_group.crossJoin(F.broadcast(totals)).select(  # one row of totals by construction
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.col("g") * salts + s)).alias("part"),
        F.lit(COUNTS).alias("kind"), F.col("c.own").alias("own"), F.col("c.target").alias("target"), "all_own", "all_target",
    )
    rows = _postings(docs, doc_id, text, buckets, groups, salts).unionByName(counts, allowMissingColumns=True)
    dealt = rows.repartitionById(groups * salts, F.col("part")).sortWithinPartitions("part", "kind")
    parts = _contributions(dealt, buckets, groups).groupBy("doc_id", "key")
    summed = parts.agg(*[F.sum(c).alias(c) for c in ("gains", "n_rows")], *[F.max(c).alias(c) for c in ("n_words", "n_features")])
    # equal rows have equal sums, so gains / n_rows is whole
    floored = F.when(F.col("n_features") > 0, F.expr("(gains div n_rows - pmod(gains div n_rows, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    weighed = summed.select("doc_id", "n_words", "n_features", floored.alias("weight"), "n_rows")
    return weighed.select("doc_id", "n_words", "n_features", "weight", F.explode(F.expr("sequence(1L, n_rows)")).alias("_row")).drop("_row")


def noise(seed: int, doc_id: Column) -> Column:
    """Thousandths of a Gumbel number from a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text", target_text: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row of docs.

    Of the rows with least_words words or more, percent of a hundred (rounded down) are drawn, those with the highest
    scores, and have a rank from 1 on.
    """
    weighed = weigh_documents(docs, target, doc_id, text, target_text)
    scored = weighed.withColumn("score", F.col("weight") + noise(seed, F.col("doc_id")))
    scored, seen = measured_table(scored, "importance-scores", long_enough=F.count_if(F.col("n_words") >= least_words))
    drawn = percent * (seen["long_enough"] or 0) // 100
    placed = ranked(scored.where(F.col("n_words") >= least_words), [], [F.desc("score"), F.asc("doc_id")]).drop("group_rows")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
