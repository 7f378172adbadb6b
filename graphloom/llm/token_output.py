"""Token-ID output: Parquet files of token lists, in document order or one given, for selective reads.

Texts are range-partitioned by document id, or by an order column such as that of a global shuffle,
before they are encoded, so only texts are shuffled and each file holds one range in ascending order.  ``ids`` is a
list column with dictionary encoding; ``doc_id``, ``ordinal`` and ``n_tokens`` are delta
encoded.  Row groups are small and pages carry indexes, so a reader that filters on ids or
asks for the metadata columns only touches little of a file.

Defined cases: a null text is empty and gives the end id alone; null ids come first, dealt over tasks;
rows with equal ids are ordered by a hash of their text, equal rows anyhow; an empty
table gives no rows; long texts are encoded whole; other columns are not read.  Ids are whole numbers
(or text that casts to them).
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import in_ranges, input_partitions, new_path, row_key, small

#: Parquet settings of the files.
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
OPTIONS = {
    "compression": "snappy",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
}
SCHEMA = "doc_id long, ordinal long, n_tokens long, ids array<int>"

#: Encoded chunks and parts of chunks that a worker keeps, and the length of the longest.
CACHE_CHUNKS, CACHE_CHARS = 1_000_000, 48
#: A chunk of Latin letters and then these marks (ASCII without the apostrophe) is cut between the two by the pre-tokenizer.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LATIN = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
#: Parts sent to the tokenizer as one text.
JOINED = 1024

_encoders: dict[tuple[str, int], "ChunkEncoder"] = {}


class ChunkEncoder:
    """Encodes texts with the tokenizers library, each distinct chunk between spaces once.

    The vocabulary's pre-tokenizer drops white space and its normaliser works on
    characters within a word, so a text's ids are those of its chunks in order.  A chunk of
    letters and closing marks is two parts, and case is folded, so parts repeat more than chunks;
    new parts go to the tokenizer many to a text, whose ids are cut after each end-of-word id.
    """

    def __init__(self, path: str, cache: int = CACHE_CHUNKS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.cache = cache
        self.known: dict[str, bytes] = {"": b""}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids): the number of ids of each text, and all ids one after the other."""
        plain = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        chunks = pc.split_pattern(plain, " ")
        coded = chunks.values.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, distinct))
        new = [i for i, ids in enumerate(found) if ids is None]
        if len(self.known) + len(new) > self.cache:
            self.known = {"": b""}
        self._encode_new([distinct[i] for i in new])
        for i in new:
            found[i] = self.known[distinct[i]]
            if len(distinct[i]) > CACHE_CHARS:
                del self.known[distinct[i]]
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), "i8", len(found)) // 4
        at = coded.indices.to_numpy()
        first = np.cumsum(sizes) - sizes
        own = sizes[at]
        ends = np.cumsum(own)
        # each chunk's ids are a run of the pool: its first place, then one by one
        ids = pool[np.repeat(first[at] - (ends - own), own) + np.arange(own.sum())]
        bounds = np.concatenate([[0], ends])[chunks.offsets.to_numpy()]
        return np.diff(bounds), ids

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        counts, ids = self.encode(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []

    def _encode_new(self, new: list[str]) -> None:
        parts, cut, whole = set(), [], []
        for c in new:
            letters = c if c.isalpha() else c.rstrip(MARKS)
            if len(c) > CACHE_CHARS or not letters.isalpha() or not (letters.isascii() or LATIN.fullmatch(letters)):
                whole.append(c)
                continue
            low = letters.lower()
            parts.add(low)
            if low != c:
                marks = c[len(letters) :]
                parts.add(marks)
                cut.append((c, low, marks))
        known = self.known
        fresh = list(parts.difference(known))
        for i in range(0, len(fresh), JOINED):
            words = fresh[i : i + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            last = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(last) != len(words):
                raise ValueError("the vocabulary does not end every word with an end-of-word id")
            data, start = ids.tobytes(), 0
            for word, end in zip(words, last, strict=True):
                known[word] = data[4 * start : 4 * end]
                start = end
        for c, low, marks in cut:
            known[c] = known[low] + known[marks]
        for i in range(0, len(whole), JOINED):
            texts = whole[i : i + JOINED]
            for c, e in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                known[c] = np.array(e.ids, "<u4").tobytes()


def encoder(path: str, cache: int = CACHE_CHUNKS) -> ChunkEncoder:
    """One encoder per worker, vocabulary and cache size, kept between tasks."""
    if (path, cache) not in _encoders:
        _encoders[path, cache] = ChunkEncoder(path, cache)
    return _encoders[path, cache]


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    cache: int = CACHE_CHUNKS,
    order: Column | None = None,
) -> None:
    """Encode every text, append end_id, and write the files in ascending order of documents, or of a long column of docs.

    cache bounds the chunks that a worker remembers, at about 150 bytes each: memory against time.
    """
    own = F.col(doc_id).cast("long")
    place = own if order is None else order.cast("long")
    thin = docs.select(own.alias("doc_id"), F.col(text).alias("text"), place.alias("place"), row_key(doc_id, text).alias("tie"))
    ordered = in_ranges(thin, "place", "tie", input_partitions(docs))
    # the partition's number in the upper bits, the row's place in it in the lower 33
    numbered = ordered.select("doc_id", F.monotonically_increasing_id().alias("ordinal"), "text")
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = encoder(tokenizer, cache)
        for batch in batches:
            counts, ids = chunks.encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("i4")
            offsets = np.concatenate([[0], np.cumsum(counts + 1)]).astype("i4")
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ordinal"), pa.array(counts + 1, "int64"), lists], ["doc_id", "ordinal", "n_tokens", "ids"]
            )

    numbered.mapInArrow(encode, SCHEMA).write.options(**OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ordinal, n_tokens, ids of the files; filters and column choices reach the scan."""
    return spark.read.schema(SCHEMA).parquet(path)


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files.

    start adds the totals of the earlier files, of which there are as many as partitions
    were written, to the running sum within the file.
    """

    def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at = ids.offsets.to_numpy()
            values = ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(values[at[i] : at[i + 1]].tobytes()) for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ordinal"), pa.array(np.diff(at).astype("int64")), pa.array(crc, "int64")],
                ["doc_id", "ordinal", "n_tokens", "ids_crc32"],
            )

    rows = tokens.select("doc_id", "ordinal", "ids").mapInArrow(checksum, "doc_id long, ordinal long, n_tokens long, ids_crc32 long")
    rows = rows.withColumn("file", F.shiftright("ordinal", 33))
    totals = tokens.groupBy(F.shiftright("ordinal", 33).alias("file")).agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    started = rows.select("*", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inside"))
    return started.join(small(bases), "file").select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def written_order() -> Column:
    """The place of a row in the Parquet table it is read from: by number of the part file, then by row.

    Spark deals files to tasks by size, so neither tasks nor row ids tell in which order a table was written.
    """
    part = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("long")
    return F.shiftleft(part, 40) + F.col("_metadata.row_index")


def token_table(docs: DataFrame, tokenizer: str, end_id: int, cache: int = CACHE_CHUNKS, order: Column | None = None) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, cache=cache, order=order)
    return read_tokens(docs.sparkSession, path)
