"""Filter interaction audit: what each filter removes, in every order of the filters.

Every document gets a mask with one bit a filter it fails.  Filters on a text's own content are
tested where the document is read; the filter on identical texts needs all documents and goes
by fingerprint.

1. Within a partition of the input, equal texts meet first: a text is remembered with its least id, as long
   as ``REMEMBERED`` bytes of texts allow (the least recently seen goes first), and rows with a larger id
   are known copies at once.  So a text that a third of all documents hold leaves each
   partition about once.
2. What is left is dealt by xxhash64 of the text, sorted by (hash, id), and compared in chains: the texts
   of one hash, each in full with its least id.  Rows that are not least fail.
3. Masks meet the labels by id, and combineByKey adds them up as one vector of counts a part: for
   each mask all documents, good ones and toxic ones.  The report follows from these vectors.

A mask has as many bits as there are filters, and the report a row per part, order and step, so both
are for a handful of filters.

Defined cases: a null text is empty, as is a null part; an id that is null is neither smaller nor larger than
another, so its row is no copy and makes none; rows of one id and text are no copies of each
other; repeated label rows of an id count as good (toxic) if one of them says so; documents without a label are
neither; texts are taken whole; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, OrderedDict
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from itertools import count, permutations

import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import input_partitions, small, table

#: Bytes of texts that a task remembers while it reads its partition.
REMEMBERED = 64 << 20

#: A test on (text, its UTF-8 bytes, its words between ASCII white space): true if the document fails.
Test = Callable[[str, bytes, list[bytes]], bool]

_UPPER = bytes(range(ord("A"), ord("Z") + 1))


def too_short(text: str, raw: bytes, words: list[bytes]) -> bool:
    return len(words) < 50


def repetitive(text: str, raw: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 65 * len(words)


def shouting(text: str, raw: bytes, words: list[bytes]) -> bool:
    return 100 * (len(raw) - len(raw.translate(None, _UPPER))) > 5 * len(text)


def symbolic(text: str, raw: bytes, words: list[bytes]) -> bool:
    return len(raw.translate(None, b"#$%&*|")) < len(raw)


TESTS: dict[str, Test] = {"A": too_short, "B": repetitive, "C": shouting, "D": symbolic}
COPY = "E"


def _local(rows: Iterable[tuple], tests: Sequence[Test], copy_bit: int) -> Iterator[tuple]:
    """((route, id), (text or None, mask, parts)) of a partition's documents; without a text the mask is final."""
    held: OrderedDict[bytes, tuple[int, int, Counter]] = OrderedDict()
    size, turn = 0, count()

    def settled(doc: int | None, mask: int, parts: Mapping[str, int]) -> tuple:
        return (next(turn), 0), (None, mask, doc, dict(parts))  # any route will do, and turns spread even one id

    def routed(raw: bytes, doc: int, mask: int, parts: Mapping[str, int]) -> tuple:
        return (xxhash.xxh64_intdigest(raw), doc), (raw, mask, doc, dict(parts))

    for doc, text, part in rows:
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        mask = sum(1 << i for i, test in enumerate(tests) if test(text, raw, words))
        if doc is None:
            yield settled(None, mask, {part: 1})
            continue
        if raw not in held:
            held[raw] = (doc, mask, Counter({part: 1}))
            size += len(raw) + 200
            while size > REMEMBERED:
                old, (least, was, parts) = held.popitem(last=False)
                size -= len(old) + 200
                yield routed(old, least, was, parts)
            continue
        held.move_to_end(raw)
        least, _, parts = held[raw]
        if doc == least:
            parts[part] += 1
        elif doc > least:
            yield settled(doc, mask | copy_bit, {part: 1})
        else:
            yield settled(least, mask | copy_bit, parts)
            held[raw] = (doc, mask, Counter({part: 1}))
    for raw, (doc, mask, parts) in held.items():
        yield routed(raw, doc, mask, parts)


def _chained(rows: Iterable[tuple], copy_bit: int) -> Iterator[tuple]:
    """(id, part, mask, n) of rows sorted by (route, id): a row whose text is in the chain of its route with a smaller id is a copy."""
    at, chain = None, {}
    for (route, _), (raw, mask, doc, parts) in rows:
        if raw is not None:
            if route != at:
                at, chain = route, {}
            if chain.setdefault(raw, doc) < doc:
                mask |= copy_bit
        for part, n in parts.items():
            yield doc, part, mask, n


def mark_documents(
    docs: DataFrame, tests: Mapping[str, Test] | None = None, doc_id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """doc_id, part, mask and n (rows that share these three): bit i of mask is set where test i fails, the last one for copies."""
    own, n = list((TESTS if tests is None else tests).values()), input_partitions(docs)
    copy_bit = 1 << len(own)
    rows = docs.select(F.col(doc_id).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(part).cast("string"), F.lit(""))).rdd
    dealt = rows.mapPartitions(lambda x: _local(x, own, copy_bit)).repartitionAndSortWithinPartitions(n, lambda k: k[0] % n)
    marked = dealt.mapPartitions(lambda x: _chained(x, copy_bit))
    return docs.sparkSession.createDataFrame(marked, "doc_id long, part string, mask int, n long", verifySchema=False)


def later_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id of each row whose text a smaller id has."""
    marked = mark_documents(docs.select(doc_id, text, F.lit("").alias("part")), {}, doc_id, text, "part")
    return marked.where("mask = 1").select(F.explode(F.expr("array_repeat(doc_id, int(n))")).alias("doc_id"))


def mask_counts(marks: DataFrame, labels: DataFrame, bits: int, doc_id: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> RDD:
    """(part, vector): at 3 * mask all documents, then the good and the toxic ones."""
    said = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id"))
    said = said.agg(F.max((F.col(good) == 1).cast("int")).alias("good"), F.max((F.col(toxic) == 1).cast("int")).alias("toxic"))
    known = marks.where("doc_id is not null").join(small(said), F.col("doc_id") == F.col("_id"), "left")
    known = known.select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    unknown = marks.where("doc_id is null").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))

    def add(vector: list[int], row: tuple) -> list[int]:
        mask, n, is_good, is_toxic = row
        vector[3 * mask] += n
        vector[3 * mask + 1] += n * is_good
        vector[3 * mask + 2] += n * is_toxic
        return vector

    pairs = known.unionByName(unknown).rdd.map(lambda r: (r["part"], (r["mask"], r["n"], r["good"], r["toxic"])))
    return pairs.combineByKey(lambda row: add([0] * (3 << bits), row), add, lambda a, b: [x + y for x, y in zip(a, b, strict=True)])


def report(part: str, vector: Sequence[int], letters: str) -> Iterator[tuple]:
    """The rows of one part: every order of the letters, each with its steps."""
    bits = len(letters)

    def left(removing: int, kind: int) -> int:
        """Documents of a kind that pass all filters in removing."""
        return sum(vector[3 * m + kind] for m in range(1 << bits) if not m & removing)

    passed = [[left(removing, kind) for kind in range(3)] for removing in range(1 << bits)]
    fails = [passed[0][0] - passed[1 << i][0] for i in range(bits)]
    rows, total = [], Counter()
    for order in permutations(range(bits)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed, good, toxic = (a - b for a, b in zip(passed[before], passed[after], strict=True))
            total[i] += removed
            name = "".join(letters[x] for x in order)
            rows.append((i, (part, name, step, passed[after][0], removed, fails[i] - removed, vector[3 << i], good, toxic)))
            before = after
    for i, row in rows:
        yield *row, total[i]


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(
    docs: DataFrame,
    labels: DataFrame,
    tests: Mapping[str, Test] | None = None,
    copy: str = COPY,
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "source",
) -> DataFrame:
    """One row per part, filter_order and step: what the filter of that step removes, given those before it.

    Letters of tests name them in filter_order, copy names the filter on identical texts.  redundant counts documents
    that fail the filter but went before, unique_fails those that fail it alone, shapley the documents it
    removes over all orders together.
    """
    tests = TESTS if tests is None else tests
    letters = "".join(tests) + copy
    marks = table(mark_documents(docs, tests, doc_id, text, part), "audit-marks")
    counts = mask_counts(marks, labels.withColumnRenamed(doc_id, "doc_id"), len(letters))
    return docs.sparkSession.createDataFrame(counts.flatMap(lambda x: report(*x, letters)), REPORT, verifySchema=False)
