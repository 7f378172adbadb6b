"""Substring dedup over bytes with prefix-free parsing.

A window is ``WINDOW`` bytes; a byte goes if a window that covers it starts anywhere else too.  A trigger is
a run of ``TRIGGER`` bytes whose rolling hash is small (one in ``PERIOD``).  Triggers cut a text into phrases,
each from one trigger to the end of the next, so where a phrase ends follows from its content alone, no phrase is
the beginning of another, and equal passages are cut alike.

1. Dictionary.  Each text sends the hashes of its phrases; those that stand at two or more places come back.
2. Parse.  Only windows whose whole phrases all come back can repeat.  Neighbouring windows with the
   same least rolling hash form one strip, which is sent, once a batch, under that hash: equal
   windows have equal least hashes, so they meet, and a strip costs about three bytes a window.
3. Corpus order.  The strips that meet are parsed again: the suffixes of their distinct phrases are sorted, and the
   suffixes of the parse, as phrase ranks.  A position's place is the rank of its phrase's suffix, then that of the parse that
   follows; equal windows are neighbours in this order and are compared byte by byte.
4. The stretches that repeat go back to their texts.

A hash under which more than ``HEAVY_BYTES`` of strips meet (a passage that very many documents hold) is not gathered:
its windows are spread by their own 96-bit hashes, resolved within each Arrow batch first.  Texts that
are equal as a whole are told so by counts and enter the steps once.  A text is named by a 64-bit hash of id and text;
phrases travel as 48 bits of hash, and a chance match there costs a comparison only.

Defined cases: a null text is empty; texts of fewer than ``WINDOW`` bytes lose nothing; ids play no part but in
naming, so null and repeated ids are no special case; rows of one id and text are equal texts; cuts may fall inside a
character, so what is kept is binary; texts are taken whole; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import input_partitions, join_per_key, row_key, small, table
from graphloom.llm.substring_dedup import _ROWS, _by_document, _meet, _numpy, _send

WINDOW = 400
#: Bytes of a trigger, a power of two.
TRIGGER = 16
#: One in so many places is a trigger; a window holds about eight phrases.
PERIOD = 48
#: Bytes of strips that one task gathers under a hash, and bytes that it puts in order together.
HEAVY_BYTES, CHUNK_BYTES = 512 << 10, 128 << 10
#: Heavy hashes up to which their list is broadcast (8 bytes each), else shuffled.
HEAVY_KEYS = 1_000_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_LIMIT = np.uint64((1 << 64) // PERIOD)
_STRIPS = "at long, row long, start int, size int, told boolean, body binary"
_SPANS = "row long, first int, last int"


def rolling(text: bytes) -> np.ndarray:
    """The hash of every run of TRIGGER bytes."""
    h = (np.frombuffer(text, "u1").astype("u8") + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    size, factor = 1, _FACTOR
    with np.errstate(over="ignore"):
        while size < TRIGGER:
            if len(h) <= size:
                return np.empty(0, "u8")
            h = h[:-size] * factor + h[size:]
            size, factor = 2 * size, factor * factor
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def phrase_hashes(text: bytes, triggers: np.ndarray) -> np.ndarray:
    """48 bits of hash of each phrase between two triggers."""
    cuts = triggers.tolist()
    found = (xxhash.xxh3_64_intdigest(text[a : b + TRIGGER]) for a, b in zip(cuts, cuts[1:]))
    return np.fromiter(found, "u8", max(len(cuts) - 1, 0)) >> np.uint64(16)


def sliding_least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours: blocks of n, from the left up to here and from here to the right."""
    blocks = -(-len(values) // n)
    padded = np.full(blocks * n, np.iinfo("u8").max, "u8")
    padded[: len(values)] = values
    grid = padded.reshape(blocks, n)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(values) - n + 1], ahead[n - 1 : len(values)])


def strips(text: bytes, known: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(least hash, start, end) of each strip of windows that may repeat; known are the phrase hashes that came back."""
    hashes = rolling(text)
    triggers = np.flatnonzero(hashes < _LIMIT)
    phrases = phrase_hashes(text, triggers)
    n = len(text) - WINDOW + 1
    _, which, times = np.unique(phrases, return_inverse=True, return_counts=True)
    alone = (times[which] == 1) & ~np.isin(phrases, known)
    first, last = triggers[:-1][alone], triggers[1:][alone] + TRIGGER
    inside = last - first <= WINDOW
    marks = np.zeros(n + 1, "i4")  # windows that hold a phrase of one place
    np.add.at(marks, np.clip(last[inside] - WINDOW, 0, n), 1)
    np.add.at(marks, np.minimum(first[inside] + 1, n), -1)
    maybe = np.cumsum(marks[:n]) == 0
    if not maybe.any():
        return
    least = sliding_least(hashes, WINDOW - TRIGGER + 1)
    change = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (maybe[1:] != maybe[:-1])])
    for a, b in zip(change.tolist(), np.r_[change[1:], n].tolist(), strict=True):
        if maybe[a]:
            yield int(least[a : a + 1].view("i8")[0]), a, b - 1 + WINDOW


def begins_anew(strip: bytes) -> bool:
    """Whether two windows of a strip begin alike, in as many bytes as a trigger has."""
    begins = rolling(strip)[: len(strip) - WINDOW + 1]
    return len(np.unique(begins)) < len(begins)


def repeated(texts: list[bytes]) -> list[np.ndarray]:
    """For distinct strips: which of each one's windows stand at another place too, in it or another.

    Dictionary and parse are put in order apart, and positions by both.
    """
    whole = b"".join(texts)
    bounds = np.cumsum([0, *map(len, texts)])
    owner_end = np.repeat(bounds[1:], np.diff(bounds))
    hashes = rolling(whole)
    cuts = np.flatnonzero(hashes < _LIMIT)
    cuts = cuts[cuts + TRIGGER <= owner_end[cuts]]
    at = np.concatenate([np.arange(a, b - WINDOW + 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    # phrases: from each text's start to the end of its first trigger, and from each trigger to the next one's end or the text's end
    begin = np.r_[bounds[:-1], cuts]
    following = np.r_[np.searchsorted(cuts, bounds[:-1], side="left"), np.arange(1, len(cuts) + 1)]
    end = np.minimum(np.append(cuts + TRIGGER, len(whole))[following], owner_end[begin])
    stand = np.argsort(begin, kind="stable")
    begin, end = begin[stand], end[stand]
    contents = [whole[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    phrases = sorted(set(contents))
    rank = {p: i for i, p in enumerate(phrases)}
    parse = np.array([rank[p] for p in contents], ">u4")
    # a position lies in the phrase that begins before it, or at its text's start
    own = np.searchsorted(begin, at, side="left") - ~np.isin(at, bounds[:-1])
    # the dictionary's suffixes, of phrases in which windows start, cut at a window's length
    used = np.unique(parse[own]).astype("i8")
    sizes = np.zeros(len(phrases), "i8")
    sizes[used] = [len(phrases[i]) for i in used.tolist()]
    suffixes = [p[i : i + WINDOW] for p in map(phrases.__getitem__, used.tolist()) for i in range(len(p))]
    places = {s: i for i, s in enumerate(sorted(set(suffixes)))}
    suffix_rank = np.fromiter(map(places.__getitem__, suffixes), "i8", len(suffixes))
    offsets = np.cumsum(np.r_[0, sizes])
    # the parse's suffixes, as ranks of the phrases that cover a window from their start
    packed, until = parse.tobytes(), np.searchsorted(begin, begin + WINDOW)
    tails = [packed[4 * i : 4 * j] for i, j in enumerate(until.tolist())]
    order = {s: i for i, s in enumerate(sorted(set(tails)))}
    tail_rank = np.fromiter(map(order.__getitem__, tails), "i8", len(tails))
    head = suffix_rank[offsets[parse[own]] + at - begin[own]]
    after = np.where(end[own] - at < WINDOW, tail_rank[np.minimum(own + 1, len(begin) - 1)] + 1, 0)
    by = np.lexsort((after, head))
    ordered, head, after = at[by], head[by], after[by]
    # neighbours with one suffix and one tail are equal, with one suffix and two tails they may be
    same = head[1:] == head[:-1]
    near = np.flatnonzero(same & (after[1:] != after[:-1]))
    pairs = zip(ordered[near].tolist(), ordered[near + 1].tolist(), strict=True)
    same[near] = np.fromiter((whole[a : a + WINDOW] == whole[b : b + WINDOW] for a, b in pairs), bool, len(near))
    hit = np.zeros(len(whole) + 1, bool)
    hit[ordered[1:][same]] = True
    hit[ordered[:-1][same]] = True
    return [hit[a : b - WINDOW + 1] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def stretches(hit: np.ndarray, start: int) -> list[tuple[int, int]]:
    """First and last byte (exclusive) of the stretches that the windows marked in hit cover."""
    if not hit.any():
        return []
    edges = np.diff(np.r_[False, hit, False].astype("i1"))
    return list(zip((np.flatnonzero(edges == 1) + start).tolist(), (np.flatnonzero(edges == -1) + start - 1 + WINDOW).tolist(), strict=True))


def _spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], ["row", "first", "last"])


def _gathered(light: DataFrame, partitions: int) -> DataFrame:
    """The spans of strips that meet under one hash; strips of several hashes are put in order together, as none of their windows are equal."""
    dealt = light.repartition(partitions, "at").sortWithinPartitions("at")

    def settle(held: dict[int, dict[bytes, list[tuple[int, int]]]]) -> list[tuple[int, int, int]]:
        """A strip that is alone under its hash needs no order: its copies repeat it whole, and in itself it repeats only if it begins anew."""
        alone = {body: np.full(len(body) - WINDOW + 1, len(places) > 1) for group in held.values() if len(group) == 1 for body, places in group.items()}
        hits = {body: hit for body, hit in alone.items() if hit[0] or not begins_anew(body)}
        ordered = [body for group in held.values() for body in group if body not in hits]
        hits |= dict(zip(ordered, repeated(ordered) if ordered else (), strict=True))
        out = []
        for group in held.values():
            for body, places in group.items():
                hit = hits[body] if len(places) == 1 else np.ones(len(hits[body]), bool)
                out += [(row, a, b) for row, start in places for a, b in stretches(hit, start)]
        return out

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        size, last = 0, None
        for batch in batches:
            done = []
            for at, row, start, body in zip(*(batch.column(c).to_pylist() for c in ("at", "row", "start", "body")), strict=True):
                if at != last and size > CHUNK_BYTES:
                    done += settle(held)
                    held, size = {}, 0
                last = at
                group = held.setdefault(at, {})
                if body not in group:
                    size += len(body)
                group.setdefault(body, []).append((row, start))
            yield _spans(done)
        if held:
            yield _spans(settle(held))

    return dealt.select("at", "row", "start", "body").mapInArrow(order, _SPANS)


def _window_hashes(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of every window."""
    digests = b"".join(xxhash.xxh3_128_digest(body[i : i + WINDOW]) for i in range(len(body) - WINDOW + 1))
    pairs = np.frombuffer(digests, ">u8").astype("u8").reshape(-1, 2)
    return pairs[:, 0].copy(), (pairs[:, 1] >> np.uint64(32)).astype("u4")


def _spread(heavy: DataFrame, partitions: int) -> DataFrame:
    """The spans of strips under heavy hashes: windows meet one by one, by their own hashes."""
    sites = table(heavy.select(F.xxhash64("row", "start").alias("site"), "row", "start", "body"), "suffix-heavy")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed(batch: pa.RecordBatch):
            for site, body in zip(batch.column("site").to_pylist(), batch.column("body").to_pylist(), strict=True):
                yield site, *_window_hashes(body)

        return _send(batches, hashed, True)

    answers = _by_document(_meet(sites.select("site", "body").mapInArrow(send, _ROWS), partitions, True), "known")
    met = sites.join(answers, F.col("site") == F.col("_to"), "left").select("row", "start", "body", "known")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            known = batch.column("known")
            for i, (row, start, body) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "start", "body")), strict=True)):
                hashes, _ = _window_hashes(body)
                _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
                hit = times[which] > 1
                if known[i].is_valid:
                    hit |= np.isin(hashes, _numpy(known[i], "u8"))
                out += [(row, a, b) for a, b in stretches(hit, start)]
            yield _spans(out)

    return met.mapInArrow(place, _SPANS)


def equal_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row and first (whether it stands for the others) of each row whose whole text is another row's too."""
    long = docs.where(F.octet_length(F.col(text)) >= WINDOW).select(row_key(doc_id, text).alias("row"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("h"))
    per_text = long.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("least")).where("n > 1")
    found = join_per_key(long, per_text, "h", "n").select("row", (F.col("row") == F.col("least")).alias("first"))
    return found.groupBy(F.col("row").alias("_row")).agg(F.max("first").alias("first"))


def dedup_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (stretches removed) and kept (the bytes that stay) of each row of docs."""
    parts = input_partitions(docs)
    equal = table(equal_texts(docs, doc_id, text), "suffix-equal")
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(doc_id, text).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    dealt = read.repartition(parts, "row")
    texts = dealt.join(equal.hint("merge"), F.col("row") == F.col("_row"), "left").select("doc_id", "row", "text", "first")

    def taking_part(batch: pa.RecordBatch) -> list[int]:
        """Texts as long as a window; of equal ones, the first."""
        sizes, firsts = pc.binary_length(batch.column("text")).to_pylist(), batch.column("first").to_pylist()
        return [i for i, n in enumerate(sizes) if n >= WINDOW and firsts[i] is not False]

    def dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed(batch: pa.RecordBatch):
            for i in taking_part(batch):
                body = batch.column("text")[i].as_py()
                found = np.unique(phrase_hashes(body, np.flatnonzero(rolling(body) < _LIMIT)))
                yield batch.column("row")[i].as_py(), found, np.zeros(len(found), "u4")

        return _send(batches, hashed, True)

    shared = _by_document(_meet(texts.mapInArrow(dictionary, _ROWS), parts, True), "shared")
    parsed = texts.join(shared.hint("merge"), F.col("row") == F.col("_to"), "left").select("doc_id", "row", "text", "first", "shared")

    def cut_strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = {}
            rows, known = [], batch.column("shared")
            for i in taking_part(batch):
                body, row = batch.column("text")[i].as_py(), batch.column("row")[i].as_py()
                for at, a, b in strips(body, _numpy(known[i] if known[i].is_valid else None, "u8")):
                    strip = body[a:b]
                    if strip in seen:
                        rows[seen[strip]][4] = True
                        rows.append([at, row, a, b - a, True, None])
                    else:
                        seen[strip] = len(rows)
                        rows.append([at, row, a, b - a, False, strip])
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _STRIPS.split(", ")])

    sent = table(parsed.mapInArrow(cut_strips, _STRIPS), "suffix-strips")
    told = sent.where("told").select("row", F.col("start").alias("first"), (F.col("start") + F.col("size")).cast("int").alias("last"))
    bodies = sent.where("body is not null")
    heavy = table(bodies.groupBy("at").agg(F.sum("size").alias("size")).where(F.col("size") > HEAVY_BYTES).select("at"), "suffix-heavy-keys")
    spans = told
    if heavy.isEmpty():
        spans = spans.unionByName(_gathered(bodies, parts))
    else:
        keys = small(heavy, HEAVY_KEYS)
        spans = spans.unionByName(_gathered(bodies.join(keys, "at", "left_anti"), parts)).unionByName(_spread(bodies.join(keys, "at", "left_semi"), parts))
    by_text = spans.groupBy(F.col("row").alias("_of")).agg(F.collect_list(F.struct(F.col("first").alias("a"), F.col("last").alias("b"))).alias("spans"))
    answered = texts.join(by_text.hint("merge"), F.col("row") == F.col("_of"), "left").select("doc_id", "row", "text", "first", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, n_spans, kept = [], [], [], []
            for body, first, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "first", "spans")), strict=True):
                size.append(len(body))
                if first is not None:
                    spans = [{"a": 0, "b": len(body)}]
                marks = np.zeros(len(body) + 1, "i4")
                for s in spans or ():
                    marks[s["a"]] += 1
                    marks[s["b"]] -= 1
                gone = np.cumsum(marks[:-1]) > 0
                removed.append(int(gone.sum()))
                n_spans.append(int((gone & ~np.r_[False, gone[:-1]][: len(gone)]).sum()))
                kept.append(np.frombuffer(body, "u1")[~gone].tobytes() if removed[-1] else body)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, "int64"), pa.array(removed, "int64"), pa.array(n_spans, "int64"), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return answered.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
