"""Secret scans with password guess costs.

Three fixed patterns give the base spans.  The method looks further at values in credential
context (after words such as "pwd is", in URLs with a user and password, in Bearer headers):
dynamic programming finds the cheapest segmentation of the value into common words, dates,
repeats, keyboard walks, sequences and brute-force spans, and the value is reported as a
span of kind ``guess`` if that many guesses, in powers of ten, reach a threshold.  Base
spans stay whatever their cost; the cost of each credential-context value is kept as well.

Words are ranked by the number of documents they stand in, outside of credential contexts, so
that no secret makes itself a word; at most ``WORDS`` of them, each in ``WORD_DOCS`` documents or
more, are broadcast after that count.  Words of one count share a rank, and ranks follow those of
the fixed words.

Costs are exact up to ``CERTAIN`` powers of ten, twice the threshold, and reported as at most that: no
verdict hangs on what lies beyond, so blocks of more characters than that need not be tried.

Defined cases: a null or empty text has no spans; overlapping kinds are all reported; ties
between segmentations have one cost, the least; repeated rows are scanned alike; an empty
table gives no rows; long texts and long values are taken whole; other columns are not read.  Ids are
whole numbers (or text that casts to them).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Mapping
from types import MappingProxyType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import table

# Fixed values of the contract.
ASSIGN = re.compile(
    r"""(?a:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex", "guess")

#: Credential contexts beyond the base patterns; group 1 is the value.
CONTEXTS = (
    re.compile(
        r"""(?a:(?i:\b(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|credentials?|private[_-]?key|access[_-]?key|client[_-]?secret|auth[_-]?token)["']?"""
        r"""(?:\x20+(?:is|was|ist|est|es)\x20+|\x20*[:=]\x20*)["']?)([^\s"'<>,;]{8,}))"""
    ),
    re.compile(r"""(?a:(?i:\bbearer)\x20+([A-Za-z0-9+/_.=~-]{8,}))"""),
    re.compile(r"""(?a:(?<=[A-Za-z0-9+.-])://[^\s/:@]*:([^\s/@]{8,})@)"""),
)
#: Any context holds one of these, whatever its case; texts without are passed over.
HINT = r"(?i)pass|pwd|pin|secret|credential|key|token|bearer|://|akia|[0-9a-f]{32}"

#: Guesses, as a power of ten, from which a value counts as a secret.
SECRET_GUESSES = 8.0
CERTAIN = 16.0
#: Most words ranked by the documents, the fewest documents that make a word, and the lengths of words.
WORDS = 50_000
WORD_DOCS = 3
WORD_LETTERS = (3, 24)
#: Guesses of a brute-forced character.
BRUTE = 10.0

# Words that guessers try first, in order; rows of keyboards; the year now.
COMMON_WORDS = (
    "password 123456 12345678 qwerty abc123 letmein monkey dragon master login welcome admin iloveyou sunshine princess football "
    "shadow superman batman trustno1 hello freedom whatever secret access test guest root user default changeme example sample "
    "summer winter spring autumn love money baby angel michael jordan charlie thomas robert daniel george hunter ranger buster "
    "soccer hockey baseball killer pepper cookie cheese coffee orange banana purple silver golden diamond computer internet server "
    "system network database private public token apikey key the and for you are with this that none null true false value string "
    "wonderful beautiful important different available following something everything personal required optional undefined unknown "
    "protected encrypted confidential necessary possible incorrect expired forgotten temporary permanent redacted placeholder"
).split()
KEYBOARD_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop")
YEAR = 2026
LEET = str.maketrans("4@31!05$7", "aaeiioost")

_ranks = {w: i for i, w in reversed(list(enumerate(COMMON_WORDS, 1)))}
_beside = {(a, b) for row in KEYBOARD_ROWS for a, b in zip(row, row[1:], strict=False)}
_beside |= {(b, a) for a, b in _beside}
_date = re.compile(r"(?:(\d{4})([-/._]?)(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/._]?)(\d{1,2})\6(\d{4}|\d{2}))")


def _word_guesses(part: str, words: Mapping[str, int] = MappingProxyType({})) -> float | None:
    """Guesses of a word of the fixed list or of words (lower case, with their ranks); None for what is none."""
    low = part.lower()
    plain = low.translate(LEET)
    rank = _ranks.get(low) or words.get(low)
    leet = 1.0
    if rank is None and plain != low and len(plain) == len(low):
        rank, leet = _ranks.get(plain) or words.get(plain), 2.0 ** sum(a != b for a, b in zip(low, plain, strict=True))
    if rank is None:
        return None
    upper = sum(c.isupper() for c in part)
    cases = 1.0 if not upper else 2.0 if upper in (1, len(part)) else float(math.comb(len(part), min(upper, len(part) - upper)))
    return rank * leet * cases


def _date_guesses(part: str) -> float | None:
    found = _date.fullmatch(part)
    if not found:
        return None
    y, m, d = (found[1], found[3], found[4]) if found[1] else (found[8], found[7], found[5])
    year = int(y) + (0 if len(y) == 4 else 2000 if int(y) <= YEAR % 100 else 1900)
    one, two = int(m), int(d)
    if not (1000 <= year <= 2100 and 1 <= one <= 31 and 1 <= two <= 31 and min(one, two) <= 12):
        return None
    return 365.0 * max(abs(year - YEAR), 20) * (4 if found[2] or found[6] else 1)


def _reaches(low: str) -> dict[str, list[int]]:
    """For each kind of run, how far one that begins at each position reaches; any part of a run is a run."""
    n = len(low)
    out = {}
    for kind in ("same", "walk", "step"):
        reach = [1] * n
        for i in range(n - 2, -1, -1):
            a, b = low[i], low[i + 1]
            step = ord(b) - ord(a)
            if kind == "same":
                goes = a == b
            elif kind == "walk":
                goes = (a, b) in _beside
            else:
                goes = abs(step) == 1
            if goes:
                on = kind != "step" or reach[i + 1] == 1 or ord(low[i + 2]) - ord(b) == step
                reach[i] = reach[i + 1] + 1 if on else 2
        out[kind] = reach
    return out


def _periods(value: str) -> dict[int, list[int]]:
    """For each length of a block, how far the text that begins at each position goes on repeating it."""
    codes = np.array([ord(c) for c in value], dtype=np.int32)
    out = {}
    for size in range(1, min(int(CERTAIN), len(value)) if len(value) > 1 else 0):
        same = codes[:-size] == codes[size:]
        here = np.arange(len(same), dtype=np.int32)
        ends = np.minimum.accumulate(np.where(same, len(same), here)[::-1])[::-1]
        out[size] = (ends - here).tolist()
    return out


def guess_cost(value: str, words: Mapping[str, int] = MappingProxyType({})) -> float:
    """log10 of the guesses that the cheapest segmentation of value needs, or ``CERTAIN`` if it needs more.

    A run, or a row of blocks, is not tried where an earlier start in the same one reaches every end at no
    higher cost, so a long one is tried few times.
    """
    n = len(value)
    brute = math.log10(BRUTE)
    runs = _reaches(value.lower())
    periods = _periods(value)
    begun: dict[str | int, int] = {}  # where the run of a kind, or the row of blocks of a length, began that goes through here
    best = np.full(n + 1, math.inf)
    best[0] = 0.0

    def one(end: int, cost: float) -> None:
        if cost < best[end]:
            best[end] = cost

    for i in range(n):
        for kind, far in (*runs.items(), *periods.items()):
            if i < len(far) and (not i or far[i - 1] != far[i] + 1):
                begun[kind] = i
        here = float(best[i])
        if here >= CERTAIN:
            continue
        one(i + 1, here + brute)
        for kind, far in runs.items():
            length, start = far[i], begun[kind]
            if length >= 3 and (start == i or best[start] + math.log10((3 + i - start) / 3) > here):
                ends = best[i + 3 : i + length + 1]
                np.minimum(ends, here + np.log10(20.0 * np.arange(3, length + 1)) + 0.3, out=ends)
        for length in range(3, min(WORD_LETTERS[1], n - i) + 1):
            guesses = _word_guesses(value[i : i + length], words)
            if guesses is not None:
                one(i + length, here + math.log10(guesses) + 0.3)
        if value[i].isdigit():
            for length in range(6, min(10, n - i) + 1):
                guesses = _date_guesses(value[i : i + length])
                if guesses is not None:
                    one(i + length, here + math.log10(guesses) + 0.3)
        for size, far in periods.items():  # a block that comes again and again
            if size < 2 or i >= len(far) or far[i] < size:
                continue
            # a block that itself repeats a shorter one is dearer than that
            if any(size % d == 0 and periods[d][i] >= size - d for d in range(1, size // 2 + 1)):
                continue
            before = (i - begun[size]) // size
            if not before or best[i - before * size] + math.log10((2 + before) / 2) > here:
                times = 1 + far[i] // size
                ends = best[i + 2 * size : i + times * size + 1 : size]
                np.minimum(ends, here + size * brute + np.log10(np.arange(2, times + 1)) + 0.3, out=ends)
    return min(float(best[n]), CERTAIN)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base spans, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST] if _long_hex.search(text) else []
    return sorted(found)


_long_hex = re.compile(r"[0-9a-f]{32}")


def credential_values(text: str, words: Mapping[str, int] = MappingProxyType({})) -> list[tuple[int, int, float]]:
    """(start, end, cost) of every value in credential context, in order."""
    spans = {m.span(1) for m in ASSIGN.finditer(text)}
    spans |= {m.span(1) for c in CONTEXTS for m in c.finditer(text)}
    return [(a, b, guess_cost(text[a:b], words)) for a, b in sorted(spans)]


def all_spans(
    text: str, base: list[tuple[int, int, int]], least: float = SECRET_GUESSES, words: Mapping[str, int] = MappingProxyType({})
) -> list[tuple[int, int, int]]:
    """The base spans and a guess span for each strong value that none of them holds."""
    return _with_guesses(base, credential_values(text, words), least)


def _with_guesses(base: list[tuple[int, int, int]], values: list[tuple[int, int, float]], least: float = SECRET_GUESSES) -> list[tuple[int, int, int]]:
    held = [(a, b) for a, _, b in base]
    more = [(a, 3, b) for a, b, cost in values if cost >= least and not any(x <= a and b <= y for x, y in held)]
    return sorted(base + more)


def _say(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def ranked_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word and rank of the words that most documents hold, at most ``WORDS``: the rank follows all words of more documents."""
    plain = F.col(text)
    for context in (ASSIGN, *CONTEXTS):  # a value in credential context makes no word
        plain = F.regexp_replace(plain, context.pattern.replace("(?a:", "(?:"), " ")
    outside = F.lower(F.when(F.col(text).rlike(HINT), plain).otherwise(F.col(text)))
    least, most = WORD_LETTERS
    words = F.array_distinct(F.split(outside, r"[^\p{L}]+"))
    found = docs.select(F.explode(F.filter(words, lambda w: F.length(w).between(least, most))).alias("word"))
    counted = table(found.groupBy("word").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= WORD_DOCS), "secret-words")
    # as many counts as there are different ones; words of one count enter together or not at all
    ranks, above = [], 0
    for r in counted.groupBy("docs").count().orderBy(F.desc("docs")).limit(WORDS).toLocalIterator():
        if above + r["count"] > WORDS:
            break
        ranks.append((r["docs"], len(COMMON_WORDS) + above + 1))
        above += r["count"]
    of_counts = docs.sparkSession.createDataFrame(ranks, "docs long, rank long")
    return counted.join(F.broadcast(of_counts), "docs").select("word", "rank")


def scan_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess and strongest (log10 guesses) of each row of docs.

    Texts without any context or pattern never leave the JVM's filter as text.
    """
    known = docs.sparkSession.sparkContext.broadcast({r["word"]: r["rank"] for r in ranked_words(docs, text).collect()})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for batch in batches:
            counts, hashes, said, strongest = [], [], [], []
            for t in batch.column("text").to_pylist():
                base = base_spans(t) if t else []
                values = credential_values(t, words) if t else []
                spans = _with_guesses(base, values)
                counts.append([sum(k == kind for _, k, _ in spans) for kind in range(4)])
                hashes.append(hashlib.sha256(_say(base).encode()).hexdigest())
                said.append(_say(spans))
                strongest.append(max((c for _, _, c in values), default=None))
            columns = list(zip(*counts, strict=True)) if counts else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, "int64") for c in columns), pa.array(hashes, pa.string()), pa.array(said, pa.string()), pa.array(strongest, "float64")],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "strongest"],
            )

    hinted = F.when(F.col(text).rlike(HINT), F.col(text))
    thin = docs.select(F.col(doc_id).cast("long").alias("doc_id"), hinted.alias("text"))
    out = thin.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, strongest double")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "strongest")
