"""Small documents with every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def sentence(start, n, prefix="w"):
    return " ".join(f"{prefix}{i}" for i in range(start, start + n))


def odd_documents():
    """Nulls in every column, empty and long texts, repeated rows, copies, near copies and shared passages."""
    long = sentence(0, 3000, "long")
    shared = sentence(0, 60, "shared")
    base = sentence(0, 100, "base")
    near = base.replace("base50", "other50")
    far = " ".join(w if i % 3 else w + "x" for i, w in enumerate(base.split()))
    rows = [
        (1, base, "en", "a", 1),
        (2, near, "en", "a", 1),
        (3, far, "en", "b", 1),
        (4, base, "en", "b", 1),
        (5, "", "en", None, 0),
        (6, None, None, "a", None),
        (7, long, "en", "a", 1),
        (8, shared + " " + sentence(0, 40, "p"), "en", "c", 1),
        (9, sentence(0, 40, "q") + "\n" + shared, "en", "c", 1),
        (10, "one two three", "en", "c", 1),
        (11, "one two three", "en", "c", 1),
        (12, "Der " * 60, "de", "a", 1),
        (13, "line of words here\n" * 12 + sentence(0, 30, "z"), "en", "a", 1),
        (14, sentence(0, 30, "é") + " ñandú ÉTÉ", "fr", "d", 1),
        (None, base, "en", "a", 1),
        (None, "only here " + sentence(0, 30, "n"), "en", None, 1),
        (15, sentence(0, 30, "twin"), "en", "a", 1),
        (15, sentence(0, 30, "twin"), "en", "a", 1),
        (15, sentence(0, 30, "other"), "en", "a", 1),
        (16, " \t\n ", "en", "a", 1),
    ]
    return rows


def documents(spark, rows=None):
    """The documents as a frame, with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_documents() if rows is None else rows, DOC_SCHEMA)
    for name in ("key", "row", "words", "kept", "n_words", "host", "rid", "_id", "copy", "start", "span"):
        df = df.withColumn(name, F.lit(f"extra {name}"))
    return df


def rule_counts(text):
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(windows)
    covered = {p for i, x in enumerate(windows) if seen[x] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_lines": len(lines),
        "n_repeat_words": len(covered),
    }


def dedup_substrings(rows):
    """(doc_id, kept words) of each row."""
    least = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            if d is not None:
                least[g] = min(d, least.get(g, d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and least[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        out.append((d, len(w), [x for i, x in enumerate(w) if i not in gone]))
    return out


def shingle_set(text):
    w = words(text)
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def jaccard_classes(rows):
    """(links, class members) by position, comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    return links, [members[find(i)] for i in range(len(rows))]


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(docs, items):
    """(n_words, n_hit, item ids) of each document."""
    windows = defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    lengths = {len(x) for x in windows}
    out = []
    for _, t in docs:
        w = bench_words(t)
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                g = tuple(w[k : k + n])
                if g in windows:
                    hit.update(range(k, k + n))
                    found |= windows[g]
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out
