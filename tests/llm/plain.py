"""Plain single-process versions of what the operators compute, for small inputs."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: doc_id, text, lang, source: nulls, empty and very long texts, ties, repeated rows.
ODD = [
    (1, "one two three four five six seven eight nine ten\n" * 3, "en", "a"),
    (2, None, None, None),
    (None, "a text without an id, which is null here and there, but has words enough to count", "en", "a"),
    (3, "", "en", None),
    (3, "", "en", None),
    (4, "only", "de", "b"),
    (5, "only", "de", "b"),
    (5, "only", "de", "b"),
    (None, None, "fr", "b"),
    (6, "Straße naïve   wide　space <|endoftext|> don't\x00stop \U0001f389!", "de", ""),
    (7, "lorem ipsum dolor " * 40_000, "la", "b"),
    (-8, "x" * 300_000, "la", "a"),
    (9, " \t\n\x0b\x0c\r ", "en", "a"),
]
NAMES = ["doc_id", "text", "lang", "source"]
#: Names that operators use themselves, and one that differs in case only.
CLASHES = ["TEXT", "kept", "n_words", "_row", "size", "sequence_id", "_x0", "distance"]


def odd_documents(spark, rows=ODD):
    kind = "doc_id long, text string, lang string, source string, " + ", ".join(f"c{i} string" for i in range(len(CLASHES)))
    made = spark.createDataFrame([(*r, *["clash"] * len(CLASHES)) for r in rows], kind)
    return made.toDF(*NAMES, *CLASHES)


def result(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def shingles(text):
    words = WORD.findall((text or "").translate(SMALL))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(documents):
    """Smallest id reachable from each (id, text), by comparing all pairs."""
    sets = [shingles(t) for _, t in documents]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(documents):
        least[root(i)].append(doc)
    smallest = {r: min((x for x in ids if x is not None), default=None) for r, ids in least.items()}
    return [(doc, len(sets[i]), smallest[root(i)] if sets[i] else doc) for i, (doc, _) in enumerate(documents)]


def without_repeats(documents, length=50):
    """Bytes of each (id, text) with which of them go."""
    last = float("inf")
    texts = [((last if i is None else i), (t or "").encode()) for i, t in documents]
    first = {}
    for i, b in texts:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(i, first.get(w, last))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        out.append((b, gone))
    return out


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            repeated.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def check_packing(pieces, capacity):
    """(sequence, offset, length) of all pieces: no gap, no overlap, none too full. Number of sequences."""
    by = defaultdict(list)
    for sequence, offset, length in pieces:
        by[sequence].append((offset, length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def runs(words):
    """(start, length, period) of every maximal periodic stretch, by comparing each word with that of each period before."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            begin = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - begin >= max(12, 2 * q):
                found.setdefault((begin, i + q - begin), q)
            i += 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, found):
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in dropped]


def periodic(doc_id, text):
    """The words of a text with the query's planted period."""
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


FOLLOW = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, audit, repaired rows) of rows (role, text, fault), by trying every edit from the end on."""
    nothing = (float("inf"), "", ())
    best = {s: (0, "", ()) if s in ("", "a") else nothing for s in ("", "s", "u", "a")}

    def with_inserts(base):
        for _ in range(3):
            for s in base:
                new = "a" if s == "u" else "u"
                cost, audit, kept = base[new]
                base[s] = min(base[s], (cost + 3, "I" + audit, ((("assistant" if s == "u" else "user"), ""), *kept)))
        return base

    best = with_inserts(best)
    for role, text, fault in reversed(rows):
        now = {}
        for s in best:
            cost, audit, kept = best[s]
            ways = [(cost + 4, "D" + audit, kept)]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if (s, role[:1]) in FOLLOW:
                    cost, audit, kept = best[FOLLOW[s, role[:1]]]
                    ways.append((cost + extra, "K" + audit, ((role, text), *kept)))
                cost, audit, kept = best["a" if s == "u" else "u"]
                ways.append((cost + extra + 3, "R" + audit, ((("assistant" if s == "u" else "user"), text), *kept)))
            now[s] = min(ways)
        best = with_inserts(now)
    return best[""]


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of rows (turn, role, text) in any order."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, judged = set(), []
    for _, role, text in rows:
        kept = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else ""
        seen.add((role, text))
        judged.append((role, text, fault))
    turns = {t for t, *_ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, kept = cheapest(judged)
    faults = Counter(f for *_, f in judged)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, [f"{r}:{t}" for r, t in kept]


def damage(rows):
    """Rows (conv_id, turn, role, text) after the query's damage."""
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out
