"""Plain forms of the contracts, for small tables."""

import hashlib
import re

SPACE = r"[^ \t\n\x0b\x0c\r]+"


def words(text):
    return re.findall(SPACE, text or "")


def edge_rows():
    """(doc_id, text, lang, source) with NULLs, blanks, ties, repeated rows, very long texts and one very long word."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30000))
    base = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
    return [
        (1001, None, "en", "s1"), (1002, "", None, "s1"), (1003, " \t\n ", "en", None), (1004, "one two", "en", "s2"),
        (1005, "ONE two", "fr", "s2"), (1006, base, "en", "s1"), (1007, base, "en", "s1"), (1007, base, "en", "s1"),
        (1008, base.upper(), "en", "s1"), (1009, base + " tail", "xx", "s3"), (1010, long, "en", "s3"), (1011, long + " end", "en", "s3"),
        (1012, "x" * 200000, "en", "s1"), (1013, "line a\nline b\nline a\n\nline b", "en", "s1"), (1014, "ünïcode 🙂 wörds " * 30, "de", "s4"), (None, base, "en", "s1"),
    ]


def component_map(sets, percent=85):
    """Smallest reachable id of each id, by comparing all pairs."""
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def without_repeats(docs, window=13):
    """doc_id -> (words, removed, digest) for a dict of texts."""
    first, out = {}, {}
    for k in sorted(docs):
        w = words(docs[k])
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first.setdefault(tuple(w[i:i + window]), k) < k:
                gone[i:i + window] = [True] * window
        out[k] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def figures(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def edits(item, text):
    """Least edit distance of item to any run of text."""
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (a != b)))
        before = now
    return min(before)
