"""The operators' definitions, word by word, for small tables."""

from __future__ import annotations

import re
from functools import cache
import unicodedata
from collections import Counter, defaultdict
from itertools import combinations

from harfgah.functions.fold import fold, normalize
from harfgah.llm.oracles import TO_LATIN
from harfgah.llm.text import INVISIBLE


def plain(text):
    s = "".join(c for c in text or "" if c not in INVISIBLE)
    return "".join(TO_LATIN.get(c, c) for c in unicodedata.normalize("NFKC", s))


@cache
def words(text):
    return re.findall(r"[^\W_]+", fold(plain(text)) or "")


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def near(e, t):
    if not e or not t:
        return False
    return "".join(e) == "".join(t) or (len(e) >= 5 and 4 * common(e, t) >= 3 * max(len(e), len(t)))


def overlaps(evals, corpus):
    """evals: (id, text, text); corpus: (id, text, text)."""
    return {(e[0], t[0]) for e in evals for t in corpus if near(words(e[1]), words(t[1])) or near(words(e[2]), words(t[2]))}


def leaks(evals, corpus):
    runs = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    return {(e[0], t[0]) for e in evals for t in corpus if (runs(words(e[1])) | runs(words(e[2]))) & (runs(words(t[1])) | runs(words(t[2])))}


def copies(records):
    groups = defaultdict(list)
    for key, a, b in records:
        k = ("".join(words(a)), "".join(words(b)))
        if k != ("", ""):
            groups[k].append(key)
    return {(min(g), x) for g in groups.values() for x in g if x != min(g)}, {min(g): len(g) for g in groups.values()}


def terms(texts):
    occurrences, records = Counter(), Counter()
    for t in texts:
        occurrences.update(words(t))
        records.update(set(words(t)))
    return {w: (n, records[w]) for w, n in occurrences.items()}


def look(text):
    return " ".join(normalize(plain(text)).split())


def lookalikes(rows):
    groups = defaultdict(list)
    for key, t in rows:
        if t is not None and look(t):
            groups[look(t)].append((key, t))
    return {tuple(sorted((a[0], b[0]))) for g in groups.values() for a, b in combinations(g, 2) if a[1] != b[1]}


def repeated(text, k):
    ws = words(text)
    seen, inside = set(), [False] * len(ws)
    for i in range(len(ws) - k + 1):
        run = tuple(ws[i : i + k])
        if run in seen:
            inside[i : i + k] = [True] * k
        seen.add(run)
    return len(ws), sum(inside)
