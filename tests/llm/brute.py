"""Plain definitions of the contracts, one text or one small table at a time."""

import hashlib
import re
from collections import defaultdict

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def phrase_pieces(text):
    """Words of each piece between the marks that end a phrase."""
    return [re.findall("[^\x20\x09]+", x) for x in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD))]


def op1(text):
    text = text or ""
    spans = []
    for kind, pattern, least, group in (
        ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
        ("access", r"AKIA[A-Z0-9]+", 20, 0),
        ("hex", r"[0-9a-f]+", 24, 0),
    ):
        spans += [(m.start(), ("assign", "access", "hex").index(kind), m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)]


def op5(rows):
    """rows: (doc_id, text) -> doc_id: (n_lines, n_dropped, sha)"""
    key = lambda x: x.strip(BLANK).translate(FOLD)
    owner = {}
    for i, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 10:
                owner[key(x)] = min(i, owner.get(key(x), i))
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if owner.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def op8(text):
    w = ALNUM.findall((text or "").translate(FOLD))
    places = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def op9(rows, width=13):
    """rows: (doc_id, text) -> doc_id: (n_words, n_removed, sha)"""
    first = {}
    split = {i: WHITE.findall(text or "") for i, text in rows}
    for i, w in split.items():
        for j in range(len(w) - width + 1):
            k = tuple(w[j : j + width])
            first[k] = min(i, first.get(k, i))
    out = {}
    for i, w in split.items():
        gone = set()
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < i:
                gone.update(range(j, j + width))
        out[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def shingle_set(text, n):
    w = WHITE.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def op10(rows, n=4, num=85):
    """rows: (doc_id, text) -> doc_id: (n_shingles, component)"""
    sets = {i: shingle_set(t, n) for i, t in rows}
    classes = defaultdict(list)
    for i, s in sets.items():
        classes[frozenset(s)].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    for s, ids in classes.items():
        if s:
            for i in ids[1:]:
                link(ids[0], i)
    reps = [(s, min(ids)) for s, ids in classes.items() if s]
    holds = defaultdict(list)
    for k, (s, _) in enumerate(reps):
        for x in s:
            holds[x].append(k)
    for k, (s, i) in enumerate(reps):
        shared = defaultdict(int)
        for x in s:
            for other in holds[x]:
                if other > k:
                    shared[other] += 1
        for other, both in shared.items():
            if 100 * both >= num * (len(s) + len(reps[other][0]) - both):
                link(i, reps[other][1])
    return {i: (len(sets[i]), find(i)) for i in sets}
