"""Plain versions of the operators for small inputs."""

import re
from collections import defaultdict

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def shingles(text, size):
    w = space_words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def jaccard_components(rows, size, percent):
    """{id: (set size, smallest id reachable)} of (id, text) rows."""
    sets = {i: shingles(t, size) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    lo, hi = sorted((find(a), find(b)))
                    top[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}


def windows(items, size=10):
    """{window: item ids}"""
    out = defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            out[tuple(w[i : i + size])].add(str(item))
    return out


def hits(text, wins):
    """(words, positions hit, items) of a text."""
    w = alnum_words(text)
    hit, items = set(), set()
    for n in {len(k) for k in wins}:
        for i in range(len(w) - n + 1):
            if (got := wins.get(tuple(w[i : i + n]))) is not None:
                hit.update(range(i, i + n))
                items |= got
    return len(w), hit, items


def drop_lines(rows, ratio, least):
    """Texts of (host, text) rows without their hosts' boilerplate lines."""
    pages, lines = defaultdict(int), defaultdict(int)
    for host, text in rows:
        pages[host] += 1
        for k in {x.strip(" \t\r") for x in (text or "").split("\n")} - {""}:
            lines[host, k] += 1
    bad = {k for k, n in lines.items() if n >= least and n > ratio * pages[k[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" \t\r")) not in bad) for h, t in rows]
