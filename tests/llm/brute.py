"""Plain versions of the operators, straight from their contracts."""

import hashlib
import re
import zlib
from collections import defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = SPACE.findall((text or "").translate(ASCII_LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def classes(rows, n=4, percent=85):
    sets = [(i, shingles(t, n)) for i, t in rows]
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(sets[a][0]), find(sets[b][0])
                top[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def repeats(rows, window=20):
    """rows: (doc_id, text). The same, for rows whose ids may be null or shared: documents are (id, text), in order of id (null first) and order(text)."""
    return {k[0]: v for k, v in repeats_of_texts(rows, window, lambda t: 0).items()}


def repeats_of_texts(rows, window, order):
    """(doc_id, text) -> words, words removed, hash of what is left."""
    first, docs = {}, sorted((((i is not None, i or 0, order(t)), (i, t), SPACE.findall(t or "")) for i, t in set(rows)), key=lambda d: d[0])
    for at, _, w in docs:
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (at, s))
    out = {}
    for at, key, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (at, s):
                gone[s : s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[key] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def targets(sizes):
    """sizes: source -> words. Targets by sharing again and again what is above three times a source's size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, full = float(sum(sizes.values())), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return {s: float(3 * sizes[s]) if s in full else share[s] for s in names}
        full |= set(over)


def licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    places = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def distance_in(pattern, text):
    """Least edits of pattern to any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def crc(text):
    return zlib.crc32((text or "").encode())


def groups(pairs):
    out = defaultdict(set)
    for k, v in pairs:
        out[k].add(v)
    return out


def gif_samples(stream, bits, count):
    """Decoding of an LZW code stream bit by bit."""
    clear, end = 1 << bits, (1 << bits) + 1
    number, at = int.from_bytes(stream, "little"), 0
    table, width, previous, out = [], bits + 1, b"", b""
    while len(out) < count:
        code = number >> at & ((1 << width) - 1)
        at += width
        if code == clear:
            table, width, previous = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, b""
            continue
        if code == end:
            break
        entry = table[code] if code < len(table) else previous + previous[:1]
        if previous and len(table) < 4096:
            table.append(previous + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        out, previous = out + entry, entry
    return out[:count]


def notices(text, templates, k, share, neighbour):
    """(label, start, end, covered) of the places of the templates (label, phrase) in a text."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    out = []
    for label, phrase in templates:
        p = phrase.split()
        size = len(p) - k + 1
        diagonals = defaultdict(list)
        for i in range(len(w) - k + 1):
            for j in range(size):
                if w[i : i + k] == p[j : j + k]:
                    diagonals[i - j].append(j)
        places, last = [], None
        for d, js in sorted(diagonals.items(), key=lambda x: (x[0] + min(x[1]), x[0])):
            if last is None or min(js) <= last[1] or abs(d - last[0]) > neighbour:
                places.append([])
            places[-1] += [(d + j, j) for j in js]
            last = (d, max(js))
        for place in places:
            assert len({j for _, j in place}) == len(place) and [j for _, j in sorted(place)] == sorted(j for _, j in place)
            if len(place) >= share * size:
                out.append((label, min(place)[0], max(place)[0] + k, len(place)))
    return sorted(out)
