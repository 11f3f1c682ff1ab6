"""Plain, single-process versions of the pipeline's stages."""
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def norm(line):
    return re.sub("[0-9]+", "0", " ".join(WORD.findall(line)).lower())


def line_counts(docs):
    held, hosts, seen = Counter(), Counter(), set()
    for _, text, _, source, _ in docs:
        if (source, text) in seen:
            continue
        seen.add((source, text))
        hosts[source] += 1
        for x in {norm(x) for x in (text or "").split("\n") if WORD.search(x)}:
            held[source, x] += 1
    return held, hosts


def plain_quality(doc, docs, cache={}):  # noqa: B006
    if id(docs) not in cache:
        cache[id(docs)] = line_counts(docs)
    held, hosts = cache[id(docs)]
    _, text, _, source, _ = doc
    w = WORD.findall(text or "")
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    if len(w) < 20 or 100 * len(covered) > 30 * len(w):
        return False
    gone = sum(len(WORD.findall(x)) for x in text.split("\n") if WORD.search(x) and held[source, norm(x)] >= 25 and (held[source, norm(x)] > 0.05 * hosts[source] or held[source, norm(x)] >= 1000))
    return len(w) - gone >= 20 and len(w) - gone >= 0.3 * len(w)


def plain_lines(docs):
    seen, out = set(), []
    for d in sorted(docs, key=lambda d: d[0]):
        lines, gone = d[1].split("\n"), set()
        for p in range(len(lines) - 2):
            k = tuple(x.strip(" \t\n\x0b\f\r") for x in lines[p:p + 3])
            if "".join(k):
                if k in seen:
                    gone.update((p, p + 1, p + 2))
                seen.add(k)
        out.append((d[0], "\n".join(x for j, x in enumerate(lines) if j not in gone), *d[2:]))
    return out


def plain_simhash_keep(docs):
    prints = []
    for d in docs:
        w = WORD.findall(lower(d[1]))
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    best = {}
    for i, d in enumerate(docs):
        best[find(i)] = min(d[0], best.get(find(i), d[0]))
    return [d for i, d in enumerate(docs) if best[find(i)] == d[0]]


def plain_contaminated(text, bench, window=13):
    w, hit = ITEM_WORD.findall(lower(text)), set()
    for _, t in bench:
        v = ITEM_WORD.findall(lower(t))
        size = min(window, len(v))
        wins = {tuple(v[i:i + size]) for i in range(len(v) - size + 1)} if v else set()
        for p in range(len(w) - size + 1):
            if size and tuple(w[p:p + size]) in wins:
                hit.update(range(p, p + size))
    return bool(hit) and 20 * len(hit) >= len(w)
