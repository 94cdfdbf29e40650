"""Plain, slow versions of what the contract queries return, for small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import defaultdict

LETTERS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return LETTERS.findall((text or "").translate(LOWER))


def near(rows, size=2, percent=80):
    def shingles(text):
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = {d: shingles(t) for d, t in rows}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def warc(rows):
    pay = {p: (h or "").encode() for p, h in rows}
    last = {}
    for p, b in pay.items():
        if len(b) >= 1000:
            last[b] = max(p, last.get(b, p))
    return {p: (len(b), hashlib.sha1(b).hexdigest(), "revisit" if last.get(b, p) != p else "response", last[b] if last.get(b, p) != p else None) for p, b in pay.items()}


def licenses(rows, phrases):
    out = {}
    for d, t in rows:
        w = words(t)
        at, labels = [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        out[d] = (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
    return out


def license_labels(rows, phrases, templates, cover=0.8):
    """labels and score, by trying every start of every template."""
    base, out = licenses(rows, phrases), {}
    for d, t in rows:
        w = words(t)
        labels, best = set(filter(None, base[d][4].split(","))), 1.0 if base[d][1] else 0.0
        for text, label, key in templates:
            t, p = text.split(), key.split()
            if not any(w[i : i + len(p)] == p for i in range(len(w))):
                continue
            agree = max(sum(w[s + k] == x for k, x in enumerate(t) if 0 <= s + k < len(w)) for s in range(1 - len(t), len(w)))
            if agree >= math.ceil(cover * len(t)):
                labels.add(label)
                best = max(best, agree / len(t))
        out[d] = (",".join(sorted(labels)), best)
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        heavy = sum(w[s] for s in open_)
        above = [s for s in open_ if left * w[s] / heavy > most * sizes[s]]
        if not above:
            return fixed | {s: left * w[s] / heavy for s in open_}
        for s in above:
            fixed[s] = most * sizes[s]
        left = share * sum(sizes.values()) - sum(fixed.values())


def contamination(docs, items, span=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(span, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    lengths = {len(k) for k in windows}
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= got
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


ASSIGN = re.compile(r"""((?:p|P)(?:a|A)(?:s|S)(?:s|S)(?:w|W)(?:o|O)(?:r|R)(?:d|D)|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(rows):
    out = {}
    for d, t in rows:
        t = t or ""
        found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        text = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
        out[d] = (*[sum(x[2] == k for x in found) for k in ("assign", "access", "hex")], hashlib.sha256(text.encode()).hexdigest())
    return out


def random_strings(n):
    for i in range(n):
        digest = hashlib.sha256(str(i).encode())
        text = base64.b64encode(digest.digest()).decode()
        yield text if i % 3 == 0 else digest.hexdigest() if i % 3 == 1 else text.upper().replace("=", "").replace("+", "7").replace("/", "9")


def identifiers(text):
    """Names of four words in a row in five forms, in turn."""
    words = re.findall("[A-Za-z]{3,}", text or "")
    for i in range(len(words) // 4):
        four = words[4 * i : 4 * i + 4]
        low = [w.lower() for w in four]
        mixed = "".join(w[0].upper() + w[1:] for w in low)
        yield ("_".join(four).upper(), "/".join(low), mixed, "-".join(low), "_".join([*low, str(i % 100)]))[i % 5]


def markov_model(rows, known, random_rows, ordinary, candidate):
    """Score of a token and its threshold, from labelled tokens; ``known`` are the values that the known forms find."""
    plain = [x for _, t in rows for x in re.findall(ordinary, t or "") if not re.search("[0-9a-f]{16,}|AKIA[A-Z0-9]{14,}", x)]
    plain += [x for _, t in rows for x in identifiers(t)]
    count, ends, n, held = [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)], [0, 0], [[], []]
    for k, tokens in ((1, [*known, *random_strings(random_rows)]), (0, plain)):
        for x in tokens:
            if zlib.crc32(x.encode()) % 5 == 0:
                if re.fullmatch(candidate, x):
                    held[k].append(x)
                continue
            for a, b in zip(x, x[1:], strict=False):
                count[k][a + b] += 1
                count[k][a] += 1
                ends[k][b] += 1
                n[k] += 1
    log = lambda k, a, b: math.log((count[k][a + b] + 8.0 * ((ends[k][b] + 0.5) / (n[k] + 64))) / (count[k][a] + 8.0))
    score = lambda x: sum(round(log(1, a, b) - log(0, a, b), 4) for a, b in zip(x, x[1:], strict=False)) / (len(x) - 1)
    steps = [[math.floor(score(x) * 20) for x in xs] for xs in held]
    cost = lambda t: sum(s < t for s in steps[1]) / len(steps[1]) + 10 * sum(s >= t for s in steps[0]) / len(steps[0])
    costs = {t: round(cost(t), 12) for t in range(-200, 202)}
    least = min(costs.values())
    best = [t for t in costs if costs[t] == least]
    return score, best[len(best) // 2] / 20


def markov_spans(rows, known, random_rows, ordinary, candidate):
    """Spans of the two models of transitions."""
    score, least = markov_model(rows, known, random_rows, ordinary, candidate)
    return {d: {m.span() for m in re.finditer(candidate, t or "") if score(m[0]) >= least} for d, t in rows}


def paragraph_links(rows, cut, size=5, percent=80):
    """Pairs of different paragraphs (as word tuples) of Jaccard similarity ``percent`` or more, found by their shingles."""
    sets = {tuple(w): {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for _, t in rows for _, _, w in cut(t or "") if len(w) >= size}
    posted = defaultdict(list)
    for w, s in sets.items():
        for x in s:
            posted[x].append(w)
    pairs = {(a, b) for held in posted.values() for i, a in enumerate(held) for b in held[i + 1 :]}
    return {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}


def neighbours(rows, k=20, every=20):
    ok = [(i, [float(x) for x in v]) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            near_ = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in ok if i != q)[:k]
            out[q] = [i for _, i in near_]
    return out
