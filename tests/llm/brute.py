"""Plain Python versions of what the operators compute, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def crc(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def base_scores(docs):
    """doc_id -> (n_tokens, n_known, N, base score)."""
    tokens = {i: [*SPACE.findall(fold(t)), None] for i, t in docs}
    counts = Counter(w for i, ws in tokens.items() if crc(i, 10) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {
        i: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        for i, ws in tokens.items()
    }


def _luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    t = text or ""
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


def span_digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def shingles(text, size=5):
    ws = SPACE.findall(text or "")
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1)))


def groups(docs):
    """(doc_id, text) -> rows (doc_id, class_id, n_copies, n_links), from all pairs of different sets of shingles that
    share one."""
    sets = [(i, shingles(t)) for i, t in docs]
    members = defaultdict(list)
    for i, s in sets:
        if s:
            members[s].append(i)
    classes = list(members)
    by = defaultdict(set)
    for k, s in enumerate(classes):
        for x in s:
            by[x].add(k)
    parent = list(range(len(classes)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = Counter()
    for k, s in enumerate(classes):
        common = Counter(j for x in s for j in by[x] if j > k)
        for j, n in common.items():
            if 5 * n >= 4 * (len(s) + len(classes[j]) - n):
                links[k] += 1
                links[j] += 1
                a, b = find(k), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for k, s in enumerate(classes):
        least[find(k)] = min([least[find(k)], *members[s]]) if find(k) in least else min(members[s])
    number = {s: k for k, s in enumerate(classes)}
    return sorted(
        (i, i, 1, 0) if not s else (i, least[find(number[s])], len(members[s]), links[number[s]]) for i, s in sets
    )


def contamination(docs, items, window=13):
    """doc_id -> (n_words, n_hit, item ids)."""
    windows = defaultdict(set)
    for name, text in items:
        ws = ALNUM.findall(fold(text))
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            windows[tuple(ws[i : i + n])].add(str(name))
    sizes = {len(w) for w in windows}
    out = {}
    for doc_id, text in docs:
        ws = ALNUM.findall(fold(text))
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    names |= windows[tuple(ws[i : i + n])]
        out[doc_id] = (len(ws), len(hit), sorted(names))
    return out


def boilerplate_out(docs, min_sites=8, min_words=3):
    """(doc_id, source, text) rows -> doc_id -> (text, n_removed)."""
    sites, first = defaultdict(set), {}
    for i, source, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            if len(SPACE.findall(line)) >= min_words:
                sites[line].add(source)
                first[line] = min(first.get(line, (i, k)), (i, k))
    bad = {x for x, s in sites.items() if len(s) >= min_sites}
    out = {}
    for i, _, text in docs:
        if text is None:
            out[i] = (None, 0)
            continue
        lines = text.split("\n")
        kept = [x for k, x in enumerate(lines) if x not in bad or first[x] == (i, k)]
        out[i] = ("\n".join(kept), len(lines) - len(kept))
    return out


def rake(cells, targets, sweeps=200):
    """cells: {key tuple: tokens}; targets: per place of the key {value: weight}. Weights of the cells."""
    total = sum(cells.values())
    w = {k: v / total for k, v in cells.items()}
    scaled = []
    for d, t in enumerate(targets):
        here = {v: t.get(v, 0.0) for v in {k[d] for k in cells}}
        scaled.append({v: x / sum(here.values()) for v, x in here.items()})
    for _ in range(sweeps):
        for d, t in enumerate(scaled):
            sums = Counter()
            for k, x in w.items():
                sums[k[d]] += x
            w = {k: x * t[k[d]] / sums[k[d]] if sums[k[d]] else 0.0 for k, x in w.items()}
    return w


class Mixer:
    """The language model in plain Python: counts of bits per context and node over `texts`, mixed by given weights."""

    def __init__(self, texts, code, weights):
        self.code, self.weights = code, weights
        self.counts = defaultdict(lambda: [0, 0])
        for t in texts:
            data = fold(t).encode() + b"\xff"
            for i, b in enumerate(data):
                for context in self.contexts(data, i):
                    for node, bit in self.path(b):
                        self.counts[context, node][bit] += 1

    @staticmethod
    def contexts(data, i):
        start = i
        while start and (chr(data[start - 1]) in "0123456789abcdefghijklmnopqrstuvwxyz" or 0x80 <= data[start - 1] <= 0xFE):
            start -= 1
        return (0, data[max(0, i - 3) : i]), (1, data[max(0, i - 5) : i]), (2, data[start:i])

    def path(self, b):
        places = range(self.code.first[b], self.code.first[b] + self.code.size[b])
        return [(int(self.code.node[j]), int(self.code.bit[j])) for j in places]

    def margins(self, data, i, b):
        """Per bit of byte `b` at place `i` the log odds of the bit."""
        for node, bit in self.path(b):
            z = 0.0
            for k, context in enumerate(self.contexts(data, i)):
                zeros, ones = self.counts.get((context, node), (0, 0))
                odds = max(-127, min(127, round(16 * math.log((ones + 0.4) / (zeros + 0.4)))))
                z += self.weights[k][node] * odds
            yield z if bit else -z

    def bits(self, text, stretch):
        data = fold(text).encode() + b"\xff"
        total, gain, power = 0.0, 1.0, 50.0
        for low in range(0, len(data), stretch):
            pull = 0.0
            for i in range(low, min(low + stretch, len(data))):
                for z in self.margins(data, i, data[i]):
                    margin = max(-16.0, min(16.0, z * gain))
                    total += math.log2(1 + math.exp(-margin))
                    pull += z / (1 + math.exp(margin))
                    power += z * z
            gain += pull / power
        return total
