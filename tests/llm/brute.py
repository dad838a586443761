"""Plain Python versions of the operators' results."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

FOLD = {c: c + 32 for c in range(65, 91)}


def folded(text):
    return (text or "").translate(FOLD)


def shingle_sets(rows, words):
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", folded(text))
        out.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    return out


def components(rows, words, num, den):
    """For each row: set size, least doc_id reachable."""
    sets = shingle_sets(rows, words)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j, common in Counter(j for g in s for j in holders[g] if j < i).items():
            if den * common >= num * (len(s) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(len(s), least[find(i)] if s else rows[i][0]) for i, s in enumerate(sets)]


def hit_words(text, items, n=10):
    return _contamination(text, items, n)[1]


def contamination(text, items, n=10):
    """Words, hit words, items with hits."""
    words, hit, found = _contamination(text, items, n)
    return len(words), len(hit), sorted(found)


def _contamination(text, items, n):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(t))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        own = split(t)
        size = min(n, len(own))
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(str(item))
    return words, hit, found


SECRETS = (
    ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 1, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def secrets(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, group, least) in enumerate(SECRETS) for m in p.finditer(text or "") if len(m.group(group)) >= least]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def jaccard(a, b):
    x, y = (shingle_sets([(0, t)], 5)[0] for t in (a, b))
    return 1.0 if not x and not y else len(x & y) / len(x | y)


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _M
    return x ^ (x >> 31)


def sketch(text, k, words):
    """The k least 48-bit hashes of the distinct shingles, by plain integers."""
    def polynomial(values, base):
        out = 0
        for i, v in enumerate(values):
            out = (out + v * pow(base, i, 1 << 64)) & _M
        return out

    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", folded(text))]
    hashes = [mixed(polynomial((mixed((b + 1) * _BASE & _M) for b in x), _BASE)) for x in w]
    n = min(words, len(w))
    runs = {mixed((polynomial(reversed(hashes[i : i + n]), _BASE) + n) & _M) >> 16 for i in range(len(w) - n + 1)} if n else set()
    return sorted(runs)[:k]


def estimate(a, b, k):
    """Likeness by two sketches."""
    union = sorted(set(a) | set(b))[:k]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


class KneserNey:
    """Interpolated Kneser-Ney character models, with dictionaries of strings."""

    def __init__(self, samples, order):
        self.order, counts = order, defaultdict(Counter)
        for i, (name, text) in enumerate(samples):
            if i % 4 != 3:
                counts[name].update(self.words(text))
        for i, (name, text) in enumerate(samples):
            if i % 4 == 3 and not counts[name]:
                counts[name].update(self.words(text))
        self.names = sorted(x for x in counts if counts[x])
        self.symbols = len({c for x in self.names for w in counts[x] for c in w}) + 2
        self.tables = {x: self.fit(counts[x]) for x in self.names}

    @staticmethod
    def words(text):
        parts = re.split(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", text.decode("utf-8", "replace"))
        return [w for w in ("".join(c for c in x.lower() if c.isalpha()) for x in parts) if w]

    def grams(self, word, n):
        flat = "\x01" * (self.order - 1) + word + "\x02"
        return [flat[i - n + 1 : i + 1] for i in range(self.order - 1, len(flat))]

    def fit(self, words):
        out = {}
        for n in range(self.order, 0, -1):
            count = Counter()
            if n == self.order:
                for w, times in words.items():
                    for g in self.grams(w, n):
                        count[g] += times
            else:
                count.update(g[1:] for g in {g for w in words for g in self.grams(w, n + 1)})
            n1, n2 = sum(c == 1 for c in count.values()), sum(c == 2 for c in count.values())
            discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
            total, left = Counter(), defaultdict(float)
            for g, c in count.items():
                total[g[:-1]] += c
                left[g[:-1]] += min(c, discount)
            out[n] = {g: (c - discount) / total[g[:-1]] for g, c in count.items()}, {ctx: left[ctx] / t for ctx, t in total.items()}
        return out

    def probability(self, name, gram):
        """Of a gram's last character after the others."""
        p = 1 / self.symbols
        for n in range(1, self.order + 1):
            share, weight = self.tables[name][n]
            own = gram[len(gram) - n :]
            p = p * weight.get(own[:-1], 1.0) + share.get(own, 0.0)
        return p

    def bits(self, name, word):
        return sum(-math.log2(self.probability(name, g)) for g in self.grams(word, self.order))

    def best(self, text):
        """Language and bits a character of a text; None without letters."""
        words = Counter(self.words(text or b""))
        size = sum((len(w) + 1) * n for w, n in words.items())
        if not size:
            return None
        return min((sum(self.bits(x, w) * n for w, n in words.items()) / size, x) for x in self.names)[::-1]
