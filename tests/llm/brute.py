"""Plain, slow versions of the operators."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def similar(sets, threshold=0.8):
    """Pairs of keys whose sets have that Jaccard similarity; two empty sets are equal."""
    where = defaultdict(list)
    for k, s in sets.items():
        for x in s or {None}:
            where[x].append(k)
    both = Counter((b, a) for ks in where.values() for i, a in enumerate(ks) for b in ks[:i])
    return [(a, b) for (a, b), n in both.items() if (n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9 if sets[a] or sets[b] else True)]


def repeats(docs, k=13):
    """doc_id -> (words, removed, digest, kept words)."""
    least = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = words(t)
        for a in range(len(w) - k + 1):
            least.setdefault(tuple(w[a : a + k]), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = set()
        for a in range(len(w) - k + 1):
            if least[tuple(w[a : a + k])] < i:
                gone |= set(range(a, a + k))
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def base_counts(text):
    w = words(text)
    seen = Counter(tuple(w[a : a + 8]) for a in range(len(w) - 7))
    covered = {j for a in range(len(w) - 7) if seen[tuple(w[a : a + 8])] > 1 for j in range(a, a + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def quality(docs, min_docs=20, max_share=0.1, min_words=20, min_kept=0.5):
    """docs (id, text, host) -> [(id, kept, text without boilerplate lines)]; documents are counted by id."""
    norm = lambda x: " ".join(words(x.lower()))
    on_host, holders = defaultdict(set), defaultdict(set)
    for i, t, h in docs:
        on_host[h].add(i)
        for x in t.split("\n"):
            holders[h, norm(x)].add(i)
    boiler = {(h, x) for (h, x), ids in holders.items() if x and len(ids) > max(min_docs, max_share * len(on_host[h]))}
    out = []
    for i, t, h in docs:
        n, *_, failed = base_counts(t)
        gone = [(h, norm(x)) in boiler for x in t.split("\n")]
        left = n - sum(len(words(x)) for x, g in zip(t.split("\n"), gone, strict=True) if g)
        kept = not failed and left >= min_words and left >= min_kept * n
        out.append((i, kept, "\n".join(x for x, g in zip(t.split("\n"), gone, strict=True) if not g)))
    return out


def line_classes(docs, k=8, threshold=0.8):
    """docs (id, text) -> {(id, line): (id, line) that stays}; ids must differ. A line shorter than a shingle is one of its own."""
    found = defaultdict(list)
    for i, t in docs:
        for j, x in enumerate((t or "").split("\n")):
            if x := " ".join(words(x)):
                found[x].append((i, j))
    sets = {x: {x[a : a + k] for a in range(max(1, len(x) - k + 1))} for x in found}
    u = Union()
    for a, b in similar(sets, threshold):
        u.join(a, b)
    first = {}
    for x, places in found.items():
        r = u.find(x)
        first[r] = min([*places, *([first[r]] if r in first else [])])
    return {p: first[u.find(x)] for x, places in found.items() for p in places}


def drop_lines(docs, **how):
    stays = line_classes(docs, **how)
    out = []
    for i, t in docs:
        lines = t.split("\n")
        left = [x for j, x in enumerate(lines) if stays.get((i, j), (i, j)) == (i, j)]
        if len(left) == len(lines) or "".join(left).strip():
            out.append((i, "\n".join(left)))
    return out


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def near(docs, threshold=0.8):
    """[(class id, links)] for docs (id, text); rows are told apart by place."""
    sets = {(i, k): shingles(t) for k, (i, t) in enumerate(docs)}
    u, links = Union(), Counter()
    for a, b in similar(sets, threshold):
        u.join(a, b)
        links[a] += 1
        links[b] += 1
    return [(i, u.find((i, k))[0], links[i, k]) for k, (i, _) in enumerate(docs)]


def edit_end(pattern, text):
    """Least edit distance of the pattern to a substring of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, p in enumerate(pattern, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best
