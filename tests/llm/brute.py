"""Plain versions of the operators, over lists of (doc_id, text), without Spark."""

import re
from collections import Counter, defaultdict

import xxhash


class Union:
    def __init__(self):
        self.up = {}

    def find(self, a):
        self.up.setdefault(a, a)
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(rows):
    """{doc_id: (fingerprint, component)} at 4 bits."""
    f = {i: fingerprint(t) for i, t in rows}
    union = Union()
    ids = sorted(f)
    for a in ids:
        for b in ids:
            if a < b and (f[a] ^ f[b]).bit_count() <= 4:
                union.join(a, b)
    return {i: (f[i], union.find(i)) for i in ids}


def line_set(line):
    """Shingles of eight characters, one from every character on; a shorter line is one."""
    line = line.lower()
    return {line[i : i + 8] for i in range(len(line) - 7)} or {line}


def alike_lines(names, least=0.8):
    """All pairs of different lines with a Jaccard index of `least` or more, through an inverted index of all shingles."""
    sets, having, out = [line_set(n) for n in names], defaultdict(list), set()
    for k, s in enumerate(sets):
        common = Counter(j for x in s for j in having[x])
        out |= {(j, k) for j, both in common.items() if both >= least * (len(s) + len(sets[j]) - both)}
        for x in s:
            having[x].append(k)
    return out


def line_dedup(rows, least=0.8):
    """{doc_id: (text, lost)}."""
    places = [(i, k, line.strip(" ")) for i, t in sorted(rows) if t is not None for k, line in enumerate(t.split("\n")) if line.strip(" \t\n\x0b\x0c\r")]
    names = sorted({line for _, _, line in places})
    union = Union()
    for a, b in alike_lines(names, least):
        union.join(names[a], names[b])
    seen, gone = set(), set()
    for i, k, line in places:
        root = union.find(line)
        if root in seen:
            gone.add((i, k))
        seen.add(root)
    out = {}
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = [line for k, line in enumerate(lines) if (i, k) not in gone]
        out[i] = (None if t is None else "\n".join(kept), len(lines) - len(kept))
    return out


def leaks(rows, items):
    """{(doc_id, item_id)}: texts of which some passage, a little longer than the longest item, holds 0.8 of an item's five-word shingles
    and 0.2 of those of its question and of its answer, the last sentence."""
    words_of = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, n=5: [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    known = []
    for item_id, text in items:
        words = words_of(text)
        if words:
            sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if words_of(s)]
            split = len(words) - len(words_of(sentences[-1])) if len(sentences) > 1 else 0
            g = grams(words)
            known.append((item_id, len(words), set(g), set(g[:split]), {x for k, x in enumerate(g) if k + 5 > split}))
    longest = max([32, *(n for _, n, *_ in known)])
    width, out = longest + max(4, longest // 8), set()
    for i, t in rows:
        words = words_of(t)
        for item_id, n, *sets in known:
            at = [[g in s for g in grams(words, min(5, n))] for s in sets]
            if sum(at[0]) < 0.8 * len(sets[0]):
                continue
            all_ = grams(words, min(5, n))
            for a in range(max(1, len(words) - width + 1)):
                have = set(all_[a : a + width - min(5, n) + 1])
                share = [len(s & have) / len(s) if s else 1.0 for s in sets]
                if share[0] >= 0.8 and min(share) >= 0.2:
                    out.add((i, item_id))
                    break
    return out


def rake(names, tokens, targets, budget, rounds=3000, alpha=0.5):
    """({cell: factor}, {cell: probability}) of cells by plain raking; targets: for each dimension shares by level, or None for tempered ones."""
    total = sum(tokens)
    weight = dict(zip(names, (t / total for t in tokens), strict=True))
    own = dict(weight)
    goals = []
    for d, wanted in enumerate(targets):
        now = Counter()
        for c, w in own.items():
            now[c[d]] += w
        if wanted:
            known = {k: wanted[k] for k in now if k in wanted}
            rest = {k: v for k, v in now.items() if k not in wanted}
            left = max(0.0, 1 - sum(known.values())) if rest else 0.0
            goal = known | {k: left * v / sum(rest.values()) for k, v in rest.items()}
        else:
            goal = {k: v**alpha for k, v in now.items()}
        goals.append({k: v / sum(goal.values()) for k, v in goal.items()})
    for _ in range(rounds):
        for d, goal in enumerate(goals):
            now = Counter()
            for c, w in weight.items():
                now[c[d]] += w
            weight = {c: w * goal[c[d]] / now[c[d]] if now[c[d]] else 0.0 for c, w in weight.items()}
    factor = {c: weight[c] / own[c] for c in weight}
    low, high = 0.0, 1 / min(f for f in factor.values() if f > 0)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(own[c] * min(1, mid * f) for c, f in factor.items()) < budget else (low, mid)
    return factor, {c: min(1, high * f) for c, f in factor.items()}
