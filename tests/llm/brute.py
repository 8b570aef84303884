"""Plain versions of the operators, for small inputs."""

import collections
import math
import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, n=5):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def classes(sets, p=4, q=5):
    """(root per item, links per item) of all pairs with a similarity of p / q or more."""
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = collections.Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and q * len(a & b) >= p * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))], links


def near_copies(rows):
    """{doc_id: (class_id, n_links)} of rows (doc_id, text) with distinct ids."""
    texts = list(dict.fromkeys((t or "").lower() for _, t in rows))
    root, links = classes([shingles(t) for t in texts])
    at = {t: i for i, t in enumerate(texts)}
    ids = collections.defaultdict(list)
    for d, t in rows:
        if WORD.search(t or ""):
            ids[root[at[(t or "").lower()]]].append(d)
    return {d: (min(ids[root[at[t.lower()]]]), links[at[t.lower()]]) if WORD.search(t or "") else (d, 0)
            for d, t in ((d, t or "") for d, t in rows)}


def repeated_words(words, n=3):
    seen = collections.Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    inside = set()
    for i in range(len(words) - n + 1):
        if seen[tuple(words[i:i + n])] > 1:
            inside.update(range(i, i + n))
    return len(inside)


def quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    repeat = repeated_words(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            repeat, len(words) < 50 or 100 * repeat > 50 * len(words))


def apportion(votes, seats):
    """Sainte-Lague by the highest quotient, one seat at a time."""
    won = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def targets(sizes, weights=(3, 1, 2), share=1.5, repeat=2):
    """Targets of sources in order, by sharing the excess again until none is above."""
    total, n = share * sum(sizes), len(sizes)
    w = [weights[i % len(weights)] for i in range(n)]
    full = set()
    while True:
        left = total - sum(repeat * sizes[i] for i in full)
        rest = sum(w[i] for i in range(n) if i not in full)
        t = [repeat * sizes[i] if i in full else left * w[i] / rest for i in range(n)]
        over = {i for i in range(n) if i not in full and t[i] > repeat * sizes[i]}
        if not over:
            return t
        full |= over


def style_tree(pages, decay=0.9):
    """{path: (importance, uses)} of one host's merged tree, from its definition.

    Pages are nested (signature, [texts], [children]); a path is the signatures from the top.
    """
    shapes, contents, paths = collections.defaultdict(list), collections.defaultdict(list), set()

    def visit(page, node, above):
        path = (*above, node[0])
        paths.add(path)
        if node[2]:
            shapes[path].append(tuple((*path, c[0]) for c in node[2]))
        contents[path] += [(t, page) for t in node[1]]
        for c in node[2]:
            visit(page, c, path)

    for i, top in enumerate(pages):
        visit(i, top, ())

    def entropy(values):
        n = collections.Counter(values)
        total = sum(n.values())
        return -sum(k / total * math.log(k / total) for k in n.values())

    own, uses = {}, {}
    for path in paths:
        texts = {t for t, _ in contents[path]}
        held = len(set(contents[path]))  # (text, page) pairs
        if texts:
            mean = sum(entropy([p for u, p in contents[path] if u == t]) for t in texts) / len(texts)
            own[path] = 1 - mean / math.log(held) if held > 1 else 1.0
        elif shapes[path]:
            n = len(shapes[path])
            own[path] = entropy(shapes[path]) / math.log(n) if n > 1 else 1.0
        uses[path] = max(len(shapes[path]), held)
    out = {}
    for path in own:
        below = [(q, decay ** (len(q) - len(path))) for q in own if q[:len(path)] == path]
        out[path] = (sum(w * own[q] for q, w in below) / sum(w for _, w in below), uses[path])
    return out
