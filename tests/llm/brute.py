"""The operators' rules in plain loops, for tests."""

import math
from collections import defaultdict

import numpy as np

from tidemill.llm import quality_classifier, quality_rules


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def near_copies(texts, n, percent):
    """The sets of shingles, and for each text the first of its component."""
    sets = [shingles(t, n) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, components(len(sets), links)


def repeat_words(words):
    seen, hit = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {p + k for p in at for k in range(3)}
    return len(hit)


def measures(text):
    """n_words, n_lines, and the four ratios."""
    text = text or ""
    words, lines = text.encode().split(), [x for x in text.split("\n") if x.encode().split()]
    n, m = max(1, len(words)), max(1, len(lines))
    return len(words), m, [sum(text.count(c) for c in "#*$%&|<>") / n, (len(lines) - len(set(lines))) / m, repeat_words(words) / n, sum(len(w.decode()) for w in words) / n]


def limit(values, unit):
    """The middle of the first gap in a group's ladder."""
    v = sorted(values)
    steps = [v[max(0, math.ceil(q * len(v)) - 1)] for q in quality_rules.LADDER]
    quartile = steps[quality_rules.LADDER.index(0.75)] - steps[0]
    for low, high in zip(steps, steps[1:], strict=False):
        if high - low > quality_rules.GAP * max(low - steps[0], quartile, unit):
            return (low + high) / 2
    return math.inf


def rules(docs):
    """Positions of the (lang, source, text) that the quality rules keep."""
    told = [measures(t) for _, _, t in docs]
    sound = [n >= quality_rules.MIN_WORDS and 100 * r[2] <= quality_rules.MAX_REPEAT_PERCENT for n, _, r in told]
    groups = defaultdict(list)
    for k, (lang, source, _) in enumerate(docs):
        if sound[k]:
            for key in ((lang, source), (lang,), ()):
                groups[key].append(k)
    limits = {}
    for key, own in groups.items():
        middle = [sorted(told[k][x] for k in own)[math.ceil(len(own) / 2) - 1] for x in (0, 1)]
        chars = sorted(told[k][2][3] for k in own)[math.ceil(len(own) / 2) - 1]
        units = [1 / middle[0], 1 / middle[1], 1 / middle[0], chars / middle[0]]
        limits[key] = [limit([told[k][2][m] for k in own], units[m]) for m in range(4)]
    out = []
    for k, (lang, source, _) in enumerate(docs):
        if sound[k]:
            key = next(g for g in ((lang, source), (lang,), ()) if len(groups[g]) >= quality_rules.MIN_GROUP or not g)
            if all(a <= b for a, b in zip(told[k][2], limits[key], strict=True)):
                out.append(k)
    return out


def logistic(x):
    return 1 / (1 + math.exp(-x))


def posteriors(rows):
    """rows of (host, path, log odds per label): the probabilities of both labels under the hierarchy."""
    out = [[None, None] for _ in rows]
    for x in range(2):
        p = [logistic(r[2][x]) for r in rows]
        host, path = defaultdict(lambda: [0.0, 0]), defaultdict(lambda: [0.0, 0])
        for (h, s, _), q in zip(rows, p, strict=True):
            for d, key in ((host, h), (path, (h, s))):
                d[key][0] += q
                d[key][1] += 1
        world = sum(p) / len(p)

        def weight(sites, prior):
            chance = [prior(k) * (1 - prior(k)) for k in sites]
            spread = max(0.0, np.mean([(t / n - prior(k)) ** 2 for k, (t, n) in sites.items()]) - np.mean([c / n for c, (_, n) in zip(chance, sites.values(), strict=True)]))
            left = np.mean(chance) - spread
            return spread / left if left > 0 else 1.0

        def shrunk(total, n, prior, w):
            w = min(w, prior, 1 - prior)
            return (w * total + prior) / (w * n + 1)

        outer = weight(host, lambda k: world)
        m = {h: shrunk(t, n, world, outer) for h, (t, n) in host.items()}
        inner = weight(path, lambda k: m[k[0]])
        for i, (h, s, e) in enumerate(rows):
            total, n = path[h, s]
            rate = shrunk(max(0.0, total - p[i]), n - 1, m[h], inner)
            mixed = (1 - quality_classifier.MIXED) * rate + quality_classifier.MIXED * world
            out[i][x] = logistic(e[x] + math.log(mixed / (1 - mixed)) - math.log(world / (1 - world)))
    return out
