"""A plain calculator of the similarity and authorship formulas, a step at a time, to test against."""

import math
from collections import Counter

M = 0xFFFFFFFF


def fnv(word, start=2166136261):
    for b in word.encode():
        start = (start ^ b) * 16777619 & M
    return start


def token_hash(word, seed):
    h = fnv(word, 2166136261 ^ seed)
    h ^= seed * 0x9E3779B9 & M
    h ^= h >> 16
    h = h * 0x85EBCA6B & M
    return h ^ h >> 13


def signature(tokens):
    width = min(3, len(tokens))
    if not width:
        return [0] * 100
    out = []
    for k in range(100):
        seed = 0x9E3779B9 + k * 0x85EBCA6B & M
        values = []
        for s in range(len(tokens) - width + 1):
            h = 2166136261 ^ seed
            for i in range(width):
                h = (h ^ token_hash(tokens[s + i], seed + 17 * i & M)) * 16777619 & M
            h ^= h >> 15
            values.append(h or 1)
        out.append(min(values))
    return out


def band_key(values, band):
    h = 2166136261 ^ band
    for v in values:
        h ^= v + 0x9E3779B9 + (h << 6 & M) + (h >> 2) & M
    return h


def prints(tokens):
    out = set()
    for s in range(len(tokens) - 4):
        h = 0
        for t in tokens[s : s + 5]:
            h = h * 16777619 + (fnv(t) or 1) & M
        out.add(h or 1)
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def weights(documents):
    n = len(documents)
    df = Counter(t for d in documents for t in set(d))
    return [{t: c / len(d) * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in Counter(d).items()} for d in documents]


def cosine(a, b):
    na, nb = (math.sqrt(sum(v * v for v in x.values())) for x in (a, b))
    return sum(v * b.get(t, 0) for t, v in a.items()) / (na * nb) if na and nb else 0.0


def perplexity(tokens, corpus, order=3):
    if not tokens:
        return 1000.0
    if len(tokens) < order:
        return 500.0 / len(tokens)
    grams = Counter(tuple(corpus[i : i + order]) for i in range(len(corpus) - order + 1))
    contexts = Counter(tuple(corpus[i : i + order - 1]) for i in range(len(corpus) - order + 1))
    size = max(1, len(set(corpus)))
    logs = [-math.log((grams[tuple(tokens[i : i + order])] + 1) / (contexts[tuple(tokens[i : i + order - 1])] + size)) for i in range(len(tokens) - order + 1)]
    return math.exp(sum(logs) / len(logs))
