"""Small documents with every awkward case, and brute-force versions of operators."""

import random
import re

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, digest string, bucket string, u string, _digest string"
SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "fr": "é eau ou le re en oi ai è qui".split()}


def prose(rng, n, lang="en"):
    word = lambda: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))
    words = [word() for _ in range(n)]
    for i in range(0, n, 12):
        words[i] = words[i].capitalize()
    return re.sub(r"(\S+ \S+ \S+ \S+ \S+ \S+ \S+ \S+ \S+ \S+ \S+ \S+) ", r"\1.\n", " ".join(words))


def documents(seed=0):
    """Rows of SCHEMA: copies, near copies, shared passages, nulls, empty and long texts, repeated rows, clashing columns."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(30, 200), rng.choice(["en", "fr"])) for _ in range(12)]
    passage = prose(rng, 40)
    texts = [*base, base[0], base[0], base[1] + " end", base[2].replace(" ", "  "), base[3] + "\n" + passage, passage + " " + base[4], passage, prose(rng, 6000), "", None, "   \n", "!!! 123", "one two", "One two", " ".join(["again and"] * 40)]
    rows = [(i, t, "fr" if t and "é" in t else "en" if i % 3 else None, f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base[6], "en", None, None), (None, "only without an id " + base[7], None, None, None)]
    return [(*r, "clash", "clash", "clash", "clash", "clash", "clash") for r in rows]


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def fingerprint(text):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(text)]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def classes(keys, linked):
    """Smallest class member of each key, by union-find over all pairs."""
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ks = sorted(keys)
    for i, a in enumerate(ks):
        for b in ks[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in ks}


def repeats(docs, window=20):
    """doc_id -> (n_words, words kept), every window looked up in full."""
    seen, out = {}, {}
    for i, text in sorted((i, t) for i, t in docs if i is not None):
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[k : k + window]), (i, k)) != (i, k):
                gone[k : k + window] = [True] * window
        out[i] = (len(w), [x for x, g in zip(w, gone, strict=True) if not g])
    return out


def jaccard_components(rows):
    """Smallest id of the component of each id, by brute force over pairs of five-word shingle sets."""
    sets = {}
    for i, text in rows:
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(text)]
        sets.setdefault(frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))), []).append(i)
    root, least = classes_of(list(sets)), {}
    for s, ids in sets.items():
        least[root[s]] = min([*ids, least.get(root[s], min(ids))])
    return {i: least[root[s]] for s, ids in sets.items() for i in ids}


def classes_of(sets):
    found = classes(range(len(sets)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    return {s: found[k] for k, s in enumerate(sets)}
