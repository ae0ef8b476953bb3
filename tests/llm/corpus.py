"""A small corpus with every difficult case, and plain versions of what operators compute."""

import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, label int, _cell int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(n)]


def rows():
    base = words(300, 1)
    near = base[:]
    near[150] = "changed"
    passage = " ".join(words(80, 2))
    texts = [
        " ".join(base), " ".join(base), " ".join(near), None, "", "   \t\n", "one", "One", "two words", "two words here",
        " ".join(words(60, 3)) + " " + passage + " " + " ".join(words(50, 4)), " ".join(words(70, 5)) + " " + passage, passage[:250],
        "é" * 150 + " ñandú " + "é" * 150, "x" * 5000, " ".join(words(9000, 6)), "<|endoftext|> a\x01b", "a\x1cb \x85 c",
    ]
    texts += [" ".join(words(20 + 3 * i, 100 + i)) for i in range(20)]
    sources = ["src0", "src1", None, "src0", "b"]
    out = [(i, t, "en", sources[i % 5], None if t is None else len(t), "n", 1, 2) for i, t in enumerate(texts)]
    out.append(out[0])  # a repeated row
    out.append((None, "a document without a key but with text", None, None, None, "n", 1, 2))
    return out


def utf8(text):
    return (text or "").encode()


def shingles(text, size):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), utf8(text))
    found = WORD.findall(low)
    if len(found) >= size:
        return frozenset(zip(*(found[i:] for i in range(size))))
    return frozenset([tuple(found)] if found else [])


def near_components(data, size, percent):
    sets = [shingles(t, size) for _, t in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(data):
        groups[find(i)].append(key)
    smallest = {r: min((k for k in g if k is not None), default=None) for r, g in groups.items()}
    return [(key, len(sets[i]), smallest[find(i)]) for i, (key, _) in enumerate(data)]


def removed_masks(texts, length):
    bodies = [utf8(t) for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    masks = []
    for b in bodies:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mask[i : i + length] = b"\x01" * length
        masks.append(mask)
    return masks
