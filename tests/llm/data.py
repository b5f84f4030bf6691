"""Small documents with copies, shared passages and odd rows."""

import random

SYLLABLES = "an be co de er fi go ha in jo ka li mo na or pe qu ra so th un ve wa xi yo zé".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def documents(seed=5, n=60):
    """(doc_id, text, lang, source) with near copies, exact copies, passages, and nulls."""
    rng = random.Random(seed)
    passage, line = prose(rng, 30), prose(rng, 6)
    texts = []
    for i in range(n):
        w = prose(rng, rng.randint(1, 200)).split(" ")
        kind = i % 6
        if kind == 1 and texts:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "changed"
        elif kind == 2:
            at = rng.randrange(len(w))
            w[at:at] = passage.split(" ")
        elif kind == 3 and texts:
            w = rng.choice(texts).split(" ")
        texts.append(" ".join(w))
    rows = [(i, t if i % 7 else t.replace(" ", "\n", 3), "en" if i % 3 else "de", "s0" if i % 3 else f"s{i % 5}") for i, t in enumerate(texts)]
    rows += [(n, "", "en", "s1"), (n + 1, None, None, None), (n + 2, " \t\n ", "en", "s1"), (n + 3, "one two", "de", "s1"), (n + 4, "one two", "de", None), (n + 5, line + "\n" + line + "\n" + passage + " " + passage, "fr", "s2"), (n + 6, "ONE two", "de", "s9"), (n + 7, "word " * 3000, "en", "s2")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"
