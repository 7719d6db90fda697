"""A small corpus for the tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_documents(seed: int = 5) -> list[tuple]:
    """A small corpus with copies, near copies, shared passages, repeated lines, licences, odd white space, null and empty texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line, base = prose(60), "A line that stands in very many documents, word for word.", prose(160)
    texts = [None, "", "   \n\t ", "one", "Released under the MIT License", passage, passage, f"{prose(30)} {passage} {prose(30)}", f"{prose(12)} {passage} {passage} {prose(12)}"]
    texts += [f"{prose(40)}\n{line}\n{prose(25)}" for _ in range(6)]
    texts += [base] * 4
    for edits in (1, 2, 3, 8, 30):
        words = base.split()
        for i in rng.sample(range(len(words)), edits):
            words[i] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [f"{base} {prose(3)}", "Licensed under the Apache\nLicense, Version 2.0. mit license MIT-License gnu general public license", "a\x0bb\x0cc\x1cd\x85e f  g", " ".join(["same"] * 90), "Ñandú ÉCOLE école ÑANDÚ " * 20]
    texts += [prose(rng.randint(1, 300)) for _ in range(20)] + [prose(3000)]
    sources = ["b", "a", None, "c", "b", "b"]
    return [(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]
