"""Small made-up corpora with copies, near copies, shared passages and odd texts."""

import random

WORDS = [a + b for a in ("ta", "no", "ri", "ke", "su", "mo", "vel", "dra") for b in ("lin", "do", "ra", "mit", "sen", "go", "ña", "ßt")]


def prose(seed, n, line=12):
    r = random.Random(seed)
    w = [r.choice(WORDS) + r.choice(["", "", "s", "en"]) for _ in range(n)]
    return "\n".join(" ".join(w[i : i + line]) for i in range(0, n, line))


def near(text, seed, edits):
    r = random.Random(seed)
    w = text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


ODD = ["", None, " \t \n", "one", "One  two\tthree\x0b\x0cfour", "\n\n\n", "same line again and again\n" * 40, "ünï çødé 漢字 漢字 𝄞 clef " * 30, "a\x00b c\x00d " * 20]


def corpus(seed=1, n=60):
    """(doc_id, text) rows: ids not dense, some texts repeated, some nearly, one very long."""
    base = [prose(seed * 1000 + i, 20 + 17 * (i % 9)) for i in range(n // 3)]
    passage = prose(seed * 77, 40, line=40)
    texts = list(base)
    texts += [base[i % 7] for i in range(n // 6)]  # exact copies
    texts += [near(base[i % 5 + 8], i, 1 + i % 6) for i in range(n // 3)]
    texts += [base[i % 6] + " " + passage + " " + prose(seed * 31 + i, 30) for i in range(n // 6)]
    texts += ODD
    texts.append(" ".join(prose(seed * 13 + i, 400) for i in range(30)))
    random.Random(seed).shuffle(texts)
    return [(i * 3 + 5, t) for i, t in enumerate(texts)]
