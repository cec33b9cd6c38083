"""Small document tables with every awkward case in them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, rep long, kind string, node string"


def docs(spark, texts, first=0):
    """texts: strings, or (doc_id, text); the further columns clash with names that the operators use."""
    rows = []
    for k, t in enumerate(texts):
        i, text = t if isinstance(t, tuple) else (first + k, t)
        rows.append((i, text, "en" if k % 3 else None, f"src{k % 2}" if k % 5 else None, None if text is None else len(text), 0.5, 1, 2, "k", "n"))
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n=120):
    rng = random.Random(seed)
    syllables = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(n))


def edited(text, share, seed=0):
    rng, words = random.Random(seed), text.split()
    for k in rng.sample(range(len(words)), max(1, int(len(words) * share))):
        words[k] = "changed" + str(rng.randint(0, 999))
    return " ".join(words)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
