from __future__ import annotations

import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "日本", "mu"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 400)}" for _ in range(n))


def messy_documents(seed: int = 5) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empties, copies, near copies, shared passages, one very long text."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 90)) for _ in range(60)]
    passage, base = prose(rng, 55), prose(rng, 120).split(" ")
    texts += [f"{prose(rng, 10)} {passage}\n{prose(rng, 12)}" for _ in range(12)]
    texts += [texts[3]] * 4 + [texts[3].replace(" ", " \t", 1)] * 2 + [passage]
    for _ in range(30):  # near copies, from almost the same to far off
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        texts.append(" ".join(words))
    texts += ["", None, " ", "\n\n", "a", "A b", "a B", "one two three", "ONE two three", "x" * 49, "x" * 50, "x" * 51, "x" * 400, "é" * 60, "é" * 60 + "!"]
    texts.append(" ".join([prose(rng, 6000), passage]))
    line = "a line that stands on many different sites"
    texts += [f"{line}\n{prose(rng, 8)}\n \n  {line}  " for _ in range(14)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "en", f"s{k % 17}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows += [rows[2], rows[2], rows[70], (None, "no id at all here", None, None, None), (None, passage, "en", "s1", 3), (rows[4][0], "the same id with another text", "en", None, 1)]
    return rows


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def messy(spark):
    """The rows, and the table with further columns whose names operators use inside."""
    from pyspark.sql import functions as F

    rows = messy_documents()
    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(5)
    return rows, df.withColumns({c: F.lit("clash") for c in ("size", "word", "kept", "component", "node", "bucket", "block", "payload", "rank", "piece", "label", "site", "gone", "key", "shard_key", "shard_range", "quality_score", "score", "row", "at", "before", "range")})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
