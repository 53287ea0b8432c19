"""Small tables with the cases every operator has to bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, h long, fp long, id long, kept boolean, `_leaf` int, `a.b` string"


def edge_rows():
    """Nulls in any column, empty and white texts, a very long one, ties, repeated rows, odd characters."""
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "naïve", "日本語", "x1", "1.2.3.4"]
    long_text = " ".join(rng.choice(words) + str(rng.randrange(4000)) for _ in range(30_000))
    texts = [
        None, "", " \t\n", "one", "one two", "one  two", "one\ttwo", "one two three", "  ", "\U0001f600 smile", long_text,
        "same text here " * 40, "same text here " * 40, "a" * 5000, "-" * 400, "mail a@b.co or 10.0.0.1", "\x00\x01 control", " ".join(words * 20),
    ]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "", None]), None) for i, t in enumerate(texts)]
    rows += [rows[11], rows[11], (None, "no id", None, None, None), (None, None, None, None, None), (None, "one two", "en", "s1", 3), (-5, "one two", "en", "s1", 7)]
    return [(*r, 1, 2, 3, 4, 5, True, 6, "z") for r in rows]


def edge_frame(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def empty_frame(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_frame(spark, texts, parts=3):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)
