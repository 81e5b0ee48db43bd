"""Small documents for the tests, and plain forms of the definitions."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def words_of(text):
    return WORDS.findall((text or "").translate(_LOWER))


def shingles_of(text, size=5):
    words = words_of(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def prose(seed, words=60, vocabulary=400):
    random_ = random.Random(seed)
    return " ".join(f"w{random_.randrange(vocabulary)}é" if random_.random() < 0.1 else f"w{random_.randrange(vocabulary)}" for _ in range(words))


def frame(spark, rows):
    """Documents from (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def clashing(docs):
    """Further columns with names that operators use inside."""
    from pyspark.sql import functions as F

    names = ["part", "node", "key", "size", "place", "score", "words", "group", "start", "spans", "doc", "html", "rank", "n", "component", "range"]
    return docs.withColumns({name: F.lit(-1) for name in names})
