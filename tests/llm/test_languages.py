import unicodedata
import zlib
from collections import Counter

import numpy as np
from llm.helpers import clashing

from siftstone.llm import languages

FOLDER = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def plain_grams(text, order):
    letters = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    if not letters.strip():
        return Counter()
    padded = (" " + " ".join(letters.split()) + " ").ljust(order)
    return Counter(padded[i : i + order] for i in range(len(padded) - order + 1))


def plain_bundle(grams):
    """Each n-gram bound letter by letter, bit by bit."""
    total = np.zeros(languages.DIMENSIONS)
    for gram, n in grams.items():
        vector = np.ones(languages.DIMENSIONS)
        for i, c in enumerate(gram):
            bits = languages.letter_vectors(np.array([0 if c == " " else ord(c)], np.uint64))
            signs = 1.0 - 2 * np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[0]
            vector = vector * np.roll(signs, len(gram) - 1 - i)
        total += n * vector
    return total


TEXTS = ["Hello, World", "a", "  Ça  va?? ça", "ÄÖ\nü", "日本語 テキスト", "x1y", "...", "", "İstanbul", "क्षि", "the the the"]


def test_grams_of_parts():
    for text in TEXTS:
        for order in (1, 2, 3):
            for part in (1, 2, 5, 100):
                if part < 5 and "İ" in text:
                    continue
                found = Counter(int(g) for grams in languages.text_grams(text, order, part) for g in grams)
                expected = Counter()
                for gram, n in plain_grams(text, order).items():
                    expected[sum((0 if c == " " else ord(c)) << (21 * (order - 1 - i)) for i, c in enumerate(gram))] += n
                if order > 1:
                    assert found == expected, (text, order, part)


def test_bundles(monkeypatch):
    for size in (1, 1 << 17):
        monkeypatch.setattr(languages, "GROUP_CHARS", size)
        got = {row: v for rows, total in languages.bundles([*TEXTS, None]) for row, v in zip(rows, total)}
        for i, text in enumerate(TEXTS):
            grams = plain_grams(text, languages.ORDER)
            assert (i in got) == bool(grams)
            if grams:
                assert (got[i] == plain_bundle(grams)).all()


def test_letter_vectors_are_unlike():
    signs = 1.0 - 2 * np.unpackbits(languages.letter_vectors(np.arange(300)).view(np.uint8), axis=1)
    likeness = signs @ signs.T / languages.DIMENSIONS
    assert np.abs(likeness - np.eye(300)).max() < 0.15


def test_prediction_by_definition(spark):
    docs = [("en", "the cat and the dog"), ("en", "and then the end"), ("de", "der hund und die katze"), ("de", "und dann das ende"), ("fr", "le chien et le chat")]
    rows = [(i, t, lang, "s", 0) for i, (lang, t) in enumerate(docs * 12)]
    got = {r["doc_id"]: r for r in languages.language_id(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {i for i, r in got.items() if r["held_out"]} == held and held
    table = {}
    for lang in ("de", "en", "fr"):
        units = [plain_bundle(plain_grams(t, 3)) for i, t, own, *_ in rows if own == lang and i not in held]
        table[lang] = sum(u / np.linalg.norm(u) for u in units)
        table[lang] /= np.linalg.norm(table[lang])
    for i, text, lang, *_ in rows:
        own = plain_bundle(plain_grams(text, 3))
        cosine = {k: own @ v / np.linalg.norm(own) for k, v in table.items()}
        assert got[i]["lang_pred"] == lang == max(cosine, key=cosine.get)
        assert abs(got[i]["score"] - cosine[lang]) < 1e-5


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = languages.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(rows) > 2000 and (rows.lang == rows.lang_pred).mean() > 0.98
    assert rows.score.between(0, 1).all()


def test_labels_of_the_held_out_fold_are_not_used(spark):
    rows = [(i, f"{'the cat and' if i % 2 else 'der hund und'} {i}", "en" if i % 2 else "de", "s", 0) for i in range(200)]
    false = [(i, t, "fr" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s, n) for i, t, lang, s, n in rows]
    found = [sorted(map(tuple, languages.language_id(spark.createDataFrame(r, SCHEMA)).collect())) for r in (rows, false)]
    assert found[0] == found[1]


def test_odd_tables(spark):
    assert languages.language_id(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "12 ..", "en", "s", 0), (None, "abc", "en", "s", 0), (4, "abc", None, "s", 0)]
    none = languages.language_id(spark.createDataFrame(odd, SCHEMA)).collect()
    assert len(none) == 5 and all(r["lang_pred"] == "und" and r["score"] == 0 and r["held_out"] in (True, False) for r in none)
    taught = next(i for i in range(10, 99) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = odd + [(taught, "abc " * 400_000, "en", "s", 0), (taught, "abc", "en", "s", 0), (taught, "xyz", "", "s", 0)]
    got = languages.language_id(clashing(spark.createDataFrame(rows, SCHEMA))).toPandas()
    assert len(got) == len(rows)
    assert sorted(got.lang_pred) == [""] + ["en"] * 4 + ["und"] * 3


def test_a_letters_vector_is_made_once_for_all_ngrams(monkeypatch):
    made, plain = [], languages.letter_vectors
    monkeypatch.setattr(languages, "letter_vectors", lambda points: made.append(len(points)) or plain(points))
    text = "".join(a + b + c for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh")
    ((rows, total),) = languages.bundles([text])
    assert rows == [0] and made == [9]  # eight letters and the gap, of hundreds of n-grams
    monkeypatch.undo()
    assert (total[0] == plain_bundle(plain_grams(text, languages.ORDER))).all()
