"""Awkward rows for every operator on documents: nulls, empty and long texts, repeats, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, base string, spans string, n_words long, `key` string, fp long, pid int, label string"

_WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(_WORDS) + (str(rng.randint(0, 99)) if rng.random() < 0.5 else "") for _ in range(n))


def documents(seed=3):
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(1, 120)) for _ in range(40)]
    passage = sentence(rng, 60)
    texts += [texts[0], texts[0], texts[1] + " tail", f"{sentence(rng, 20)} {passage} {sentence(rng, 20)}", f"{passage}\n{sentence(rng, 9)}", "loop " * 90]
    texts += [None, "", " \t\n", "one", "two words", "Ünï çødé 漢字 😀 " * 5, "x" * 50_000, sentence(rng, 3000), "a b c\x85d e f g\x1ch"]
    rows = [(k, t, "en", f"s{k % 3}", len(t or ""), "r", "b", "s", 7, "k", 1, 2, "l") for k, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rows.append((None, texts[2], None, None, None, None, None, None, None, None, None, None, None))
    rows.append((3, "another text under the id of an earlier row", *rows[3][2:]))
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
