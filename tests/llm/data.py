"""Small tables with odd rows for the operators of the training-data pipeline."""

import random

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SHAPE + ", doc int, version string, token string, `count` int, rows string"


def sentence(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 8))) for _ in range(n)) + "."


def texts():
    base = sentence(1, 120)
    words = base.split()
    passage = "This passage of more than fifty bytes stands in several documents, word for word. "
    rows = [
        (1, base), (2, base), (3, " ".join(words[:110] + ["changed"] * 3 + words[113:])), (4, base.upper()), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "one"), (10, "One two three"),
        (11, sentence(2) + passage + sentence(3)), (12, passage + sentence(4)), (13, sentence(5) + "\n" + passage), (14, "a" * 3000), (15, "a" * 200 + sentence(6)), (16, "é漢字🙂 " * 80), (17, "é漢字🙂 " * 80),
        (18, "| | | > | nav | menu | x |\n" * 30), (19, sentence(7, 20000)), (20, sentence(7, 19000)), (21, "12345 67890 ... !!!"), (22, "x\x1cy\x85z <|endoftext|> 'S it's"),
    ]
    return rows


def documents(spark, rows=None, extra=False):
    rows = texts() if rows is None else rows
    full = [(i, t, None if i % 5 == 0 else ("en" if i % 2 else "fr"), f"s{i % 3}", None if t is None else len(t)) for i, t in rows]
    full += [full[0]] if full else []  # a repeated row
    if extra:
        return spark.createDataFrame([(*r, 1, "v", "t", 2, "r") for r in full], EXTRA)
    return spark.createDataFrame(full, SHAPE)
