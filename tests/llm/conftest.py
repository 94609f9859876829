import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, `class` string, signature string, copies int, window int"


def words(r, n):
    return " ".join("".join(r.choice(("er", "th", "on", "ä", "que", "tion", "a")) for _ in range(r.randint(1, 4))) for _ in range(n))


def make_texts():
    r = random.Random(11)
    texts = [None, "", " ", "\n", "one", "two words", "same text here", "same text here", "  two  spaces ", "tab\there\r\nnew line", "▁ mark <s> \\### Assistant: </turn>", "汉字 😀 and\x00nul \x1f \u3000wide\xa0space"]
    base = [words(r, n) for n in (3, 12, 40, 90, 150, 400)]
    for b in base:
        w = b.split()
        texts += [b, b, b.upper()]
        for k in (1, 2, 6):
            v = list(w)
            for _ in range(k):
                v[r.randrange(len(v))] = "new" + str(r.randint(0, 9))
            texts.append(" ".join(v))
    texts += ["repeat " * 3000, "x" * 50_000, "\n".join(["line with words"] * 40), "ab12 " * 60]
    texts += [f"write to {chr(97 + i)}b.c{i}@mail.example.com or +1 (555) 555-01{i:02d} from 10.0.0.{i} card 4111 1111 1111 1111 end" for i in range(8)]
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def documents(spark, texts):
    rows = [(3 * i, t, "en", None if i % 7 == 0 else f"src{i % 4}", len(t or ""), i, "c", "s", i, i) for i, t in enumerate(texts)]
    rows.append(rows[6])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
