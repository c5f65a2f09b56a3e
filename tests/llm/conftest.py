import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, h long, fp long, copies long, page int, spans string, ids string, component_id long, score double, class int, doc string, __cleaned string, cleaned string, words string, repeats string, row string, found string, own_id string, n_bytes long, __repeats_of string"


def odd_texts():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(1, 8)))
    prose = lambda n: " ".join(word() + ("." if r.random() < 0.1 else "") for _ in range(n)) + "."
    base = [prose(r.randint(12, 120)) for _ in range(12)]
    passage = prose(70)
    texts = [*base, base[0], base[0], base[3], passage, base[1] + "\n" + passage, passage + "\n" + base[2], prose(4000), "x" * 5000, "y " * 3000, base[5][:200] + " other " + base[5][200:]]
    return [*texts, None, "", " \n\t ", "one", "two words", "HOME | ABOUT | NEWS | LINKS | SHOP", "Loud!! LOUD!! Loud!! loud!! LOUD!! Loud!! loud!! Loud!! loud!! Loud!! loud!!", "日本語の文。" * 30, "▁ odd ▁▁ space\r\n\x0b end", "naïve café " * 20, "line one is here.\n" * 9]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, copies, shared passages, repeated rows and columns whose names clash."""
    rows = [(k, t, "en", [None, "a", "b", "a", "c"][k % 5], None, 1, True, 2, 3, 4, 5, "s", "i", 6, 0.5, 7, "d", "c", "e", "w", "r", "o", "u", "p", 8, "q") for k, t in enumerate(odd_texts())]
    # An id with several texts: sharing a passage, sharing nothing, of two-byte characters, a copy.
    several = [rows[15][1] + " " + rows[4][1], "ßüä öéè " * 3 + "".join(chr(0xC0 + k * 7 % 300) for k in range(400)), rows[18][1][:60][::-1] * 4, rows[0][1]]
    rows += [(60, t, *rows[2][2:]) for t in several] + [(5, several[0], *rows[3][2:])]
    rows += [rows[1], rows[1], (None, rows[2][1], *rows[2][2:]), (None, None, *rows[2][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
