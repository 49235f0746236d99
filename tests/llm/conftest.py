import random

import pytest

CLASHING = "size long, taken long, set_id long, token string, row string, score double, kept boolean, part int, n long, word string, id long, key string, licenses string, ids string"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties and clashing column names."""
    rnd = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "Été", "naïve", "the", "of", "and", "x1", "zz-top", "ΑΒΓ"]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = say(60)
    texts = [None, "", "   \n\t", "one", "one two three", base, base, base.replace("beta", "BETA", 1), base + " tail", "\n".join([base, say(30), base]),
             say(4000), say(40), say(40).replace(" ", "  \n"), "a" * 300, "under the MIT license\n" + say(20)]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None, None), (None, None, None, None, None), (3, "another text with id three", "en", "src0", 1)]
    extra = (1, 2, 3, "t", "r", 0.5, True, 4, 5, "w", 6, "k", "l", "i")
    return spark.createDataFrame([r + extra for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").coalesce(2)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("false")
