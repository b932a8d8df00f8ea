import random

import pytest

WHITE = b" \t\n\x0b\x0c\r"
#: Columns that operators use inside, to clash with.
EXTRA = "key string, t string, n string, _flag string, _row string, digest string, kept_text string, id string, bucket string, score string, y string, _keep string, _sha string, _nth string, n_words string, n_removed string, _kept_text string, _word string, row string, class string, short string, `a.b` string"


def prose(rng, n, words=400):
    return " ".join(rng.choice("th er an in on re nd he st es".split()) + rng.choice("a b c d e f g h i j k l m n o p".split()) + str(rng.randrange(words)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared passages, nulls, blanks, repeated rows, a null id and a very long one."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(1, 160)) for _ in range(30)]
    passage = prose(rng, 60)
    out = [(i, t) for i, t in enumerate(base)]
    for i in range(20):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "edited"
        out.append((100 + i, " ".join(w)))
    out += [(200 + i, prose(rng, 30) + " " + passage + "\n" + prose(rng, 30)) for i in range(6)]
    out += [(300, None), (301, ""), (302, " \n\t"), (303, None), (304, "one"), (305, "ONE"), (306, "one two"), (307, " one\ttwo "), (308, "été ÉTÉ naïve — “q” 日本語  x"), (309, "it " * 200), (310, "<|endoftext|> a<|endoftext|>")]
    out += [(400, base[0]), (400, base[0]), (401, base[1] + "  "), (None, base[2]), (None, "alone without an id"), (402, prose(rng, 40_000, 10**6))]
    out += [(500 + i, base[3]) for i in range(25)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.select("*", *[F.lit("x").alias(c.split()[0]) for c in EXTRA.split(", ")]).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
