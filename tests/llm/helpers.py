"""Small tables with everything that may be odd about them."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, t double, label string, score int, part int"


def docs(spark, texts):
    """Rows of (doc_id, text); the other columns have names that operators might use themselves."""
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "x", 1, 0.5, "y", 2, 3) for i, t in texts], DOCS)


def words(rng, many, vocabulary=40):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(many)]


def corpus(seed, many=40):
    """Copies, near copies, shared passages, short and odd texts, nulls, repeated rows."""
    rng = random.Random(seed)
    passage = words(rng, 30, 500)
    out = []
    for i in range(many):
        kind = rng.randrange(8)
        if kind == 0 or not out:
            t = " ".join(words(rng, rng.randrange(1, 60), 500))
        elif kind == 1:
            t = rng.choice(out)[1]
        elif kind == 2:
            old = (rng.choice(out)[1] or "a b c").split(" ")
            for _ in range(rng.randrange(1, 3)):
                old[rng.randrange(len(old))] = "new" + str(rng.randrange(9))
            t = " ".join(old)
        elif kind == 3:
            t = "\n".join([" ".join(words(rng, 5, 500)), " ".join(passage), " ".join(words(rng, 8, 500))])
        elif kind == 4:
            t = rng.choice(["", "  \n\t ", "one", "Zwei  Wörter", "ÄÖ ß 中文 😀", "a b c"])
        elif kind == 5:
            t = None
        elif kind == 6:
            t = " ".join(["same"] * rng.randrange(1, 30))
        else:
            t = " ".join(words(rng, 20, 500)).upper()
        out.append((i * 3 % 101, t))
    out.append(out[0])  # a repeated row
    return out


def multiset(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
