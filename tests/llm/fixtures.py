"""A small corpus with copies, near copies, shared passages, nulls, empty and long texts, repeated rows and clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, ka string, kept int, id string, component int"


def corpus(seed=5, n=40):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(300)]

    def prose(k):
        return " ".join(r.choice(vocabulary) for _ in range(k))

    passage, rows = prose(60), []
    for i in range(n):
        rows.append([i, "\n".join(prose(r.randint(3, 40)) for _ in range(r.randint(1, 5)))])
    base = prose(120)
    for i in range(8):  # near copies of one text
        words = base.split(" ")
        words[r.randrange(120)] = f"x{i}"
        rows.append([100 + i, " ".join(words)])
    for i in range(6):  # a passage in other text, and exact copies
        rows.append([200 + i, prose(15) + "\n" + passage + "\n" + prose(15)])
        rows.append([300 + i, rows[0][1]])
    rows += [
        [400, None], [401, ""], [402, " \t\n "], [403, "ab " * 3000], [404, "z" * 5000], [405, "one"], [406, "one"],
        [407, "tab\tand\x0bvt  two"], [407, "tab\tand\x0bvt  two"], [407, "another text with this id " + passage],
        [None, passage + " more"], [None, prose(30)], [None, None], [408, "a b c"],
    ]
    lang = ["en", "de", None, "fr"]
    return [
        (i, t, lang[(i or 0) % 4], f"s{(i or 0) % 3}", len(t) if t else None, 1, "k", 0, "x", 9) for i, t in rows
    ]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(4)
