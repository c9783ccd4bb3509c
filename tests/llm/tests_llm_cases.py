"""Rows with nulls, empty and very long texts, ties and repetitions."""


def odd_rows(rnd, rows):
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    long_text = " ".join(rnd.choice(words) for _ in range(60_000))
    base = " ".join(rnd.choice(words) for _ in range(300)).split()
    near = base.copy()
    near[150] = "changed"
    out = [
        (1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, " \n\t ", None, "s", 4), (1003, "word", None, None, None),
        (1004, "two words", "xx", "s", 9), (1005, "TWO  words", "xx", "s", 10), (None, "no id at all", "en", "s", 1), (None, None, None, None, None),
        (1006, "a a a a " * 40, "en", "s", 1), (1007, "a a a a " * 41, "en", "s", 1),
        (1008, long_text, "en", "s", 1), (1009, "x" * 30_000, "en", "s", 1), (1010, "1 2 3 !!! ...", "en", "s", 1),
        (1011, "head " + passage + " tail", "en", "s", 1), (1012, "other " + passage, "de", "s", 1), (1013, passage + " end\n" + passage, "de", "s", 1),
        (1014, " ".join(base), "en", "s", 1), (1015, " ".join(near), "en", "s", 1), (1016, "\n".join(base), "en", "s", 1),
        (1017, "日本語 テキスト 😀 ▁mark été ﬁ", "en", "s", 1), (1018, "é   nbsp x\x0b\x0c\r\n y", "en", "s", 1),
        (1019, "line one two three four\n" * 12, "en", "s", 1), (1020, " ".join(str(i) for i in range(35)), "en", "s", 1),
        (1021, " ".join(str(i) for i in range(36)), "en", "s", 1),
    ]
    again = [rows[3], rows[3], (2000, rows[4][1], "fr", "s", 1), (2001, (rows[4][1] or "").replace(" ", "\n"), "fr", "s", 1), (rows[5][0], "same id, another text", "en", "s", 1)]
    return out + out[13:15] + again
