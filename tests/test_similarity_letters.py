"""V16 against brute force on letters beyond ASCII."""

import __spark_entry__ as E


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_different_letters_count_as_different(spark, tmp_path):
    talks = [["привет мир", "другой сон"], ["αβγδε", "ζηθικ", "ζηθικ"], ["你好世界", "再见朋友"], ["été 😀", "ete 😃", "plain"]]
    rows = [(i, t, x) for i, talk in enumerate(talks) for t, x in enumerate(talk)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pairs = [p for talk in talks for p in zip(talk, talk[1:])]
    total, length = sum(distance(a, b) for a, b in pairs), sum(max(len(a), len(b)) for a, b in pairs)
    row = E.queries()["V16_generation_similarity"](spark, str(tmp_path)).collect()[0]
    assert (row.total_distance, row.total_length, row.ratio, row.similar) == (total, length, round(total / length, 6), False)
