import random

import pytest

from kestrel.llm.substring import remove_repeats

from test_repeats import kept, result


@pytest.mark.parametrize("times", [2, 40])
def test_a_repeated_row_is_looked_up(spark, times):
    """A row given more than once, and documents with inner words of its passage."""
    rnd = random.Random(times)
    fresh = lambda n: [f"w{rnd.randrange(10 ** 6)}" for _ in range(n)]
    rows = []
    for k in range(8):
        passage = fresh(400)
        rows += [(k if k % 2 else None, " ".join(passage))] * times
        for at in (100, 180, 260):
            rows.append((100 + len(rows), " ".join(fresh(5) + passage[at:at + 40] + fresh(7))))
    rows.append((99, " ".join(fresh(60))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(remove_repeats(df)) == kept(rows, 35)
