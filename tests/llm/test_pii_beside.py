import re

import pytest

from test_pii import luhn, run

CARD, AMEX, IBANS, PHONE = "4111 1111 1111 1111", "3782 822463 10005", ("BE68 5390 0754 7034", "GB82 WEST 1234 5698 7654 32"), "+44 20 7946 0958"


def alone(spark, values):
    return dict(zip(values, (t for t, _ in run(spark, values)), strict=True))


def test_numbers_with_digits_and_capitals_beside(spark):
    other = "4041 8949 7460 8795"
    joined = CARD.replace(" ", "")
    values = [CARD, AMEX, other, joined, joined.replace("1111", "1111-", 3), *IBANS, PHONE, "123-45-6789", "2024-05-06", "10.20.30.40", "415 555 2671"]
    new = alone(spark, values)
    assert all(new[v] != v for v in values) and luhn(new[CARD]) and new[CARD].replace(" ", "") == new[joined]
    cases = ["{%s} 12/25" % CARD, "{%s} 123" % joined, "2 {%s}" % CARD, "12 34 {%s} 12/25" % CARD, "7 {%s} 42 007" % AMEX, "{%s} {%s}" % (CARD, other),
             "{%s} {123-45-6789}" % CARD, "{%s} {2024-05-06}" % CARD, "{%s} {10.20.30.40}" % joined, "{%s} {415 555 2671}" % CARD, "{%s} 3rd" % CARD]
    cases += ["{%s} %s" % (i, tail) for i in IBANS for tail in ("EUR", "AB", "X", "EURO 12", "2024", "12")]
    cases += ["{%s} 12" % PHONE, "{%s} 12 34" % PHONE, "{%s} {123-45-6789}" % PHONE, "{+33 1 23 45 67 89} 12"]
    new |= alone(spark, ["+33 1 23 45 67 89"])
    got = run(spark, [re.sub("[{}]", "", c) for c in cases])
    want = [(re.sub(r"\{(.*?)\}", lambda m: new[m[1]], c), c.count("{")) for c in cases]
    for c, g, w in zip(cases, got, want, strict=True):
        assert g == w, c


@pytest.mark.parametrize("n", [30, 6000])
def test_long_runs_of_groups(spark, n):
    table = " ".join(str(i % 7) for i in range(n))
    (text, found), (again, _) = run(spark, [table + " x " + CARD, CARD])
    assert text.endswith(again) and found >= 1
    assert re.sub(r"\d", "0", text) == re.sub(r"\d", "0", table + " x " + CARD)
