"""Personal data replaced by format-preserving Feistel pseudonyms (DataFrame functions only).

One pattern finds candidates: an IBAN or a telephone number has its country's
length where that is known, and within a run of digit groups cards are looked
for from each group on, so text beside a number is kept.  Each is validated for its kind (Luhn sum, IBAN
remainder, octets, day of a month, number plans) and then permuted within
exactly that kind's domain by a keyed Feistel network: halves of sizes a and b
are added modulo a and b to keyed hashes of each other, which is a permutation
of the a * b values.  Check digits are recomputed.  So a pseudonym is a valid
value of the same format, equal values get equal pseudonyms in all documents,
and different values different ones.  Everything happens within a row: no
shuffle, no state.

Kinds: card numbers (13 to 19 digits; first digit kept), IBAN, IPv4, US social
security numbers, telephone numbers (country code kept), dates from 1900 to
2099, and the local part of e-mail addresses (letters and digits permuted in
their places, in lower case); with ``secrets`` also access key ids and
hexadecimal passwords after ``password=``.

Defined results: a null text stays null with count 0; a text without valid
candidates is returned as it is; candidates that fail validation stay; rows
equal in text get equal results; texts of any length are processed whole; an
empty table gives an empty table.  Working columns start with ``__``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DIGITS, HEX, LOWER = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
UPPER_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
PASSWORD = r"(?<=password=)[0-9a-f]{8,26}(?![0-9A-Za-z])"
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_IBAN_OF = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in IBAN_SIZES.items())
_IBAN_NEXT = f"(?! ?(?:{'|'.join(IBAN_SIZES.values()).replace(' ', '|')})[0-9]{{2}} )"
# by the country's length; else groups of four and a rest, to be tried from the longest
IBAN = (rf"(?<![A-Za-z0-9])(?:{_IBAN_OF}|"
        rf"[A-Z]{{2}}[0-9]{{2}}(?:{_IBAN_NEXT} ?[A-Z0-9]{{4}}){{2,7}}(?:{_IBAN_NEXT} ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))")
DATE = (r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2(?:19|20)[0-9]{2})"
        r"(?![0-9])(?![./-][0-9])")
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
US_PHONE = r"(?<![0-9A-Za-z+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
# most and least national digits after a country code; other plans have up to 15 digits in all
PHONE_SIZES = {
    "44": (9, 10), "33|34|31|41|48|40|61|27|351|380|420|421|254": (9, 9), "45|47|65|852": (8, 8), "32|36|66|971|972": (8, 9),
    "7|30|52|63|90|91|92|880": (10, 10), "46": (7, 9), "353": (7, 9), "20|81|84": (9, 10), "54|55|86": (10, 11), "60|64|82|234": (8, 10)}
_GAP = "[ ().-]{0,2}"
_PHONE_OF = "|".join(f"(?:{c})(?:{_GAP}[0-9]){{{a},{b}}}(?![0-9])" for c, (a, b) in PHONE_SIZES.items())
PHONE = rf"(?<![0-9A-Za-z+])\+(?:{_PHONE_OF}|[2-9](?:{_GAP}[0-9]){{6,14}}(?![0-9]))"
LOCAL_PHONE = r"(?<![0-9A-Za-z+(.-])\(?[2-9][0-9]{2}\)?[ .-]{1,2}[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])"
# a run of digit groups up to the next value of another kind; cards are looked for within
_NOT_CARD = "|".join([DATE.replace(r"\1", r"\3").replace(r"\2", r"\4"), EMAIL, IPV4, SSN, LOCAL_PHONE])
CARD = rf"(?<![0-9A-Za-z.-])(?=(?:[ -]?[0-9]){{13}})[0-9]++(?![A-Za-z])(?:[ -](?!{_NOT_CARD})[0-9]++(?![A-Za-z]))*+"
CARD_SIZES = (13, 19)
ISSUED = r"^(?:4[0-9]{15}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|35[0-9]{14}|6[0-9]{15}|3[47][0-9]{13}|3[0689][0-9]{12})$"

FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 days: to the end of 2099


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


class Feistel:
    def __init__(self, key: str):
        self.key = key

    def _noise(self, kind: str | Column, i: Column, value: Column) -> Column:
        text = F.concat_ws("|", F.lit(self.key), kind if isinstance(kind, Column) else F.lit(kind), i.cast("string"), value.cast("string"))
        return F.conv(F.substr(F.sha2(text, 256), F.lit(1), F.lit(15)), 16, 10).cast("long")

    def permute(self, kind: str | Column, left: Column, right: Column, a: Column, b: Column, then: Callable[[Column, Column], Column]) -> Column:
        """``then(left, right)`` after the rounds, ``left`` below a, ``right`` below b."""
        start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

        def turn(s: Column, i: Column) -> Column:
            return F.when(i % 2 == 0, F.struct(((s["l"] + self._noise(kind, i, s["r"])) % a).alias("l"), s["r"].alias("r"))).otherwise(
                F.struct(s["l"].alias("l"), ((s["r"] + self._noise(kind, i, s["l"])) % b).alias("r")))

        return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn, lambda s: then(s["l"], s["r"]))

    def text(self, kind: str, s: Column, alphabet: str) -> Column:
        """A string over ``alphabet`` permuted among those of its length; a very
        long one in blocks of two halves of 53 bits at most, one after the
        other, each by its place and the other blocks."""
        base = len(alphabet)
        most = 2 * int(53 / math.log2(base))

        def run(x: Column, tweak: Column) -> Column:
            n = F.length(x)
            m = F.floor(n / 2).cast("int")
            size = lambda k: F.pow(F.lit(float(base)), k).cast("long")
            return F.when(n == 0, x).otherwise(self.permute(
                tweak, number(F.substr(x, F.lit(1), m), alphabet), number(F.substr(x, m + 1, n), alphabet), size(m), size(n - m),
                lambda l, r: F.concat(spell(l, m, alphabet), spell(r, n - m, alphabet))))

        def block(t: Column, k: Column) -> Column:
            before, after = F.substr(t, F.lit(1), k * most), F.substr(t, (k + 1) * most + 1, F.length(t))
            tweak = F.concat(F.lit(f"{kind}{base}"), F.when(F.length(t) > most, F.concat_ws("|", F.lit(""), k.cast("string"), before, after)).otherwise(""))
            return let(tweak, lambda w: F.concat(before, run(F.substr(t, k * most + 1, F.lit(most)), w), after))

        last = F.greatest(F.floor((F.length(s) - 1) / most).cast("int"), F.lit(0))
        return F.aggregate(F.sequence(F.lit(0), last), s, block)


def number(s: Column, alphabet: str) -> Column:
    return F.aggregate(F.split(s, ""), F.lit(0).cast("long"),
                       lambda n, c: F.when(c == "", n).otherwise(n * len(alphabet) + F.instr(F.lit(alphabet), c) - 1))


def spell(v: Column, n: Column, alphabet: str) -> Column:
    base = F.lit(len(alphabet)).cast("long")
    start = F.struct(v.alias("v"), F.lit("").alias("t"))
    done = F.aggregate(
        F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), start,
        lambda s, i: F.struct(F.call_function("div", s["v"], base).alias("v"),
                              F.concat(F.substr(F.lit(alphabet), (s["v"] % base + 1).cast("int"), F.lit(1)), s["t"]).alias("t")),
        lambda s: s["t"])
    return done


def put(x: Column, fresh: Column, which: str) -> Column:
    """``x`` with the characters that match ``which`` replaced, in order, by those of ``fresh``."""
    return let(fresh, lambda new: F.aggregate(
        F.split(x, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("k")),
        lambda s, c: F.when(c.rlike(which), F.struct(F.concat(s["t"], F.substr(new, s["k"], F.lit(1))).alias("t"), (s["k"] + 1).alias("k")))
        .otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["k"].alias("k"))),
        lambda s: s["t"]))


def only(x: Column, which: str) -> Column:
    return F.regexp_replace(x, f"[^{which}]", "")


def luhn(body: Column) -> Column:
    """Luhn sum of the digits before the check digit."""
    n = F.length(body)
    parts = F.transform(F.split(body, ""), lambda c, i: F.when(c == "", F.lit(0)).otherwise(
        F.when((n - i) % 2 == 1, F.call_function("div", c.cast("int") * 2, F.lit(10)) + c.cast("int") * 2 % 10).otherwise(c.cast("int"))))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, b: a + b)


def mod97(s: Column) -> Column:
    return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda n, c: F.when(c == "", n).when(
        c.rlike("[0-9]"), (n * 10 + F.ascii(c) - 48) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97))


def part(x: Column, at: int, size: int) -> Column:
    return F.substr(x, F.lit(at), F.lit(size))


def pseudonym(f: Feistel, x: Column) -> Column:
    """The candidate (``t``) with what is valid in it replaced, and how many values that is (``n``)."""
    digits = only(x, "0-9")
    whole = lambda pattern: x.rlike(f"^(?:{pattern})$")

    def email() -> Column:
        local, rest = F.lower(F.substring_index(x, "@", 1)), F.substr(x, F.instr(x, "@"), F.length(x))
        numbers = put(local, f.text("mail", only(local, "0-9"), DIGITS), "[0-9]")
        return F.concat(put(numbers, f.text("mail", only(local, "a-z"), LOWER), "[a-z]"), rest)

    def card() -> Column:
        """At each group of the run the groups that make a card: an issuer's
        length first, then the longest, unless an issuer's begins within."""
        def valid(d: Column) -> Column:
            return F.length(d).between(*CARD_SIZES) & ((luhn(F.substr(d, F.lit(1), F.length(d) - 1)) + F.right(d, F.lit(1)).cast("int")) % 10 == 0)

        def changed(text: Column) -> Column:
            return let(only(text, "0-9"), lambda d: put(text, let(
                F.concat(part(d, 1, 1), f.text("card", F.substr(d, F.lit(2), F.length(d) - 2), DIGITS)),
                lambda b: F.concat(b, ((10 - luhn(b) % 10) % 10).cast("string"))), "[0-9]"))

        def run(g: Column) -> Column:
            joined = lambda i, k: F.array_join(F.slice(g, i, k), "")
            numbers = lambda i: F.transform(
                F.sequence(F.least(F.lit(CARD_SIZES[1]), F.size(g) - i + 1), F.lit(1)),
                lambda k: F.struct(k.alias("k"), only(joined(i, k), "0-9").alias("d")))
            best = lambda own: F.coalesce(
                F.get(F.filter(own, lambda c: c["d"].rlike(ISSUED)), F.lit(0)), F.get(own, F.lit(0)))
            places = F.transform(F.sequence(F.lit(1), F.size(g)), lambda i: let(F.filter(numbers(i), lambda c: valid(c["d"])), best))

            def turn(at: Column) -> Column:
                def step(s: Column, i: Column) -> Column:
                    own = F.get(at, i - 1)
                    inner = F.exists(F.slice(at, i + 1, F.coalesce(own["k"], F.lit(1)) - 1), lambda c: F.coalesce(c["d"].rlike(ISSUED), F.lit(False)))
                    here = own.isNotNull() & (own["d"].rlike(ISSUED) | ~inner)
                    done = lambda new: F.struct(
                        F.concat(s["t"], new).alias("t"), (i + own["k"]).alias("next"), (s["n"] + F.when(new == joined(i, own["k"]), 0).otherwise(1)).alias("n"))
                    return (F.when(i < s["next"], s).when(here, let(changed(joined(i, own["k"])), done))
                            .otherwise(F.struct(F.concat(s["t"], F.get(g, i - 1)).alias("t"), s["next"].alias("next"), s["n"].alias("n"))))
                start = F.struct(F.lit("").alias("t"), F.lit(1).alias("next"), F.lit(0).alias("n"))
                return F.aggregate(F.sequence(F.lit(1), F.size(g)), start, step, lambda s: F.struct(s["t"].alias("t"), s["n"].alias("n")))
            return let(places, turn)

        return let(F.regexp_extract_all(x, F.lit("[ -]?[0-9]+"), F.lit(0)), run)

    def iban() -> Column:
        def run(s: Column) -> Column:
            body = F.substr(s, F.lit(5), F.length(s))
            letters = put(body, f.text("iban", only(body, "A-Z"), UPPER), "[A-Z]")
            fresh = let(put(letters, f.text("iban", only(body, "0-9"), DIGITS), "[0-9]"), lambda b: F.concat(
                part(s, 1, 2), F.lpad((98 - mod97(F.concat(b, part(s, 1, 2), F.lit("00")))).cast("string"), 2, "0"), b))
            return fresh

        def valid(t: Column) -> Column:
            s = F.regexp_replace(t, " ", "")
            return (F.length(s) >= 12) & (mod97(F.concat(F.substr(s, F.lit(5), F.length(s)), part(s, 1, 4))) == 1)

        words = F.split(x, " ")  # whole first, then without the last group, and so on
        heads = F.transform(F.sequence(F.size(words), F.lit(1)), lambda k: F.array_join(F.slice(words, 1, k), " "))
        changed = lambda t: F.concat(
            put(t, run(F.regexp_replace(t, " ", "")), "[A-Z0-9]"), F.substr(x, F.length(t) + 1, F.length(x)))
        return let(F.get(F.filter(heads, valid), F.lit(0)), lambda t: F.when(t.isNull(), x).otherwise(changed(t)))

    def ipv4() -> Column:
        def run(o: Column) -> Column:
            octet = lambda i: F.get(o, F.lit(i)).cast("long")
            high = lambda v: F.call_function("div", v, F.lit(256).cast("long"))
            fresh = f.permute("ipv4", octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536),
                              lambda l, r: F.concat_ws(".", high(l).cast("string"), (l % 256).cast("string"), high(r).cast("string"), (r % 256).cast("string")))
            return F.when(F.forall(o, lambda v: v.cast("int") < 256), fresh).otherwise(x)
        return let(F.split(x, r"\."), run)

    def ssn() -> Column:
        area, group, serial = (part(x, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
        valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)

        def spelt(l: Column, r: Column) -> Column:
            k = F.call_function("div", l, F.lit(99).cast("long"))
            return F.concat_ws("-", F.lpad((k + 1 + F.when(k >= 665, 1).otherwise(0)).cast("string"), 3, "0"),
                               F.lpad((l % 99 + 1).cast("string"), 2, "0"), F.lpad((r + 1).cast("string"), 4, "0"))

        left = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1
        return F.when(valid, f.permute("ssn", left, serial - 1, F.lit(898 * 99), F.lit(9999), spelt)).otherwise(x)

    def phone() -> Column:
        """Ten digits by the North American plan, else all after two digits."""
        def run(d: Column) -> Column:
            ten = F.right(d, F.lit(10))
            area, office, line = (part(ten, a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
            plan = x.rlike(r"^(?:\+1(?![0-9])|\+1[2-9]|[(2-9])") & F.length(d).isin(10, 11) & (area >= 200) & (office >= 200)
            in_plan = f.permute("nanp", (area - 200) * 800 + office - 200, line, F.lit(640000), F.lit(10000), lambda l, r: F.concat(
                F.substr(d, F.lit(1), F.length(d) - 10), (F.call_function("div", l, F.lit(800).cast("long")) + 200).cast("string"),
                (l % 800 + 200).cast("string"), F.lpad(r.cast("string"), 4, "0")))
            other = F.concat(part(d, 1, 2), f.text("phone", F.substr(d, F.lit(3), F.length(d)), DIGITS))
            return put(x, F.when(plan, in_plan).otherwise(other), "[0-9]")
        return let(digits, run)

    def date() -> Column:
        def run(p: Column) -> Column:
            get = lambda i: F.get(p, F.lit(i))
            iso = F.length(get(0)) == 4
            us = ~iso & (get(1).cast("int") > 12)  # month first only where day first can't be
            y = F.when(iso, get(0)).otherwise(get(2))
            m = F.when(iso | ~us, get(1)).otherwise(get(0))
            d = F.when(iso, get(2)).when(us, get(1)).otherwise(get(0))
            day = F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
            sep = F.regexp_extract(x, "[-/.]", 0)
            padded = F.length(x) == 10

            def spelt(l: Column, r: Column) -> Column:
                def shown(new: Column) -> Column:
                    two = lambda pattern: F.when(padded, F.date_format(new, pattern * 2)).otherwise(F.date_format(new, pattern))
                    yy, mm, dd = F.date_format(new, "yyyy"), two("M"), two("d")
                    return F.when(iso, F.concat(yy, sep, mm, sep, dd)).when(us, F.concat(mm, sep, dd, sep, yy)).otherwise(F.concat(dd, sep, mm, sep, yy))
                return let(F.date_add(F.to_date(F.lit(FIRST_DAY)), (l * DAYS[1] + r).cast("int")), shown)

            def moved(k: Column) -> Column:
                return f.permute("date", F.call_function("div", k, F.lit(DAYS[1]).cast("long")), k % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), spelt)

            since = F.datediff(day, F.to_date(F.lit(FIRST_DAY))).cast("long")
            return F.when(day.isNull(), x).otherwise(let(since, moved))
        return let(F.split(x, "[-/.]"), run)

    one = lambda new: let(new, lambda v: F.struct(v.alias("t"), F.when(v == x, 0).otherwise(1).alias("n")))
    local = whole(r"\(?[2-9][0-9]{2}\)?[ .-]{1,2}[2-9][0-9]{2}[ .-][0-9]{4}")
    return (F.when(x.contains("@"), one(email()))
            .when(x.rlike("^AKIA"), one(F.concat(F.lit("AKIA"), f.text("key", F.substr(x, F.lit(5), F.lit(16)), UPPER_DIGITS))))
            .when(x.rlike("^[A-Z]{2}[0-9]{2}"), one(iban()))
            .when(x.rlike("^[0-9a-f]*[a-f]"), one(f.text("hex", x, HEX)))
            .when(whole(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), one(ssn()))
            .when(whole(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}"), one(date()))
            .when(whole(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"), one(ipv4()))
            .when(x.rlike(r"^\+") | local, one(phone()))
            .otherwise(card()))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", secrets: bool = True, count_col: str = "n_pseudonyms") -> DataFrame:
    """``docs`` with pseudonyms in the text, and their number in ``count_col``."""
    kinds = [EMAIL, *([ACCESS_KEY, PASSWORD] if secrets else []), IBAN, IPV4, SSN, US_PHONE, PHONE, LOCAL_PHONE, CARD]
    pattern = "|".join([DATE, *kinds])  # the date comes first: it has the numbered groups
    t = F.col("__text")
    hits = F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    names = [c for c in docs.columns if c not in (text_col, count_col)]
    staged = (docs.select(*names, F.col(text_col).alias("__text")).withColumn("__hits", hits)
              .withColumn("__new", F.transform("__hits", lambda x: pseudonym(Feistel(key), x))))
    spliced = F.array_join(F.zip_with(F.split(t, pattern), F.concat(F.col("__new.t"), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    found = F.aggregate("__new", F.lit(0), lambda a, v: a + v["n"])
    return staged.select(*names, F.when(F.size("__hits") > 0, spliced).otherwise(t).alias(text_col),
                         F.greatest(F.coalesce(found, F.lit(0)), F.lit(0)).alias(count_col))
