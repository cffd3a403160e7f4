"""Format-preserving pseudonyms for personal data, by keyed Feistel networks.

Column expressions only. A value is found by its form, validated, and replaced by another
value of the same form: the map is a permutation of the form's values under one key, so equal
values stay equal across documents and different ones stay different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w(.+-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w.-]\d)"
CARD = r"(?<!\d)(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{13,19})(?!\d)"
SOCIAL = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"
DATE = r"(?<![\d-])(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])|(?<![\d/])(?:0?[1-9]|[12]\d|3[01])/(?:0?[1-9]|1[0-2])/(?:19|20)\d{2}(?![\d/])"
#: Kinds in the order in which they are tried at one place.
KINDS = {"email": EMAIL, "ip": IP, "phone": PHONE, "social": SOCIAL, "date": DATE, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())

#: Dates from this day on, this many years of 365 days, are permuted among each other.
FIRST_DAY, YEARS = "1900-01-01", 200


def _digest(*parts: Column | str) -> Column:
    """A number of 48 bits from the key and the other parts."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint")


def permute_number(high: Column, low: Column, highs: int, lows: int, key: str, tweak: str) -> Column:
    """A permutation of the pairs (high, low) with high < highs and low < lows, as a struct (a, b).

    Rounds add a keyed hash of one half to the other in turn, each modulo its own size, so
    every round can be undone and no value leaves the domain.
    """

    def turn(acc: Column, r: Column) -> Column:
        even = F.pmod(acc["a"] + _digest(key, tweak, r, acc["b"]), F.lit(highs))
        odd = F.pmod(acc["b"] + _digest(key, tweak, r, acc["a"]), F.lit(lows))
        first = r % 2 == 0
        return F.struct(F.when(first, even).otherwise(acc["a"]).alias("a"), F.when(first, acc["b"]).otherwise(odd).alias("b"))

    start = F.struct(high.cast("bigint").alias("a"), low.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permute_text(text: Column, key: str, tweak: str) -> Column:
    """A permutation of the texts of one form: letters stay letters of their case, digits digits, the rest stays.

    Both halves take turns; a character moves within its class by a keyed hash of the other
    half and its own place. Texts of one character move by the key alone.
    """

    def moved(half: Column, other: Column, r: Column) -> Column:
        def step(c: Column, i: Column) -> Column:
            k = _digest(key, tweak, r, i, other)
            within = lambda low, size: F.char(F.lit(low) + F.pmod(F.ascii(c) - low + k, F.lit(size)))
            return (
                F.when((c >= "0") & (c <= "9"), within(48, 10)).when((c >= "a") & (c <= "z"), within(97, 26)).when((c >= "A") & (c <= "Z"), within(65, 26)).otherwise(c)
            )

        return F.array_join(F.transform(F.split(half, ""), step), "")

    def turn(acc: Column, r: Column) -> Column:
        return F.struct(acc["b"].alias("a"), moved(acc["a"], acc["b"], r).alias("b"))

    middle = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), middle).alias("a"), F.substring(text, middle + 1, F.length(text)).alias("b"))
    end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return F.concat(end["a"], end["b"])


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes ``payload`` with it a valid card number."""

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.split(F.reverse(payload), ""), weigh), F.lit(0), lambda a, x: a + x)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def is_card(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.right(digits, F.lit(1)) == luhn_digit(F.substring(digits, F.lit(1), F.length(digits) - 1))


def _card(m: Column, key: str) -> Column:
    """The first digit (the network) stays, the others are permuted, the check digit is made anew."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    payload = F.concat(F.substring(digits, 1, 1), permute_text(F.substring(digits, F.lit(2), F.length(digits) - 2), key, "card"))
    made = F.concat(payload, luhn_digit(payload))
    mark = F.substring(m, 5, 1)
    quad = [F.substring(made, i, 4) for i in (1, 5, 9, 13)]
    parted = F.concat(quad[0], mark, quad[1], mark, quad[2], mark, quad[3])
    return F.when(~is_card(m), m).when(mark.isin(" ", "-"), parted).otherwise(made)


def _ip(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))
    low = F.element_at(part, 3) * 256 + F.element_at(part, 4)
    out = permute_number(F.element_at(part, 1) * 256 + F.element_at(part, 2), low, 65536, 65536, key, "ip")
    text = lambda n: F.concat_ws(".", F.floor(n / 256).cast("string"), (n % 256).cast("string"))
    return F.concat_ws(".", text(out["a"]), text(out["b"]))


def _social(m: Column, key: str) -> Column:
    area = F.substring(m, 1, 3).cast("bigint")
    place = area - F.when(area > 666, 2).otherwise(1)
    rest = (F.substring(m, 5, 2).cast("bigint") - 1) * 9999 + F.substring(m, 8, 4).cast("bigint") - 1
    out = permute_number(place, rest, 898, 99 * 9999, key, "social")
    made = out["a"] + F.when(out["a"] >= 665, 2).otherwise(1)
    pad = lambda n, w: F.lpad(n.cast("bigint").cast("string"), w, "0")
    return F.concat_ws("-", pad(made, 3), pad(F.floor(out["b"] / 9999) + 1, 2), pad(out["b"] % 9999 + 1, 4))


def _day(m: Column) -> Column:
    """The day of a written date, counted from the first; NULL for dates that do not exist or lie outside."""
    part = F.split(m, "/")
    turned = F.concat_ws("-", F.get(part, 2), F.lpad(F.get(part, 1), 2, "0"), F.lpad(F.get(part, 0), 2, "0"))
    day = F.datediff(F.try_to_date(F.when(m.contains("/"), turned).otherwise(m), "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("bigint")
    return F.when(day < 365 * YEARS, day)


def _date(m: Column, key: str) -> Column:
    """Days are permuted among all days of the years; the form keeps its order and its zeros."""
    day = _day(m)
    out = permute_number(F.floor(day / YEARS), day % YEARS, 365, YEARS, key, "date")
    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), (out["a"] * YEARS + out["b"]).cast("int"))
    both = F.regexp_like(m, F.lit(r"^\d\d/\d\d/"))
    return (
        F.when(~m.contains("/"), F.date_format(moved, "yyyy-MM-dd")).when(both, F.date_format(moved, "dd/MM/yyyy")).otherwise(F.date_format(moved, "d/M/yyyy"))
    )


def kind_of(m: Column) -> Column:
    """Which kind a found value is; NULL for dates and digits that fail their check."""
    out = F.when(m.contains("@"), F.lit("email"))
    for name in ("ip", "social", "date", "phone"):
        form = F.regexp_like(m, F.lit(f"^(?:{KINDS[name]})$"))
        out = out.when(form & _day(m).isNotNull() if name == "date" else form, F.lit(name))
    return out.when(F.regexp_like(m, F.lit(f"^(?:{CARD})$")) & is_card(m), F.lit("card"))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """Another value of the same form; ``m`` itself if it is of no known kind."""
    at = F.instr(m, "@")
    host = F.substring(m, at + 1, F.length(m))
    top = F.regexp_extract(host, r"\.[^.]*$", 0)
    email = F.concat(
        permute_text(F.substring(m, F.lit(1), at - 1), key, "local"), F.lit("@"), permute_text(F.substring(host, F.lit(1), F.length(host) - F.length(top)), key, "host"), top
    )
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0)
    phone = F.concat(code, permute_text(F.substring(m, F.length(code) + 1, F.length(m)), key, "phone"))
    return (
        F.when(kind == "email", email).when(kind == "ip", _ip(m, key)).when(kind == "phone", phone).when(kind == "social", _social(m, key)).when(kind == "date", _date(m, key))
        .when(kind == "card", _card(m, key)).otherwise(m)
    )


def found(docs: DataFrame, *, key: str) -> DataFrame:
    """The rows of ``docs`` as column ``row``, with ``kinds`` (of the values found) and ``made`` (the new text).

    A text is cut at its matches once, and put together again with the pseudonyms in their
    places; texts without a digit or an @ are not searched. NULL stays NULL, empty stays empty.
    """
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("t"))
    base = base.withColumn("hits", F.when(F.regexp_like("t", F.lit("[0-9@]")), F.regexp_extract_all("t", F.lit(ANY), F.lit(0))))
    base = base.withColumn("gaps", F.when(F.size("hits") > 0, F.split("t", ANY, -1)))
    base = base.withColumn("kinds", F.when(F.size("hits") > 0, F.transform("hits", kind_of)).otherwise(F.array().cast("array<string>")))
    base = base.withColumn("news", F.when(F.size("hits") > 0, F.transform("hits", lambda m, i: pseudonym(m, F.get("kinds", i), key))))
    pieces = F.transform("gaps", lambda g, i: F.concat(g, F.coalesce(F.get("news", i), F.lit(""))))
    made = F.when(F.size("hits") > 0, F.array_join(pieces, "")).otherwise(F.col("t"))
    return base.select("row", "kinds", made.alias("made"))


def pseudonymise(docs: DataFrame, *, key: str) -> DataFrame:
    """``docs`` with every validated e-mail address, IP address, phone, social security and card number and
    date in ``text`` replaced by its pseudonym under ``key``. Columns, rows and all other text are as before.
    """
    out = found(docs, key=key)
    return out.select(*[F.col("made").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
