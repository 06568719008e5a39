"""Format-preserving pseudonyms for personal data, in SQL expressions alone.

What is found is checked first (card numbers by Luhn, IPv4 octets, telephone and social
security number ranges, calendar dates) and then permuted within its format by a
keyed Feistel network, so an equal value gets the same valid-looking pseudonym in
every document and different values never share one:

* numbers and dates are a pair (a, b) of indices below (A, B); a round adds a keyed
  digest of one half to the other, modulo its range. A card keeps its length and
  separators and gets the check digit of its new digits.
* the local part of e-mail addresses and the body of keys and secrets are two half
  strings; a round shifts each character of one half within its alphabet by a keystream
  of the other half. Separators, letter case and domain stay.

Dates are those of the years 1800 to 2199 as yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, dd/mm/yyyy
and mm/dd/yyyy (where the second number can't be a month), alone or before a time (T..).

Cases: a null text stays null; a text without finds is unchanged, byte for byte; what
fails its check is left alone. Values at the same place may overlap only
once: the first kind in `KINDS` that fits from the left wins. A card beside other numbers
(expiry, security code, item number) is found at each number of their run, and of
overlapping ones with a right check digit the first is replaced. Texts of any length are
searched whole, within one row. Repeated rows are treated
alike. All other columns are passed on as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import unused

ROUNDS = 8

# The formats, in order of preference.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "secret": r"(?i:password|passwd|token|secret|api_key)[\"']?[ ]?[=:][ ]?[\"']?[0-9a-f]{16,64}(?![0-9A-Za-z])",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "phone": r"(?<![\w.+-])(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!(?!T\d{2}:)[\w/-])",
}
# Card numbers are looked for within a whole run of numbers with one blank or hyphen
# between, up to a number where another kind begins: those in a usual grouping at any
# number of the run, then others of 13 to 19 digits in what is left.
_NUMBER = r"\d++(?!\w|-(?!\d++(?!\w)))"
_NEXT = "|".join(KINDS[k] for k in ("email", "ip", "phone", "ssn", "date"))
KINDS["card"] = rf"(?<![\w-])(?=(?:\d[ -]?){{13}}){_NUMBER}(?:[ -](?!{_NEXT}){_NUMBER})*+"
USUAL = r"(?<!\d)(?=((?:(?:\d{4}[ -]){3}\d{4}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19})(?!\d))?)\d++"
FREE = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
ANY = "|".join(KINDS.values())
# No find is without one of these: all others have a digit or an @.
HINT = r"[0-9@]|AKIA[A-Z]{16}|(?i:password|passwd|token|secret|api_key)"
# 400 years of the calendar are 146,097 days, or 189 times 773.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
# 88,497 of them are later than the 12th of their 4,800 months, or 9 times 9,833.
LATE_DAYS, MONTHS = (9, 9833), 4800
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
HEX = ("0123456789abcdef",)


def _digest(secret: str, kind: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(secret), F.lit(kind), turn.cast("string"), half.cast("string")), 256)


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def permuted(a: Column, b: Column, below_a: Column, below_b: Column, kind: str, secret: str) -> Column:
    """struct(a, b): a keyed permutation of the pairs below (below_a, below_b)."""

    def turn(s: Column, r: Column) -> Column:
        first = r % 2 == 0
        amount = _number(F.substring(_digest(secret, kind, r, F.when(first, s["b"]).otherwise(s["a"])), 1, 15))
        return F.struct(
            F.when(first, F.pmod(s["a"] + F.pmod(amount, below_a), below_a)).otherwise(s["a"]).alias("a"),
            F.when(first, s["b"]).otherwise(F.pmod(s["b"] + F.pmod(amount, below_b), below_b)).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.array(*(F.lit(r) for r in range(ROUNDS))), start, turn)


def _shifted(half: Column, other: Column, r: Column, kind: str, secret: str, alphabets: tuple[str, ...]) -> Column:
    def char(i: Column) -> Column:
        c = F.substr(half, i, F.lit(1))
        block = F.concat_ws(":", F.lower(other), F.floor((i - 1) / 32).cast("string"))
        byte = F.substr(_digest(secret, kind, r, block), (F.pmod(i - 1, F.lit(32)) * 2 + 1).cast("int"), F.lit(2))
        out = c
        for letters in alphabets:
            at = F.instr(F.lit(letters), c)
            to = F.pmod(at - 1 + _number(byte), F.lit(len(letters))) + 1
            out = F.when((at > 0) & (c != ""), F.substr(F.lit(letters), to.cast("int"), F.lit(1))).otherwise(out)
        return out

    return F.when(F.length(half) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), char), "")).otherwise("")


def permuted_text(text: Column, kind: str, secret: str, alphabets: tuple[str, ...] = ALPHABETS) -> Column:
    """A keyed permutation of the strings with the same alphabet at every place."""

    def turn(s: Column, r: Column) -> Column:
        first = r % 2 == 0
        return F.struct(
            F.when(first, _shifted(s["a"], s["b"], r, kind, secret, alphabets)).otherwise(s["a"]).alias("a"),
            F.when(first, s["b"]).otherwise(_shifted(s["b"], s["a"], r, kind, secret, alphabets)).alias("b"),
        )

    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), cut).alias("a"), F.substr(text, cut + 1, F.length(text)).alias("b"))
    return F.aggregate(F.array(*(F.lit(r) for r in range(ROUNDS))), start, turn, lambda s: F.concat(s["a"], s["b"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _part(digits: Column, at: int, n: int) -> Column:
    return F.substring(digits, at, n).try_cast("long")


def _padded(value: Column, n: int | Column) -> Column:
    return F.lpad(value.cast("string"), n, "0") if isinstance(n, int) else F.lpad(value.cast("string"), n, F.lit("0"))


def _filled(form: Column, digits: Column) -> Column:
    """`form` with its digits replaced in order."""

    def char(i: Column) -> Column:
        c = F.substr(form, i, F.lit(1))
        place = F.length(_digits(F.substr(form, F.lit(1), i)))
        return F.when(c.between("0", "9"), F.substr(digits, place, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), char), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of the digits that stand before the check digit."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.pmod(F.length(digits) - i, F.lit(2)) == 0
        return total + F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _check_digit(digits: Column) -> Column:
    return F.pmod(10 - F.pmod(_luhn(digits), F.lit(10)), F.lit(10)).cast("string")


def _email(m: Column, secret: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(permuted_text(local, "email", secret), F.substr(m, F.length(local) + 1, F.length(m)))


def _secret(m: Column, secret: str) -> Column:
    body = F.regexp_extract(m, r"([0-9a-f]{16,64})$", 1)
    label = F.substr(m, F.lit(1), F.length(m) - F.length(body))
    return F.concat(label, permuted_text(body, "secret", secret, HEX))


def _key(m: Column, secret: str) -> Column:
    return F.concat(F.lit("AKIA"), permuted_text(F.substr(m, F.lit(5), F.lit(16)), "key", secret))


def _ip(m: Column, secret: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    good = F.forall(octets, lambda o: o <= 255)
    half = F.lit(65536)
    two = permuted(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], half, half, "ip", secret)

    def dotted(s: Column) -> Column:
        parts = [F.floor(s["a"] / 256), F.pmod(s["a"], F.lit(256)), F.floor(s["b"] / 256), F.pmod(s["b"], F.lit(256))]
        return F.concat_ws(".", *(p.cast("string") for p in parts))

    return F.when(good, _once(two, dotted))


def _once(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _phone(m: Column, secret: str) -> Column:
    all_digits = _digits(m)
    ten = F.right(all_digits, F.lit(10))
    area, local = _part(ten, 1, 3) - 200, _part(ten, 4, 7) - 2_000_000
    new = permuted(area, local, F.lit(800), F.lit(8_000_000), "phone", secret)
    front = F.substr(all_digits, F.lit(1), F.length(all_digits) - 10)
    made = _once(new, lambda s: _filled(m, F.concat(front, (s["a"] + 200).cast("string"), (s["b"] + 2_000_000).cast("string"))))
    return F.when((area >= 0) & (local >= 0), made)


def _ssn(m: Column, secret: str) -> Column:
    # Areas 001 to 899 without 666, groups from 01, serial numbers from 0001.
    nine = _digits(m)
    area, group, serial = _part(nine, 1, 3), _part(nine, 4, 2), _part(nine, 6, 4)
    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    new = permuted(
        area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), "ssn", secret
    )

    def made(s: Column) -> Column:
        back = s["a"] + F.when(s["a"] >= 665, 2).otherwise(1)
        parts = [_padded(back, 3), _padded(F.floor(s["b"] / 9999) + 1, 2), _padded(F.pmod(s["b"], F.lit(9999)) + 1, 4)]
        return _filled(m, F.concat(*parts))

    return F.when(good, _once(new, made))


def _date(m: Column, secret: str) -> Column:
    digits = _digits(m)
    year_first = F.length(F.regexp_extract(m, r"^\d+", 0)) == 4
    # Of nn/nn/yyyy the second is the day where it can't be a month. Such dates stay
    # among themselves, so that their pseudonyms read the same way.
    late = ~year_first & F.regexp_like(m, F.lit("/")) & (F.substring(digits, 3, 2) > "12")
    first_two, next_two = F.substring(digits, 1, 2), F.substring(digits, 3, 2)
    year = F.when(year_first, F.substring(digits, 1, 4)).otherwise(F.substring(digits, 5, 4))
    month = F.when(year_first, F.substring(digits, 5, 2)).when(late, first_two).otherwise(next_two)
    day = F.when(year_first, F.substring(digits, 7, 2)).when(late, next_two).otherwise(first_two)
    when = F.concat_ws("-", year, month, day).try_cast("date")
    first, (a, b), (c, d) = F.lit(FIRST_DAY).cast("date"), DAYS, LATE_DAYS
    n = F.datediff(when, first)
    new = permuted(F.floor(n / b), F.pmod(n, F.lit(b)), F.lit(a), F.lit(b), "date", secret)
    months = (F.year(when) - F.year(first)) * 12 + F.month(when) - 1
    rank = n - 12 * (months + 1)
    new_late = permuted(F.floor(rank / d), F.pmod(rank, F.lit(d)), F.lit(c), F.lit(d), "late date", secret)

    def made(s: Column) -> Column:
        to = F.date_add(first, (s["a"] * b + s["b"]).cast("int"))
        return _filled(m, F.when(year_first, F.date_format(to, "yyyyMMdd")).otherwise(F.date_format(to, "ddMMyyyy")))

    def before(month: Column) -> Column:
        """Late days before a month."""
        return F.datediff(F.add_months(first, month), first) - 12 * month

    def made_late(s: Column) -> Column:
        at = (s["a"] * d + s["b"]).cast("int")
        near = F.floor(at * (MONTHS / (c * d))).cast("int")  # off by one month at most
        of = F.array_max(F.filter(F.sequence(near - 1, near + 1), lambda k: before(k) <= at))
        to = _once(of, lambda k: F.date_add(F.add_months(first, k), at - before(k) + 12))
        return _filled(m, F.date_format(to, "MMddyyyy"))

    good = when.isNotNull() & n.between(0, a * b - 1)
    return F.when(good & late, _once(new_late, made_late)).when(good, _once(new, made))


def _card(m: Column, secret: str) -> Column:
    digits = _digits(m)
    n = F.length(digits) - 1  # without the check digit
    body = F.substr(digits, F.lit(1), n)
    cut = F.floor(n / 2).cast("int")
    size = [F.pow(F.lit(10.0), k).cast("long") for k in (cut, n - cut)]
    new = permuted(
        F.substr(body, F.lit(1), cut).cast("long"), F.substr(body, cut + 1, n).cast("long"), *size, "card", secret
    )
    joined = _once(new, lambda s: F.concat(_padded(s["a"], cut), _padded(s["b"], n - cut)))
    made = _once(joined, lambda d: _filled(m, F.concat(d, _check_digit(d))))
    return F.when(_valid(m), made)


def _valid(m: Column) -> Column:
    """Whether the check digit of a card is right."""
    digits = _digits(m)
    return _check_digit(F.substr(digits, F.lit(1), F.length(digits) - 1)) == F.right(digits, F.lit(1))


def _free_cards(m: Column, secret: str) -> Column:
    """struct(n, text): m with the cards of any grouping replaced, and their number."""
    found = F.transform(
        F.regexp_extract_all(m, F.lit(FREE), F.lit(0)),
        lambda c: _once(_card(c, secret), lambda t: F.struct(t.isNotNull().alias("good"), F.coalesce(t, c).alias("text"))),
    )

    def joined(f: Column) -> Column:
        parts = F.zip_with(F.split(m, FREE, -1), f["text"], lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.struct(F.size(F.filter(f, lambda c: c["good"])).alias("n"), F.array_join(parts, "").alias("text"))

    return _once(found, joined)


def _cards(m: Column, secret: str) -> Column:
    """The like for a run of numbers, those in a usual grouping first."""
    # By number of the run: how many numbers the card that begins there has, or 0.
    lengths = F.transform(
        F.regexp_extract_all(m, F.lit(USUAL), F.lit(1)),
        lambda c: F.when((c != "") & _valid(c), F.size(F.split(c, "[ -]"))).otherwise(0),
    )
    numbers = F.regexp_extract_all(m, F.lit(r"\d++[ -]?"), F.lit(0))

    def starts(length: Column) -> Column:
        # Numbers are counted from 1. The last start is behind the run.
        begin = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at"))

        def step(s: Column, i: Column) -> Column:
            more = F.struct((i + F.element_at(length, i)).alias("next"), F.concat(s["at"], F.array(i)).alias("at"))
            return F.when((F.element_at(length, i) > 0) & (i >= s["next"]), more).otherwise(s)

        kept = F.aggregate(F.sequence(F.lit(1), F.size(length)), begin, step, lambda s: s["at"])
        return F.concat(kept, F.array(F.size(length) + 1))

    def text(numbers: Column, first: Column, behind: Column) -> Column:
        return F.array_join(F.slice(numbers, first, behind - first), "")

    def pieces(x: Column) -> Column:
        at, length, numbers = x["at"], x["length"], x["numbers"]

        def piece(to: Column, k: Column) -> Column:
            # What stands before the k-th start, and the card there.
            before = F.element_at(at, F.greatest(k, F.lit(1)))
            since = F.when(k > 0, before + F.element_at(length, F.least(before, F.size(length)))).otherwise(1)
            rest = _free_cards(text(numbers, since, to), secret)
            last = to > F.size(length)
            card = text(numbers, to, to + F.when(last, 0).otherwise(F.element_at(length, F.least(to, F.size(length)))))
            bare = F.regexp_replace(card, "[ -]$", "")
            new = F.when(last, F.lit("")).otherwise(
                F.concat(_card(bare, secret), F.substr(card, F.length(bare) + 1, F.length(card)))
            )
            return _once(
                rest, lambda r: F.struct((r["n"] + F.when(last, 0).otherwise(1)).alias("n"), F.concat(r["text"], new).alias("text"))
            )

        return F.transform(at, piece)

    def joined(p: Column) -> Column:
        n = F.aggregate(p, F.lit(0), lambda total, x: total + x["n"])
        return F.struct(n.alias("n"), F.array_join(F.transform(p, lambda x: x["text"]), "").alias("text"))

    x = _once(
        F.struct(lengths.alias("length"), numbers.alias("numbers")),
        lambda y: F.struct(starts(y["length"]).alias("at"), y["length"].alias("length"), y["numbers"].alias("numbers")),
    )
    return _once(_once(x, pieces), joined)


_MAKERS = {"email": _email, "secret": _secret, "key": _key, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date}


def _kind(m: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        kind = F.when(F.regexp_like(m, F.lit(f"^(?:{pattern})$")), name).otherwise(kind)
    return kind


def _pseudonym(m: Column, secret: str) -> Column:
    """struct(kinds, text): the kinds replaced in a find, none where it fails its check."""

    def made(kind: Column) -> Column:
        new = F.lit(None).cast("string")
        for name, maker in _MAKERS.items():
            new = F.when(kind == name, maker(m, secret)).otherwise(new)
        one = _once(new, lambda t: F.struct(F.when(t.isNotNull(), 1).otherwise(0).alias("n"), F.coalesce(t, m).alias("text")))
        found = F.when(kind == "card", _cards(m, secret)).otherwise(one)
        return _once(found, lambda f: F.struct(F.array_repeat(kind, f["n"]).alias("kinds"), f["text"].alias("text")))

    return _once(_kind(m), made)


def pseudonymized(docs: DataFrame, secret: str, found: str | None = None) -> DataFrame:
    """docs with their text column pseudonymized under the key `secret`.

    found: name of a column to add with the kinds replaced, in order of the text.
    """
    text = F.col("text").cast("string")
    hinted = F.when(F.regexp_like(text, F.lit(HINT)), text)
    finds = F.coalesce(F.regexp_extract_all(hinted, F.lit(ANY), F.lit(0)), F.array().cast("array<string>"))
    new = unused("new", docs)
    out = docs.withColumn(new, F.transform(finds, lambda m: _pseudonym(m, secret)))
    texts = F.transform(F.col(new), lambda p: p["text"])
    between = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(between, texts, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = out.withColumn("text", F.when(F.size(new) > 0, joined).otherwise(text))
    if found:
        out = out.withColumn(found, F.flatten(F.transform(F.col(new), lambda p: p["kinds"])))
    return out.drop(new)
