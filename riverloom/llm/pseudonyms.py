"""Format-preserving pseudonyms for personal numbers, dates and addresses, by keyed Feistel permutations.

Each kind is found by a pattern and validated (check digits, octets, calendar dates); what fails stays as it is. A
value's digits go through a Feistel network whose halves are changed in turn by digits of an HMAC of the other half, so
the pseudonym is one of the values of the same format, two values of a kind and format never share one, and a value has
the same one in every document, however its groups are separated. Where only some values of a format are valid, the
network is walked on until its result is valid as well, which keeps it a permutation. Check digits are computed anew,
and separators stay in place. Everything is Spark SQL; the key reaches the plan as a scalar subquery, so neither plans
nor event logs show it.

======== ============================================ =======================================================
kind     validated by                                 kept; permuted
======== ============================================ =======================================================
email    form                                         separators, last label, with ``.invalid`` behind it; lower-cased
                                                      letters and digits. Over 254 characters: an HMAC of 256 bits
                                                      in place of the local part, which is no permutation
iban     country, its length, remainder 1 modulo 97   country, letters; digits of the account; check digits anew
card     13 to 19 digits, Luhn sum                    length, first digit, separators; digits; check digit anew
phone    a plus sign and 7 to 15 digits, or ten       country code; rest; numbers that fit the North American plan,
         digits grouped and fit for the North         with +1 or without, stay within it, others outside of it
         American plan
ssn      123-45-6789 with area not 000, 666, 9xx,     form; all nine digits, among valid numbers
         group not 00, serial not 0000
ip       four octets up to 255                        form; the 32 bits as 8 hexadecimal digits
date     a calendar date of 1900 to 2099 written      form; the day among the 73,049 of that span
         year first with - or /, or day first with .
======== ============================================ =======================================================
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Most steps to a valid value; at least 64 % of a format's values are valid, so the chance to need more is below 1e-28.
WALK = 64
DIGITS, HEX = "0123456789", "0123456789abcdef"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = DIGITS + LETTERS.lower()
#: Days from 1900-01-01 to 2099-12-31 as a product, so that a Feistel network covers them exactly.
DAYS = (17, 4297)
FIRST_DAY = "1900-01-01"
LONGEST_EMAIL = 254

#: Lengths of IBANs by country, from the public registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31,
    "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
#: Country codes of one and two digits; all others have three.
COUNTRY = r"\A(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Ten digits that fit the North American plan.
NORTH_AMERICAN = r"\A[2-9][0-9]{2}[2-9][0-9]{6}\z"


def _ibans() -> str:
    """Countries of a length, check digits, and as many letters and digits as the length leaves, blanks between any."""
    by: dict[int, list[str]] = {}
    for land, n in IBAN_LENGTHS.items():
        by.setdefault(n, []).append(land)
    return "|".join(f"(?:{'|'.join(lands)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, lands in sorted(by.items()))


_NOT_IN_NUMBER = r"(?<![0-9A-Za-z])"
_END = r"(?![0-9A-Za-z])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}+",
    "iban": _NOT_IN_NUMBER + f"(?:{_ibans()})" + _END,
    "date": _NOT_IN_NUMBER + r"(?<![-/.])(?:(?:19|20)[0-9]{2}([-/])[0-9]{2}\1[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2})" + _END + r"(?![-/][0-9])(?!\.[0-9])",
    "ssn": _NOT_IN_NUMBER + r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END + r"(?!-[0-9])",
    "ip": _NOT_IN_NUMBER + r"(?<!\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}" + _END + r"(?!\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\+(?:1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|(?!1[ (.-])[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4})"
    r"|\([2-9][0-9]{2}\) ?[2-9][0-9]{2}[ .-][0-9]{4}|[2-9][0-9]{2}-[2-9][0-9]{2}-[0-9]{4}|[2-9][0-9]{2}\.[2-9][0-9]{2}\.[0-9]{4})" + _END + r"(?![.-][0-9])",
    "card": _NOT_IN_NUMBER + r"(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}-[0-9]{6}-[0-9]{5}|[0-9]{4} [0-9]{6} [0-9]{5})" + _END,
}
KINDS = list(PATTERNS)
NUMBERS = "(?=[0-9A-Z+(])(?:" + "|".join(p.replace(r"\1", r"\k<sep>").replace(r"([-/])", r"(?<sep>[-/])") for k, p in PATTERNS.items() if k != "email") + ")"
ANY = PATTERNS["email"] + "|" + NUMBERS


def pads(key: str) -> tuple[bytes, bytes]:
    """The inner and outer blocks of HMAC-SHA256 for a key."""
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytes(x ^ 0x36 for x in block), bytes(x ^ 0x5C for x in block)


def with_key(df: DataFrame, key: str, name: str = "__key") -> DataFrame:
    """``df`` with a column of the key's blocks, from a subquery that is run once and shows no values in the plan."""
    row = df.sparkSession.createDataFrame([(pads(key),)], "k struct<i:binary,o:binary>")
    return df.withColumn(name, row.scalar())


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it stands in the result."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hash(key: Column, kind: str, turn: Column, half: Column) -> Column:
    """HMAC-SHA256 as hexadecimal digits; ``key`` holds the blocks of ``pads``."""
    message = F.concat_ws("|", F.lit(kind), turn.cast("string"), half).cast("binary")
    return F.sha2(F.concat(key["o"], F.unhex(F.sha2(F.concat(key["i"], message), 256))), 256)


def _shifted(half: Column, other: Column, turn: Column, alphabet: str, key: Column, kind: str) -> Column:
    """``half`` with each digit moved on by four hexadecimal digits of keyed hashes of the other half."""
    base = len(alphabet)

    def moved(h: Column) -> Column:
        def one(i: Column) -> Column:
            shift = F.conv(F.substr(h, (i - 1) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            old = F.instr(F.lit(alphabet), F.substr(half, i, F.lit(1))) - 1
            return F.substr(F.lit(alphabet), F.pmod(old + shift, F.lit(base)) + 1, F.lit(1))

        return F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(half)), one))

    # a hash has 64 digits: sixteen shifts
    hashes = F.transform(F.sequence(F.lit(0), F.floor((F.length(half) - 1) / 16).cast("int")), lambda i: _hash(key, kind, turn * 100 + i, other))
    return F.when(F.length(half) == 0, half).otherwise(let(F.concat_ws("", hashes), moved))


def feistel(digits: Column, key: Column, kind: str, alphabet: str = DIGITS) -> Column:
    """A keyed permutation of the strings of one length over an alphabet; a single digit is shifted."""

    def halves(x: Column) -> Column:
        left = F.floor(F.length(x) / 2).cast("int")
        return F.struct(F.substr(x, F.lit(1), left).alias("l"), F.substr(x, left + 1, F.length(x)).alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        odd = F.pmod(i, F.lit(2)) == 1
        return F.struct(
            F.when(odd, acc["l"]).otherwise(_shifted(acc["l"], acc["r"], i, alphabet, key, kind)).alias("l"),
            F.when(odd, _shifted(acc["r"], acc["l"], i, alphabet, key, kind)).otherwise(acc["r"]).alias("r"),
        )

    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, let(digits, halves), turn, lambda acc: F.concat(acc["l"], acc["r"]))


def feistel_number(n: Column, key: Column, kind: str, factors: tuple[int, int]) -> Column:
    """A keyed permutation of 0 .. a * b - 1."""
    a, b = factors
    start = let(n, lambda x: F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r")))

    def draw(i: Column, other: Column) -> Column:
        return F.conv(F.substr(_hash(key, kind, i, other.cast("string")), F.lit(1), F.lit(12)), 16, 10).cast("long")

    def turn(acc: Column, i: Column) -> Column:
        odd = F.pmod(i, F.lit(2)) == 1
        return F.struct(
            F.when(odd, acc["l"]).otherwise(F.pmod(acc["l"] + draw(i, acc["r"]), F.lit(a))).cast("long").alias("l"),
            F.when(odd, F.pmod(acc["r"] + draw(i, acc["l"]), F.lit(b))).otherwise(acc["r"]).cast("long").alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: acc["l"] * b + acc["r"])


def walked(value: Column, step, valid) -> Column:
    """``step`` of a value until ``valid`` says of the result what it says of the value: a permutation of each set."""
    start = F.struct(value.alias("v"), F.lit(False).alias("done"))

    def go(acc: Column, _: Column) -> Column:
        new = let(step(acc["v"]), lambda v: F.struct(v.alias("v"), (valid(v) == valid(value)).alias("done")))
        return F.when(acc["done"], acc).otherwise(new)

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, go, lambda acc: acc["v"])


def valid_ssn(digits: Column) -> Column:
    return ~digits.rlike(r"\A(?:000|666|9)") & ~digits.rlike(r"\A...00") & ~digits.rlike(r"0000\z")


def only(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"[^{chars}]", "")


def refill(shape: Column, chars: str, value: Column) -> Column:
    """``shape`` with its characters of a class replaced, in order, by those of ``value``."""

    def filled(v: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            before = F.length(only(F.substr(shape, F.lit(1), i + 1), chars))
            return F.when(c.rlike(f"[{chars}]"), F.substr(v, before, F.lit(1))).otherwise(c)

        return F.concat_ws("", F.transform(F.split(shape, ""), one))

    return let(value, filled)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits of which the last counts once."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(F.pmod(i, F.lit(2)) == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda t, x: t + x)


def mod97(text: Column) -> Column:
    """A string of digits and capital letters, letters as 10 to 35, modulo 97."""

    def step(t: Column, c: Column) -> Column:
        v = F.instr(F.lit(DIGITS + LETTERS), c) - 1
        return F.pmod(F.when(v > 9, t * 100 + v).otherwise(t * 10 + v), F.lit(97)).cast("int")

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _date(x: Column) -> Column:
    """The calendar day that a date text names, null where there is none."""
    flat = F.when(
        x.contains("."), F.concat_ws("-", F.substr(x, F.lit(7), F.lit(4)), F.substr(x, F.lit(4), F.lit(2)), F.substr(x, F.lit(1), F.lit(2)))
    ).otherwise(F.replace(x, F.lit("/"), F.lit("-")))
    return F.try_to_date(flat, "yyyy-MM-dd")


def kind_of(x: Column) -> Column:
    """The kind of a text that a pattern found, null where the value is not valid."""
    whole = {k: x.rlike(rf"\A(?:{p})\z") for k, p in PATTERNS.items()}
    flat = F.replace(x, F.lit(" "), F.lit(""))
    digits = only(x, "0-9")
    octets = F.split(x, r"\.")
    valid = {
        "email": F.lit(True),
        "iban": (mod97(F.concat(F.substr(flat, F.lit(5), F.length(flat)), F.substr(flat, F.lit(1), F.lit(4)))) == 1),
        "date": _date(x).isNotNull(),
        "ssn": valid_ssn(digits),
        "ip": F.forall(octets, lambda o: o.cast("int") <= 255),
        "phone": F.length(digits).between(7, 15),
        "card": F.pmod(luhn_sum(digits), F.lit(10)) == 0,
    }
    out = F.lit(None).cast("string")
    for k in reversed(KINDS):
        out = F.when(whole[k], F.when(valid[k], F.lit(k))).otherwise(out)
    return out


def pseudonym(x: Column, kind: Column, key: Column) -> Column:
    """The pseudonym of a valid value of a kind; ``key`` is a column of ``with_key``."""
    digits = only(x, "0-9")
    n = F.length(digits)
    flat = F.replace(x, F.lit(" "), F.lit(""))
    head, last = (F.regexp_extract(F.lower(x), r"\A(.*)\.([a-z0-9-]+)\z", k) for k in (1, 2))
    long = F.concat(F.lit("u"), _hash(key, "email", F.lit(0), F.lower(x)), F.lit("@example.invalid"))
    email = F.concat(refill(head, "a-z0-9", feistel(only(head, "a-z0-9"), key, "email", LOWER)), F.lit("."), last, F.lit(".invalid"))
    email = F.when(F.length(x) > LONGEST_EMAIL, long).otherwise(email)
    checked = lambda d: F.concat(d, F.pmod(10 - F.pmod(luhn_sum(F.concat(d, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), feistel(F.substr(digits, F.lit(2), n - 2), key, "card"))
    card = refill(x, "0-9", let(body, checked))
    country = F.when(x.startswith("+"), F.regexp_extract(digits, COUNTRY, 1)).otherwise("1")
    rest = F.when(x.startswith("+"), F.substr(digits, F.length(country) + 1, n)).otherwise(digits)
    turned = let(rest, lambda r: walked(r, lambda v: feistel(v, key, "phone"), lambda v: (country == "1") & v.rlike(NORTH_AMERICAN)))
    phone = refill(x, "0-9", F.when(x.startswith("+"), F.concat(country, turned)).otherwise(turned))
    ssn = refill(x, "0-9", let(digits, lambda d: walked(d, lambda v: feistel(v, key, "ssn"), valid_ssn)))
    octets = F.transform(F.split(x, r"\."), lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0"))
    octet = lambda h: F.transform(F.sequence(F.lit(1), F.lit(7), F.lit(2)), lambda i: F.conv(F.substr(h, i, F.lit(2)), 16, 10))
    ip = let(feistel(F.concat_ws("", octets), key, "ip", HEX), lambda h: F.concat_ws(".", octet(h)))
    day = feistel_number(F.datediff(_date(x), F.to_date(F.lit(FIRST_DAY))).cast("long"), key, "date", DAYS)
    written = lambda d: (
        F.when(x.contains("."), F.date_format(d, "dd.MM.yyyy"))
        .when(x.contains("/"), F.date_format(d, "yyyy/MM/dd"))
        .otherwise(F.date_format(d, "yyyy-MM-dd"))
    )
    date = let(F.date_add(F.to_date(F.lit(FIRST_DAY)), day.cast("int")), written)
    account = F.substr(flat, F.lit(5), F.length(flat))
    land = F.substr(flat, F.lit(1), F.lit(2))
    two = lambda a: F.lpad((98 - mod97(F.concat(a, land, F.lit("00")))).cast("string"), 2, "0")
    account = refill(account, "0-9", feistel(only(account, "0-9"), key, "iban"))
    iban = let(account, lambda a: refill(x, "0-9A-Z", F.concat(land, two(a), a)))
    by = {"email": email, "card": card, "phone": phone, "ssn": ssn, "ip": ip, "date": date, "iban": iban}
    out = F.lit(None).cast("string")
    for k, v in by.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in the text, and n_pseudonyms and kinds (the kinds met, sorted).

    A text is cut into what stands between candidates and the candidates; valid ones are replaced and the parts joined
    again, all within the row: nothing is shuffled. Null texts stay null with no pseudonyms, empty ones empty; texts of
    any length are read whole, and an empty table gives an empty one. Rows that repeat have the same result, as it
    depends on text and key alone. Where two kinds could begin at one place the one first in the table above counts.
    Other columns stay; columns of ``docs`` named like new ones are replaced.
    """
    docs = docs.drop("n_pseudonyms", "kinds")
    names = docs.columns
    docs = with_key(docs, key)
    text = F.col(text_col)
    cut = rf"(?s)(.*?)({ANY}|\z)"
    some = (text.rlike("[0-9]") & text.rlike(NUMBERS)) | (text.contains("@") & text.rlike(PATTERNS["email"]))
    gaps, found = F.regexp_extract_all(text, F.lit(cut), 1), F.regexp_extract_all(text, F.lit(cut), 2)
    empty = F.array().cast("array<struct<gap:string,value:string,kind:string>>")
    parts = F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value"), F.when(v != "", kind_of(v)).alias("kind")))
    docs = docs.withColumn("__parts", F.when(some, parts).otherwise(empty))
    new = lambda p: F.concat(p["gap"], F.coalesce(pseudonym(p["value"], p["kind"], F.col("__key")), p["value"]))
    kinds = F.filter(F.transform("__parts", lambda p: p["kind"]), lambda k: k.isNotNull())
    docs = docs.withColumn("__text", F.when(some, F.concat_ws("", F.transform("__parts", new))).otherwise(text))
    docs = docs.withColumn("n_pseudonyms", F.size(kinds).cast("long")).withColumn("kinds", F.array_sort(F.array_distinct(kinds)))
    return docs.select(*[F.col("__text").alias(c) if c == text_col else F.col(f"`{c}`") for c in names], "n_pseudonyms", "kinds")
