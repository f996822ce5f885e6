"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Values that a pattern finds and a check confirms are permuted within their own format by a keyed Feistel network, so equal
values become equal pseudonyms in every document and different values of one length stay different:

- payment card numbers (13 to 19 digits, blanks or hyphens between allowed, Luhn sum 0): the digits but the last are permuted
  and the last becomes the check digit, so that the pseudonym is a valid number too;
- phone numbers: + and a country code of the international plan, 8 to 15 digits in all, or ten digits in the layouts of the
  North American plan, with 1 or nothing before. The digits after the code are permuted under the code, whatever
  the layout, so that one number has one pseudonym; a trunk zero in brackets stays. Pseudonyms under code 1 are walked on until
  area and exchange are ones that exist;
- social security numbers (3-2-4 digits in their issued ranges): the nine digits, walked on until they are valid again;
- IPv4 addresses (four octets): as a 32-bit number, two halves of 16 bits;
- dates (year-month-day, day/month/year, or month/day/year where the day is over 12; valid in the calendar, 1900 to 2099): as
  the number of the day in that range, so that one day in two layouts has one pseudonym;
- e-mail addresses: letters and digits of the local part, each class within itself, so the shape stays (letters beyond Latin-1
  stay as they are);
- secrets written after token, key, secret or password and = or a colon: hexadecimal digits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hex_int

ROUNDS = 8

# Each pattern begins with what its first character must be, so that most places of a text fail at once.
EMAIL = r"(?<![\p{L}\p{N}_.%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}_.%+-]*+@[A-Za-z0-9.-]*[A-Za-z0-9]\.[A-Za-z]{2,24}(?![A-Za-z0-9-])"
SECRET = r"(?=[0-9A-Fa-f]{16})(?<=(?i:token|key|secret|password)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?)[0-9A-Fa-f]{16,}+(?![0-9A-Za-z_-])"
PHONE = r"\+(?<![\dA-Za-z+]\+)\d{1,3}(?:[ .-]?\(\d{1,4}\)[ .-]?\d{3}[ .-]?\d{4}|(?:[ .-]?\(\d{1,4}\))?[ .-]?\d{1,4}(?:[ .-]?\d{2,4}){1,4})(?!\d|\.\d)"
#: Layouts of the North American plan: (212) 555-1234, 212-555-1234, 212.555.1234, with or without 1 before.
NATIONAL = r"(?:1[ .-])?(?:\([2-9]\d\d\) ?[2-9]\d\d[ .-]\d{4}|[2-9]\d\d-[2-9]\d\d-\d{4}|[2-9]\d\d\.[2-9]\d\d\.\d{4})"
BRACKET = rf"(?=\([2-9])(?<![\dA-Za-z+)][ .-]?){NATIONAL}(?!\d|[./-]\d)"
# The country codes of the international numbering plan by their lengths; what is left has three digits.
CODE = r"^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
DATE = r"(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|(?:(?:0[1-9]|[12]\d|3[01])/(?:0[1-9]|1[0-2])|(?:0[1-9]|1[0-2])/(?:1[3-9]|2\d|3[01]))/(?:19|20)\d\d"
SSN = r"\d{3}-\d{2}-\d{4}"
CARD = r"\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}"
NUMBER = rf"(?=\d)(?<![\dA-Za-z])(?<!\d[./-])(?:{IPV4}|{DATE}|{SSN}|{CARD}|{NATIONAL})(?![\dA-Za-z]|[./-]\d)"
ANY = "|".join([SECRET, EMAIL, NUMBER, PHONE, BRACKET])


def _prf(key: str, kind: str, round_: Column, half: Column) -> Column:
    """48 bits of a keyed hash of half a value."""
    return hex_int(F.substring(F.sha2(F.concat(F.lit(f"{key}|{kind}|"), round_.cast("string"), F.lit("|"), half), 256), 1, 12))


def _rounds(a: Column, b: Column, changed: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """The struct (a, b) after the rounds: a changes in even and b in odd ones, to changed(round, ours, other, even)."""

    def step(p: Column, r: Column) -> Column:
        even = r % 2 == 0
        new = changed(r, F.when(even, p["a"]).otherwise(p["b"]), F.when(even, p["b"]).otherwise(p["a"]), even)
        return F.struct(F.when(even, new).otherwise(p["a"]).alias("a"), F.when(even, p["b"]).otherwise(new).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.alias("a"), b.alias("b")), step)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value being worked out once."""
    return F.transform(F.array(value), then)[0]


def feistel_number(value: Column, low: Column, high: Column, key: str, kind: str) -> Column:
    """Keyed permutation of 0 <= value < low * high (longs): the halves value / low and value % low add keyed hashes of one
    another in turn, each modulo its own size."""
    moved = lambda r, ours, other, even: F.pmod(ours + _prf(key, kind, r, other.cast("string")), F.when(even, high).otherwise(low))
    return _let(_rounds(F.floor(value / low).cast("long"), F.pmod(value, low), moved), lambda p: p["a"] * low + p["b"])


def feistel_digits(digits: Column, key: str, kind: str, tweak: Column | None = None) -> Column:
    """Keyed permutation of the decimal strings of one length (2 to 30 digits; a single digit stays), another one for each tweak."""
    n = F.length(digits)
    salt = F.concat(F.lit("#"), n.cast("string"), *([] if tweak is None else [F.lit("#"), tweak]))
    half = F.floor(n / 2).cast("int")

    def moved(r: Column, ours: Column, other: Column, even: Column) -> Column:
        size = F.pow(F.lit(10.0), F.length(ours)).cast("long")
        return F.lpad(F.pmod(ours.cast("long") + _prf(key, kind, r, F.concat(other, salt)), size).cast("string"), F.length(ours), "0")

    done = _rounds(F.substr(digits, F.lit(1), half), F.substr(digits, half + 1), moved)
    return F.when(n < 2, digits).otherwise(_let(done, lambda p: F.concat(p["a"], p["b"])))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum modulo 10, the last digit counting once."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    worth = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.when(c.cast("int") > 4, 1).otherwise(0)))
    return F.pmod(F.aggregate(worth, F.lit(0), lambda s, x: s + x), F.lit(10))


def _poured(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced by those given, in order."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    is_digit = lambda c: c.between("0", "9")
    done = F.aggregate(
        chars,
        start,
        lambda s, c: F.struct(F.concat(s["out"], F.when(is_digit(c), F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + F.when(is_digit(c), 1).otherwise(0)).alias("at")),
    )
    return done["out"]


def is_card(x: Column) -> Column:
    return _let(_digits(x), lambda d: (luhn_sum(d) == 0) & (F.regexp_replace(d, "0", "") != ""))


def card(x: Column, key: str) -> Column:
    check = lambda body: F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    body = _let(_digits(x), lambda d: feistel_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card"))
    return _let(body, lambda body: _poured(x, F.concat(body, check(body))))


def is_phone(x: Column) -> Column:
    return F.length(_digits(x)).between(8, 15)


def _is_american(d: Column) -> Column:
    return d.rlike(r"^[2-9]\d\d[2-9]\d{6}$")


def phone(x: Column, key: str) -> Column:
    """What stands before the national digits (+ and the code, or 1), then these poured into their layout. A walk of 24 steps
    under code 1 ends except with odds under 10**-10; then the last step's number stays, which is a permuted one too."""
    code = F.when(x.startswith("+"), F.regexp_extract(_digits(x), CODE, 0)).otherwise(F.lit("1"))

    def under(code: Column) -> Column:
        head = F.when(x.startswith("+"), F.concat(F.lit("+"), code)).otherwise(F.regexp_extract(x, r"^1[ .-]", 0))
        return _let(head, lambda head: F.concat(head, _let(shape(head), lambda s: poured(s, code))))

    # a trunk zero is no digit of the number
    shape = lambda head: F.regexp_replace(F.substr(x, F.length(head) + 1), r"\(0\)", "(_)")

    def poured(s: Column, code: Column) -> Column:
        done = _let(_digits(s), lambda digits: walked(digits, code))
        return F.regexp_replace(_poured(s, done), r"\(_\)", "(0)")

    def walked(digits: Column, code: Column) -> Column:
        steps = F.sequence(F.lit(1), F.when((code == "1") & _is_american(digits), F.lit(25)).otherwise(F.lit(1)))
        return F.aggregate(steps, digits, lambda v, k: F.when((k > 1) & _is_american(v), v).otherwise(feistel_digits(v, key, "phone", code)))

    return _let(code, under)


def is_ssn(x: Column) -> Column:
    area, group, serial = (F.split(x, "-")[k].cast("int") for k in range(3))
    return (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)


def ssn(x: Column, key: str) -> Column:
    """Cycle walking: the permutation is applied again while the number is one that is never issued. A walk of 24 steps
    ends except with odds under 10**-22; then the value becomes 001-01-0001."""
    permuted = lambda v: _poured(F.lit("000-00-0000"), feistel_digits(_digits(v), key, "ssn"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(25)), x, lambda v, k: F.when((k > 1) & is_ssn(v), v).otherwise(permuted(v)))
    return _let(walked, lambda out: F.when(is_ssn(out), out).otherwise(F.lit("001-01-0001")))


def ipv4(x: Column, key: str) -> Column:
    part = F.transform(F.split(x, r"\."), lambda p: p.cast("long"))
    n = F.aggregate(part, F.lit(0).cast("long"), lambda s, p: s * 256 + p)
    wide = F.lit(65536).cast("long")
    octets = lambda out: F.array(*[F.pmod(F.shiftright(out, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])
    return F.array_join(_let(_let(n, lambda n: feistel_number(n, wide, wide, key, "ipv4")), octets), ".")


_FIRST, _DAYS = "1900-01-01", 73049  # days from 1900-01-01 to 2099-12-31: 11 * 6641 - 2


def _month_first(x: Column) -> Column:
    return F.substr(x, F.lit(4), F.lit(2)) > "12"


def _date(x: Column) -> Column:
    part = lambda at, n: F.substr(x, F.lit(at), F.lit(n))
    slashed = F.when(_month_first(x), F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2))).otherwise(F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2)))
    return F.try_to_timestamp(F.when(x.contains("-"), x).otherwise(slashed), F.lit("yyyy-MM-dd")).cast("date")


def is_date(x: Column) -> Column:
    return _date(x).isNotNull()


def date(x: Column, key: str) -> Column:
    """The range is padded to 271 * 270 numbers, and a number beyond the last day is permuted again (24 times at most, where
    the odds to be still beyond are under 10**-60)."""
    wide, high = F.lit(270).cast("long"), F.lit(271).cast("long")
    day = F.datediff(_date(x), F.lit(_FIRST).cast("date")).cast("long")
    out = F.aggregate(F.sequence(F.lit(1), F.lit(25)), day, lambda v, k: F.when((k > 1) & (v < _DAYS), v).otherwise(feistel_number(v, wide, high, key, "date")))
    new = F.date_add(F.lit(_FIRST).cast("date"), F.pmod(out, F.lit(_DAYS)).cast("int"))
    slashed = lambda new: F.when(_month_first(x), F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "dd/MM/yyyy"))
    return _let(new, lambda new: F.when(x.contains("-"), F.date_format(new, "yyyy-MM-dd")).otherwise(slashed(new)))


#: Classes of characters (first code, how many) that e-mail names are moved within: digits, and the letters of ASCII and Latin-1.
CLASSES = ((48, 10), (97, 26), (65, 26), (0xC0, 23), (0xD8, 7), (0xDF, 24), (0xF8, 8))


def _moved(c: Column, shift: Column) -> Column:
    """A letter or digit moved on within its class; other characters stay. c may be of any alphabet."""
    code, out = F.ascii(c), None
    for first, n in CLASSES:
        case, new = code.between(first, first + n - 1), F.char(F.lit(first) + F.pmod(code - first + shift, F.lit(n)))
        out = F.when(case, new) if out is None else out.when(case, new)
    return out.otherwise(c)


def _moved_hex(c: Column, shift: Column) -> Column:
    return F.lower(F.conv(F.pmod(F.conv(c, 16, 10).cast("int") + shift, F.lit(16)).cast("string"), 10, 16))


def feistel_text(x: Column, key: str, kind: str, moved: Callable[[Column, Column], Column]) -> Column:
    """Keyed permutation of strings of one length: the characters of each half move on by keyed hashes of the other half."""

    def changed(r: Column, ours: Column, other: Column, even: Column) -> Column:
        chars = F.filter(F.split(ours, ""), lambda c: c != "")
        pad = F.sha2(F.concat(F.lit(f"{key}|{kind}|"), r.cast("string"), F.lit("|"), other), 256)
        # 61 windows of 4 hex digits, then the same again: each place has a shift of its own
        shift = lambda h, i: F.conv(F.substr(h, F.pmod(i, F.lit(61)) + 1, F.lit(4)), 16, 10).cast("int") + i
        return _let(pad, lambda h: F.array_join(F.transform(chars, lambda c, i: moved(c, shift(h, i))), ""))

    half = F.floor(F.length(x) / 2).cast("int")
    return _let(_rounds(F.substr(x, F.lit(1), half), F.substr(x, half + 1), changed), lambda p: F.concat(p["a"], p["b"]))


def email(x: Column, key: str) -> Column:
    local = F.substring_index(x, "@", 1)
    return F.concat(feistel_text(local, key, "email", _moved), F.substr(x, F.length(local) + 1))


def secret(x: Column, key: str) -> Column:
    out = feistel_text(F.lower(x), key, "secret", _moved_hex)
    return F.when(x == F.upper(x), F.upper(out)).otherwise(out)


def kind_of(x: Column) -> Column:
    """Kind of a match of ANY whose check holds, else null."""
    found = F.when(x.contains("@"), "email").when(x.startswith("+"), F.when(is_phone(x), "phone"))
    found = found.when(x.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ipv4")
    found = found.when(x.rlike(r"^(?:\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4})$"), F.when(is_date(x), "date"))
    found = found.when(x.rlike(r"^\d{3}-\d\d-\d{4}$"), F.when(is_ssn(x), "ssn"))
    found = found.when(x.rlike(rf"^{NATIONAL}$"), "phone")
    found = found.when(x.rlike(r"^[\d -]{13,19}$"), F.when(is_card(x), "card"))
    return found.when(x.rlike(r"^[0-9A-Fa-f]+$"), "secret")


def pseudonym(kind: Column, x: Column, key: str) -> Column:
    makers = {"email": email, "phone": phone, "ipv4": ipv4, "date": date, "ssn": ssn, "card": card, "secret": secret}
    return reduce(lambda c, k: c.when(kind == k, makers[k](x, key)), makers, F.when(kind.isNull(), x)).otherwise(x)


KINDS = ("email", "phone", "ipv4", "date", "ssn", "card", "secret")


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the text with each confirmed value replaced by its pseudonym, n_replaced, and kinds (distinct, sorted).

    A null text stays null with 0 replaced, an empty one stays empty; texts without values come back as they are. Candidates
    that fail their check (a Luhn sum, an impossible date, an unissued number) stay. Each row is worked on alone, so
    repeated rows give equal results and the size of the table does not matter, nor does the length of a text: all of it is
    searched, in one pass of the pattern. An empty table gives no rows. Where two patterns meet in one place the one that
    begins first counts, then the one listed first. Columns other than doc_id and text are not read, whatever their names. Whoever has the key can trace pseudonyms back, so it has
    no default.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("found"))
    tagged = F.transform("found", lambda x: F.struct(x.alias("x"), kind_of(x).alias("k")))
    rows = rows.select("doc_id", "text", tagged.alias("found"))
    new = F.transform("found", lambda f: pseudonym(f["k"], f["x"], key))
    some = F.exists("found", lambda f: f["k"].isNotNull())
    pieces = F.split("text", ANY, -1)
    glued = F.array_join(F.flatten(F.zip_with(pieces, new, lambda p, x: F.array(F.coalesce(p, F.lit("")), F.coalesce(x, F.lit(""))))), "")
    kinds = F.array_sort(F.array_distinct(F.filter(F.transform("found", lambda f: f["k"]), lambda k: k.isNotNull())))
    n = F.size(F.filter("found", lambda f: f["k"].isNotNull())).cast("long")
    return rows.select("doc_id", F.when(some, glued).otherwise(F.col("text")).alias("text"), F.when(F.col("text").isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_replaced"), F.array_join(F.coalesce(kinds, F.array().cast("array<string>")), ",").alias("kinds"))
