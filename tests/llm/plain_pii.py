"""The pseudonyms in plain Python: a Feistel network in a loop, one value at a time."""

import datetime
import hashlib

import regex

from sondera.llm import pii

FOUND = regex.compile(pii.ANY)
NATIONAL = regex.compile(pii.NATIONAL)
CODE = regex.compile(pii.CODE)


def prf(key, kind, r, half):
    return int(hashlib.sha256(f"{key}|{kind}|{r}|{half}".encode()).hexdigest()[:12], 16)


def network(a, b, changed):
    for r in range(8):
        if r % 2 == 0:
            a = changed(r, a, b)
        else:
            b = changed(r, b, a)
    return a, b


def digits(d, key, kind, tweak=None):
    n = len(d)
    if n < 2:
        return d
    salt = f"#{n}" + ("" if tweak is None else f"#{tweak}")
    moved = lambda r, ours, other: str((int(ours) + prf(key, kind, r, other + salt)) % 10 ** len(ours)).zfill(len(ours))
    return "".join(network(d[: n // 2], d[n // 2 :], moved))


def number(v, low, high, key, kind):
    a, b = v // low, v % low
    for r in range(8):
        if r % 2 == 0:
            a = (a + prf(key, kind, r, b)) % high
        else:
            b = (b + prf(key, kind, r, a)) % low
    return a * low + b


def text(x, key, kind, moved):
    def changed(r, ours, other):
        pad = hashlib.sha256(f"{key}|{kind}|{r}|{other}".encode()).hexdigest()
        return "".join(moved(c, int(pad[i % 61 : i % 61 + 4], 16) + i) for i, c in enumerate(ours))

    return "".join(network(x[: len(x) // 2], x[len(x) // 2 :], changed))


def moved(c, shift):
    for first, n in ((48, 10), (97, 26), (65, 26), (0xC0, 23), (0xD8, 7), (0xDF, 24), (0xF8, 8)):
        if first <= ord(c) < first + n:
            return chr(first + (ord(c) - first + shift) % n)
    return c


def only_digits(x):
    return "".join(c for c in x if c in "0123456789")


def poured(shape, d):
    it = iter(d)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (c > "4") for k, c in enumerate(reversed(d))) % 10


def walked(v, ok, step):
    for _ in range(25):
        v = step(v)
        if ok(v):
            break
    return v


def issued(x):
    a, g, s = map(int, x.split("-"))
    return a not in (0, 666) and a < 900 and g > 0 and s > 0


def day_of(x):
    try:
        if "-" in x:
            return datetime.date.fromisoformat(x)
        a, b, y = map(int, x.split("/"))
        return datetime.date(y, a, b) if b > 12 else datetime.date(y, b, a)
    except ValueError:
        return None


def kind_of(x):
    if "@" in x:
        return "email"
    if x.startswith("+"):
        return "phone" if 8 <= len(only_digits(x)) <= 15 else None
    if regex.fullmatch(r"\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}", x):
        return "date" if day_of(x) else None
    if regex.fullmatch(r"\d{3}-\d\d-\d{4}", x):
        return "ssn" if issued(x) else None
    if NATIONAL.fullmatch(x):
        return "phone"
    if regex.fullmatch(r"\d+\.\d+\.\d+\.\d+", x):
        return "ipv4"
    if regex.fullmatch(r"[\d -]{13,19}", x):
        return "card" if luhn(only_digits(x)) == 0 and only_digits(x).strip("0") else None
    return "secret" if regex.fullmatch("[0-9A-Fa-f]+", x) else None


def pseudonym(kind, x, key):
    if kind == "email":
        local, at, host = x.partition("@")
        return text(local, key, "email", moved) + at + host
    if kind == "secret":
        out = text(x.lower(), key, "secret", lambda c, s: f"{(int(c, 16) + s) % 16:x}")
        return out.upper() if x == x.upper() else out
    if kind == "phone":
        if x.startswith("+"):
            code = CODE.match(only_digits(x))[0]
            head = "+" + code
        else:
            code, head = "1", regex.match(r"(?:1[ .-])?", x)[0]
        shape = x[len(head) :].replace("(0)", "(_)")
        d, american = only_digits(shape), lambda v: regex.fullmatch(r"[2-9]\d\d[2-9]\d{6}", v)
        step = lambda v: digits(v, key, "phone", code)
        out = walked(d, american, step) if code == "1" and american(d) else step(d)
        return head + poured(shape, out).replace("(_)", "(0)")
    if kind == "ipv4":
        n = 0
        for p in x.split("."):
            n = n * 256 + int(p)
        out = number(n, 65536, 65536, key, "ipv4")
        return ".".join(str(out >> s & 255) for s in (24, 16, 8, 0))
    if kind == "date":
        first = datetime.date(1900, 1, 1)
        v = walked((day_of(x) - first).days, lambda v: v < 73049, lambda v: number(v, 270, 271, key, "date"))
        new = first + datetime.timedelta(v % 73049)
        return new.isoformat() if "-" in x else f"{new:%m/%d/}{new.year:04d}" if x[3:5] > "12" else f"{new:%d/%m/}{new.year:04d}"
    if kind == "ssn":
        return walked(x, issued, lambda v: poured("000-00-0000", digits(only_digits(v), key, "ssn")))
    d = only_digits(x)
    body = digits(d[:-1], key, "card")
    return poured(x, body + str((10 - luhn(body + "0")) % 10))


def pseudonymise(text_, key):
    """(text, number of values, kinds)."""
    kinds = []

    def swap(m):
        kind = kind_of(m[0])
        if kind is None:
            return m[0]
        kinds.append(kind)
        return pseudonym(kind, m[0], key)

    out = None if text_ is None else FOUND.sub(swap, text_)
    return out, len(kinds), ",".join(sorted(set(kinds)))
