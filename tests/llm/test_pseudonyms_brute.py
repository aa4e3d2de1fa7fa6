"""Pseudonyms of a whole table beside a version of their own in plain Python."""

import datetime as dt
import hashlib

import regex

from shardloom.llm import pseudonyms as P
from shardloom.llm import registry

DIGITS, SMALL, LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST = dt.date(1900, 1, 1)


def noise(kind, r, half):
    return hashlib.sha256(f"{P.KEY}|{kind}|{r}|{half}".encode()).hexdigest()


def pair(kind, a, b, size_a, size_b):
    for r in range(8):
        if r % 2 == 0:
            a = (a + int(noise(kind, r, b)[:15], 16)) % size_a
        else:
            b = (b + int(noise(kind, r, a)[:15], 16)) % size_b
    return a, b


def digits(kind, text):
    left = len(text) // 2
    a, b = pair(kind, int(text[:left] or 0), int(text[left:] or 0), 10**left, 10 ** (len(text) - left))
    return (f"{a:0{left}}" if left else "") + f"{b:0{len(text) - left}}"


def characters(kind, text, alphabets):
    a, b = text[: len(text) // 2], text[len(text) // 2 :]

    def shifted(half, hexes):
        out = ""
        for i, c in enumerate(half):
            by = int(hexes[2 * (i % 32) : 2 * (i % 32) + 2], 16)
            letters = next((x for x in alphabets if c in x), None)
            out += letters[(letters.index(c) + by) % len(letters)] if letters else c
        return out

    for r in range(8):
        if r % 2 == 0:
            a = shifted(a, noise(kind, r, b))
        else:
            b = shifted(b, noise(kind, r, a))
    return a + b


def only(text):
    return "".join(c for c in text if c in DIGITS)


def refill(shape, new):
    new = iter(new)
    return "".join(next(new) if c in DIGITS else c for c in shape)


def luhn(number):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(number))) % 10


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def card(m):
    d = only(m)
    if luhn(d) or not d.strip("0"):
        return m
    inner = digits("card", d[1:-1])
    if d[0] == "0" and not inner.strip("0"):
        inner = digits("card", inner)
    body = d[0] + inner
    return refill(m, body + str(-luhn(body + "0") % 10))


def iban(m):
    plain = m.replace(" ", "")
    if not (15 <= len(plain) <= 34 and mod97(plain[4:] + plain[:4]) == 1 and 2 <= int(plain[2:4]) <= 98 and len(only(plain)) > 3):
        return m
    account = refill(plain[4:], digits("iban", only(plain[4:])))
    return refill(m, f"{98 - mod97(account + plain[:2] + '00'):02}" + only(account))


def ip(m):
    parts = m.split(".")
    if any(len(x) > 1 and x[0] == "0" or int(x) > 255 for x in parts):
        return m
    o = [*map(int, parts)]
    halves = pair("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
    return ".".join(str(x) for h in halves for x in divmod(h, 256))


def ssn(m):
    area, group, serial = map(int, m.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return m
    a, b = pair("ssn", area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
    return f"{a + (2 if a >= 665 else 1):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"


def phone(m):
    d = only(m)
    area, exchange, line = int(d[-10:-7]), int(d[-7:-4]), int(d[-4:])
    from_area, areas = (0, 200) if area < 200 else (200, 800)
    from_exchange, exchanges = (0, 1000) if area < 200 else (200, 800) if exchange >= 200 else (0, 200)
    a, b = pair("phone", area - from_area, (exchange - from_exchange) * 10_000 + line, areas, exchanges * 10_000)
    return refill(m, ("1" if len(d) == 11 else "") + f"{a + from_area:03}{b // 10_000 + from_exchange:03}{b % 10_000:04}")


def date(m):
    pattern = {"-": "%Y-%m-%d", ".": "%d.%m.%Y", "/": "%Y/%m/%d" if m[4] == "/" else "%m/%d/%Y"}[m[4] if m[4] in "-/" else m[2]]
    try:
        n = (dt.datetime.strptime(m, pattern).date() - FIRST).days
    except ValueError:
        return m
    if not 0 <= n < 73_000:
        return m
    a, b = pair("date", n // 365, n % 365, 200, 365)
    return (FIRST + dt.timedelta(days=a * 365 + b)).strftime(pattern)


def email(m):
    local = m.split("@")[0]
    return characters("email", local, (DIGITS, SMALL, LARGE)) + m[len(local) :]


def secret(m):
    name = regex.match("^(.*[=:] {0,3}[\"']?)", m)[1]
    return name + characters("secret", m[len(name) :], (DIGITS, "abcdef", "ABCDEF"))


MAKERS = {"email": email, "secret": secret, "iban": iban, "ip": ip, "ssn": ssn, "date": date, "phone": phone, "card": card}


def test_whole_table(spark):
    directory = "/root/testdata/sf0.01"
    pattern = regex.compile(P.ANY.replace(r"\k<gap>", "(?P=gap)"))
    seen = dict.fromkeys(MAKERS, 0)

    def made(m):
        kind = next(k for k in MAKERS if regex.search(P.SHAPES[k], m[0]))
        out = MAKERS[kind](m[0])
        seen[kind] += out != m[0]
        return out

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{directory}/documents.parquet").collect()}
    got = {r.doc_id: r.text for r in registry.QUERIES["op2_pseudonyms"](spark, directory).collect()}
    assert got == {i: None if t is None else pattern.sub(made, t) for i, t in texts.items()}
    assert sum(n > 0 for n in seen.values()) >= 4
