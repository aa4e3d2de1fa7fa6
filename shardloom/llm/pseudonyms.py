"""Format-preserving pseudonyms for personal data, as DataFrame functions.

One pattern finds candidates in a text. Each is validated (Luhn, IBAN's mod 97,
octets, calendar, numbering plans) and goes through a keyed Feistel network over
the values of its own format, so an equal value gets an equal pseudonym in every
document, two values never share one, and the holder of the key can undo it. The
round function is SHA-256 under the key.

  card     13-19 digits that satisfy Luhn: the first digit stays, the check digit is made anew
  iban     digits of the account permuted, check digits (02 to 98) made anew
  ssn      valid area, group and serial numbers
  phone    North American numbers, a leading 1 stays; those without +1 need an area and an exchange of 200-999
  ip       IPv4: all 32 bits
  date     1900-01-01 to 2099-11-13, as yyyy-MM-dd, yyyy/MM/dd, dd.MM.yyyy or MM/dd/yyyy
  email    letters and digits of the local part, each within its class; the domain stays
  secret   hexadecimal digits given to a password, token, secret or key, digits and letters each in their class

Defined results: null stays null and the empty text empty; candidates that fail
validation stay as they are; every row is handled by itself, so repeated rows give
repeated results, and a text of any length is handled whole in its row's memory; other
columns are carried along, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# fixed values: formats
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
_SECRET = r"(?i:password|passwd|pwd|token|secret|key) {0,3}[=:] {0,3}[\"']?(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{16,64}|[0-9A-F]{16,64})(?![0-9A-Za-z])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
_DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./-][0-9])"
_PHONE = r"(?<![0-9A-Za-z.-])(?:(?:1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9]|\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9])[0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
_CARD = r"(?<![0-9A-Za-z])(?:[0-9]{4}(?<gap>[ -])[0-9]{4}\k<gap>[0-9]{4}\k<gap>[0-9]{4}|[0-9]{13,19})(?![0-9A-Za-z])"
PATTERNS = {"email": _EMAIL, "secret": _SECRET, "iban": _IBAN, "ip": _IP, "ssn": _SSN, "date": _DATE, "phone": _PHONE, "card": _CARD}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: The shape of a candidate, without what must stand around it.
SHAPES = {
    "email": r"^[^@]+@",
    "secret": r"[=:]",
    "iban": r"^[A-Z]{2}",
    "ip": r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "date": r"^(?:[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4})$",
    "phone": r"^(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$",
    "card": r"^[0-9][0-9 -]+[0-9]$",
}
_DAYS = (200, 365)  # 73,000 days
_DIGITS, _SMALL, _LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _long(value) -> Column:
    return value.cast("long") if isinstance(value, Column) else F.lit(value).cast("long")


class Network:
    """Keyed permutations; ``undo`` runs them backwards."""

    def __init__(self, key: str, undo: bool = False):
        self.key, self.undo = key, undo

    def _order(self) -> Column:
        return F.array(*map(F.lit, range(ROUNDS)[:: -1 if self.undo else 1]))

    def _hash(self, kind: str, rnd: Column, half: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(self.key), F.lit(kind), rnd.cast("string"), half.cast("string")), 256)

    def pair(self, kind: str, a: Column, b: Column, size_a, size_b) -> Column:
        """Struct (a, b) of a permuted pair below ``size_a`` and ``size_b``."""
        size_a, size_b = _long(size_a), _long(size_b)
        sign = -1 if self.undo else 1

        def step(s, r):
            on_a = r % 2 == 0
            noise = F.conv(F.substring(self._hash(kind, r, F.when(on_a, s["b"]).otherwise(s["a"])), 1, 15), 16, 10).cast("long")
            return F.struct(
                F.when(on_a, F.pmod(s["a"] + sign * F.pmod(noise, size_a), size_a)).otherwise(s["a"]).alias("a"),
                F.when(on_a, s["b"]).otherwise(F.pmod(s["b"] + sign * F.pmod(noise, size_b), size_b)).alias("b"),
            )

        return F.aggregate(self._order(), F.struct(_long(a).alias("a"), _long(b).alias("b")), step)

    def digits(self, kind: str, text: Column) -> Column:
        """A string of up to 36 digits, permuted among those of its length."""
        n = F.length(text)
        left = F.floor(n / 2).cast("int")
        sizes = [F.rpad(F.lit("1"), k + 1, "0").cast("long") for k in (left, n - left)]
        halves = [F.coalesce(F.nullif(x, F.lit("")), F.lit("0")).cast("long") for x in (F.substr(text, F.lit(1), left), F.substr(text, left + 1, n - left))]

        def done(s):
            return F.concat(
                F.when(left > 0, F.lpad(s["a"].cast("string"), left, F.lit("0"))).otherwise(""),
                F.lpad(s["b"].cast("string"), n - left, F.lit("0")),
            )

        return _let(self.pair(kind, *halves, *sizes), done)

    def characters(self, kind: str, text: Column, alphabets: tuple[str, ...]) -> Column:
        """A string whose characters are permuted, each within the alphabet it is in."""
        n = F.length(text)
        left = F.floor(n / 2).cast("int")
        sign = -1 if self.undo else 1

        def shifted(half, noise):
            def one(i):
                c = F.substr(half, i, F.lit(1))
                by = F.conv(F.substr(noise, 1 + 2 * F.pmod(i - 1, F.lit(32)), F.lit(2)), 16, 10).cast("int")
                out = c
                for letters in alphabets:
                    at = F.instr(F.lit(letters), c)
                    out = F.when(at > 0, F.substr(F.lit(letters), 1 + F.pmod(at - 1 + sign * by, F.lit(len(letters))), F.lit(1))).otherwise(out)
                return out

            places = F.when(F.length(half) > 0, F.sequence(F.lit(1), F.length(half))).otherwise(F.array().cast("array<int>"))
            return F.array_join(F.transform(places, one), "")

        def step(s, r):
            on_a = r % 2 == 0
            noise = self._hash(kind, r, F.when(on_a, s["b"]).otherwise(s["a"]))
            return F.struct(
                F.when(on_a, shifted(s["a"], noise)).otherwise(s["a"]).alias("a"),
                F.when(on_a, s["b"]).otherwise(shifted(s["b"], noise)).alias("b"),
            )

        start = F.struct(F.substr(text, F.lit(1), left).alias("a"), F.substr(text, left + 1, n - left).alias("b"))
        return _let(F.aggregate(self._order(), start, step), lambda s: F.concat(s["a"], s["b"]))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order."""

    def step(s, c):
        digit = F.instr(F.lit(_DIGITS), c) > 0
        return F.struct(
            F.concat(s["out"], F.when(digit, F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"),
            (s["k"] + F.when(digit, 1).otherwise(0)).alias("k"),
        )

    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""

    def add(total, i):
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10


def _mod97(text: Column) -> Column:
    def add(rest, c):
        letter = F.instr(F.lit(_LARGE), c)
        return F.when(letter > 0, (rest * 100 + letter + 9) % 97).otherwise((rest * 10 + F.instr(F.lit(_DIGITS), c) - 1) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _card(net: Network, m: Column) -> Column:
    def made(d):
        first = F.substring(d, 1, 1)
        inner = net.digits("card", F.substr(d, F.lit(2), F.length(d) - 2))
        # nothing becomes the number of zeros, which is no card: such a value takes one more step
        past = _let(inner, lambda x: F.when((first == "0") & x.rlike("^0+$"), net.digits("card", x)).otherwise(x))
        body = F.concat(first, past)
        return _let(body, lambda b: _refill(m, F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))))

    return _let(_only_digits(m), lambda d: F.when((_luhn(d) == 0) & ~d.rlike("^0+$"), made(d)).otherwise(m))


def _iban(net: Network, m: Column) -> Column:
    def made(plain):
        account = F.substr(plain, F.lit(5), F.length(plain))
        own = _let(net.digits("iban", _only_digits(account)), lambda d: _refill(account, d))

        def with_check(a):
            check = 98 - _mod97(F.concat(a, F.substring(plain, 1, 2), F.lit("00")))
            digits = F.concat(F.lpad(check.cast("string"), 2, "0"), _only_digits(a))
            return _refill(m, digits)

        return _let(own, with_check)

    def checked(plain):
        moved = F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
        check = F.substring(plain, 3, 2).cast("int")  # others are not made by the rule for check digits
        good = F.length(plain).between(15, 34) & (_mod97(moved) == 1) & check.between(2, 98) & (F.length(_only_digits(plain)) > 3)
        return F.when(good, made(plain)).otherwise(m)

    return _let(F.translate(m, " ", ""), checked)


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _ip(net: Network, m: Column) -> Column:
    def made(o):
        number = net.pair("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return _let(number, lambda s: F.concat_ws(".", *(x.cast("string") for h in ("a", "b") for x in (F.floor(s[h] / 256), s[h] % 256))))

    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    plain = ~m.rlike(r"(?:^|\.)0[0-9]")
    return _let(octets, lambda o: F.when(plain & F.forall(o, lambda x: x <= 255), made(o)).otherwise(m))


def _ssn(net: Network, m: Column) -> Column:
    area, group, serial = (F.substring(m, *p).cast("int") for p in ((1, 3), (5, 2), (8, 4)))
    index = F.when(area > 666, area - 2).otherwise(area - 1)

    def made(s):
        a = F.when(s["a"] >= 665, s["a"] + 2).otherwise(s["a"] + 1)
        parts = ((a, 3), (F.floor(s["b"] / 9999) + 1, 2), (s["b"] % 9999 + 1, 4))
        return F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in parts))

    good = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(good, _let(net.pair("ssn", index, (group - 1) * 9999 + serial - 1, 898, 99 * 9999), made)).otherwise(m)


def _phone(net: Network, m: Column) -> Column:
    def made(d):
        own = F.substr(d, F.length(d) - 9, F.lit(10))
        area, exchange, line = (F.substring(own, *p).cast("long") for p in ((1, 3), (4, 3), (7, 4)))
        # numbers with an area or an exchange that is not assigned stay among their like
        from_area, areas = (F.when(area < 200, x).otherwise(y) for x, y in ((0, 200), (200, 800)))
        plain = (area >= 200) & (exchange >= 200)
        from_exchange, exchanges = (F.when(area < 200, x).when(~plain, y).otherwise(z) for x, y, z in ((0, 0, 200), (1000, 200, 800)))
        pair = net.pair("phone", area - from_area, (exchange - from_exchange) * 10_000 + line, areas, exchanges * 10_000)

        def digits(s):
            head = F.when(F.length(d) == 11, F.lit("1")).otherwise("")
            parts = ((s["a"] + from_area, 3), (F.floor(s["b"] / 10_000) + from_exchange, 3), (s["b"] % 10_000, 4))
            return _refill(m, F.concat(head, *(F.lpad(x.cast("string"), n, "0") for x, n in parts)))

        return _let(pair, digits)

    return _let(_only_digits(m), made)


def _date(net: Network, m: Column) -> Column:
    formats = {r"^[0-9]{4}-": "yyyy-MM-dd", r"^[0-9]{4}/": "yyyy/MM/dd", r"^[0-9]{2}\.": "dd.MM.yyyy", r"^[0-9]{2}/": "MM/dd/yyyy"}
    out = m
    for shape, pattern in formats.items():
        out = F.when(m.rlike(shape), F.coalesce(_let(F.try_to_date(m, pattern), _moved(net, m, pattern)), m)).otherwise(out)
    return out


def _moved(net: Network, m: Column, pattern: str):
    first = F.lit("1900-01-01").cast("date")

    def made(day):
        n = F.date_diff(day, first)
        pair = net.pair("date", F.floor(n / _DAYS[1]), n % _DAYS[1], *_DAYS)
        moved = _let(pair, lambda s: F.date_format(F.date_add(first, (s["a"] * _DAYS[1] + s["b"]).cast("int")), pattern))
        return F.when(n.between(0, _DAYS[0] * _DAYS[1] - 1), moved).otherwise(m)

    return made


def _email(net: Network, m: Column) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(net.characters("email", local, (_DIGITS, _SMALL, _LARGE)), F.substr(m, F.length(local) + 1, F.length(m)))


def _secret(net: Network, m: Column) -> Column:
    name = F.regexp_extract(m, "^(.*[=:] {0,3}[\"']?)", 1)
    value = F.substr(m, F.length(name) + 1, F.length(m))
    return F.concat(name, net.characters("secret", value, (_DIGITS, "abcdef", "ABCDEF")))


_MAKERS = {"email": _email, "ip": _ip, "ssn": _ssn, "date": _date, "phone": _phone, "iban": _iban, "card": _card, "secret": _secret}


def _kind(m: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind in reversed(list(PATTERNS)):
        out = F.when(m.rlike(SHAPES[kind]), F.lit(kind)).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, undo: bool = False, text_col: str = "text", kinds_col: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``. ``kinds_col``: also an array of what was replaced, in order.

    ``undo`` restores the original texts under the same key. A column that is called as ``kinds_col`` gives way to it.
    """
    net = Network(key, undo)
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    staged = docs.select(row, F.col(text_col).cast("string").alias("text"))
    text = F.col("text")
    may = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    nothing = F.array().cast("array<string>")
    found = F.when(may, F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(nothing)

    def made(m):
        kind = _kind(m)
        out = m
        for name, maker in _MAKERS.items():
            out = F.when(kind == name, maker(net, m)).otherwise(out)
        return out

    staged = staged.withColumn("found", found).withColumn("made", F.transform("found", made))
    gaps = F.split(text, ANY, -1)
    rebuilt = F.array_join(F.zip_with(gaps, F.col("made"), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    changed = F.when(F.size("found") > 0, rebuilt).otherwise(text)
    columns = [(changed if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c != kinds_col]
    if kinds_col:
        pairs = F.filter(F.arrays_zip(F.col("found").alias("f"), F.col("made").alias("m")), lambda p: p["f"] != p["m"])
        columns.append(F.transform(pairs, lambda p: _kind(p["f"])).alias(kinds_col))
    return staged.select(columns)


#: In production this comes from a secret store.
KEY = "shardloom demonstration key"


def query(spark, sf_dir: str) -> DataFrame:
    from .store import table

    out = pseudonymize(table(spark, sf_dir, "documents"), KEY, kinds_col="kinds")
    return out.select("doc_id", "text", F.size("kinds").cast("long").alias("n_replaced"), F.array_sort(F.array_distinct("kinds")).alias("kinds"))
