"""Personal data under format-preserving pseudonyms, in DataFrame functions only.

Candidates are found by one pattern; those that validate are replaced, the rest of a text stays as it is.
Numbers and dates are permuted within their format by a keyed Feistel network, so a value has the same
pseudonym in every document and no two values share one:

* cards (13 to 19 digits, Luhn), also between other groups of digits: all digits but the first are permuted,
  the check digit is made anew;
* IBANs (mod 97, the length of their country), also with groups that follow: the digits of the account are permuted, the check digits made anew;
* phone numbers: area, exchange and line of +1 numbers, among the valid ones if they are (2-9 first in area and
  exchange), else among the others; all digits but the first two after another plus;
* US social security numbers (spaces or hyphens), the 900s that the tax office gives out among themselves, IPv4
  addresses: among the valid ones; IPv6 addresses: the network and the rest each among all, written in full;
* dates (1800 to 2199): among the days of these 400 years, in the same notation, whichever it is. Days up to the 12th and
  later ones go among themselves, so a date that can only be day/month/year stays one;
* the letters and digits of e-mail names, hosts and access keys: among those of their length, up to 22 of them.

Secrets (passwords and tokens after their names) and longer words become keyed hashes of the same length. Lengths
and separators never change, except that the groups of an address have no fixed width.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The key of the query below and of tests; a run on real data names its own.
TEST_KEY = "lamina test key"
ROUNDS = 10
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
SECRET = r"\bAKIA[0-9A-Z]{16}\b|(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key))[\"']?\s?[=:]\s?[\"']?[A-Za-z0-9_+/.-]{7,}[A-Za-z0-9_+/-]"
#: Characters of an IBAN by country.
LENGTHS = {15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU"}
KNOWN = r"\b(?:" + "|".join(rf"(?:{c})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in LENGTHS.items()) + r")\b"
IBAN = rf"{KNOWN}|\b[A-Z]{{2}}\d{{2}}(?: ?(?!{KNOWN})[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?\b"
DATE = r"(?<![\d./-])(?:\d{4}([-/])\d{2}\1\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!\d|[./-]\d)"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
IP6_GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})"
IP6 = rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:{IP6_GROUPS}{{7}}|[0-9A-Fa-f]{{3,4}}(?::[0-9A-Fa-f]{{1,4}}){{0,6}}::(?:{IP6_GROUPS}{{0,6}})?)(?![0-9A-Za-z:]|\.[0-9])"
SSN = r"(?<![\d-])(?:\d{3}-\d{2}-\d{4}|(?<!\d )\d{3} \d{2} \d{4}(?! \d))(?!\d|-\d)"
PHONE = r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d(])\(?[2-9]\d{2}\)?[ .-][2-9]\d{2}[ .-]\d{4}(?!\d)|\+[2-9]\d(?:[ .()-]{0,2}\d){6,13}(?!\d)"
#: What ends a run of groups of digits: a group that begins something else.
OTHER = rf"{MAIL}|{IP}|{IP6}|{SSN}|{PHONE}|(?<![\d./-])(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}}/\d{{2}}/\d{{2}}|\d{{2}}/\d{{2}}/\d{{4}}|\d{{2}}\.\d{{2}}\.\d{{4}})(?!\d|[./-]\d)"
#: The whole run of groups that a card may lie in.
CARD = rf"(?<![\dA-Za-z])(?=\d(?:[ -]?\d){{12}})\d++(?![A-Za-z])(?:[ -](?!{OTHER})\d++(?![A-Za-z]))*+"
ANY = "|".join((MAIL, SECRET, IBAN, DATE, IP, IP6, SSN, PHONE, CARD))
#: What a text must hold for any of them.
HINT = r"[0-9@]|(?i:password|passwd|pwd|secret|token|api[_-]?key)"


def _hash(key: str, *parts: Column | str | int) -> Column:
    text = F.concat_ws("|", F.lit(key), *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.sha2(text, 256)


def feistel(key: str, kind: str | Column, left: Column, right: Column, a: Column | int, b: Column | int) -> Column:
    """A keyed permutation of the pairs in [0, a) x [0, b), as a struct (l, r): each round adds to one side what the other says."""
    a, b = (x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def turn(acc: Column, k: Column) -> Column:
        said = lambda x: F.conv(F.substring(_hash(key, kind, k, x), 1, 15), 16, 10).cast("long")
        odd = k % 2 == 1
        mixed = said(F.when(odd, acc["r"]).otherwise(acc["l"]))
        return F.struct(F.when(odd, (acc["l"] + mixed % a) % a).otherwise(acc["l"]).alias("l"), F.when(odd, acc["r"]).otherwise((acc["r"] + mixed % b) % b).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def _pad(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width, F.lit("0")) if isinstance(width, Column) else F.lpad(n.cast("string"), width, "0")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _refill(v: Column, digits: Column, kind: str = "[0-9]") -> Column:
    """``v`` with its digits, or characters of another kind, replaced one after the other by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def put(acc: Column, c: Column) -> Column:
        digit = c.rlike(kind)
        return F.struct(F.concat(acc["out"], F.when(digit, F.substr(digits, acc["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), F.when(digit, acc["k"] + 1).otherwise(acc["k"]).alias("k"))

    return F.aggregate(_chars(v), start, put, lambda acc: acc["out"])


def _decimal(key: str, kind: str, d: Column) -> Column:
    """A digit string of up to 30 digits permuted among those of its length."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    part = lambda at, size: F.coalesce(F.substr(d, at, size).try_cast("long"), F.lit(0).cast("long"))
    power = lambda k: F.pow(F.lit(10), k).cast("long")
    out = feistel(key, F.concat(F.lit(kind), n.cast("string")), part(F.lit(1), u), part(u + 1, n - u), power(u), power(n - u))
    return _let(out, lambda p: F.concat(F.when(u > 0, _pad(p["l"], u)).otherwise(F.lit("")), F.when(n > 0, _pad(p["r"], n - u)).otherwise(F.lit(""))))


def _luhn(d: Column) -> Column:
    """The Luhn sum modulo 10; 0 for a valid number."""
    def worth(c: Column, k: Column) -> Column:
        x = c.cast("int")
        return F.when(k % 2 == 0, x).otherwise(2 * x - F.when(x > 4, F.lit(9)).otherwise(F.lit(0)))

    return F.aggregate(F.transform(_chars(F.reverse(d)), worth), F.lit(0), lambda acc, x: acc + x) % 10


def _mod97(s: Column) -> Column:
    """The number that an IBAN's characters spell, modulo 97."""
    def add(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), acc * 10 + c.try_cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(_chars(s), F.lit(0), add)


def _card(key: str, v: Column) -> Column:
    """The pseudonym of a card; null for what is none."""
    def made(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), _decimal(key, "card", F.substr(d, F.lit(2), n - 2)))
        whole = _let(body, lambda p: F.concat(p, ((10 - _luhn(F.concat(p, F.lit("0")))) % 10).cast("string")))
        return F.when(_is_card(d), _refill(v, whole))

    return _let(_digits(v), made)


def _is_card(d: Column) -> Column:
    return F.when(F.length(d).between(13, 19) & d.rlike("^[0-9]+$"), _luhn(d) == 0).otherwise(F.lit(False))


def _cards(key: str, v: Column) -> Column:
    """``v`` with the cards among its groups replaced: from the left, the longest span of whole groups that validates."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def spans(groups: Column) -> Column:
        span = lambda i, j: F.array_join(F.slice(groups, i, j - i + 1), "")

        def step(acc: Column, i: Column) -> Column:
            ends = F.sequence(F.least(i + 18, F.size(groups)), i, F.lit(-1))
            last = F.try_element_at(F.filter(ends, lambda j: _is_card(F.regexp_replace(span(i, j), "[ -]", ""))), F.lit(1))

            def put(e: Column) -> Column:
                held = _let(span(i, e), lambda x: F.concat(_card(key, F.rtrim(x)), F.substr(x, F.length(F.rtrim(x)) + 1, F.lit(1))))
                return F.struct(F.concat(acc["out"], F.coalesce(held, F.element_at(groups, i))).alias("out"), F.coalesce(e + 1, i + 1).alias("next"))

            return F.when(i < acc["next"], acc).otherwise(_let(last, put))

        return F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step, lambda acc: acc["out"])

    return _let(F.regexp_extract_all(v, F.lit("[^ -]+[ -]?"), F.lit(0)), spans)


def _iban(key: str, v: Column) -> Column:
    """The longest part of ``v`` that ends with a group and validates replaced; cards in what remains."""
    def valid(s: Column) -> Column:
        return F.length(s).between(15, 34) & (_mod97(F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))) == 1)

    def made(x: Column) -> Column:
        s = F.regexp_replace(x, " ", "")
        country, account = F.substr(s, F.lit(1), F.lit(2)), F.substr(s, F.lit(5), F.length(s))
        new = _refill(account, _decimal(key, "iban", _digits(account)))
        check = _let(new, lambda a: F.concat(_pad(98 - _mod97(F.concat(a, country, F.lit("00"))), 2), _digits(a)))
        rest = F.substr(v, F.length(x) + 1, F.length(v))
        return F.when(x == "", _cards(key, v)).otherwise(F.concat(_refill(x, check), F.when(rest == "", rest).otherwise(F.concat(F.lit(" "), _cards(key, F.ltrim(rest))))))

    ends = lambda g: F.transform(F.sequence(F.size(g), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(g, 1, k), " "))
    found = F.filter(_let(F.split(v, " "), ends), lambda x: valid(F.regexp_replace(x, " ", "")))
    return _let(F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("")), made)


def _phone(key: str, v: Column) -> Column:
    def made(d: Column) -> Column:
        n = F.length(d)
        ten = F.substr(d, n - 9, F.lit(10))
        area, exchange = F.substr(ten, F.lit(1), F.lit(3)).cast("int"), F.substr(ten, F.lit(4), F.lit(3)).cast("int")
        # Area codes below 200 go among themselves, then exchanges below 200, then the valid numbers.
        low, short = F.when(area < 200, 0).otherwise(200), F.when(area < 200, 0).when(exchange < 200, 0).otherwise(200)
        many, most = F.when(area < 200, 200).otherwise(800), F.when(area < 200, 1000).when(exchange < 200, 200).otherwise(800)
        pair = feistel(key, "phone", area - low, (exchange - short) * 10000 + F.substr(ten, F.lit(7), F.lit(4)).cast("int"), many, most * 10000)
        us = _let(pair, lambda p: F.concat(F.substr(d, F.lit(1), n - 10), _pad(p["l"] + low, 3), _pad(F.floor(p["r"] / 10000) + short, 3), _pad(p["r"] % 10000, 4)))
        other = F.concat(F.substr(d, F.lit(1), F.lit(2)), _decimal(key, "phone", F.substr(d, F.lit(3), n)))
        named = v.startswith("+") & ~v.startswith("+1")
        return _refill(v, F.when(named, other).otherwise(us))

    return _let(_digits(v), made)


def _ssn(key: str, v: Column) -> Column:
    def made(d: Column) -> Column:
        part = lambda at, n: F.substr(d, F.lit(at), F.lit(n)).cast("int")
        area, group, serial = part(1, 3), part(4, 2), part(6, 4)
        tax = area >= 900
        left = F.when(tax, area - 900).otherwise(area - 1 - (area > 666).cast("int"))
        pair = feistel(key, F.when(tax, "tax").otherwise("ssn"), left, (group - 1) * 9999 + serial - 1, F.when(tax, 100).otherwise(898), 99 * 9999)
        first = lambda p: F.when(tax, p["l"] + 900).otherwise(p["l"] + 1 + (p["l"] >= 665).cast("int"))
        new = _let(pair, lambda p: F.concat(_pad(first(p), 3), _pad(F.floor(p["r"] / 9999) + 1, 2), _pad(p["r"] % 9999 + 1, 4)))
        return F.when((area > 0) & (area != 666) & (group > 0) & (serial > 0), _refill(v, new)).otherwise(v)

    return _let(_digits(v), made)


def _ip(key: str, v: Column) -> Column:
    def made(o: Column) -> Column:
        at = lambda k: F.element_at(o, k).cast("int")
        pair = feistel(key, "ip", at(1) * 256 + at(2), at(3) * 256 + at(4), 1 << 16, 1 << 16)
        new = _let(pair, lambda p: F.concat_ws(".", *(x.cast("bigint").cast("string") for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256))))
        return F.when(F.forall(o, lambda x: x.cast("int") <= 255), new).otherwise(v)

    return _let(F.split(v, r"\."), made)


def _ip6(key: str, v: Column) -> Column:
    """The eight groups in full; what doesn't come to eight stays."""
    groups = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")
    short = v.contains("::")
    head, tail = groups(F.substring_index(v, "::", 1)), F.when(short, groups(F.substring_index(v, "::", -1))).otherwise(F.array().cast("array<string>"))

    def made(g: Column) -> Column:
        word = lambda k: F.conv(F.concat(F.lpad(F.element_at(g, k), 4, "0"), F.lpad(F.element_at(g, k + 1), 4, "0")), 16, 10).cast("long")
        halves = [feistel(key, f"ip6 {k}", word(k), word(k + 2), 1 << 32, 1 << 32) for k in (1, 5)]
        text = lambda n: F.lpad(F.lower(F.conv(n.cast("string"), 10, 16)), 8, "0")
        four = lambda p: F.concat_ws(":", *(F.substr(text(p[c]), F.lit(at), F.lit(4)) for c in ("l", "r") for at in (1, 5)))
        return F.when(F.size(g) == 8, F.concat_ws(":", *(_let(h, four) for h in halves))).otherwise(v)

    fill = F.when(short, F.greatest(8 - F.size(head) - F.size(tail), F.lit(1))).otherwise(0)
    return _let(F.concat(head, F.array_repeat(F.lit("0"), fill), tail), made)


BASE = "1800-01-01"
#: Months, and days up to the 12th and after it, in 400 years.
MONTHS, EARLY, LATE = 4800, (240, 240), (9, 9833)


def _permuted_day(key: str, day: Column) -> Column:
    """The pseudonym of a date: among the days up to the 12th of a month, or among the later ones."""
    base = F.lit(BASE).cast("date")
    month = (F.year(day) - 1800) * 12 + F.month(day) - 1
    begin = lambda k: F.add_months(base, k.cast("int"))
    later = lambda k: F.datediff(begin(k), base) - 12 * k  # later days before month k
    early = feistel(key, "date", F.floor((month * 12 + F.dayofmonth(day) - 1) / EARLY[1]), (month * 12 + F.dayofmonth(day) - 1) % EARLY[1], *EARLY)
    early = _let(_let(early, lambda p: p["l"] * EARLY[1] + p["r"]), lambda n: F.date_add(begin(F.floor(n / 12)), (n % 12).cast("int")))
    rank = later(month) + F.dayofmonth(day) - 13
    late = _let(feistel(key, "late date", F.floor(rank / LATE[1]), rank % LATE[1], *LATE), lambda p: p["l"] * LATE[1] + p["r"])

    def placed(n: Column) -> Column:
        guess = F.floor(n * MONTHS / (LATE[0] * LATE[1]))  # off by one month at most
        of = F.when(n >= later(guess + 1), guess + 1).when(n >= later(guess), guess).otherwise(guess - 1)
        return _let(of, lambda k: F.date_add(begin(k), (12 + n - later(k)).cast("int")))

    return F.when(F.dayofmonth(day) <= 12, early).otherwise(_let(late, placed))


def _date(key: str, v: Column) -> Column:
    """month/day/year, or day/month/year where only that is a date."""
    digits = _digits(v)
    part = lambda at, n: F.substr(digits, F.lit(at), F.lit(n))
    first, dotted = v.rlike(r"^\d{4}"), v.contains(".")
    date = lambda y, m, d: F.concat_ws("-", y, m, d).try_cast("date")
    american, european = date(part(5, 4), part(1, 2), part(3, 2)), date(part(5, 4), part(3, 2), part(1, 2))
    day = F.when(first, date(part(1, 4), part(5, 2), part(7, 2))).when(dotted, european).otherwise(F.coalesce(american, european))
    shape = F.when(first, F.when(v.contains("-"), 1).otherwise(2)).when(dotted, 3).when(american.isNotNull(), 4).otherwise(5)
    spelled = ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy")

    def made(d: Column) -> Column:
        text = F.when(shape == 1, F.date_format(d, spelled[0]))
        for k, pattern in enumerate(spelled[1:], 2):
            text = text.when(shape == k, F.date_format(d, pattern))
        return text

    inside = _let(day, lambda d: F.when(F.year(d).between(1800, 2199), _let(_permuted_day(key, d), made)))
    return F.coalesce(inside, v)


def _hashed(key: str, kind: str, s: Column) -> Column:
    """A keyed hash of the same length."""
    return _let(s, lambda x: F.substr(F.repeat(_hash(key, kind, x), F.ceil(F.length(x) / 64).cast("int")), F.lit(1), F.length(x)))


def _word(key: str, kind: str, s: Column) -> Column:
    """Lower-case letters and digits permuted among those of their number, in the places they have; over 22 of them, a hash."""
    def made(x: Column) -> Column:
        n = F.length(x)
        u = F.floor(n / 2).cast("int")
        number = lambda at, size: F.coalesce(F.conv(F.substr(x, at, size), 36, 10).cast("long"), F.lit(0).cast("long"))
        power = lambda k: F.pow(F.lit(36.0), k).cast("long")
        out = feistel(key, F.concat(F.lit(kind), n.cast("string")), number(F.lit(1), u), number(u + 1, n - u), power(u), power(n - u))
        text = lambda k, size: F.lpad(F.lower(F.conv(k.cast("string"), 10, 36)), size, F.lit("0"))
        new = _let(out, lambda p: F.concat(F.when(u > 0, text(p["l"], u)).otherwise(F.lit("")), text(p["r"], n - u)))
        return F.when(n == 0, s).when(n <= 22, _refill(s, new, "[a-z0-9]")).otherwise(_hashed(key, kind, s))

    return _let(F.regexp_replace(s, "[^a-z0-9]", ""), made)


def _mail(key: str, v: Column) -> Column:
    lower = F.lower(v)
    labels = F.split(F.substring_index(lower, "@", -1), r"\.")
    hosts = F.transform(F.slice(labels, 1, F.size(labels) - 1), lambda x: _word(key, "host", x))
    return F.concat(_word(key, "mail", F.substring_index(lower, "@", 1)), F.lit("@"), F.array_join(hosts, "."), F.lit("."), F.element_at(labels, -1))


def _secret(key: str, v: Column) -> Column:
    value = F.regexp_extract(v, r"[A-Za-z0-9_+/.-]+$", 0)
    named = F.concat(F.substr(v, F.lit(1), F.length(v) - F.length(value)), _hashed(key, "secret", value))
    return F.when(v.rlike(r"^AKIA[0-9A-Z]{16}$"), F.concat(F.lit("AKIA"), F.upper(_word(key, "access", F.lower(F.substr(v, F.lit(5), F.lit(16))))))).otherwise(named)


def pseudonym(v: Column, key: str) -> Column:
    """The pseudonym of one candidate; the candidate itself if it doesn't validate."""
    whole = lambda p: v.rlike(f"^(?:{p})$")
    out = F.when(v.contains("@"), _mail(key, v)).when(whole(SECRET), _secret(key, v)).when(whole(IBAN), _iban(key, v))
    out = out.when(whole(DATE), _date(key, v)).when(whole(IP), _ip(key, v)).when(whole(IP6), _ip6(key, v)).when(whole(SSN), _ssn(key, v))
    return out.when(whole(PHONE), _phone(key, v)).otherwise(_cards(key, v))


def pseudonymize(docs: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with its text under pseudonyms; all other columns, and rows without candidates, stay as they are.

    Null and empty texts stay. Repeated rows stay and get equal texts, as do ties of any kind: a pseudonym
    depends on the key and the value alone. An empty table stays empty.
    """
    text = F.col(text_col)
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    names = docs.columns
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), found.alias("found"))
    pieces = F.split(F.col(f"row.`{text_col}`"), ANY, -1)
    new = F.transform("found", lambda v: pseudonym(v, key))
    joined = F.array_join(F.zip_with(pieces, new, lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
    out = F.when(F.size("found") > 0, joined).otherwise(F.col(f"row.`{text_col}`"))
    return held.select(*((out if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names))


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table with its texts under pseudonyms."""
    return pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key=TEST_KEY)
