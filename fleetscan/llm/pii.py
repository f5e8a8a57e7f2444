"""Format-preserving pseudonyms of personal data, as Spark expressions only (operator 7).

One pattern finds candidates; each is validated by its kind (Luhn and IBAN check digits,
octet and calendar ranges) and then replaced within its format.  Numbers and dates are
permuted by a keyed Feistel network on their own domain, so the replacement is valid,
distinct values stay distinct, and equal values stay equal in every document:

* payment cards: all digits but the last are permuted, the check digit is made anew;
* telephone numbers: all digits after a country code are permuted, the layout stays;
* IPv4 addresses: the 32 bits are permuted;
* dates: the day's number in its 400-year calendar cycle is permuted;
* social security numbers and IBANs: their digits are permuted (IBAN check digits anew);
* e-mail addresses and secrets (known forms, or named by a key), which are no numbers,
  get keyed digests of their form.

What looks like a candidate but isn't valid (a 16-digit number that fails Luhn, a date in
month 13) stays as it is.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: Rounds of the Feistel networks.
ROUNDS = 8

#: The name of a secret, in quotes or not (JSON, also within a string), and
#: the separators.
_NAME = r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api[_\-]?key)(?:\\?[\x22'`])?[ \t]*+"
_EQUALS, _COLON = r"(?:=>|:=|={1,3}+)[ \t]*+", r":(?!=)[ \t]*+"
#: A value of 8 signs or more in quotes, up to the closing one of its line. All repeated
#: groups are possessive, which Java runs without recursion: values have no longest length.
_QUOTED = "|".join([r"\\\x22(?:[^\x22\\\r\n]|\\\\\\\x22|\\(?!\x22)){8,}+\\\x22", *(rf"{q}(?:[^{q}\\\r\n]|\\.){{8,}}+{q}" for q in (r"\x22", "'", "`"))])
#: A sign of a value without quotes, which runs to white space; a quote belongs to it before
#: a word's sign only, and stops that end a clause don't.
_INNER = r"[^\s\x22'`,;.:)\]}>]"
_SIGN = rf"(?:{_INNER}|[,;.:)\]}}>](?=[,;.:)\]}}>]{{0,64}}+{_INNER})|[\x22'`](?=\w))"
#: Behind a colon, which prose has too, such a value needs a digit or a sign in its first 513.
#: Looking ahead is bounded (64 stops, 512 letters), so a text's length counts once.
_IN_CODE = rf"(?=[\p{{L}}\p{{M}}\-'`’,;.:)\]}}>]{{0,512}}+(?:[\d#$%&*+/=@^_|~\\]|[!?]{_INNER}))"
_OPEN = r"(?:\\?[\x22'`])?"
_KEYED = f"{_NAME}(?:{_EQUALS}(?:{_QUOTED}|{_OPEN}{_SIGN}{{8,}}+)|{_COLON}(?:{_QUOTED}|{_OPEN}{_IN_CODE}{_SIGN}{{8,}}+))"
#: The candidate patterns by kind, in the order they are tried. Each repeat is of
#: a class, possessive, or bounded (126 labels are the most that a host name has), so that
#: Java's matcher, which recurses for other groups, needs little stack for any text.
PATTERNS: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}+\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-f]{40}|[0-9A-F]{40}|[0-9a-f]{32}|[0-9A-F]{32}|[0-9a-f]{64}|[0-9A-F]{64})(?![A-Za-z0-9])",
    "keyed_secret": _KEYED,
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d\-])\d{3}-\d{3}-\d{4}(?![\d\-])",
    "date": r"(?<![\d\-/.])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d\-/]|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\w\-])(?:\d{13,19}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{6}-\d{5}|\d{4} \d{6} \d{5})(?![\w\-])",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without any of these have no candidate: every pattern needs a digit or "@" but for
#: known secrets of letters alone and keyed ones.
MAY_HAVE = rf"[@\d]|AKIA|gh[pousr]_|[a-f]{{32}}|[A-F]{{32}}|{_NAME}[:=]"
#: The days of 400 Gregorian years, as the product of two Feistel halves, and
#: the first day of such a cycle (others begin 400 years, or a multiple, before and after).
CYCLE_DAYS, DAYS_A, DAYS_B = 146097, 189, 773
FIRST_DAY = "1600-01-01"
#: Setting of the session with the key, and the key of tests.
KEY_SETTING = "spark.fleetscan.pseudonym.secret"
#: A key, which a plan shows, or a column that holds it.
Key = str | Column


def _mix(key: Key, label: str, i: Column, half: Column, modulus: Column) -> Column:
    """A round's keyed value below ``modulus``."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), i.cast("string"), half.cast("string"), modulus.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(value: Column, a: Column, b: Column, key: Key, label: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the numbers below a * b (a and b long, a * b below 2^63).

    The number is a pair (x below a, y below b); rounds add to one half, in turn, a keyed
    value of the other, which can be undone, so distinct numbers stay distinct.
    """

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        x = F.when(even, F.pmod(s["x"] + _mix(key, label, i, s["y"], a), a)).otherwise(s["x"])
        y = F.when(even, s["y"]).otherwise(F.pmod(s["y"] + _mix(key, label, i, s["x"], b), b))
        return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))

    def whole(v: Column) -> Column:
        start = F.struct(((v - F.pmod(v, b)) / b).cast("long").alias("x"), F.pmod(v, b).cast("long").alias("y"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn, lambda s: s["x"] * b + s["y"])

    return let(value, whole)


def _power(n: Column) -> Column:
    """10^n as a long, n at most 18."""
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("long")


def permute_digits(digits: Column, key: Key, label: str) -> Column:
    """A string of digits as another of the same length: a permutation for each length.
    Strings over 18 digits are permuted in two parts; one digit stays."""

    def part(d: Column, name: str) -> Column:
        n = F.length(d)
        low = F.floor(n / 2)
        return F.when(n < 2, d).otherwise(F.lpad(feistel(d.try_cast("long"), _power(n - low), _power(low), key, name).cast("string"), n, "0"))

    def whole(d: Column) -> Column:
        return F.when(F.length(d) <= 18, part(d, label)).otherwise(F.concat(let(F.substring(d, 1, 18), lambda x: part(x, label + "1")), let(F.substring(d, 19, 18), lambda x: part(x, label + "2"))))

    return let(digits, whole)


def relay(layout: Column, digits: Column) -> Column:
    """``layout`` with its digits replaced in turn by those of ``digits``."""

    def whole(d: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            is_digit = c.between("0", "9")
            return F.struct(F.concat(s["out"], F.when(is_digit, d.substr(s["i"] + 1, F.lit(1))).otherwise(c)).alias("out"), F.when(is_digit, s["i"] + 1).otherwise(s["i"]).alias("i"))

        return F.aggregate(F.split(layout, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step, lambda s: s["out"])

    return let(digits, whole)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, its last digit counted once."""

    def step(s: Column, c: Column) -> Column:
        d = c.try_cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((s["t"] + F.when(s["i"] % 2 == 0, d).otherwise(twice)).alias("t"), (s["i"] + 1).alias("i"))

    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("t"), F.lit(0).alias("i")), step, lambda s: s["t"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _card(m: Column, key: Key) -> Column:
    def made(d: Column) -> Column:
        # The Luhn sum of the new body and a 0 gives the check digit.
        body = permute_digits(d.substr(F.lit(1), F.length(d) - 1), key, "card")
        full = let(body, lambda x: F.concat(x, F.pmod(F.lit(10) - luhn_sum(F.concat(x, F.lit("0"))) % 10, F.lit(10)).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, relay(m, full))

    return let(_digits(m), made)


def _phone(m: Column, key: Key) -> Column:
    # The country code stays: the digits up to the first separator, or one digit.
    code = F.regexp_extract(m, r"^(\+(?:\d{1,3}(?=[ .\-(])|\d)|)", 1)

    def made(c: Column) -> Column:
        return F.concat(c, let(m.substr(F.length(c) + 1, F.length(m)), lambda rest: relay(rest, permute_digits(_digits(rest), key, "phone"))))

    return let(code, made)


def _ip(m: Column, key: Key) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.try_cast("long"))
    number = F.aggregate(parts, F.expr("0L"), lambda s, x: s * 256 + x)
    side = F.expr("65536L")
    spelled = let(feistel(number, side, side, key, "ip"), lambda n: F.concat_ws(".", *(F.pmod(F.shiftright(n, k), F.lit(256)).cast("string") for k in (24, 16, 8, 0))))
    return F.when(F.forall(parts, lambda x: x <= 255), spelled)


def _date(m: Column, key: Key) -> Column:
    """Year first, or day first where dots divide or the first number can't be a month, or
    else month first; the new date is written in the same way, with one-digit months and
    days where the old one has such."""
    first, second, third = (F.regexp_extract(m, r"^(\d+)\D(\d+)\D(\d+)$", k) for k in (1, 2, 3))
    sep = F.regexp_extract(m, r"([\-/.])", 1)
    year_first = F.length(first) == 4
    short = (F.length(first) == 1) | (F.length(second) == 1)

    def made(day_first: Column) -> Column:
        x, y = F.lpad(first, 2, "0"), F.lpad(second, 2, "0")
        iso = F.when(year_first, F.concat_ws("-", first, second, third)).when(day_first, F.concat_ws("-", third, y, x)).otherwise(F.concat_ws("-", third, x, y))
        number = F.datediff(iso.try_cast("date"), F.to_date(F.lit(FIRST_DAY))).cast("long")

        def permuted(n: Column) -> Column:
            inside = F.pmod(n, F.lit(CYCLE_DAYS))
            return F.when(n.isNotNull(), F.date_add(F.to_date(F.lit(FIRST_DAY)), (n - inside + feistel(inside, F.expr(f"{DAYS_A}L"), F.expr(f"{DAYS_B}L"), key, "date")).cast("int")))

        def spelled(d: Column) -> Column:
            year = F.lpad(F.year(d).cast("string"), 4, "0")
            month, day = (F.when(short, f(d).cast("string")).otherwise(F.lpad(f(d).cast("string"), 2, "0")) for f in (F.month, F.day))
            return F.when(d.isNotNull(), F.when(year_first, F.concat(year, sep, month, sep, day)).when(day_first, F.concat(day, sep, month, sep, year)).otherwise(F.concat(month, sep, day, sep, year)))

        return let(let(number, permuted), spelled)

    return let(m.contains(".") | (first.try_cast("int") > 12), made)


def _ssn(m: Column, key: Key) -> Column:
    """Among the valid numbers: 898 areas (001 to 899 but 666), 99 groups, 9999 serials."""

    def made(p: Column) -> Column:
        area, group, serial = F.substring(p, 1, 3).try_cast("long"), F.substring(p, 4, 2).try_cast("long"), F.substring(p, 6, 4).try_cast("long")
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        index = (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1) * 9999 + serial - 1
        new = feistel(index, F.expr("88902L"), F.expr("9999L"), key, "ssn")

        def spelled(n: Column) -> Column:
            high = (n - F.pmod(n, F.lit(9999))) / 9999
            a = F.floor(high / 99) + 1
            return F.concat_ws("-", F.lpad(F.when(a >= 666, a + 1).otherwise(a).cast("string"), 3, "0"), F.lpad((F.pmod(high.cast("long"), F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(n, F.lit(9999)) + 1).cast("string"), 4, "0"))

        return F.when(valid, let(new, spelled))

    return let(_digits(m), made)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of a string of letters (A is 10) and digits."""
    return F.aggregate(F.split(text, ""), F.expr("0L"), lambda s, c: F.when(c.between("0", "9"), (s * 10 + c.try_cast("long")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, key: Key) -> Column:
    """Country and letters stay; the other digits are permuted, the check digits anew."""

    def made(p: Column) -> Column:
        country, body = F.substring(p, 1, 2), F.substring(p, 5, 40)
        joined = let(relay(body, permute_digits(_digits(body), key, "iban")), lambda x: F.concat(country, F.lpad((98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))
        spaced = let(joined, lambda x: F.when(m.contains(" "), F.trim(F.regexp_replace(x, "(.{4})", "$1 "))).otherwise(x))
        return F.when(_mod97(F.concat(body, F.substring(p, 1, 4))) == 1, spaced)

    return let(F.regexp_replace(m, " ", ""), made)


def _digest(m: Column, key: Key, label: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), m), 256)


def _email(m: Column, key: Key) -> Column:
    return F.concat(F.lit("u"), F.substring(_digest(F.lower(m), key, "email"), 1, 16), F.lit("@example.invalid"))


def _secret(m: Column, key: Key) -> Column:
    """Of the same length and case; a known prefix stays. Digests are chained to any length."""

    def made(prefix: Column) -> Column:
        n = F.length(m) - F.length(prefix)

        def chain(first: Column) -> Column:
            more = F.when(n > 128, F.array_join(F.transform(F.sequence(F.lit(3), F.ceil(n / 64).cast("int")), lambda i: F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), i.cast("string"), first), 256)), "")).otherwise("")
            return F.concat(first, _digest(m, key, "secret2"), more)

        new = let(_digest(m, key, "secret"), chain).substr(F.lit(1), n)
        return F.concat(prefix, F.when(F.upper(m) == m, F.upper(new)).otherwise(new))

    return let(F.regexp_extract(m, r"^(AKIA|gh[pousr]_|)", 1), made)


def _keyed_secret(m: Column, key: Key) -> Column:
    """The value after the name, which stays, as do the quotes."""

    def made(name: Column) -> Column:
        rest = m.substr(F.length(name) + 1, F.length(m))
        # A value without quotes doesn't end in one.
        end = F.when(~m.rlike(r"[\x22'`]$"), 0).when(name.endswith("\\\""), 2).otherwise(1)
        return F.concat(name, let(rest.substr(F.lit(1), F.length(rest) - end), lambda v: _secret(v, key)), F.when(end > 0, F.right(m, end)).otherwise(""))

    return let(F.regexp_extract(m, f"^({_NAME}(?:{_EQUALS}|{_COLON}){_OPEN})", 1), made)


_MAKERS = {"email": _email, "secret": _secret, "keyed_secret": _keyed_secret, "ip": _ip, "phone": _phone, "date": _date, "ssn": _ssn, "iban": _iban, "card": _card}


def pseudonym(match: Column, key: Key) -> Column:
    """(kind, value) of one candidate by the first kind whose pattern it matches as a whole
    and that finds it valid; null where none does."""
    made = F.array(*(F.struct(F.lit(kind).alias("kind"), F.when(match.rlike(f"^(?:{PATTERNS[kind]})$"), make(match, key)).alias("value")) for kind, make in _MAKERS.items()))
    return F.get(F.filter(made, lambda s: s["value"].isNotNull()), F.lit(0))


def session_key(spark: SparkSession) -> str:
    """The session's key, from ``KEY_SETTING``, whose name has Spark redact it. Where it isn't set,
    one is drawn for the application, which all of its sessions share, so that equal values are
    linked within it and nobody can undo them; set it to link values over several runs."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))
    return key


_DRAWN: dict[str, str] = {}


SPANS = "array<struct<kind:string,start:bigint,length:bigint>>"


def pseudonymize(docs: DataFrame, text: str = "text", key: str | None = None, found: str = "pii") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, all columns kept, and ``found`` (an
    array of kind, start and length in characters of the original, in order).

    Null texts stay null and have an empty array; empty ones stay empty. Rows are
    independent, so repeated rows stay equal. ``key`` is the secret of the permutations,
    by default the session's (:func:`session_key`). It comes from a table of one row that is
    broadcast, as a literal would show in plans, the UI and event logs.
    Texts of any length are searched whole, in time that grows with their length. ``found``
    must be a new column's name.
    """
    if found.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {found} already")
    spark, t = docs.sparkSession, F.col(text)
    m, p, r, k = (fresh(docs, f"__pii_{x}") for x in "mprk")
    keys = spark.createDataFrame([(key or session_key(spark),)], f"`{k}` string")
    rows = docs.crossJoin(F.broadcast(keys)).withColumn(m, F.when(t.rlike(MAY_HAVE), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    has = F.size(m) > 0
    rows = rows.withColumn(p, F.when(has, F.split(t, ANY))).withColumn(r, F.when(has, F.transform(m, lambda x: pseudonym(x, F.col(k)))))
    before = F.slice(p, F.lit(1), F.size(m))
    joined = F.concat(F.array_join(F.zip_with(before, F.zip_with(m, r, lambda x, y: F.coalesce(y["value"], x)), lambda x, y: F.concat(x, y)), ""), F.element_at(p, -1))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["p"])
        one = F.struct(x["r"]["kind"].alias("kind"), start.cast("long").alias("start"), F.length(x["m"]).cast("long").alias("length"))
        return F.struct((start + F.length(x["m"])).cast("long").alias("at"), F.when(x["r"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(one))).alias("out"))

    none = F.array().cast(SPANS)
    spans = F.aggregate(F.arrays_zip(before.alias("p"), F.col(m).alias("m"), F.col(r).alias("r")), F.struct(F.expr("0L").alias("at"), none.alias("out")), step, lambda s: s["out"])
    return rows.select(*(F.when(has, joined).otherwise(t).alias(c) if c == text else F.col(c) for c in docs.columns), F.when(has, spans).otherwise(none).alias(found))
