"""PII: format-preserving Feistel pseudonyms, all in SQL expressions.

Values are found by pattern and validated: payment card numbers (issuer prefix and
Luhn), telephone numbers, IPv4 addresses, social security numbers, calendar dates,
e-mail addresses, long hexadecimal tokens and assigned secrets. Each is replaced by a
keyed permutation of its own format: equal values get equal pseudonyms in every
document, different values different ones, pseudonyms pass the same validation, and
whoever holds the key can invert them (``invert=True``).

Strings of symbols are split into two halves and ``ROUNDS`` times a keystream made from
SHA-512 of key, format, round and one half is added to the other; numbers are two
residues treated alike, so any range that is a product of two sizes is permuted
exactly. What a product can't express is reached by cycle walking: the permutation is
repeated until the value is of its own class again.

* Separators, e-mail domains, country codes and a card's first four digits stay; the
  check digit is made anew. Symbols are case sensitive but for hexadecimal tokens,
  which stay all lower or all upper case.
* Social security numbers are permuted among the valid ones (areas 001-665 and
  667-899, groups 01-99, serials 0001-9999). North American telephone numbers keep
  whether area and exchange start with 0 or 1, so valid ones stay valid.
* Day numbers are permuted inside 1900-01-01 and the 73,000 days from it (250 x 292),
  other days are rotated by a keyed amount inside the days before or after. Days of
  the month up to 12 stay so, as do those above, so a date with slashes can be read
  in one way before and after. A date keeps its way of writing, and one date has one
  pseudonym in all of them.

Edge cases: null stays null, the empty text empty; what fails validation stays as it
is; overlapping finds go to the leftmost; a column named like the count is replaced,
all other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import free_name

#: Rounds of a network (even), and steps after which cycle walking has ended but for about 1e-14 of all values.
ROUNDS, WALK = 8, 64
DIGITS, HEX, ALNUM = "0123456789", "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Issuer prefixes and lengths of payment cards (fixed values of the public numbering plan).
ISSUERS = r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11}|35(?:2[89]|[3-8][0-9])[0-9]{12}|6(?:011|4[4-9][0-9]|5[0-9]{2})[0-9]{12}|62[0-9]{14,17})$"

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Kind -> pattern; the order decides where several match at a place.
PATTERNS = {
    "secret": r"(?<![A-Za-z0-9])(?i:token|secret|password|passwd|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?[A-Za-z0-9+/_-]{12,}+",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}",
    "hex": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-]|\.[0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "phone": r"(?:(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "ipv4": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])",
}
ANY = "|".join(PATTERNS.values())


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _col(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _keystream(key: str, name: Column | str, turn: Column | int, half: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), _col(name), _col(turn).cast("string"), _col(half)), 512)


def _number(key: str, name: Column | str, turn: Column | int, half: Column | str) -> Column:
    return F.conv(F.substring(_keystream(key, name, turn, half), 1, 12), 16, 10).cast("long")


def _rounds(invert: bool) -> Column:
    return F.sequence(F.lit(ROUNDS), F.lit(1)) if invert else F.sequence(F.lit(1), F.lit(ROUNDS))


def _walk(value: Column, step: Callable[[Column], Column], own_class: Callable[[Column], Column]) -> Column:
    """``step`` repeated until ``own_class`` holds: a permutation of the class, if ``step`` is one of a larger set."""

    def once(state: Column, _: Column) -> Column:
        return F.when(state["done"], state).otherwise(_let(step(state["v"]), lambda v: F.struct(v.alias("v"), own_class(v).alias("done"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(value.alias("v"), F.lit(False).alias("done")), once, lambda s: s["v"])


def permute(value: Column, alphabet: str, key: str, name: str, invert: bool = False) -> Column:
    """A keyed permutation of the strings of the value's length over ``alphabet``; foreign symbols count as the first."""
    letters, radix, sign = F.lit(alphabet), len(alphabet), -1 if invert else 1

    def add(half: Column, stream: Column) -> Column:
        def symbol(i: Column) -> Column:
            at = F.greatest(F.instr(letters, F.substring(half, i, F.lit(1))) - 1, F.lit(0))
            shift = F.conv(F.substring(stream, F.pmod(i - 1, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            return F.substring(letters, F.pmod(at + sign * shift, F.lit(radix)) + 1, F.lit(1))

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), symbol), "")

    def turn(halves: Column, k: Column) -> Column:
        a, b = halves["a"], halves["b"]
        if invert:
            return _let(_keystream(key, name, k, a), lambda s: F.struct(add(b, s).alias("a"), a.alias("b")))
        return _let(_keystream(key, name, k, b), lambda s: F.struct(b.alias("a"), add(a, s).alias("b")))

    u = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), u).alias("a"), F.substring(value, u + 1, F.length(value)).alias("b"))
    whole = F.aggregate(_rounds(invert), start, turn, lambda h: F.concat(h["a"], h["b"]))
    return F.when(F.length(value) > 1, whole).when(F.length(value) == 1, add(value, _keystream(key, name, 0, ""))).otherwise(value)


def permute_pair(a: Column, size_a: Column | int, b: Column, size_b: Column | int, key: str, name: Column | str, invert: bool = False) -> Column:
    """A keyed permutation of the pairs (a, b) with 0 <= a < size_a and 0 <= b < size_b, as a struct."""
    size_a, size_b, sign = _col(size_a).cast("long"), _col(size_b).cast("long"), -1 if invert else 1

    def turn(s: Column, k: Column) -> Column:
        even = F.pmod(k, F.lit(2)) == 0
        new_a = F.when(even, F.pmod(s["a"] + sign * _number(key, name, k, s["b"].cast("string")), size_a)).otherwise(s["a"])
        new_b = F.when(even, s["b"]).otherwise(F.pmod(s["b"] + sign * _number(key, name, k, s["a"].cast("string")), size_b))
        return F.struct(new_a.alias("a"), new_b.alias("b"))

    return F.aggregate(_rounds(invert), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def luhn_sum(digits: Column) -> Column:
    """The weighted digit sum; the last digit counts once."""
    n = F.length(digits)

    def weigh(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * (F.pmod(n - i, F.lit(2)) + 1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), weigh)


def _refill(shape: Column, symbols: Column, fits: str) -> Column:
    """``shape`` with its characters of class ``fits`` replaced in turn."""

    def place(state: Column, i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        new = F.substring(symbols, state["k"] + 1, F.lit(1))
        return F.when(c.rlike(f"^{fits}$"), F.struct((state["k"] + 1).alias("k"), F.concat(state["s"], new).alias("s"))).otherwise(F.struct(state["k"].alias("k"), F.concat(state["s"], c).alias("s")))

    return F.aggregate(F.sequence(F.lit(1), F.length(shape)), F.struct(F.lit(0).alias("k"), F.lit("").alias("s")), place, lambda s: s["s"])


def _rewrite(found: Column, alphabet: str, fits: str, key: str, name: str, invert: bool) -> Column:
    """Permute all symbols of class ``fits`` in a find, keep the rest."""
    return _let(F.regexp_replace(found, f"[^{fits[1:]}", ""), lambda symbols: F.when(F.length(symbols) > 0, _refill(found, permute(symbols, alphabet, key, name, invert), fits)).otherwise(found))


def _hex(found: Column, key: str, invert: bool) -> Column:
    """A hexadecimal token in its own case; without letters it counts as lower case."""
    lower = permute(found, HEX, key, "hex", invert)
    upper = _walk(F.lower(found), lambda v: permute(v, HEX, key, "hex", invert), lambda v: v.rlike("[a-f]"))
    return F.when(found.rlike("[A-F]"), F.upper(upper)).otherwise(lower)


_IS_HEX = "^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})$"


def _secret(value: Column, key: str, invert: bool) -> Column:
    """Tokens like bare ones; other values stay other values."""
    other = _walk(value, lambda v: _rewrite(v, ALNUM, "[0-9A-Za-z]", key, "secret", invert), lambda v: ~v.rlike(_IS_HEX))
    return F.when(value.rlike(_IS_HEX), _hex(value, key, invert)).otherwise(other)


def _card(found: Column, key: str, invert: bool) -> Column:
    def new(digits: Column) -> Column:
        body = F.concat(F.substring(digits, 1, 4), permute(F.substring(digits, F.lit(5), F.length(digits) - 5), DIGITS, key, "card", invert))
        return _let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    return _let(F.regexp_replace(found, "[^0-9]", ""), lambda d: F.when(d.rlike(ISSUERS) & (F.pmod(luhn_sum(d), F.lit(10)) == 0), _refill(found, new(d), "[0-9]")).otherwise(found))


def _ipv4(found: Column, key: str, invert: bool) -> Column:
    octets = F.split(found, "\\.")
    as_hex = F.array_join(F.transform(octets, lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0")), "")
    return _let(permute(as_hex, HEX, key, "ipv4", invert), lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10)), "."))


def _padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _ssn(found: Column, key: str, invert: bool) -> Column:
    area, group, serial = (F.substring(found, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    place = area - F.when(area > 666, 2).otherwise(1)

    def write(p: Column) -> Column:
        return F.concat_ws("-", _padded(p["a"] + F.when(p["a"] >= 665, 2).otherwise(1), 3), _padded(F.floor(p["b"] / 9999) + 1, 2), _padded(F.pmod(p["b"], F.lit(9999)) + 1, 4))

    return _let(permute_pair(place, 898, (group - 1) * 9999 + serial - 1, 99 * 9999, key, "ssn", invert), write)


def _phone(found: Column, key: str, invert: bool) -> Column:
    """The number after the country code."""
    country = F.regexp_extract(found, "^(\\+[0-9]{1,3}(?=[ .(-])|\\+[0-9]|)(.*)$", 1)
    rest = F.substring(found, F.length(country) + 1, F.length(found))

    def american(digits: Column) -> Column:
        area, exchange, line = (F.substring(digits, at, n).cast("long") for at, n in ((1, 3), (4, 3), (7, 4)))
        low_a, low_e = F.when(area >= 200, 200).otherwise(0), F.when(exchange >= 200, 200).otherwise(0)
        size_a, size_e = F.when(area >= 200, 800).otherwise(200), F.when(exchange >= 200, 800).otherwise(200)
        pair = permute_pair(area - low_a, size_a, (exchange - low_e) * 10000 + line, size_e * 10000, key, F.concat_ws("/", F.lit("phone"), size_a.cast("string"), size_e.cast("string")), invert)
        return _let(pair, lambda p: F.concat(_padded(p["a"] + low_a, 3), _padded(F.floor(p["b"] / 10000) + low_e, 3), _padded(F.pmod(p["b"], F.lit(10000)), 4)))

    def new(digits: Column) -> Column:
        return F.when(country.isin("", "+1") & (F.length(digits) == 10), american(digits)).otherwise(permute(digits, DIGITS, key, "phone", invert))

    return F.concat(country, _let(F.regexp_replace(rest, "[^0-9]", ""), lambda d: _refill(rest, new(d), "[0-9]")))


#: First day of the permuted range, its sides, and the first and last day that can be written with four digits.
DAY_0, SIDE_A, SIDE_B = "1900-01-01", 250, 292
FIRST_DAY, LAST_DAY = "0001-01-01", "9999-12-31"


def permute_day(day: Column, key: str, invert: bool = False) -> Column:
    """A date as a date: a permutation of the days inside the range, and of those before and after it, each among days of the month up to 12 or above."""
    size, sign = SIDE_A * SIDE_B, -1 if invert else 1
    first = F.lit(DAY_0).cast("date")
    before = F.datediff(first, F.lit(FIRST_DAY).cast("date")).cast("long")
    after = F.datediff(F.lit(LAST_DAY).cast("date"), first).cast("long") + 1 - size

    def step(n: Column) -> Column:
        inside = _let(permute_pair(F.floor(n / SIDE_B), SIDE_A, F.pmod(n, F.lit(SIDE_B)), SIDE_B, key, "day", invert), lambda s: s["a"] * SIDE_B + s["b"])
        early = F.pmod(n + before + sign * _number(key, "day", 0, "before"), before) - before
        late = F.pmod(n - size + sign * _number(key, "day", 0, "after"), after) + size
        return F.when(n < 0, early).when(n >= size, late).otherwise(inside)

    def late_in_month(n: Column) -> Column:
        return F.dayofmonth(F.date_add(first, n.cast("int"))) > 12

    moved = _walk(F.datediff(day, first).cast("long"), step, lambda n: late_in_month(n) == (F.dayofmonth(day) > 12))
    return F.date_add(first, moved.cast("int"))


def _date(found: Column, key: str, invert: bool) -> Column:
    y_first = found.rlike("^[0-9]{4}")
    year = F.when(y_first, F.substring(found, 1, 4)).otherwise(F.substring(found, 7, 4))
    p, q = F.when(y_first, F.substring(found, 6, 2)).otherwise(F.substring(found, 4, 2)), F.when(y_first, F.substring(found, 9, 2)).otherwise(F.substring(found, 1, 2))
    day_month = F.try_to_timestamp(F.concat_ws("-", year, p, q), F.lit("yyyy-MM-dd")).cast("date")
    month_day = F.try_to_timestamp(F.concat_ws("-", year, q, p), F.lit("yyyy-MM-dd")).cast("date")
    # day first where that is a date; with slashes else month first
    swapped = day_month.isNull() & found.contains("/")

    def write(d: Column) -> Column:
        style = F.when(y_first, F.date_format(d, "yyyy-MM-dd")).when(found.contains("."), F.date_format(d, "dd.MM.yyyy"))
        return style.when(swapped, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy"))

    given = F.coalesce(day_month, F.when(swapped, month_day))
    valid = given.isNotNull() & (given >= F.lit(FIRST_DAY).cast("date"))
    return F.when(valid, _let(permute_day(given, key, invert), write)).otherwise(found)


def pseudonym(found: Column, key: str, invert: bool = False) -> Column:
    """The pseudonym of one find of ``ANY``, or what it stands for."""
    is_kind = {k: found.rlike(f"^(?:{p})$") for k, p in PATTERNS.items()}
    assigned = F.regexp_extract(found, "^(.*?[=:][ \\t]*[\"']?)(.*)$", 1)
    local = F.regexp_extract(found, "^([^@]*)", 1)
    rest = lambda head: F.substring(found, F.length(head) + 1, F.length(found))
    return (
        F.when(is_kind["secret"], F.concat(assigned, _let(rest(assigned), lambda v: _secret(v, key, invert))))
        .when(is_kind["email"], F.concat(_rewrite(local, ALNUM, "[0-9A-Za-z]", key, "email", invert), rest(local)))
        .when(is_kind["hex"], _hex(found, key, invert))
        .when(is_kind["date"], _date(found, key, invert))
        .when(is_kind["ssn"], _ssn(found, key, invert))
        .when(is_kind["phone"], _phone(found, key, invert))
        .when(is_kind["ipv4"], _ipv4(found, key, invert))
        .when(is_kind["card"], _card(found, key, invert))
        .otherwise(found)
    )


def pseudonymise(df: DataFrame, key: str, text: str = "text", count: str = "n_pseudonyms", invert: bool = False) -> DataFrame:
    """``text`` with its personal values replaced (or, inverted, restored), and ``count``: how many were. A narrow projection."""
    kept = [c for c in df.columns if c != count]
    finds_of, new_of = free_name(df, "finds"), free_name(df, "new")
    body = F.col(f"`{text}`")
    # few texts hold a digit or an at sign; only these are searched
    candidates = body.rlike("[0-9@]|(?i:token|secret|passw|key)")
    finds = F.when(candidates, F.regexp_extract_all(body, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    work = df.select(*[F.col(f"`{c}`") for c in kept], finds.alias(finds_of))
    work = work.withColumn(new_of, F.transform(finds_of, lambda m: pseudonym(m, key, invert)))
    gaps = F.split(body, ANY, -1)
    spliced = F.array_join(F.zip_with(gaps, F.concat(new_of, F.array(F.lit(""))), lambda g, m: F.concat(g, m)), "")
    changed = F.size(F.filter(F.zip_with(finds_of, new_of, lambda a, b: a != b), lambda x: x))
    out = [F.when(F.size(finds_of) > 0, spliced).otherwise(body).alias(text) if c == text else F.col(f"`{c}`") for c in kept]
    return work.select(*out, F.when(body.isNull(), 0).otherwise(changed).cast("int").alias(count))
