"""PII: format-preserving pseudonyms from a keyed Feistel permutation, in DataFrame functions only.

Kinds, what makes a match valid, and the set that its pseudonym is drawn from:

- card: 13 to 19 digits, Luhn-valid, unbroken or with single spaces or single hyphens after each
  four digits or in the groups 4-6-5, 4-6-4, 4-4-5 or 6-13. First digit kept, the others
  permuted, check digit computed anew: another valid number of that length. Of two that start at
  one place the longer counts.
- ssn: ddd-dd-dddd with an area of 001-899 but 666, a group and a serial above zero. Permuted
  among all such numbers.
- phone: NANP forms with area and exchange of 200-999, permuted among these; with +1 also the
  others, permuted among themselves; other numbers that start with + and have 8 to 15 digits keep
  their first two digits.
- ip: dotted IPv4 without leading zeros, permuted among all addresses.
- date: yyyy-mm-dd (also / and .), dd.mm.yyyy, dd/mm/yyyy, and mm/dd/yyyy where the day cannot be
  first; a date of the calendar, permuted within its 400-year cycle.
- email: the local part becomes "u" and 16 hex digits of a keyed hash; the domain stays.
- secret: at least 32 hex digits given to a name such as token or key, as many digits of a keyed
  hash.

Separators stay where they are. What is not valid stays as it is, and is no match: it hides no
valid value that starts or ends inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "secret", "ip", "date", "ssn", "card", "phone")
ROUNDS = 10

# fixed values: the shapes of the kinds; no quantifier over a group is unbounded
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
_SECRET = (
    r"(?<=(?i:token|secret|api_key|apikey|key|password)[ ]{0,2}[=:][ ]{0,2}[\"']?)"
    r"(?<![0-9A-Fa-f])[0-9a-f]{32,128}(?![0-9A-Fa-f])"
)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d)(?!\.\d)"
# what a date needs is looked for ahead of its shape, so the separators are any character there
_YEAR = r"(?:1[6-9]|[2-9]\d)\d{2}"
_LEAP = r"(?:(?:1[6-9]|[2-9]\d)(?:0[48]|[2468][048]|[13579][26])|(?:16|[2468][048]|[3579][26])00)"
_D31, _D30, _D28 = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|[12]\d|30)", r"(?:0[1-9]|1\d|2[0-8])"
_M31, _M30 = r"(?:0[13578]|1[02])", r"(?:0[469]|11)"
_MONTH_DAY = rf"(?:{_M31}.{_D31}|{_M30}.{_D30}|02.{_D28})"
_DAY_MONTH = rf"(?:{_D31}.{_M31}|{_D30}.{_M30}|{_D28}.02)"
_YMD = rf"(?={_YEAR}.{_MONTH_DAY}|{_LEAP}.02.29)\d{{4}}([-/.])\d{{2}}\1\d{{2}}"
_DMY = (
    rf"(?={_DAY_MONTH}.{_YEAR}|29.02.{_LEAP}|(?=../)(?:{_MONTH_DAY}.{_YEAR}|02.29.{_LEAP}))"
    r"\d{2}([/.])\d{2}\2\d{4}"
)
_DATE = rf"(?<![\d/.-])(?:{_YMD}|{_DMY})(?!\d)(?![/.-]\d)"
_SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"
_NANP = r"(?:\(\d{3}\)[ ]?|\d{3}[-. ])\d{3}[-. ]\d{4}"
_ASSIGNED = r"(?:\([2-9]\d{2}\)[ ]?|[2-9]\d{2}[-. ])[2-9]\d{2}[-. ]\d{4}"
_CARD_START, _NUMBER_END = r"(?<![\d.+-])", r"(?!\d)(?![-.]\d)"
# groups of four, also with a short last one; a month or day before a slash is none
_CARD_LONG = r"\d{4}(?<a>[ -])(?:\d{4}\k<a>){3}\d{1,3}(?!/\d)"
_CARD = (
    r"(?:\d{13,19}|\d{4}(?<b>[ -])(?:\d{4}\k<b>){2}(?:\d{4}|\d{1,3}(?!/\d))"
    r"|\d{4}(?<c>[ -])\d{6}\k<c>\d{4,5}|\d{4}(?<d>[ -])\d{4}\k<d>\d{5}|\d{6}[ -]\d{13})"
)
# written out, as Java must see how far a look-behind goes
_EIGHT_TO_15 = r"[-. ()]{0,3}\d" * 8 + r"(?:[-. ()]{0,3}\d" * 7 + ")?" * 7


def _phone_shape(no_group: str) -> str:
    """A phone number none of whose groups after the first starts with ``no_group``.

    What follows + is taken as a whole, then its digits are counted: no part of it is a number.
    """
    group = rf"(?:{no_group}[-. ]?\(?\d{{1,4}}\)?)"
    return (
        rf"(?:\+1[-. ]?{_NANP}{_NUMBER_END}|(?>\+\d{{1,3}}{group}{{2,5}}{_NUMBER_END})"
        rf"(?<=\+{_EIGHT_TO_15}\)?)|(?<![\d+.-]){_ASSIGNED}{_NUMBER_END})"
    )


_BEFORE_CARD = "|".join(f"(?:{p})" for p in (_EMAIL, _SECRET, _IP, _DATE, _SSN))
_NO_CARD = f"{_BEFORE_CARD}|{_phone_shape('')}"


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _number(hex_text: Column, digits: int = 15) -> Column:
    return F.conv(F.substring(hex_text, 1, digits), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tag: Column) -> Column:
    """Permute the pairs (left, right) of Z_a x Z_b; struct of l and r.

    Each of an even number of rounds swaps the halves after adding to the left one, modulo its
    size, a keyed hash of the right one. This is a bijection for any sizes, so no value has to
    be drawn again to stay within the set.
    """
    state = F.struct(left.alias("l"), right.alias("r"), a.alias("a"), b.alias("b"))

    def one(s: Column, i: Column) -> Column:
        added = (s["l"] + _number(_hash(key, tag, i, s["r"])) % s["a"]) % s["a"]
        return F.struct(s["r"].alias("l"), added.alias("r"), s["b"].alias("a"), s["a"].alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, one)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n.cast("int") + 1, "0").cast("long")


def permute_digits(digits: Column, key: str, tag: str) -> Column:
    """Another string of as many digits (1 to 36): the keyed image of ``digits``."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    left = F.coalesce(F.substr(digits, F.lit(1), half).cast("long"), F.lit(0).cast("long"))
    right = F.substr(digits, half + 1).cast("long")
    mark = F.concat(F.lit(tag + ":"), n.cast("string"))
    out = feistel(left, right, _power(half), _power(n - half), key, mark)
    return _let(
        out,
        lambda s: F.concat(
            F.when(half > 0, F.lpad(s["l"].cast("string"), half, "0")).otherwise(""),
            F.lpad(s["r"].cast("string"), n - half, "0"),
        ),
    )


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once for several uses in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    step = lambda s, c: F.when(
        c.rlike("[0-9]"),
        F.struct(
            F.concat(s["t"], F.substr(digits, s["k"], F.lit(1))).alias("t"), (s["k"] + 1).alias("k")
        ),
    ).otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["k"].alias("k")))
    start = F.struct(F.lit("").alias("t"), F.lit(1).alias("k"))
    return F.aggregate(F.split(shape, ""), start, step)["t"]


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10; the last digit counts once."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)

    def swap(d: Column) -> Column:
        body = F.substr(d, F.lit(2), F.length(d) - 2)
        kept = F.concat(F.substring(d, 1, 1), permute_digits(body, key, "card"))
        number = _let(
            kept, lambda k: F.concat(k, ((10 - _luhn(F.concat(k, F.lit("0")))) % 10).cast("string"))
        )
        return F.when(_luhn(d) == 0, _let(number, lambda x: _refill(m, x)))

    return _let(digits, swap)


def _pair(left: Column, right: Column, a: int, b: int, key: str, tag: str, body) -> Column:
    size = lambda n: F.lit(n).cast("long")
    return _let(feistel(left, right, size(a), size(b), key, F.lit(tag)), body)


def _padded(number: Column, n: int) -> Column:
    return F.lpad(number.cast("string"), n, "0")


def _ssn(m: Column, key: str) -> Column:
    part = lambda at, n: F.substring(m, at, n).cast("long")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    left = area - 1 - F.when(area > 666, 1).otherwise(0)

    def write(s: Column) -> Column:
        new_area = s["l"] + 1 + F.when(s["l"] >= 665, 1).otherwise(0)
        new_group, new_serial = F.floor(s["r"] / 9999) + 1, s["r"] % 9999 + 1
        return F.concat_ws("-", _padded(new_area, 3), _padded(new_group, 2), _padded(new_serial, 4))

    return F.when(valid, _pair(left, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn", write))


def _phone(m: Column, key: str) -> Column:
    nanp = m.rlike(rf"^(?:\+1[-. ]?)?{_NANP}$")

    def swap(d: Column) -> Column:
        own = F.substr(d, F.length(d) - 9)
        area, exchange = F.substring(own, 1, 3).cast("long"), F.substring(own, 4, 3).cast("long")
        line = F.substring(own, 7, 4).cast("long")
        head = F.substr(d, F.lit(1), F.length(d) - 10)

        def write(a: Column, e: Column, last: Column) -> Column:
            return _refill(m, F.concat(head, _padded(a, 3), _padded(e, 3), _padded(last, 4)))

        def assigned(s: Column) -> Column:
            return write(F.floor(s["l"] / 800) + 200, s["l"] % 800 + 200, s["r"])

        def unassigned(s: Column) -> Column:
            # pairs with an area below 200 first, then those with only the exchange below 200
            low, rest = s["l"] < 200_000, s["l"] - 200_000
            a = F.when(low, F.floor(s["l"] / 1000)).otherwise(F.floor(rest / 200) + 200)
            return write(a, F.when(low, s["l"] % 1000).otherwise(rest % 200), s["r"])

        pair = F.when(area < 200, area * 1000 + exchange).otherwise(
            200_000 + (area - 200) * 200 + exchange
        )
        national = F.when(
            (area >= 200) & (exchange >= 200),
            _pair((area - 200) * 800 + exchange - 200, line, 640_000, 10_000, key, "nanp", assigned),
        ).when(
            m.startswith("+"), _pair(pair, line, 360_000, 10_000, key, "nanp-other", unassigned)
        )
        rest = permute_digits(F.substr(d, F.lit(3)), key, "phone")
        other = F.when(
            m.startswith("+") & F.length(d).between(8, 15),
            _let(F.concat(F.substring(d, 1, 2), rest), lambda x: _refill(m, x)),
        )
        return F.when(nanp, national).otherwise(other)

    return _let(_digits(m), swap)


def _ip(m: Column, key: str) -> Column:
    octet = lambda i: F.split_part(m, F.lit("."), F.lit(i)).cast("long")
    write = lambda s: F.concat_ws(
        ".",
        F.floor(s["l"] / 256).cast("string"), (s["l"] % 256).cast("string"),
        F.floor(s["r"] / 256).cast("string"), (s["r"] % 256).cast("string"),
    )
    return _pair(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), 65536, 65536, key, "ip", write)


def _date(m: Column, key: str) -> Column:
    year_first = m.rlike(r"^\d{4}")
    cut = lambda at, n: F.substring(m, at, n)
    year = F.when(year_first, cut(1, 4)).otherwise(cut(7, 4))
    second, first = F.when(year_first, cut(6, 2)).otherwise(cut(4, 2)), F.when(
        year_first, cut(9, 2)
    ).otherwise(cut(1, 2))
    swapped = ~year_first & (F.substring(m, 3, 1) == "/") & (second.cast("int") > 12)
    month, day = F.when(swapped, first).otherwise(second), F.when(swapped, second).otherwise(first)
    date = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")
    # 146097 days, the 400-year cycle of the calendar, are 189 times 773
    cycle_start = F.lit("2000-01-01").cast("date")
    since = F.date_diff(date, cycle_start).cast("long")
    in_cycle = F.pmod(since, F.lit(146_097).cast("long"))

    def write(s: Column) -> Column:
        moved = F.date_add(cycle_start, (since - in_cycle + s["l"] * 773 + s["r"]).cast("int"))
        ymd = F.date_format(moved, "yyyyMMdd")
        y, mo, d = F.substring(ymd, 1, 4), F.substring(ymd, 5, 2), F.substring(ymd, 7, 2)
        order = (
            F.when(year_first, F.concat(y, mo, d))
            .when(swapped, F.concat(mo, d, y))
            .otherwise(F.concat(d, mo, y))
        )
        return _refill(m, order)

    moved = _pair(F.floor(in_cycle / 773).cast("long"), in_cycle % 773, 189, 773, key, "date", write)
    return F.when(date.isNotNull() & (year.cast("int") >= 1600), moved)


def _pseudonym(m: Column, key: str) -> Column:
    """struct(kind, new) of a match; both null where it is not valid."""
    at = F.instr(m, "@")
    email = F.concat(F.lit("u"), F.substring(_hash(key, F.lit("email"), m), 1, 16), F.substr(m, at))
    secret_hash = F.concat(_hash(key, F.lit("s1"), m), _hash(key, F.lit("s2"), m))
    secret = F.substr(secret_hash, F.lit(1), F.length(m))
    cases = [
        ("email", at > 0, email),
        ("secret", m.rlike(r"^[0-9a-f]{32,128}$"), secret),
        ("ip", m.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), _ip(m, key)),
        ("date", m.rlike(rf"^(?:{_YMD}|{_DMY})$"), _date(m, key)),
        ("ssn", m.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(m, key)),
        ("phone", m.rlike(rf"^\+|^{_NANP}$"), _phone(m, key)),
        ("card", F.lit(True), _card(m, key)),
    ]
    chosen = None
    for kind, test, new in cases:
        own = F.struct(F.lit(kind).alias("kind"), new.alias("new"))
        chosen = F.when(test, own) if chosen is None else chosen.when(test, own)
    return chosen


def _shapes(text: Column) -> Column:
    """Pattern of all valid matches of ``text``: those of its cards that are Luhn-valid by name.

    Cards are looked for at every place, also inside others, so that an invalid number hides
    neither a card in it nor anything else.
    """

    def cards(shape: str) -> Column:
        return F.regexp_extract_all(
            text, F.lit(f"{_CARD_START}(?=({shape}){_NUMBER_END})"), F.lit(1)
        )

    distinct = F.array_distinct(F.concat(cards(_CARD_LONG), cards(_CARD)))
    valid = F.filter(distinct, lambda c: _luhn(_digits(c)) == 0)
    longest_first = F.reverse(
        F.array_sort(F.transform(valid, lambda c: F.struct(F.length(c).alias("n"), c.alias("c"))))
    )
    tail = lambda c: F.when(c.rlike(r"[ -]\d{1,3}$"), r"(?!/\d)").otherwise("")
    each = F.transform(longest_first, lambda x: F.concat(x["c"], tail(x["c"])))
    before, after = _phone_shape("\0").split("\0")

    def shapes(names: Column) -> Column:
        card = F.concat(
            F.lit(f"{_CARD_START}(?:"), F.array_join(names, "|"), F.lit(f"){_NUMBER_END}")
        )
        return F.when(F.size(names) == 0, F.lit(_NO_CARD)).otherwise(
            F.concat(
                F.lit(f"{_BEFORE_CARD}|"), card, F.lit(f"|{before}(?![-. ]?"), card,
                F.lit(f"){after}"),
            )
        )

    return _let(each, shapes)


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``pii_counts``: struct of a long for each kind.

    Equal values get equal pseudonyms in all documents; different values of a permuted kind and
    format never meet. Matches do not overlap; of kinds that start at one place, the first of
    ``KINDS`` wins. Text outside valid matches is unchanged. Null texts stay null, with counts of
    0; empty texts, repeated rows and an empty table need no special case. A column named
    ``pii_counts`` in ``docs`` is replaced; other columns are untouched, whatever their names.
    No shuffle.
    """
    names = docs.columns
    columns = [f"c{i}" for i in range(len(names))]  # no name of its own begins with a letter
    text = columns[names.index(text)]
    docs = docs.toDF(*columns)
    own = F.col(text).cast("string")
    has_any = own.rlike("[0-9@]")
    docs = docs.withColumn("_shapes", F.when(has_any, _shapes(own)))
    found = F.when(has_any, F.regexp_extract_all(own, F.col("_shapes"), F.lit(0)))
    none = F.array().cast("array<string>")
    pattern = F.transform(
        F.coalesce(found, none),
        lambda m: F.struct(m.alias("old"), _pseudonym(m, key).alias("made")),
    )
    marked = docs.withColumn("_made", pattern)
    is_valid = lambda x: x["made"]["new"].isNotNull()

    def count(kind: str) -> Column:
        own = F.filter("_made", lambda x: is_valid(x) & (x["made"]["kind"] == kind))
        return F.size(own).cast("long").alias(kind)

    counts = F.struct(*map(count, KINDS))
    gaps = F.split(own, F.col("_shapes"), -1)
    new = F.transform("_made", lambda x: F.coalesce(x["made"]["new"], x["old"]))
    joined = F.array_join(
        F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda g, n: F.concat(g, n)), ""
    )
    changed = F.exists("_made", is_valid)
    return marked.select(
        *[
            (F.when(changed, joined).otherwise(own) if c == text else F.col(c)).alias(n)
            for c, n in zip(columns, names)
            if n != "pii_counts"
        ],
        counts.alias("pii_counts"),
    )
