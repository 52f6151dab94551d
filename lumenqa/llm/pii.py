"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

A recognised value becomes a row of digits with a radix each (a card number: its decimal digits
without the check digit; a date: its day number in two mixed-radix digits; ...).  A keyed Feistel
network permutes that row: the digits are cut into two halves, and in each round one half is added,
digit by digit modulo its radices, to a SHA-256 stream of the key, the kind and the other half.  The
result is written back in the value's own format, with check digits made anew.  The map is a
permutation of the valid values of a format, so equal values stay equal, and different ones
different, across documents.

Numbers are validated first (first digit and Luhn, ISO 7064 mod 97, octets, calendar); what fails stays as it is.
A card may stand next to other numbers, so the recogniser takes the whole run of digit groups and
:func:`_cards` looks for the valid cards in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

ROUNDS = 8
#: Any 400 Gregorian years have 146,097 days = 189 x 773; dates of these years are permuted.
FIRST_DAY, DAY_RADICES = "1800-01-01", (189, 773)
DIGITS, HEX = "0123456789", "0123456789abcdef"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ACCENTED = "".join(chr(i) for i in range(0xE0, 0x100) if chr(i).isalpha())

#: How long the account numbers of the ISO 13616 registry are, by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: Recognisers, tried in this order at each place of a text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,24}",
    "token": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iso_date": r"(?<![\d-])\d{4}[-/.]\d{2}[-/.]\d{2}(?!\d)",
    "day_date": r"(?<![\d.])\d{1,2}[-/.]\d{1,2}[-/.]\d{4}(?!\d)",
    # National numbers of North America; the digits get the pseudonym they have after +1.
    "local_phone": r"(?<![\w+.(-])(?:\([2-9]\d{2}\)[ .-]?|[2-9]\d{2}[.-])\d{3}[.-]\d{4}(?![\d-])",
}
#: A run of digit groups with 13 digits at least; a group in which another value begins is not of it.
RUN_GROUPS = 400
PATTERNS["card"] = (
    r"(?<![\d.-])(?=\d(?:[ -]?\d){12})\d++(?:[ -](?!" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + rf")\d++){{0,{RUN_GROUPS}}}+"
)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _radices(count: Column, radix: int) -> Column:
    return F.transform(F.sequence(F.lit(1), count), lambda _: F.lit(radix))


def feistel(digits: Column, radices: Column, key: str, kind: str) -> Column:
    """The digits permuted within their radices; a row of 1 to 128 digits."""

    def add(values: Column, radix: Column, other: Column, number: Column) -> Column:
        tweak = F.concat_ws("/", F.lit(key), F.lit(kind), number.cast("string"), F.size(values).cast("string"), F.array_join(other.cast("array<string>"), "."))
        stream = F.concat(F.sha2(tweak, 512), F.sha2(F.concat(F.lit("+"), tweak), 512))  # 64 numbers of 16 bits

        def moved(bits: Column) -> Column:
            return F.transform(
                values, lambda v, i: F.pmod(v + F.conv(F.substring(bits, i * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.get(radix, i))
            )

        return let(stream, moved)

    # The state holds the half that the next round changes (a), its radices, and the other half.
    def step(s: Column, number: Column) -> Column:
        return F.struct(s["b"].alias("a"), s["rb"].alias("ra"), add(s["a"], s["ra"], s["b"], number).alias("b"), s["ra"].alias("rb"))

    def run(row: Column) -> Column:
        cut = F.floor(F.size(row["d"]) / 2).cast("int")
        half = lambda c, first: F.slice(c, F.lit(1), cut) if first else F.slice(c, cut + 1, F.size(c) - cut)
        start = F.struct(half(row["d"], True).alias("a"), half(row["r"], True).alias("ra"), half(row["d"], False).alias("b"), half(row["r"], False).alias("rb"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["a"], s["b"]))

    return let(F.struct(digits.alias("d"), radices.alias("r")), run)


def _numbers(text: Column) -> Column:
    """The decimal digits of a string, as ints."""
    return F.transform(F.split(F.regexp_replace(text, r"\D", ""), ""), lambda c: c.cast("int"))


def _refill(text: Column, digits: Column) -> Column:
    """``text`` with its decimal digits replaced, in order; separators stay."""
    chars = F.split(text, "")
    step = lambda s, c: F.when(
        c.rlike(r"\d"), F.struct(F.concat(s["out"], F.get(digits, s["at"]).cast("string")).alias("out"), (s["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda s: s["out"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum; ``doubled`` is the parity, from the right, of the doubled places."""
    n = F.size(digits)
    each = F.transform(digits, lambda d, i: F.when((n - 1 - i) % 2 == doubled, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d)


def _mod97(text: Column) -> Column:
    """The number that letters (A = 10 ... Z = 35) and digits spell, modulo 97."""
    step = lambda s, c: F.when(c.rlike(r"\d"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: step(s, c).cast("int"))


def _lettered(text: Column, key: str, kind: str, classes: tuple[str, ...]) -> Column:
    """Each character permuted within its class; characters of no class stay.

    A class is a string of its characters; ``classes`` don't overlap.
    """
    every = "".join(classes)
    starts, sizes = [], []
    for chosen in classes:
        starts += [sum(map(len, classes[: classes.index(chosen)]))] * len(chosen)
        sizes += [len(chosen)] * len(chosen)
    first, radix = F.array(*map(F.lit, [0, *starts])), F.array(*map(F.lit, [1, *sizes]))

    def of(chars: Column) -> Column:
        # Place of each character among all classes, from 1; 0 for none.
        return let(F.transform(chars, lambda c: F.instr(F.lit(every), c)), lambda at: permuted(chars, at))

    def permuted(chars: Column, at: Column) -> Column:
        values = F.transform(at, lambda p: F.when(p > 0, p - 1 - F.get(first, p)).otherwise(0))
        moved = feistel(values, F.transform(at, lambda p: F.get(radix, p)), key, kind)
        put = lambda m: F.transform(
            chars, lambda c, i: F.when(F.get(at, i) > 0, F.substring(F.lit(every), F.get(first, F.get(at, i)) + F.get(m, i) + 1, F.lit(1))).otherwise(c)
        )
        return F.array_join(let(moved, put), "")

    return let(F.split(text, ""), of)


def _card(value: Column, key: str) -> Column:
    def of(digits: Column) -> Column:
        payload = F.slice(digits, F.lit(1), F.size(digits) - 1)
        moved = feistel(payload, _radices(F.size(digits) - 1, 10), key, "card")
        return let(moved, lambda m: _refill(value, F.concat(m, F.array(F.pmod(-luhn_sum(m, 0), F.lit(10)).cast("int")))))

    return let(_numbers(value), of)


#: How the digits of a card are grouped in print.
LAYOUTS = ("4-4-4-4", "4-6-5", "4-6-4", "4-4-4-4-3", *map(str, range(13, 20)))


def _spans(run: Column) -> Column:
    """The valid cards of a run of digit groups, best first: (rank, a, back, b) for characters a to b - 1.

    A card is some adjacent groups of 13 to 19 digits in all that start like one and pass Luhn.  Printed layouts come
    first, then the longest such groups from the start of the run, then any others of three digits and more
    a group (shorter ones are mostly tables).  Within a rank the earliest and then the longest is best.
    """

    def of(sizes: Column) -> Column:
        def total(i: Column, k: Column) -> Column:
            return F.aggregate(F.slice(sizes, i + 1, k), F.lit(0), lambda t, n: t + n)

        def groups(i: Column) -> Column:
            return F.sequence(F.lit(1), F.least(F.lit(19), F.size(sizes) - i))

        first = F.size(F.filter(groups(F.lit(0)), lambda k: total(F.lit(0), k) <= 19))

        def reach(_: Column, i: Column) -> Column:
            def candidate(k: Column, n: Column, a: Column) -> Column:
                own = F.slice(sizes, i + 1, k)
                layout = F.array_join(own.cast("array<string>"), "-").isin(*LAYOUTS)
                rank = F.when(layout, 0).when((i == 0) & (k == first), 1).when(F.array_min(own) >= 3, 2)
                rank = F.when(n.between(13, 19), rank)
                return F.struct(rank.alias("rank"), a.alias("a"), (-k).alias("back"), (a + n + k - 1).alias("b"))

            # Before group i stand the digits of i groups and i separators.
            return let(total(F.lit(0), i) + i, lambda a: F.transform(groups(i), lambda k: let(total(i, k), lambda n: candidate(k, n, a))))

        found = F.filter(F.flatten(F.transform(sizes, reach)), lambda x: x["rank"].isNotNull())
        # ISO/IEC 7812 gives payment cards the first digits 1 to 6; account and order numbers have others, too.
        card = lambda d: F.get(d, F.lit(0)).between(1, 6) & (luhn_sum(d, 1) % 10 == 0)
        valid = lambda x: let(_numbers(F.substring(run, x["a"] + 1, x["b"] - x["a"])), card)
        return F.array_sort(F.filter(found, valid))

    return let(F.transform(F.regexp_extract_all(run, F.lit(r"\d+"), F.lit(0)), lambda g: F.char_length(g)), of)


def _cards(run: Column, key: str) -> Column:
    """A run of digit groups with its cards replaced; the best ones are taken, and no two overlap."""

    def of(spans: Column) -> Column:
        none = F.array().cast("array<struct<a:int,b:int>>")
        chosen = F.aggregate(
            spans,
            none,
            lambda had, x: F.when(F.exists(had, lambda y: (x["a"] < y["b"]) & (y["a"] < x["b"])), had).otherwise(
                F.concat(had, F.array(F.struct(x["a"].cast("int").alias("a"), x["b"].cast("int").alias("b"))))
            ),
            lambda had: F.array_sort(had),
        )
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        step = lambda s, x: F.struct(
            F.concat(s["out"], F.substring(run, s["at"] + 1, x["a"] - s["at"]), _card(F.substring(run, x["a"] + 1, x["b"] - x["a"]), key)).alias("out"),
            x["b"].alias("at"),
        )
        return F.aggregate(chosen, start, step, lambda s: F.concat(s["out"], F.substring(run, s["at"] + 1, F.char_length(run))))

    return let(_spans(run), lambda spans: F.when(F.size(spans) > 0, of(spans)).otherwise(run))


def _local_phone(value: Column, key: str) -> Column:
    moved = let(_numbers(value), lambda d: feistel(d, _radices(F.size(d), 10), key, "phone"))
    return let(moved, lambda m: _refill(value, m))


def _iban(value: Column, key: str) -> Column:
    """What stands after the account number stays: capitals that follow it may have been taken along.

    The number ends where its country's do; else it is the longest valid one that ends with a group.
    """

    def valid(end: Column) -> Column:
        return let(F.replace(F.substring(value, F.lit(1), end), F.lit(" "), F.lit("")), lambda x: _mod97(F.concat(F.substring(x, F.lit(5), F.char_length(x)), F.substring(x, 1, 4))) == 1)

    def candidate(end: Column) -> Column:
        size = end - F.regexp_count(F.substring(value, F.lit(1), end), F.lit(" "))
        country = F.try_element_at(F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair]), F.substring(value, 1, 2))
        inside = F.substring(value, end, F.lit(1)) != " "
        rank = F.when(inside & (size == country), 0).when(end == F.char_length(value), 1).when(inside & (F.substring(value, end + 1, F.lit(1)) == " ") & (size >= 15), 2)
        return F.struct(rank.alias("rank"), (-end).alias("back"), end.alias("end"))

    ends = F.filter(F.transform(F.sequence(F.lit(12), F.char_length(value)), candidate), lambda x: x["rank"].isNotNull())
    best = F.get(F.array_sort(F.filter(ends, lambda x: valid(x["end"]))), F.lit(0))

    def of(end: Column) -> Column:
        head = F.substring(value, F.lit(1), end)
        plain = F.replace(head, F.lit(" "), F.lit(""))
        country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.char_length(plain))
        made = let(
            _lettered(account, key, "iban", (DIGITS, UPPER)),
            lambda m: F.concat(country, F.lpad((98 - _mod97(F.concat(m, country, F.lit("00")))).cast("string"), 2, "0"), m),
        )
        spaced = let(made, lambda m: F.when(F.instr(head, " ") > 0, F.rtrim(F.regexp_replace(m, "(.{4})", "$1 "))).otherwise(m))
        return F.concat(spaced, F.substring(value, end + 1, F.char_length(value)))

    return F.coalesce(let(best["end"], lambda end: F.when(end.isNotNull(), of(end))), value)


def _phone(value: Column, key: str) -> Column:
    """The country code stays."""
    country = F.regexp_extract(value, r"^\+\d{1,3}", 0)

    def of(rest: Column) -> Column:
        moved = let(_numbers(rest), lambda d: feistel(d, _radices(F.size(d), 10), key, "phone"))
        return F.concat(country, let(moved, lambda m: _refill(rest, m)))

    return let(F.substring(value, F.char_length(country) + 1, F.char_length(value)), of)


def _ip(value: Column, key: str) -> Column:
    def of(octets: Column) -> Column:
        moved = feistel(octets, _radices(F.lit(4), 256), key, "ip")
        return F.when(F.array_max(octets) < 256, F.array_join(moved.cast("array<string>"), ".")).otherwise(value)

    return let(F.transform(F.split(value, r"\."), lambda x: x.cast("int")), of)


def _ssn(value: Column, key: str) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999."""

    def of(p: Column) -> Column:
        a, b, c = (F.get(p, i) for i in range(3))
        valid = a.between(1, 899) & (a != 666) & (b > 0) & (c > 0)
        moved = feistel(F.array(a - F.when(a > 666, 2).otherwise(1), b - 1, c - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn")
        shown = lambda m: F.format_string(
            "%03d-%02d-%04d", F.get(m, 0) + F.when(F.get(m, 0) >= 665, 2).otherwise(1), F.get(m, 1) + 1, F.get(m, 2) + 1
        )
        return F.when(valid, let(moved, shown)).otherwise(value)

    return let(F.transform(F.split(value, "-"), lambda x: x.cast("int")), of)


def _day(year: Column, month: Column, day: Column, key: str) -> Column:
    """The pseudonym of a date, null if it isn't one of the calendar's or out of range."""
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
    a, b = DAY_RADICES

    def of(number: Column) -> Column:
        moved = feistel(F.array(F.floor(number / b).cast("int"), (number % b).cast("int")), F.array(F.lit(a), F.lit(b)), key, "date")
        made = let(moved, lambda m: F.date_add(F.lit(FIRST_DAY).cast("date"), F.get(m, 0) * b + F.get(m, 1)))
        return F.when(number.between(0, a * b - 1), made)

    return let(F.datediff(date, F.lit(FIRST_DAY).cast("date")), of)


def _date(value: Column, key: str) -> Column:
    """Year first or last; day before month unless only the other order can be; separators stay."""
    marks = F.split(F.regexp_replace(value, r"\d", ""), "")
    mark = lambda i: F.get(marks, i)
    text = lambda d, form: F.date_format(d, form)

    def of(p: Column) -> Column:
        year_first, flip = F.get(p, 0) > 31, F.get(p, 1) > 12
        day = _day(
            F.when(year_first, F.get(p, 0)).otherwise(F.get(p, 2)),
            F.when(year_first | ~flip, F.get(p, 1)).otherwise(F.get(p, 0)),
            F.when(year_first, F.get(p, 2)).when(flip, F.get(p, 1)).otherwise(F.get(p, 0)),
            key,
        )
        shown = lambda d: F.when(
            year_first, F.concat(text(d, "yyyy"), mark(0), text(d, "MM"), mark(1), text(d, "dd"))
        ).when(flip, F.concat(text(d, "MM"), mark(0), text(d, "dd"), mark(1), text(d, "yyyy"))).otherwise(
            F.concat(text(d, "dd"), mark(0), text(d, "MM"), mark(1), text(d, "yyyy"))
        )
        return F.coalesce(let(day, shown), value)

    return let(F.transform(F.split(value, r"\D"), lambda x: x.cast("int")), of)


#: A Feistel row has at most so many digits; a longer name is permuted in parts.
MOST_DIGITS = 128


def _email(value: Column, key: str) -> Column:
    """The domain stays."""
    upper = "".join(c.upper() for c in ACCENTED if len(c.upper()) == 1 and ord(c.upper()) < 256)
    classes = (DIGITS, LOWER, UPPER, ACCENTED, upper)

    def of(name: Column) -> Column:
        starts = F.sequence(F.lit(1), F.char_length(name), F.lit(MOST_DIGITS))
        return F.array_join(F.transform(starts, lambda a: _lettered(F.substring(name, a, F.lit(MOST_DIGITS)), key, "email", classes)), "")

    return F.concat(let(F.substring_index(value, "@", 1), of), F.lit("@"), F.substring_index(value, "@", -1))


def _token(value: Column, key: str) -> Column:
    made = _lettered(F.lower(value), key, "token", (HEX,))
    return F.when(value.rlike("[A-F]"), F.upper(made)).otherwise(made)


_MAKERS = {"email": _email, "token": _token, "iban": _iban, "phone": _phone, "ip": _ip, "ssn": _ssn, "iso_date": _date, "day_date": _date, "local_phone": _local_phone, "card": _cards}


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value; a value that fails validation is its own."""
    out = None
    for name, pattern in PATTERNS.items():
        whole, made = value.rlike(f"^(?:{pattern})$"), _MAKERS[name](value, key)
        out = F.when(whole, made) if out is None else out.when(whole, made)
    return out.otherwise(value)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text with pseudonyms, n_found, n_changed.

    n_found counts recognised values (a run of numbers with cards in it is one), n_changed those
    replaced: a value that fails validation stays, and so does one that the permutation happens to map
    to itself.  A null text stays null with zero counts.  One pass, no shuffle; repeated rows give
    repeated results, and an empty table an empty one.  Only the two columns are read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.withColumn("found", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    none = F.coalesce(F.size("found"), F.lit(0)) <= 0
    made = found.withColumn("made", F.when(~none, F.transform("found", lambda v: pseudonym(v, key))))
    between = F.split("text", ANY, -1)
    filled = F.array_join(F.zip_with(between, F.col("made"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("found", "made", lambda a, b: a != b), lambda x: x))
    return made.select(
        "doc_id", F.when(F.col("made").isNull(), F.col("text")).otherwise(filled).alias("text"),
        F.when(none, 0).otherwise(F.size("found")).cast("long").alias("n_found"), F.when(none, 0).otherwise(changed).cast("long").alias("n_changed"),
    )
