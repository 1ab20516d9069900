"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame functions only.

A keyed Feistel network permutes each validated value inside its format: the pseudonym has the same separators and
valid check digits, equal values get equal pseudonyms in every document, and different values stay different.  Numbers
keep their length; octets of IPv4 addresses and days and months of one digit may get more or fewer digits.  Card
numbers, IBANs, social security numbers, dates, IPv4 addresses and phone numbers are permuted; e-mail addresses and
secrets have no fixed format and get a keyed digest.  What fails its validation (a Luhn sum, an octet over 255, a 31st
of February) isn't personal and stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Days from 1900-01-01 to 2099-12-31 are exactly 17 * 4297.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)

# Fixed formats, most specific first; \p{L} are letters, (?<! ) and (?! ) keep a match from starting or ending inside a longer run.
SECRET = r"(?i:token|secret|api[_-]?key|access[_-]?key|password|passwd)\s{0,3}[=:]\s{0,3}[\"']?(?=[A-Za-z+/_\-.=]*+\d)(?=[A-Za-z0-9+/_\-.=]{11}[A-Za-z0-9+/_\-=])[A-Za-z0-9+/_\-]++(?:[.=]++[A-Za-z0-9+/_\-]++)*+=*+"
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
ISO_DATE = r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])"
DAY_DATE = r"(?<![\d./])\d{1,2}[./]\d{1,2}[./]\d{4}(?![\d/])"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
PHONE = r"(?<![\d+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])"
CARD = r"\d(?:[ \-]?\d){12,18}"
# Cards and IBANs stand in runs of groups, among other numbers and capital words; a run ends before any other format.
OTHER = "|".join((SECRET, EMAIL, IPV4, ISO_DATE, DAY_DATE, SSN, PHONE))
IBAN_RUN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]){{8}})[A-Z0-9]++(?![A-Za-z])(?:[ \-](?!{OTHER})[A-Z0-9]++(?![A-Za-z]))*+"
CARD_RUN = rf"(?<![\d\-])\d(?:(?:[ \-](?!{OTHER}))?\d){{12,}}+"
RUN = r"[A-Z0-9]+(?:[ \-][A-Z0-9]+)*+"
ANY = "|".join((SECRET, EMAIL, IPV4, ISO_DATE, DAY_DATE, SSN, IBAN_RUN, PHONE, CARD_RUN))

#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    n: names.split()
    for n, names in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}

#: Country codes of two digits; 1 and 7 have one, the others three.
TWO_DIGIT_CODES = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _round(key: str, tag: str, i: Column, half: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tag: str) -> Column:
    """A keyed permutation of pairs (left below a, right below b), as a struct of l and r."""

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        left = F.when(odd, F.pmod(s["l"] + _round(key, tag, i, s["r"]), a)).otherwise(s["l"])
        right = F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + _round(key, tag, i, s["l"]), b))
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def permute_digits(digits: Column, key: str, tag: str) -> Column:
    """A keyed permutation of digit strings of one length, 2 to 32 digits."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    half = lambda x, size: F.lpad(x.cast("string"), size, "0")
    power = lambda size: F.pow(F.lit(10.0), size).cast("long")
    left, right = F.substr(digits, F.lit(1), u), F.substr(digits, u + 1)
    swapped = feistel(left.cast("long"), right.cast("long"), power(u), power(n - u), key, tag)
    return let(swapped, lambda s: F.concat(half(s["l"], u), half(s["r"], n - u)))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum; a multiple of 10 for a valid number."""

    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def mod97(text: Column) -> Column:
    """An IBAN's digits and letters (A is 10) as one number, modulo 97."""

    def add(s: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.between("0", "9"), (s * 10 + (F.ascii(c) - 48)) % 97).otherwise((s * 100 + letter) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise(add(s, c)))


def fill_digits(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by ``digits``."""

    def put(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        char = F.when(is_digit, F.substr(digits, s["k"] + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(s["out"], char).alias("out"), (s["k"] + is_digit.cast("int")).alias("k"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    return F.aggregate(F.split(form, ""), start, put)["out"]


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _card(m: Column, key: str) -> Column:
    """The first digit (the network) stays; the check digit is made anew."""

    def swap(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_digits(F.substr(d, F.lit(2), n - 2), key, "card"))
        return let(body, lambda p: F.concat(p, ((10 - luhn_sum(F.concat(p, F.lit("0"))) % 10) % 10).cast("string")))

    return let(_only_digits(m), lambda d: F.when(luhn_sum(d) % 10 == 0, fill_digits(m, swap(d))))


def _iban(m: Column, key: str) -> Column:
    """Country and letters stay, the account's digits are permuted, the check digits are made anew."""

    def swap(plain: Column) -> Column:
        account = F.substr(plain, F.lit(5))
        digits = _only_digits(account)
        body = F.when(F.length(digits) >= 2, let(digits, lambda d: fill_digits(account, permute_digits(d, key, "iban")))).otherwise(account)
        country = F.substr(plain, F.lit(1), F.lit(2))
        return let(body, lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))

    valid = lambda p: mod97(F.concat(F.substr(p, F.lit(5)), F.substr(p, F.lit(1), F.lit(4)))) == 1
    return let(F.replace(m, F.lit(" "), F.lit("")), lambda p: F.when(valid(p), let(swap(p), lambda q: fill_digits(m, _only_digits(q)))))


def _ssn(m: Column, key: str) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999."""
    area, group, serial = (F.split(m, "-")[k].cast("int") for k in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    left = area - 1 - (area > 666).cast("int")
    right = (group - 1) * 9999 + serial - 1

    def form(s: Column) -> Column:
        a = s["l"] + 1 + (s["l"] >= 665).cast("int")
        return F.format_string("%03d-%02d-%04d", a, F.floor(s["r"] / 9999) + 1, s["r"] % 9999 + 1)

    return F.when(valid, let(feistel(left, right, F.lit(898), F.lit(99 * 9999), key, "ssn"), form))


def _ipv4(m: Column, key: str) -> Column:
    def swap(o: Column) -> Column:
        valid = F.forall(o, lambda x: x <= 255)
        mixed = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ipv4")
        part = lambda x: F.array(F.floor(x / 256).cast("int"), (x % 256).cast("int"))
        return F.when(valid, let(mixed, lambda s: F.concat_ws(".", F.concat(part(s["l"]), part(s["r"])).cast("array<string>"))))

    return let(F.split(m, r"\.").cast("array<int>"), swap)


def _date(year: Column, month: Column, day: Column, form: Callable[[Column], Column], key: str) -> Column:
    day_number = F.datediff(F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
    a, b = DAYS

    def swap(n: Column) -> Column:
        mixed = feistel(F.floor(n / b), n % b, F.lit(a), F.lit(b), key, "date")
        return F.when(n.between(0, a * b - 1), let(mixed, lambda s: form(F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * b + s["r"]).cast("int")))))

    return let(day_number, swap)


def _iso_date(m: Column, key: str) -> Column:
    y, mo, d = (F.split(m, "-")[k].cast("int") for k in range(3))
    return _date(y, mo, d, lambda x: F.date_format(x, "yyyy-MM-dd"), key)


def _day_date(m: Column, key: str) -> Column:
    """Day first; month first only where the second number can't be a month.  The separator and zeros stay."""
    mark = F.when(F.contains(m, F.lit("/")), F.lit("/")).otherwise(F.lit("."))
    parts = F.split(m, "[./]")
    a, b, y = (parts[k].cast("int") for k in range(3))
    month_first = (b > 12) & (a <= 12)
    width = lambda k: F.when(F.length(parts[k]) == 2, 2).otherwise(1)

    def form(x: Column) -> Column:
        one, two = F.when(month_first, F.month(x)).otherwise(F.day(x)), F.when(month_first, F.day(x)).otherwise(F.month(x))
        pad = lambda v, k: F.when(v >= 10, v.cast("string")).otherwise(F.lpad(v.cast("string"), width(k), "0"))
        return F.concat(pad(one, 0), mark, pad(two, 1), mark, F.year(x).cast("string"))

    return _date(y, F.when(month_first, a).otherwise(b), F.when(month_first, b).otherwise(a), form, key)


def _phone(m: Column, key: str) -> Column:
    """The country's code, and a (0) after it, stay; the national digits are permuted, 7 to 15 digits in all.

    A number without a code is North American, so that it gets the pseudonym of its international form; blanks, marks
    and brackets stay where they are and don't matter.
    """
    plus = F.startswith(m, F.lit("+"))

    def swap(d: Column) -> Column:
        code = F.when(d.rlike("^[17]"), 1).when(F.substr(d, F.lit(1), F.lit(2)).isin(TWO_DIGIT_CODES), 2).otherwise(3)
        kept = F.when(~plus, 0).otherwise(code + m.rlike(r"^\+\d{1,3}[ .\-]?\(0\)").cast("int"))
        mixed = F.concat(F.substr(d, F.lit(1), kept), permute_digits(F.substr(d, kept + 1), key, "phone"))
        return F.when(F.length(d).between(7, 15), fill_digits(m, mixed))

    return let(_only_digits(m), swap)


def _email(m: Column, key: str) -> Column:
    """104 bits of a digest: no two of 2 ** 40 addresses are likely to meet."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 26), F.lit("@mail.invalid"))


def _secret(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, r"^(.*?[=:]\s*[\"']?)(.+)$", 1)
    value = F.regexp_extract(m, r"^(.*?[=:]\s*[\"']?)(.+)$", 2)
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value), 256)
    return F.concat(name, F.rpad(digest, F.length(value), digest))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \-]", "")


def _longest(values: Column, size: Callable[[Column], Column], usual: Column) -> Column:
    """The value of the usual size, else the longest: the last of an ascending sort; null if there is none."""
    rank = lambda v: F.struct((size(v["c"]) == usual).alias("usual"), F.length(v["c"]).alias("n"), v["k"].alias("k"), v["c"].alias("c"))
    return F.try_element_at(F.array_sort(F.transform(values, rank)), F.lit(-1))


def _heads(groups: Column, at: Column, most: int) -> Column:
    """The texts of the first 1, 2, ... groups from ``at`` on, up to ``most`` groups, as structs of k and c."""
    own = F.slice(groups, at + 1, F.lit(most))
    text = lambda k: F.struct(k.alias("k"), _strip(F.array_join(F.slice(own, F.lit(1), k), "")).alias("c"))
    return F.transform(F.sequence(F.lit(1), F.size(own)), text)


def _iban_at(groups: Column, at: Column) -> Column:
    """The IBAN that begins with a group: the country's length first, else the longest that is valid."""
    plain = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    valid = lambda c: c.rlike(_whole(IBAN)) & let(plain(c), lambda p: mod97(F.concat(F.substr(p, F.lit(5)), F.substr(p, F.lit(1), F.lit(4)))) == 1)
    country = F.substring(_strip(groups[at]), 1, 2)
    usual = F.coalesce(*[F.when(country.isin(names), n) for n, names in IBAN_LENGTHS.items()], F.lit(0))
    found = F.filter(_heads(groups, at, 35), lambda v: valid(v["c"]))
    return _longest(found, lambda c: F.length(plain(c)), usual)


def _card_at(groups: Column, at: Column) -> Column:
    """The card that begins with a group: its network's length first, else the longest that is valid.

    Inside a run a card begins as a payment card does (3 to 9, or 22 to 27), so that lists of years aren't taken; where
    a run begins, the longest number is taken with any first digit.
    """
    first = _strip(groups[at])
    usual = F.when(first.rlike("^3[47]"), 15).when(first.rlike("^3[0689]"), 14).otherwise(16)
    fits = F.filter(_heads(groups, at, 19), lambda v: v["c"].rlike(_whole(CARD)))
    fits = F.when(first.rlike("^(?:[3-9]|2[2-7])"), fits).otherwise(F.slice(fits, F.greatest(F.size(fits), F.lit(1)), 1))
    found = F.filter(fits, lambda v: luhn_sum(_only_digits(v["c"])) % 10 == 0)
    return _longest(found, lambda c: F.length(_only_digits(c)), usual)


def _run(m: Column, key: str) -> Column:
    """A run of groups with its cards and IBANs replaced, and how many they are, as a struct of text and n.

    A card or IBAN begins and ends at the run's own blanks, hyphens or ends.  One of its kind's usual length goes before
    an overlapping one of another length, and of the others the first one goes before.
    """

    def best(groups: Column, at: Column) -> Column:
        first = _strip(groups[at])
        own = F.when(first.rlike(r"^[A-Z]{2}\d{2}"), _iban_at(groups, at)).when(first.rlike("^(?:[3-9]|2[2-7])[0-9]*$") | ((at == 0) & first.rlike("^[0-9]+$")), _card_at(groups, at))
        return let(own, lambda x: F.struct(at.alias("at"), F.coalesce(x["k"], F.lit(0)).alias("k"), F.coalesce(x["usual"], F.lit(False)).alias("usual"), x["c"].alias("c")))

    def choose(found: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            beaten = ~x["usual"] & F.exists(found, lambda y: y["usual"] & (y["at"] > x["at"]) & (y["at"] < x["at"] + x["k"]))
            end = F.coalesce(F.get(s, F.size(s) - 1)["at"] + F.get(s, F.size(s) - 1)["k"], F.lit(0))
            return F.when((x["at"] >= end) & ~beaten, F.concat(s, F.array(x))).otherwise(s)

        return F.aggregate(found, F.slice(found, 1, 0), step)

    def text(groups: Column, chosen: Column) -> Column:
        end = lambda i: F.when(i > 0, F.get(chosen, i - 1)["at"] + F.get(chosen, i - 1)["k"]).otherwise(0)
        gap = lambda start, stop: F.array_join(F.slice(groups, start + 1, stop - start), "")
        mark = lambda x: F.regexp_extract(groups[x["at"]], r"^[ \-]?", 0)
        new = lambda c: F.when(c.rlike("^[A-Z]"), _iban(c, key)).otherwise(_card(c, key))
        parts = F.transform(chosen, lambda x, i: F.concat(gap(end(i), x["at"]), mark(x), new(x["c"])))
        return F.concat(F.array_join(parts, ""), gap(end(F.size(chosen)), F.size(groups)))

    def whole(groups: Column) -> Column:
        found = F.filter(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), lambda at: best(groups, at)), lambda x: x["k"] > 0)
        return let(let(found, choose), lambda chosen: F.struct(text(groups, chosen).alias("text"), F.size(chosen).alias("n")))

    return let(F.regexp_extract_all(m, F.lit(r"[ \-]?[A-Z0-9]+"), F.lit(0)), whole)


#: Kind, pattern and pseudonym (null where a match isn't valid), in the order in which they are tried.
KINDS: list[tuple[str, str, Callable[[Column, str], Column]]] = [
    ("secret", SECRET, _secret),
    ("email", EMAIL, _email),
    ("ipv4", IPV4, _ipv4),
    ("date", ISO_DATE, _iso_date),
    ("date", DAY_DATE, _day_date),
    ("ssn", SSN, _ssn),
    ("phone", PHONE, _phone),
]


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of one match and how many values it replaces, as a struct of text and n; the match itself and 0 where no kind takes it."""
    chain = None
    for _, pattern, swap in KINDS:
        fits = match.rlike(_whole(pattern.replace(r"(?<![\p{L}\p{N}._%+\-])", "")))
        new = let(F.coalesce(swap(match, key), match), lambda x: F.struct(x.alias("text"), (x != match).cast("int").alias("n")))
        chain = F.when(fits, new) if chain is None else chain.when(fits, new)
    return F.coalesce(chain.when(match.rlike(_whole(RUN)), _run(match, key)), F.struct(match.alias("text"), F.lit(0).alias("n")))


def pseudonymize(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with the personal values of ``column`` replaced, and ``n_replaced``, how many were.

    Other columns and the number of rows stay; repeated rows are replaced alike; an empty table gives no rows.  A null
    text stays null with 0 replaced; an empty one stays empty.  Where two kinds could take a match, the earlier of KINDS
    takes it.
    Texts without a digit or @ aren't searched: every kind has one.  Columns of the input named ``n_replaced`` are
    replaced.
    """
    text, columns = F.col(column), [c for c in docs.columns if c != "n_replaced"]
    some = text.rlike("[0-9@]")
    found = docs.select(*columns, F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("__found"))
    swapped = F.when(F.size("__found") > 0, F.transform("__found", lambda m: pseudonym(m, key)))
    found = found.withColumn("__new", swapped)
    pieces = F.zip_with(F.split(text, ANY, -1), F.col("__new"), lambda gap, new: F.concat(gap, F.coalesce(new["text"], F.lit(""))))
    changed = F.aggregate("__new", F.lit(0), lambda n, new: n + new["n"])
    out = F.when(F.col("__new").isNotNull(), F.array_join(pieces, "")).otherwise(text)
    n = F.when(F.col("__new").isNotNull(), changed).otherwise(F.lit(0)).alias("n_replaced")
    return found.select(*[out.alias(column) if c == column else c for c in columns], n)
