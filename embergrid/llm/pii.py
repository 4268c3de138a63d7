"""Operator 5 [native]: format-preserving Feistel pseudonyms for personal data and secrets.

Found values are replaced by keyed permutations of the same format, so equal values stay equal
in all documents. Only DataFrame functions are used; one pass over the text, no shuffle.

* payment cards (13 to 19 digits, plain or in groups, Luhn-valid): the payload's digits are
  permuted, the check digit is set anew; digits that fail the check stay.
* dates (yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, dd/mm/yyyy, or mm/dd/yyyy where only that is
  valid; years 1600 to 2399): permuted among the days of their 400-year cycle, month-first dates
  among those that have no day-first reading, so that no two dates meet in one string.
* IPv4 addresses with octets up to 255: permuted among all addresses.
* US social security numbers: permuted until valid (cycle walking).
* phone numbers: the last ten digits (all, if they are fewer) as one number, whatever stands
  between them, so a number is linked over all its spellings; digits before those stay.
* e-mail addresses: all but the top-level domain, in lower case; capitals are set anew in their
  places, so an address is linked whatever its case (A-Z).
* secrets (``token = ...`` and the like, or 32 to 64 hexadecimal digits): every letter and digit
  within its class; hexadecimal digits of one case with letters among them within the sixteen of their case.

Formats tell, not meanings: a valid date or address is replaced wherever it stands, in release notes or version
numbers, too. Other numbers, such as IBANs, and names are not looked for.

Digits permute among digits, lower-case among lower-case letters, capitals among capitals, by an
alternating Feistel network whose round function is SHA-256 of key, round, other half and place.
Who has the key can undo the pseudonyms; it is a required argument. ``QUERY_KEY`` is for the
registered queries and tests only.

Defined results: a null text stays null with zero counts; empty and letterless texts stay as they
are; whole texts are searched, however long. Matches do not overlap; the leftmost wins, in the order email, secret, address, date, phone,
SSN, card. Extra columns stay; ``n_pii`` is added (a column of that name is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, free_name
from .quality import let

QUERY_KEY = "public test key"
ROUNDS = 6
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"
NAMED_SECRET = r"(?i:token|secret|password|passwd|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/-]{12,}+"
HEX_SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-])"
PHONE = r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[.-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, NAMED_SECRET, HEX_SECRET, ADDRESS, DATE, PHONE, SSN, CARD))
LOWER, UPPER = "0123456789abcdef", "0123456789ABCDEF"
CYCLE = (189, 773)  # the factors of the 146,097 days of 400 years


def _hash(key: str, n: Column, *parts: Column) -> Column:
    """A number from 0 to 2^32 - 1."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), n.cast("string"), *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


def _shift(own: Column, other: Column, r: Column, key: str, alphabet: str | None = None) -> Column:
    """Each letter or digit of ``own`` moved within its class, or within ``alphabet``, by a hash of the other half."""

    def moved(i: Column) -> Column:
        char = F.substr(own, i, F.lit(1))
        code, h = F.ascii(char), _hash(key, r, other, i)
        if alphabet:
            return F.substr(F.lit(alphabet), (F.pmod(F.position(char, F.lit(alphabet)) - 1 + h, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))

        def within(first: int, size: int) -> Column:
            return F.char(F.lit(first) + F.pmod(code - first + h, F.lit(size)))

        return F.when(code.between(48, 57), within(48, 10)).when(code.between(97, 122), within(97, 26)).when(code.between(65, 90), within(65, 26)).otherwise(char)

    return F.when(F.length(own) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(own)), moved), ""))


def permute(s: Column, key: str, alphabet: str | None = None) -> Column:
    """A keyed permutation of the strings with the same classes of characters, or of those of ``alphabet``, of one length."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s)).alias("r"))

    def turn(x: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(_shift(x["l"], x["r"], i, key, alphabet).alias("l"), x["r"].alias("r"))).otherwise(F.struct(x["l"].alias("l"), _shift(x["r"], x["l"], i, key, alphabet).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda x: F.concat(x["l"], x["r"]))


def permute_pair(a: Column, b: Column, sizes: tuple[int, int], key: str) -> Column:
    """A keyed permutation of the pairs (a, b) with a < sizes[0] and b < sizes[1]."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(x: Column, i: Column) -> Column:
        first = F.struct(F.pmod(x["a"] + _hash(key, i, x["b"]), F.lit(sizes[0])).cast("long").alias("a"), x["b"].alias("b"))
        second = F.struct(x["a"].alias("a"), F.pmod(x["b"] + _hash(key, i, x["a"]), F.lit(sizes[1])).cast("long").alias("b"))
        return F.when(i % 2 == 0, first).otherwise(second)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string modulo 10."""

    def worth(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        doubled = (F.length(digits) - i) % 2 == 1
        return F.when(doubled, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, d: a + d) % 10


def _fill(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced, in order, by ``digits``."""

    def char(i: Column) -> Column:
        c = F.substr(template, i, F.lit(1))
        at = F.length(F.regexp_replace(F.substr(template, F.lit(1), i), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]"), F.substr(digits, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(template)), char), "")


def _card(m: Column, key: str) -> Column:
    def replaced(digits: Column) -> Column:
        payload = permute(F.substr(digits, F.lit(1), F.length(digits) - 1), key + "/card")
        full = let(payload, lambda p: F.concat(p, F.pmod(-_luhn(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when(_luhn(digits) == 0, let(full, lambda d: _fill(m, d))).otherwise(m)

    return let(F.regexp_replace(m, "[^0-9]", ""), replaced)


def _date(m: Column, key: str) -> Column:
    layouts = [(r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{4}/", "yyyy/MM/dd"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}/", "dd/MM/yyyy"), (r"^\d{2}/", "MM/dd/yyyy")]
    out = m
    base = F.to_date(F.lit("2000-01-01"))

    def step(n: Column) -> Column:
        """The day ``n`` moved within its cycle of 400 years."""
        block, at = F.floor(n / 146_097), F.pmod(n, F.lit(146_097))
        pair = permute_pair(at % CYCLE[0], F.floor(at / CYCLE[0]), CYCLE, key + "/date")
        return let(pair, lambda p: (block * 146_097 + p["a"] + p["b"] * CYCLE[0]).cast("int"))

    def moved_as(layout: str):
        def moved(n: Column) -> Column:
            new = step(n)
            if layout == "MM/dd/yyyy":  # walk on to a day that only month-first dates have
                apart = lambda d: F.dayofmonth(F.date_add(base, d)) > 12
                new = F.aggregate(F.sequence(F.lit(1), F.lit(40)), new, lambda d, _: F.when(apart(d), d).otherwise(step(d)))
            return F.date_format(F.date_add(base, new), layout)

        return moved

    for head, layout in reversed(layouts):
        day = F.to_date(F.try_to_timestamp(m, F.lit(layout)))
        out = F.when(m.rlike(head) & day.isNotNull() & F.year(day).between(1600, 2399), let(F.datediff(day, base), moved_as(layout))).otherwise(out)
    return out


def _address(m: Column, key: str) -> Column:
    def replaced(octets: Column) -> Column:
        o = [F.get(octets, i).cast("long") for i in range(4)]
        pair = permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), key + "/address")
        text = let(pair, lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)]))
        return F.when(F.greatest(*o) <= 255, text).otherwise(m)

    return let(F.split(m, r"\."), replaced)


def _ssn(m: Column, key: str) -> Column:
    def valid(s: Column) -> Column:
        return s.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")

    walked = F.aggregate(F.sequence(F.lit(0), F.lit(40)), m, lambda s, i: F.when((i > 0) & valid(s), s).otherwise(permute(s, key + "/ssn")))
    return F.when(valid(m), walked).otherwise(m)


def _email(m: Column, key: str) -> Column:
    def cased(lower: Column) -> Column:
        def char(i: Column) -> Column:
            c = F.substr(lower, i, F.lit(1))
            return F.when(F.substr(m, i, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), char), "")

    domain = F.regexp_extract(m, r"\.[A-Za-z0-9-]+$", 0)
    own = F.lower(F.substr(m, F.lit(1), F.length(m) - F.length(domain)))
    return let(F.concat(permute(own, key + "/email"), F.lower(domain)), cased)


def _phone(m: Column, key: str) -> Column:
    def replaced(digits: Column) -> Column:
        kept = F.greatest(F.length(digits) - 10, F.lit(0))
        return let(F.concat(F.substr(digits, F.lit(1), kept), permute(F.substr(digits, kept + 1, F.lit(10)), key + "/phone")), lambda d: _fill(m, d))

    return let(F.regexp_replace(m, "[^0-9]", ""), replaced)


def pseudonym(m: Column, key: str) -> Column:
    """The replacement of one matched value."""

    def whole(pattern: str) -> Column:
        return m.rlike(f"^(?:{pattern})$")

    head = F.when(m.rlike(r"[=:]"), F.regexp_extract(m, r"^.*?[=:]\s{0,3}[\"']?", 0)).otherwise("")

    def hidden(value: Column) -> Column:
        """Digits alone stay digits, hexadecimal digits with letters stay such in their case, else each class stays."""
        lower, upper = (value.rlike(f"^(?=.*[{c}])[0-9{c}]{{32,64}}$") for c in ("a-f", "A-F"))
        return F.when(lower, permute(value, key, LOWER)).when(upper, permute(value, key, UPPER)).otherwise(permute(value, key))

    secret = let(head, lambda h: F.concat(h, let(F.substr(m, F.length(h) + 1, F.length(m) - F.length(h)), hidden)))
    special = m.rlike("^[0-9][0-9./ -]*$")
    return (
        F.when(m.contains("@") & ~m.rlike("[=:]"), _email(m, key))
        .when(m.rlike(r"^[+(]"), _phone(m, key))
        .when(~special | whole("[0-9]{32,64}"), secret)
        .when(whole(r"(?:\d{1,3}\.){3}\d{1,3}"), _address(m, key))
        .when(whole(r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}"), _date(m, key))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), _ssn(m, key))
        .when(whole(r"\d{3}[.-]\d{3}[.-]\d{4}"), _phone(m, key))
        .otherwise(_card(m, key))
    )


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with the personal data of ``text`` replaced and ``n_pii``, the number of replaced values."""
    t, old, new = F.col(text), free_name(df, "found"), free_name(df, "new")
    found = F.when(t.rlike("[0-9@=:]|[a-f]{32}|[A-F]{32}"), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)))
    out = df.withColumn(old, found)
    out = out.withColumn(new, F.when(F.size(old) > 0, F.transform(old, lambda m: pseudonym(m, key))))
    parts = F.split(t, PATTERN, -1)
    joined = let(F.struct(parts.alias("p"), F.col(new).alias("m")), lambda x: F.array_join(F.zip_with(x["p"], x["m"], lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))
    count = F.size(F.filter(F.zip_with(old, new, lambda a, b: F.when(a != b, 1)), lambda x: x.isNotNull()))
    out = out.withColumns({text: F.when(F.col(new).isNotNull(), joined).otherwise(t), "n_pii": F.when(F.col(new).isNotNull(), count).otherwise(0).cast("long")})
    return out.drop(old, new)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), QUERY_KEY)
