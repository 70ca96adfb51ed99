"""Format-preserving pseudonyms of personal data by Feistel networks, in DataFrame operations only."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barflow.llm.session import fresh

ROUNDS = 10
#: The setting that holds the secret key of the registered queries; by its name Spark leaves its value out of logs and pages.
KEY_SETTING = "spark.barflow.pseudonyms.secret"
#: Country codes of one and of two digits; all others have three.
COUNTRY_1 = ["1", "7"]
COUNTRY_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Kinds in the order in which they are tried at a position. Lookarounds keep a match from starting or ending inside a longer number.
#: Local parts have at most 64 characters and domains 126 labels of 63, as in mail and DNS: so the matcher's stack has a bound.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "phone": r"(?<![0-9+])(?:(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-]?[0-9]{4}|\+1[2-9][0-9]{2}[2-9][0-9]{6})(?![0-9])",
    "foreign_phone": r"(?<![0-9+])\+[2-9](?:[ .-]?[0-9]){7,14}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iso_date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "slash_date": r"(?<![0-9/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9/])",
    "dot_date": r"(?<![0-9.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9]|\.[0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
}
#: A run of digit groups one space or hyphen apart, with 13 digits or more up to where a value of another kind begins; cards are
#: sought in it group by group. All quantifiers are possessive: long runs take no stack.
KINDS["card"] = rf"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:[ -](?!{'|'.join(KINDS.values())})[0-9]++)*+"
#: The groupings that cards are written in.
_GROUPED = r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$"
PATTERN = "|".join(KINDS.values())


def _prf(key: str, kind: str | Column, turn: Column, half: Column) -> Column:
    """60 bits of SHA-256 over key, kind, round and the other half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: int | Column, b: int | Column, key: str, kind: str | Column) -> Column:
    """Struct(l, r): a keyed permutation of the pairs with 0 <= left < a and 0 <= right < b.

    Halves of unequal size take turns: each is shifted modulo its own size by a function of the other, so every
    domain of a * b values is permuted as a whole and nothing has to be walked or retried.
    """

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        left = F.when(odd, F.pmod(s["l"] + _prf(key, kind, i, s["r"]), F.lit(a))).otherwise(s["l"])
        right = F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + _prf(key, kind, i, s["l"]), F.lit(b)))
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _pad(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(shape, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")


def _email(x: Column, key: str) -> Column:
    """The local part, letter for letter, case for case and digit for digit; the domain stays.

    Its halves take turns, each character shifted within its class by bits of the other half. Local parts of one
    character have an empty other half and are shifted by the key alone.
    """

    def shifted(part: Column, other: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), other), 512)

        def one(c: Column, at: Column, digest: Column) -> Column:
            bits = F.conv(F.substr(digest, F.pmod(at, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            in_class = lambda first, n: F.char(F.lit(ord(first)) + F.pmod(F.ascii(c) - ord(first) + bits, F.lit(n)))
            return F.when(c.rlike("[a-z]"), in_class("a", 26)).when(c.rlike("[A-Z]"), in_class("A", 26)).when(c.rlike("[0-9]"), in_class("0", 10)).otherwise(c)

        return _with(digest, lambda x: F.array_join(F.transform(F.filter(F.split(part, ""), lambda c: c != ""), lambda c, at: one(c, at, x)), ""))

    local, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    half = (F.length(local) / 2).cast("int")
    start = F.struct(F.substr(local, F.lit(1), half).alias("l"), F.substr(local, half + 1, F.length(local)).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(F.when(odd, shifted(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(odd, s["r"]).otherwise(shifted(s["r"], s["l"], i)).alias("r"))

    return F.concat(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["l"], s["r"])), F.lit("@"), domain)


def _phone(x: Column, key: str) -> Column:
    """Ten digits whose area and exchange codes start at 200; a leading country code 1 stays."""
    d = F.right(_digits(x), F.lit(10))
    codes = (F.substr(d, F.lit(1), F.lit(3)).cast("int") - 200) * 800 + F.substr(d, F.lit(4), F.lit(3)).cast("int") - 200
    new = _with(feistel(codes, F.substr(d, F.lit(7), F.lit(4)).cast("int"), 640_000, 10_000, key, "phone"), lambda s: F.concat(_pad(F.floor(s["l"] / 800) + 200, 3), _pad(s["l"] % 800 + 200, 3), _pad(s["r"], 4)))
    return _refill(x, F.concat(F.when(F.length(_digits(x)) == 11, F.lit("1")).otherwise(F.lit("")), new))


def _foreign_phone(x: Column, key: str) -> Column:
    """A plus sign and 8 to 15 digits: the country code stays, and the digits behind it are permuted among those of their number."""
    d = _digits(x)
    code = F.when(F.substr(d, F.lit(1), F.lit(1)).isin(COUNTRY_1), 1).when(F.substr(d, F.lit(1), F.lit(2)).isin(COUNTRY_2), 2).otherwise(3)

    def number(s: Column) -> Column:
        left = F.floor(s["n"] / 2).cast("int")
        right = s["n"] - left
        size = lambda n: F.pow(F.lit(10), n).cast("long")
        part = lambda at, n: F.substr(s["d"], at, n).cast("long")
        new = feistel(part(F.lit(1), left), part(left + 1, right), size(left), size(right), key, F.concat(F.lit("foreign_phone"), s["n"].cast("string")))
        return _with(new, lambda h: F.concat(F.lpad(h["l"].cast("string"), left, F.lit("0")), F.lpad(h["r"].cast("string"), right, F.lit("0"))))

    whole = F.struct(F.substr(d, code + 1, F.length(d)).alias("d"), (F.length(d) - code).alias("n"))
    return _refill(x, F.concat(F.substr(d, F.lit(1), code), _with(whole, number)))


def _ssn(x: Column, key: str) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999; others are not valid and stay."""
    area, group, serial = (F.element_at(F.split(x, "-"), i).cast("int") for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)
    rank = area - 1 - (area > 666).cast("int")
    new = _with(feistel(rank * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn"), lambda s: _with(F.floor(s["l"] / 99) + 1, lambda q: F.concat_ws("-", _pad(q + (q >= 666).cast("int"), 3), _pad(s["l"] % 99 + 1, 2), _pad(s["r"] + 1, 4))))
    return F.when(valid, new)


def _ip(x: Column, key: str) -> Column:
    """Four octets of 0-255 without leading zeros."""
    o = [F.element_at(F.split(x, r"\."), i) for i in (1, 2, 3, 4)]
    n = [c.cast("int") for c in o]
    valid = F.lit(True)
    for text, number in zip(o, n):
        valid = valid & (number <= 255) & (text == number.cast("string"))
    part = lambda v: F.concat_ws(".", F.floor(v / 256).cast("string"), (v % 256).cast("string"))
    return F.when(valid, _with(feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], 65536, 65536, key, "ip"), lambda s: F.concat_ws(".", part(s["l"]), part(s["r"]))))


def _card(x: Column, key: str) -> Column:
    """13 to 19 digits that pass the Luhn check: the first stays, the check digit is computed anew, the others are permuted."""

    def of(n: int) -> Column:
        a = (n - 2) // 2
        left, right = F.substr(d, F.lit(2), F.lit(a)).cast("long"), F.substr(d, F.lit(2 + a), F.lit(n - 2 - a)).cast("long")
        return _with(feistel(left, right, 10**a, 10 ** (n - 2 - a), key, f"card{n}"), lambda s: F.concat(F.substr(d, F.lit(1), F.lit(1)), _pad(s["l"], a), _pad(s["r"], n - 2 - a)))

    d = _digits(x)
    body = F.lit(None).cast("string")
    for n in range(13, 20):
        body = F.when(F.length(d) == n, of(n)).otherwise(body)
    check = lambda b: F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(b, c.cast("string"))), lambda v: F.call_function("luhn_check", v)), 1)
    return F.when(F.call_function("luhn_check", d), _refill(x, _with(body, check)))


#: Days of the months past the twelfth, in a year that is no leap year, and where they start among those of months of one width.
_LATE = [m - 12 for m in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)]
_STARTS = [sum(_LATE[:m]) for m in range(9)] + [sum(_LATE[9:m]) for m in range(9, 12)]


def _date(y: Column, m: Column, d: Column, key: str) -> Column:
    """Struct(y, m, d): a valid date of 1900-2099 as another one, null otherwise.

    Month and day keep their number of digits, and a day past the twelfth stays one, so that every way of writing a date
    keeps its width and the order in which it is read, and a date is the same pseudonym however it is written. Within such
    a class, 200 years and the days of one are permuted as a pair; the 49 leap days are permuted among themselves.
    """
    valid = F.try_to_date(F.concat_ws("-", _pad(y, 4), _pad(m, 2), _pad(d, 2)), "yyyy-MM-dd").isNotNull() & y.between(1900, 2099)
    first = F.when(m < 10, 1).otherwise(10)
    each = F.when(d < 10, 9).when(d < 13, 3)  # days of a month in the class, but for late ones
    low = F.when(d < 10, 1).when(d < 13, 10).otherwise(13)
    late, starts = d > 12, F.array(*map(F.lit, _STARTS))
    size = F.when(late, F.when(m < 10, sum(_LATE[:9])).otherwise(sum(_LATE[9:]))).otherwise(each * F.when(m < 10, 9).otherwise(3))
    index = F.when(late, F.element_at(starts, m) + d - 13).otherwise((m - first) * each + d - low)
    kind = F.concat(F.lit("date"), first.cast("string"), F.lit(":"), low.cast("string"))

    def plain(s: Column) -> Column:
        own = F.slice(starts, first, F.when(m < 10, 9).otherwise(3))
        month = F.when(late, first - 1 + F.size(F.filter(own, lambda x: x <= s["r"]))).otherwise(first + F.floor(s["r"] / each))
        day = lambda n: F.when(late, s["r"] - F.element_at(starts, n) + 13).otherwise(low + s["r"] % each)
        return _with(month.cast("int"), lambda n: F.struct((s["l"] + 1900).cast("int").alias("y"), n.alias("m"), day(n).cast("int").alias("d")))

    # the leap years from 1904 to 2096, by number
    n = F.floor((y - 1904) / 4)
    leap = _with(feistel(F.floor(n / 7), n % 7, 7, 7, key, "leap"), lambda s: F.struct((1904 + 4 * (s["l"] * 7 + s["r"])).cast("int").alias("y"), m.alias("m"), d.alias("d")))
    return F.when(valid & (m == 2) & (d == 29), leap).when(valid, _with(feistel(y - 1900, index, 200, size, key, kind), plain))


def _parts(x: Column, by: str) -> list[Column]:
    return [F.element_at(F.split(x, by), i) for i in (1, 2, 3)]


def _written(x: Column, by: str, order: str, key: str) -> Column:
    """The date in ``x`` with its parts in ``order``, each as wide as it was."""
    parts = dict(zip(order, _parts(x, f"[{by}]")))
    new = _date(*(parts[p].cast("int") for p in "ymd"), key)
    return _with(new, lambda v: F.when(v.isNotNull(), F.concat_ws(by, *[F.lpad(v[p].cast("string"), F.length(parts[p]), F.lit("0")) for p in order])))


def _slash_date(x: Column, key: str) -> Column:
    """month/day/year if the first part can be a month, else day/month/year."""
    return F.when(_parts(x, "/")[0].cast("int") <= 12, _written(x, "/", "mdy", key)).otherwise(_written(x, "/", "dmy", key))


def _dot_date(x: Column, key: str) -> Column:
    return _written(x, ".", "dmy", key)


def _iso_date(x: Column, key: str) -> Column:
    return _written(x, "-", "ymd", key)


def _cards(x: Column, key: str) -> Column:
    """A run of digit groups with each card in it replaced: struct(value, n cards), or null if there is none.

    From left to right, the longest window of whole groups that is grouped as cards are and passes the Luhn check. If there
    is none, the run's first groups of up to 19 digits, whatever their grouping.
    """

    def found(t: Column, lengths: Callable[[Column], Column], starts: Column, grouped: bool) -> Column:
        def at(i: Column) -> Column:
            window = lambda n: F.struct(i.alias("i"), n.alias("n"), F.rtrim(F.regexp_replace(F.array_join(F.slice(t, i + 1, n), ""), "-$", "")).alias("raw"))
            right = lambda w: (w["raw"].rlike(_GROUPED) if grouped else F.length(_digits(w["raw"])).between(13, 19)) & F.call_function("luhn_check", _digits(w["raw"]))
            return F.slice(F.filter(F.transform(F.filter(lengths(i), lambda n: i + n <= F.size(t)), window), right), 1, 1)

        return F.flatten(F.transform(starts, at))

    def longest(t: Column) -> Column:
        fits = lambda n: F.length(_digits(F.array_join(F.slice(t, F.lit(1), n), ""))) <= 19
        return F.slice(F.reverse(F.filter(F.sequence(F.lit(1), F.lit(19)), lambda n: (n <= F.size(t)) & fits(n))), 1, 1)

    def replaced(t: Column, cards: Column) -> Column:
        def turn(s: Column, c: Column) -> Column:
            end = c["i"] + c["n"]
            between = F.regexp_extract(F.element_at(t, end), "[ -]?$", 0)
            out = F.concat(s["value"], F.array_join(F.slice(t, s["at"] + 1, c["i"] - s["at"]), ""), _card(c["raw"], key), between)
            new = F.struct(end.alias("at"), out.alias("value"), (s["n"] + 1).alias("n"))
            return F.when(c["i"] >= s["at"], new).otherwise(s)

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("value"), F.lit(0).alias("n"))
        rest = lambda s: F.struct(F.concat(s["value"], F.array_join(F.slice(t, s["at"] + 1, F.size(t) - s["at"]), "")).alias("value"), s["n"].alias("n"))
        return F.when(F.size(cards) > 0, F.aggregate(cards, start, turn, rest))

    def run(t: Column) -> Column:
        usual = found(t, lambda i: F.array(*[F.lit(n) for n in (5, 4, 3, 1)]), F.sequence(F.lit(0), F.size(t) - 1), True)
        loose = found(t, lambda i: longest(t), F.array(F.lit(0)), False)
        return _with(usual, lambda u: replaced(t, F.when(F.size(u) > 0, u).otherwise(loose)))

    return _with(F.regexp_extract_all(x, F.lit("[0-9]+[ -]?"), F.lit(0)), run)


_PSEUDONYM = {"email": _email, "phone": _phone, "foreign_phone": _foreign_phone, "ssn": _ssn, "iso_date": _iso_date, "slash_date": _slash_date, "dot_date": _dot_date, "ip": _ip}


def pseudonym(x: Column, key: str) -> Column:
    """Struct(kind, value, n) of a match of ``PATTERN`` under a ``round_key``: its pseudonym and the number of values in it (a run of digit groups may
    hold several cards), or null if there is no valid value of its kind."""
    out = F.lit(None).cast("struct<kind:string,value:string,n:int>")
    for kind, pattern in reversed(KINDS.items()):
        bare = pattern[pattern.index(")") + 1 :] if pattern.startswith("(?<!") else pattern
        found = _cards(x, key) if kind == "card" else _with(_PSEUDONYM[kind](x, key), lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(1).alias("n"))))
        named = _with(found, lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v["value"].alias("value"), v["n"].alias("n"))))  # noqa: B023
        out = F.when(x.rlike(f"^(?:{bare})$"), named).otherwise(out)
    return out


def round_key(key: str) -> str:
    """What stands in plans instead of the key: a digest of it."""
    return hashlib.sha256(f"rounds of {key}".encode()).hexdigest()


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", kinds_col: str = "_kinds") -> DataFrame:
    """``docs`` with each valid number, date and e-mail address in ``text_col`` replaced, and the kinds in ``kinds_col``.

    The pseudonym is a keyed permutation within the value's format, so it depends on key, kind and value alone: equal
    values stay equal across documents and different ones stay different. Keep ``key`` secret: who has it can turn
    pseudonyms back; plans hold a digest of it only. A phone number is one of ten digits as written in North America, with separators or
    a leading +1, or one with a plus sign and a country code; bare digits are none, since they may be anything. Whole texts are searched; a null text stays null with no kinds; texts without a digit or @ are passed
    by; repeated rows stay. All other columns stay as they are, but for one that is named ``kinds_col``, which is replaced.
    """
    text, (hits_col, new_col) = F.col(text_col), fresh([*docs.columns, kinds_col], "hits", "new")
    hits = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    rows = docs.drop(kinds_col).withColumn(hits_col, hits).withColumn(new_col, F.transform(hits_col, lambda h: pseudonym(h, round_key(key))))
    pieces = F.transform(F.split(text, PATTERN, -1), lambda gap, i: F.concat(gap, F.coalesce(F.get(new_col, i)["value"], F.get(hits_col, i), F.lit(""))))
    kinds = F.coalesce(F.flatten(F.transform(F.filter(new_col, lambda p: p.isNotNull()), lambda p: F.array_repeat(p["kind"], p["n"]))), F.array().cast("array<string>"))
    # a text without a valid value stays as it is, byte for byte
    return rows.withColumn(kinds_col, kinds).withColumn(text_col, F.when(F.size(kinds_col) > 0, F.array_join(pieces, "")).otherwise(text)).drop(hits_col, new_col)


_DRAWN: list[str] = []


def key_of(spark: SparkSession) -> str:
    """The key that the session sets; where it sets none, one that is drawn for this driver and known to nobody, so that pseudonyms link the
    documents of its jobs and no others."""
    if not _DRAWN:
        _DRAWN.append(secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING, _DRAWN[0])


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("_kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return pseudonymised(docs, key_of(spark)).select("doc_id", "text", *[count(kind) for kind in KINDS])


QUERIES = {"op5_feistel_pseudonyms": op5_feistel_pseudonyms}
ORACLES: dict[str, str] = {}
