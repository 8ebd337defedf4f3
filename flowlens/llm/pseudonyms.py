"""Format-preserving pseudonyms for personal numbers and dates (operator 3).

Card numbers, social security numbers, telephone numbers, IPv4 addresses,
calendar dates and the local part of e-mail addresses are found in whole texts,
validated, and replaced by another value of the same format. The replacement is
a keyed permutation of all values of that format: a Feistel network over a
product of two ranges, whose round function is a keyed SHA-256. The same key
therefore maps equal values to equal pseudonyms in every document, different
values to different ones, and its owner can invert it.

| kind | validated by | permuted among |
|---|---|---|
| card | 13 to 19 digits, Luhn sum | all numbers of that length with a right check digit |
| ssn | area, group and serial in use | all such numbers |
| phone | layout | all digits of the ten-digit number; the country code stays |
| ip | four octets up to 255 | all addresses |
| date | a real day of 1900 to 2099 | all days of these years, in the same layout |
| email | layout | letters and digits of the local part; the domain stays |

Everything is a column expression within a row. Defined cases: a null text
stays null; numbers that fail validation stay; equal rows get equal results; a
null id is kept; an empty table gives an empty result; extra columns pass
through ``pseudonymise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import fresh, let, quoted
from flowlens.operators.staging import compute_once

ROUNDS = 10
FIRST_DAY, DAYS = "1900-01-01", 73_049  # through 2099-12-31; 73,049 = 17 x 4,297
CHUNK = 6

PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+",
    "phone": r"(?<![\d(+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])",
}
ORDER = ("email", "card", "phone", "ssn", "date", "ip")


def _any_pattern() -> str:
    """All patterns as one; the card's group is the only capturing one."""
    return "|".join(PATTERNS[k] for k in ORDER)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"\D+", "")


def feistel(value: Column, left: Column, right: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of 0 .. left * right - 1.

    Rounds take turns in adding a keyed digest of one half to the other, modulo
    that half's range, so each round can be undone.
    """
    def digest(i: Column, half: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")

    def turn(acc: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0,
            F.struct(F.pmod(acc["l"] + digest(i, acc["r"]), acc["b"]).alias("l"), acc["r"].alias("r"),
                     acc["b"].alias("b"), acc["c"].alias("c")),
        ).otherwise(
            F.struct(acc["l"].alias("l"), F.pmod(acc["r"] + digest(i, acc["l"]), acc["c"]).alias("r"),
                     acc["b"].alias("b"), acc["c"].alias("c"))
        )

    def run(p: Column) -> Column:
        start = F.struct(
            _div(p["v"], p["c"]).alias("l"), (p["v"] % p["c"]).alias("r"), p["b"].alias("b"), p["c"].alias("c")
        )
        ended = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
        return let(ended, lambda e: e["l"] * e["c"] + e["r"])

    return let(
        F.struct(value.cast("long").alias("v"), left.cast("long").alias("b"), right.cast("long").alias("c")), run
    )


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _div(value: Column, by: Column | int) -> Column:
    """Whole quotient of longs, exact for eighteen digits."""
    return F.call_function("div", value, _long(by) if isinstance(by, int) else by)


def _power(base: int, exponent: Column) -> Column:
    """Whole power up to 18 digits, exact."""
    return F.aggregate(
        F.when(exponent > 0, F.sequence(F.lit(1), exponent.cast("int"))).otherwise(F.array().cast("array<int>")),
        _long(1), lambda acc, _: acc * base,
    )


def _permute_digits(digits: Column, key: str, kind: str) -> Column:
    size = F.length(digits)
    half = F.floor(size / 2).cast("int")
    moved = feistel(digits.cast("long"), _power(10, half), _power(10, size - half), key,
                    F.concat(F.lit(kind), size.cast("string")))
    return F.lpad(moved.cast("string"), size, "0")


def _lay_out(match: Column, digits: Column) -> Column:
    """``match`` with its digits replaced in order."""
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(match)),
            lambda i: F.when(
                F.substr(match, i, F.lit(1)).rlike(r"\d"),
                F.substr(digits, F.length(_digits(F.substr(match, F.lit(1), i))), F.lit(1)),
            ).otherwise(F.substr(match, i, F.lit(1))),
        ),
        "",
    )


def _luhn(digits: Column) -> Column:
    """Luhn sum of all digits; a valid number has a multiple of ten."""
    size = F.length(digits)
    values = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: let(
            F.substr(digits, i, F.lit(1)).cast("int") * F.when((size - i) % 2 == 1, 2).otherwise(1),
            lambda d: F.when(d > 9, d - 9).otherwise(d),
        ),
    )
    return F.aggregate(values, F.lit(0), lambda acc, d: acc + d)


def _card(match: Column, key: str) -> Column:
    def replaced(digits: Column) -> Column:
        body = _permute_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
        return let(
            body,
            lambda b: _lay_out(match, F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))),
        )

    return let(_digits(match), lambda d: F.when(_luhn(d) % 10 == 0, replaced(d)))


def _ssn(match: Column, key: str) -> Column:
    parts = F.struct(
        F.substring(match, 1, 3).cast("long").alias("a"), F.substring(match, 5, 2).cast("long").alias("g"),
        F.substring(match, 8, 4).cast("long").alias("s"),
    )

    def replaced(p: Column) -> Column:
        area = p["a"] - 1 - F.when(p["a"] > 666, 1).otherwise(0)
        index = (area * 99 + p["g"] - 1) * 9999 + p["s"] - 1
        moved = feistel(index, _long(898 * 99), _long(9999), key, F.lit("ssn"))

        def shown(v: Column) -> Column:
            serial, rest = v % 9999 + 1, _div(v, 9999)
            group, code = rest % 99 + 1, _div(rest, 99) + 1
            code = code + F.when(code >= 666, 1).otherwise(0)
            return F.concat_ws("-", F.lpad(code.cast("string"), 3, "0"), F.lpad(group.cast("string"), 2, "0"),
                               F.lpad(serial.cast("string"), 4, "0"))

        return let(moved, shown)

    used = lambda p: (p["a"] > 0) & (p["a"] < 900) & (p["a"] != 666) & (p["g"] > 0) & (p["s"] > 0)
    return let(parts, lambda p: F.when(used(p), replaced(p)))


def _phone(match: Column, key: str) -> Column:
    """The last ten digits move; a country code before them stays."""
    return let(
        _digits(match),
        lambda d: _lay_out(match, F.concat(
            F.substr(d, F.lit(1), F.length(d) - 10),
            _permute_digits(F.substr(d, F.length(d) - 9, F.lit(10)), key, "phone"),
        )),
    )


def _ip(match: Column, key: str) -> Column:
    octets = F.transform(F.split(match, r"\."), lambda o: o.cast("long"))

    def replaced(o: Column) -> Column:
        value = F.aggregate(o, _long(0), lambda acc, x: acc * 256 + x)
        moved = feistel(value, _long(65_536), _long(65_536), key, F.lit("ip"))
        return let(moved, lambda v: F.array_join(
            F.transform(F.array(*[_long(256**k) for k in (3, 2, 1, 0)]),
                        lambda s: (_div(v, s) % 256).cast("string")), "."
        ))

    return let(octets, lambda o: F.when(F.array_max(o) <= 255, replaced(o)))


def _date(match: Column, key: str) -> Column:
    layout = (
        F.when(match.rlike("^....-"), F.lit("yyyy-MM-dd")).when(match.rlike("/"), F.lit("MM/dd/yyyy"))
        .otherwise(F.lit("dd.MM.yyyy"))
    )
    d = _digits(match)
    iso = (
        F.when(match.rlike("^....-"), match)
        .when(match.rlike("/"), F.concat_ws("-", F.substring(d, 5, 4), F.substring(d, 1, 2), F.substring(d, 3, 2)))
        .otherwise(F.concat_ws("-", F.substring(d, 5, 4), F.substring(d, 3, 2), F.substring(d, 1, 2)))
    )
    day = F.datediff(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date"))

    def shown(n: Column) -> Column:
        moved = feistel(n, _long(17), _long(4_297), key, F.lit("date"))
        new = let(moved, lambda v: F.date_add(F.lit(FIRST_DAY).cast("date"), v.cast("int")).cast("string"))
        return let(new, lambda s: F.when(layout == "yyyy-MM-dd", s).when(
            layout == "MM/dd/yyyy", F.concat_ws("/", F.substring(s, 6, 2), F.substring(s, 9, 2), F.substring(s, 1, 4))
        ).otherwise(F.concat_ws(".", F.substring(s, 9, 2), F.substring(s, 6, 2), F.substring(s, 1, 4))))

    return let(day, lambda n: F.when((n >= 0) & (n < DAYS), shown(n)))


def _email(match: Column, key: str) -> Column:
    """Letters and digits of the local part, in chunks of six base-36 digits.

    A chunk's permutation depends on the domain and on the chunks before it, so
    the whole is still a permutation of local parts of one layout.
    """
    lowered = F.lower(match)
    parts = F.struct(
        F.substring_index(lowered, "@", 1).alias("local"), F.substring_index(lowered, "@", -1).alias("domain"),
        F.substring_index(match, "@", -1).alias("shown"),
    )

    def replaced(p: Column) -> Column:
        plain = F.regexp_replace(p["local"], "[^a-z0-9]+", "")

        def chunks(s: Column) -> Column:
            starts = F.sequence(F.lit(1), F.length(s), F.lit(CHUNK))

            def chunk(at: Column) -> Column:
                piece = F.substr(s, at, F.lit(CHUNK))
                size = F.length(piece)
                half = F.floor(size / 2).cast("int")
                moved = feistel(
                    F.conv(piece, 36, 10).cast("long"), _power(36, half), _power(36, size - half), key,
                    F.concat_ws("|", F.lit("email"), p["domain"], F.substr(s, F.lit(1), at - 1), size.cast("string")),
                )
                return F.lpad(F.lower(F.conv(moved.cast("string"), 10, 36)), size, "0")

            return F.array_join(F.transform(starts, chunk), "")

        local = p["local"]
        laid = lambda n: F.array_join(F.transform(
            F.sequence(F.lit(1), F.length(local)),
            lambda i: F.when(
                F.substr(local, i, F.lit(1)).rlike("[a-z0-9]"),
                F.substr(n, F.length(F.regexp_replace(F.substr(local, F.lit(1), i), "[^a-z0-9]+", "")), F.lit(1)),
            ).otherwise(F.substr(local, i, F.lit(1))),
        ), "")
        return F.concat(let(let(plain, chunks), laid), F.lit("@"), p["shown"])

    return let(parts, replaced)


def _whole(kind: str) -> str:
    return f"^(?:{PATTERNS[kind]})$"


def replacement(match: Column, key: str) -> Column:
    """The pseudonym of a match, or null if it fails validation."""
    makers = {"email": _email, "card": _card, "phone": _phone, "ssn": _ssn, "date": _date, "ip": _ip}
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind in ORDER:
        chosen = chosen.when(match.rlike(_whole(kind)), makers[kind](match, key))
    return chosen


def pseudonymised(text: Column, key: str) -> Column:
    """Struct (text, n_replaced)."""
    pattern = F.lit(_any_pattern())
    unchanged = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_replaced"))

    def rebuilt(found: Column) -> Column:
        changes = F.transform(found, lambda m: F.struct(m.alias("m"), replacement(m, key).alias("n")))
        pieces = F.struct(changes.alias("c"), F.split(text, _any_pattern(), -1).alias("rest"))
        return let(pieces, lambda p: F.struct(
            F.concat(F.get(p["rest"], F.lit(0)), F.array_join(F.transform(
                p["c"], lambda c, i: F.concat(F.coalesce(c["n"], c["m"]), F.get(p["rest"], i + 1))
            ), "")).alias("text"),
            F.size(F.filter(p["c"], lambda c: c["n"].isNotNull())).cast("long").alias("n_replaced"),
        ))

    return let(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda found: F.when(F.size(found) > 0, rebuilt(found)).otherwise(unchanged),
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", out: str = "n_replaced") -> DataFrame:
    """``docs`` with pseudonyms in the text and a column for how many were set."""
    if not key:
        raise ValueError("a key is needed")
    out, held = fresh(docs, out), fresh(docs, "__new")
    changed = compute_once(docs, {held: pseudonymised(quoted(text), key)})
    columns = [quoted(held)["text"].alias(c) if c == text else quoted(c) for c in docs.columns]
    return changed.select(*columns, F.coalesce(quoted(held)["n_replaced"], F.lit(0).cast("long")).alias(out))
