"""Pseudonyms against a plain Feistel network, bijection, formats, odd rows."""

import hashlib
import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from flowlens.llm import pseudonyms as ps

KEY = "test-key"


def _feistel(value, left, right, tweak, key=KEY):
    a, b = divmod(value, right)
    for i in range(ps.ROUNDS):
        half = b if i % 2 == 0 else a
        d = int(hashlib.sha256(f"{key}|{tweak}|{i}|{half}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            a = (a + d) % left
        else:
            b = (b + d) % right
    return a * right + b


def _digits(value, kind):
    n = len(value)
    return str(_feistel(int(value), 10 ** (n // 2), 10 ** (n - n // 2), f"{kind}{n}")).zfill(n)


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total


def _lay(match, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in match)


def _one(match):
    digits = re.sub(r"\D", "", match)
    if "@" in match:
        local, domain = match.split("@")
        plain = re.sub("[^a-z0-9]", "", local.lower())
        out = ""
        for at in range(0, len(plain), 6):
            piece = plain[at:at + 6]
            n = len(piece)
            v = _feistel(int(piece, 36), 36 ** (n // 2), 36 ** (n - n // 2), f"email|{domain.lower()}|{plain[:at]}|{n}")
            shown = ""
            while v:
                v, r = divmod(v, 36)
                shown = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + shown
            out += shown.rjust(n, "0")
        it = iter(out)
        return "".join(next(it) if re.match("[a-z0-9]", c) else c for c in local.lower()) + "@" + domain
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", match):
        a, g, s = int(match[:3]), int(match[4:6]), int(match[7:])
        if not (0 < a < 900 and a != 666 and g and s):
            return match
        v = _feistel(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99, 9999, "ssn")
        rest, s = divmod(v, 9999)
        a, g = divmod(rest, 99)
        a += 1
        return f"{a + (a >= 666):03d}-{g + 1:02d}-{s + 1:04d}"
    if match.count(".") == 3:
        octets = [int(o) for o in match.split(".")]
        if max(octets) > 255:
            return match
        v = _feistel(sum(o << s for o, s in zip(octets, (24, 16, 8, 0))), 65536, 65536, "ip")
        return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)|(\d\d)/(\d\d)/(\d{4})|(\d\d)\.(\d\d)\.(\d{4})", match):
        g = m.groups()
        y, mo, d = (g[0], g[1], g[2]) if g[0] else (g[5], g[3], g[4]) if g[3] else (g[8], g[7], g[6])
        try:
            day = date(int(y), int(mo), int(d))
        except ValueError:
            return match
        if not 1900 <= day.year <= 2099:
            return match
        new = date(1900, 1, 1) + timedelta(_feistel((day - date(1900, 1, 1)).days, 17, 4297, "date"))
        return new.strftime("%Y-%m-%d" if g[0] else "%m/%d/%Y" if g[3] else "%d.%m.%Y")
    if len(digits) >= 13 and "(" not in match and "+" not in match:
        if _luhn(digits) % 10:
            return match
        body = _digits(digits[:-1], "card")
        return _lay(match, body + str(-_luhn(body + "0") % 10))
    return _lay(match, digits[:-10] + _digits(digits[-10:], "phone"))


def _valid_card(rng, n):
    body = "".join(rng.choices("0123456789", k=n - 1))
    return body + str(-_luhn(body + "0") % 10)


def _values():
    rng = random.Random(9)
    out = ["bosbt.42@mail8.example.com", "A.b-C+9@x.co", "q@e.org", "007_Long.local.part-with.many@sub.domain.io"]
    out += ["+1 (988) 555-2485", "(212) 555-0100", "212-555-0100", "+49 212 555 0100"]
    out += ["123-45-6789", "665-01-0001", "667-99-9999", "899-50-1234", "000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567"]
    out += ["70.123.182.155", "0.0.0.0", "255.255.255.255", "300.1.1.1", "256.0.0.1"]
    out += ["2024-02-29", "2023-02-29", "12/31/1999", "31.12.1999", "1999-12-31", "1899-12-31", "13/01/2000", "2099-12-31", "1900-01-01"]
    for n in (13, 15, 16, 19):
        out += [_valid_card(rng, n) for _ in range(3)]
    card = _valid_card(rng, 16)
    out += [card, f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}", f"{card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]}"]
    out += [card[:-1] + str((int(card[-1]) + 1) % 10)]
    return out


def test_matches_plain_network(spark):
    values = _values()
    rows = [(k, f"before {v}, after") for k, v in enumerate(values)]
    rows += [(100, " and ".join(values)), (101, None), (102, ""), (103, "no numbers but 12 and 3.14 and v1.2.3"), (104, values[0]), (None, values[4])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_replaced int")
    found = {r.doc_id: r for r in ps.pseudonymise(docs, KEY).collect()}
    for k, v in enumerate(values):
        assert found[k].text == f"before {_one(v)}, after", v
        assert found[k]["n_replaced_"] == int(_one(v) != v)
    assert found[100].text == " and ".join(map(_one, values))
    assert found[101].text is None and found[102].text == "" and found[103].text == rows[len(values) + 3][1]
    assert found[104].text == _one(values[0]) and found[None].text == _one(values[4])


def test_layouts_of_one_value_stay_linked():
    assert len({re.sub(r"\D", "", _one(v)) for v in _values()[-4:-1]}) == 1
    assert _one("12/31/1999")[6:] + _one("12/31/1999")[:2] == _one("1999-12-31")[:4] + _one("1999-12-31")[5:7]


@pytest.mark.parametrize("left,right", [(1, 36), (17, 4297), (10, 100), (6, 6)])
def test_is_a_permutation(spark, left, right):
    moved = spark.range(left * right).select(
        ps.feistel(F.col("id"), F.lit(left), F.lit(right), KEY, F.lit("t")).alias("v")
    )
    row = moved.agg(F.countDistinct("v").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).first()
    assert tuple(row) == (left * right, 0, left * right - 1)


def test_key_matters_and_long_text(spark):
    text = "mail q1w2e3@e.org " * 4000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    a, b = (ps.pseudonymise(docs, k).first() for k in ("one", "two"))
    assert a.n_replaced == 4000 and a.text != b.text and len(set(a.text.split(" "))) == 3
    with pytest.raises(ValueError):
        ps.pseudonymise(docs, "")
    assert ps.pseudonymise(docs.limit(0), KEY).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = ps.pseudonymise(docs, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
