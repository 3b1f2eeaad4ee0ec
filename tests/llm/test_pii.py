"""The pseudonyms against a plain-Python twin, format by format."""

import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from grainery.llm import pii

DAYS = [dt.date(1800, 1, 1) + dt.timedelta(i) for i in range(146_097)]
LATE = [d for d in DAYS if d.day > 12]
PLACE = {d: i for i, d in enumerate(LATE)}


class Twin:
    def __init__(self, key):
        self.inner, self.outer = (hashlib.sha256(f"{side}:{key}".encode()).hexdigest() for side in ("inner", "outer"))

    def hex(self, message):
        return hashlib.sha256((self.outer + hashlib.sha256((self.inner + message).encode()).hexdigest()).encode()).hexdigest()

    def mix(self, tweak, a, b, m, n):
        for i in range(1, 9):
            if i % 2:
                a = (a + int(self.hex(f"{tweak}|{i}|{b}")[:15], 16)) % m
            else:
                b = (b + int(self.hex(f"{tweak}|{i}|{a}")[:15], 16)) % n
        return a, b

    def digits(self, kind, d):
        if len(d) < 2:
            return d
        h, rest = len(d) // 2, len(d) - len(d) // 2
        a, b = self.mix(f"{kind}:{len(d)}", int(d[:h]), int(d[h:]), 10**h, 10**rest)
        return f"{a:0{h}}{b:0{rest}}"

    def day(self, d):
        if d.day <= 12:
            a, b = self.mix("date", d.year - 1800, (d.month - 1) * 12 + d.day - 1, 400, 144)
            return dt.date(1800 + a, b // 12 + 1, b % 12 + 1)
        a, b = self.mix("late date", *divmod(PLACE[d], 9833), 9, 9833)
        return LATE[a * 9833 + b]

    def date(self, text):
        parts, seps = re.split("[-/.]", text), re.findall("[-/.]", text)
        p = [int(x) for x in parts]
        order = "ymd" if len(parts[0]) == 4 else "mdy" if p[1] > 12 else "dmy"
        try:
            new = self.day(dt.date(*(p[order.index(c)] for c in "ymd")))
        except (ValueError, KeyError):
            return text
        width = 1 if order != "ymd" and min(len(parts[0]), len(parts[1])) == 1 else 2
        out = [f"{new.year}" if c == "y" else f"{new.month if c == 'm' else new.day:0{width}}" for c in order]
        return out[0] + seps[0] + out[1] + seps[1] + out[2]

    def account(self, text):
        d = re.sub(r"\D", "", text)
        if luhn(d):
            return text
        body = self.digits("account", d[:-1])
        return refill(text, body + next(c for c in "0123456789" if not luhn(body + c)))

    def ip(self, text):
        o = [int(x) for x in text.split(".")]
        a, b = self.mix("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"

    def ssn(self, text):
        d = re.sub(r"\D", "", text)
        areas = [x for x in range(1, 900) if x != 666]
        a, b = self.mix("ssn", areas.index(int(d[:3])), (int(d[3:5]) - 1) * 9999 + int(d[5:]) - 1, 898, 989901)
        return f"{areas[a]:03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"

    def phone(self, text):
        d = re.sub(r"\D", "", text)
        if re.match(r"\+1[^0-9]", text) or (text.startswith("+1") and len(d) == 11):
            code = 1
        elif text.startswith("+"):
            code = len(m[1]) if (m := re.match(r"\+([0-9]{1,3})[ .(-]", text)) else 2
        else:
            code = 0
        return refill(text, d[:code] + self.digits("phone", d[code:]))

    def iban(self, text):
        d = re.sub(r"\D", "", text[4:])
        tail = refill(text[4:], self.digits("iban", d[:18]) + self.digits("iban-rest", d[18:]))
        return text[:2] + f"{98 - rest(tail.replace(' ', '') + text[:2] + '00'):02}" + tail

    def secret(self, text):
        x = (self.hex("secret:" + text.lower()) * (1 + len(text) // 64))[: len(text)]
        return x.upper() if text == text.upper() else x

    def email(self, text):
        low = text.lower()
        x = f"u{self.hex('email:' + low)[:12]}@{self.hex('domain:' + low.rsplit('@', 1)[1])[:8]}.example"
        return x.upper() if text == text.upper() else x


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10


def rest(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def refill(text, digits):
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), text)


def run(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.text for r in pii.pseudonymize(df, key).orderBy("doc_id").collect()]


def test_every_format(spark):
    r, twin, made = random.Random(3), Twin("k"), []
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    card = lambda n: next(b + c for b in [number(n - 1)] for c in "0123456789" if not luhn(b + c))
    for _ in range(40):
        d = r.choice(DAYS)
        made += [("date", d.strftime(f)) for f in ("%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%d.%m.%Y", "%d-%m/%Y")] + [("date", f"{d.day}/{d.month}/{d.year}")]
        made += [("date", d.strftime("%m/%d/%Y"))] if d.day > 12 else []
        made += [("account", card(n)) for n in (12, 15, 16, 19)] + [("account", re.sub(r"(....)(?=.)", r"\1 ", card(16))), ("account", re.sub(r"(....)(?=.)", r"\1-", card(16)))]
        made += [("ip", ".".join(str(r.randrange(256)) for _ in range(4))), ("ssn", f"{r.choice([1, 12, 665, 667, 899]):03}-{r.randrange(1, 100):02}-{r.randrange(1, 10000):04}")]
        made += [("phone", f"+1 ({number(3)}) {number(3)}-{number(4)}"), ("phone", f"+49 {number(3)} {number(4)} {number(3)}"), ("phone", f"({number(3)}) {number(3)}-{number(4)}"), ("phone", f"+1{number(10)}")]
        b = number(16)
        made += [("iban", f"BE{98 - rest(b[:12] + 'BE00'):02}{b[:12]}"), ("iban", re.sub(r"(....)(?=.)", r"\1 ", f"AT{98 - rest(b + 'AT00'):02}{b}"))]
        made += [("secret", hashlib.sha1(b.encode()).hexdigest()), ("secret", hashlib.sha1(b.encode()).hexdigest().upper() + "0" * 80), ("email", f"Ann.{b[:3]}@mail.example.org"), ("email", f"B{b[:3]}@X.ORG")]
    got = run(spark, [f"so {m} it is" for _, m in made])
    assert got == [f"so {getattr(twin, kind)(m)} it is" for kind, m in made]
    assert run(spark, [" , ".join(m for _, m in made)]) == [" , ".join(getattr(twin, kind)(m) for kind, m in made)]


def test_numbers_that_fail_their_check_stay(spark):
    r = random.Random(5)
    texts = [f"order {n} of 2023-02-30 at 1700000000123 and 31/04/2020, 666-12-1234" for n in ("".join(r.choice("0123456789") for _ in range(k)) for k in range(12, 20)) if luhn(n) and luhn("1700000000123")]
    assert len(texts) > 4 and run(spark, texts) == texts


def test_no_two_days_share_a_pseudonym(spark):
    days = spark.range(len(DAYS)).select(F.expr("date_add(DATE'1800-01-01', CAST(id AS INT))").alias("d"))
    forms = ["yyyy-MM-dd", "dd/MM/yyyy", "d/M/yyyy"]
    for form in forms:
        out = pii.pseudonymize(days.select("d", F.date_format("d", form).alias("text")), "k")
        if form == "yyyy-MM-dd":
            twin = Twin("k")
            some = random.Random(1).sample(DAYS, 300)
            want = {d: twin.day(d).isoformat() for d in some}
            assert {r.d: r.text for r in out.filter(F.col("d").isin(some)).collect()} == want
        assert out.select("text").distinct().count() == len(DAYS), form
    late = days.filter("day(d) > 12")
    both = pii.pseudonymize(days.select(F.date_format("d", "dd/MM/yyyy").alias("text")), "k").select("text")
    swapped = pii.pseudonymize(late.select(F.date_format("d", "MM/dd/yyyy").alias("text")), "k").select("text")
    assert both.union(swapped).distinct().count() == len(DAYS) + len(LATE)


@pytest.mark.parametrize("name", ["__pii", "__PII", "kind", "m", "v", "b"])
def test_columns_of_the_same_names(spark, name):
    df = spark.createDataFrame([("mail a.b@c.org", "kept"), (None, None)], f"text string, {name} string")
    out = pii.pseudonymize(df, "k")
    assert out.columns == df.columns and [r[1] for r in out.collect()] == ["kept", None] and "a.b@" not in out.first().text


def test_marks_in_texts(spark):
    texts = ["a\x01b 10.0.0.1\x01", "\x01\x02 1.2.3.4 \x01\x03 5.6.7.8 \x01\x01\x03\x02", "\x01\x03", "\x01\x02"]
    twin = Twin("k")
    want = [re.sub(r"\d+(\.\d+){3}", lambda m: twin.ip(m[0]), t) for t in texts]
    assert run(spark, texts) == want


def test_accounts_among_other_groups(spark):
    card, twin = "4111 1111 1111 1111", Twin("k")
    for text in ("{} 11 x", "1234 {}", "1234 5678 {} 22", "{} 5678", "{0} {0}", "2024 {} 1"):
        assert run(spark, [text.format(card)]) == [text.format(twin.account(card))], text
    assert run(spark, ["4111 1111 1111 1112 and 1234 5678 9012"]) == ["4111 1111 1111 1112 and 1234 5678 9012"]
