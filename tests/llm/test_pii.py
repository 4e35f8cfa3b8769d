"""Pseudonyms against plain Python, and their properties."""

import hashlib
import random
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from papersheaf.llm import pii
from tests.llm.helpers import clashing, documents

SECRET = "k1"


def digest(kind, *parts):
    return hashlib.sha256("|".join([SECRET, kind, *map(str, parts)]).encode()).hexdigest()


def network(a, b, sizes, kind):
    for number in range(pii.ROUNDS):
        a, b = b, (a + int(digest(kind, *sizes, number, b)[:15], 16)) % sizes[number % 2]
    return a, b


def number(digits, kind):
    half = len(digits) // 2
    rest = len(digits) - half
    a, b = network(int(digits[:half]), int(digits[half:]), (10**half, 10**rest), kind)
    return f"{a:0{half}d}{b:0{rest}d}"


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10


def card(digits):
    body = number(digits[:-1], "card")
    return body + str(-luhn(body + "0") % 10)


def fill(shape, digits):
    left = iter(digits)
    return re.sub(r"\d", lambda _: next(left), shape)


def day(value):
    n = (value - date(1800, 1, 1)).days
    a, b = network(n // 773, n % 773, (189, 773), "date")
    return date(1800, 1, 1) + timedelta(a * 773 + b)


def replaced(spark, rows, secret=SECRET):
    got = pii.pseudonymise(clashing(documents(spark, rows)), secret).collect()
    return sorted((tuple(r) for r in got), key=str)


def test_values_equal_plain_python(spark):
    valid = "4539578763621486"
    assert luhn(valid) == 0
    cases = [
        (f"pay {valid}.", f"pay {card(valid)}.", "card"),
        ("4539 5787 6362 1486, 4539-5787-6362-1486", f"{fill('0000 0000 0000 0000', card(valid))}, {fill('0000-0000-0000-0000', card(valid))}", "card"),
        ("no 4539578763621487 nor 12345", "no 4539578763621487 nor 12345", None),
        ("call +1 (988) 555-2485 now", f"call {fill('+1 (000) 000-0000', '1' + number('9885552485', 'phone'))} now", "phone"),
        ("+49 170 1234567", f"{fill('+49 170 1234567', '49' + number('1701234567', 'phone'))}", "phone"),
        ("born 2000-02-29", f"born {day(date(2000, 2, 29))}", "date"),
        ("am 29.02.2000!", f"am {day(date(2000, 2, 29)):%d.%m.%Y}!", "date"),
        ("29/02/2000", f"{day(date(2000, 2, 29)):%d/%m/%Y}", "date"),
        ("not 2001-02-29, 1799-12-31, 32.01.2000", "not 2001-02-29, 1799-12-31, 32.01.2000", None),
        ("id 123-45-6789", f"id {fill('000-00-0000', number('123456789', 'security'))}", "security"),
        ("300.1.1.1 and 01.2.3.4 and 1.2.3.4.5", "300.1.1.1 and 01.2.3.4 and 1.2.3.4.5", None),
        ("日本語 text without any", "日本語 text without any", None),
        ("", "", None),
        (None, None, None),
    ]
    got = replaced(spark, [(k, case[0]) for k, case in enumerate(cases)])
    got = {row[0]: row for row in got}
    for k, (_, text, kind) in enumerate(cases):
        counts = dict(zip(pii.KINDS, got[k][1:-1]))
        assert (got[k][-1], {name for name, n in counts.items() if n}) == (text, {kind} - {None})


def test_addresses_and_mail_keep_their_form(spark):
    rows = [(1, "10.0.0.255 x.Y-42@mail8.example.com"), (2, "again: 10.0.0.255, (x.Y-42@mail8.example.com)"), (3, "a@b.c é@b.c")]
    one, two, three = (row[-1] for row in replaced(spark, rows))
    address, mail = one.split(" ")
    assert two == f"again: {address}, ({mail})"
    assert address != "10.0.0.255" and all(0 <= int(x) < 256 for x in address.split("."))
    assert re.fullmatch(r"[a-z]\.[A-Z]-\d\d@mail8\.example\.com", mail) and mail != "x.Y-42@mail8.example.com"
    assert re.fullmatch(r"[a-z]@b\.c é@b\.c", three)
    assert replaced(spark, rows[:1], "another")[0][-1] != one


def test_pseudonyms_are_permutations(spark):
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert numbers.select(pii.digits_pseudonym(F.col("d"), SECRET, "card").alias("p")).exceptAll(numbers).isEmpty()
    pairs = spark.range(35).select(pii.feistel(F.floor(F.col("id") / 7), F.col("id") % 7, (F.lit(5), F.lit(7)), SECRET, "x").alias("p"))
    assert {(r.p.a, r.p.b) for r in pairs.collect()} == {(a, b) for a in range(5) for b in range(7)}


def test_whole_long_text_and_repeated_rows(spark):
    draw = random.Random(5)
    body = " ".join(draw.choice(["word", "4539578763621486", "2000-02-29"]) for _ in range(5000))
    want = body.replace("4539578763621486", card("4539578763621486")).replace("2000-02-29", str(day(date(2000, 2, 29))))
    got = replaced(spark, [(1, body), (1, body), (None, "2000-02-29")])
    assert [row[-1] for row in got[:2]] == [want, want] and got[2][-1] == str(day(date(2000, 2, 29)))
    assert replaced(spark, []) == []


def test_cards_beside_other_numbers(spark):
    one, two = "4111111111111111", "378282246310005"
    spaced, moved = "4111 1111 1111 1111", fill("0000 0000 0000 0000", card(one))
    cases = [
        (f"card {one} 123 x", f"card {card(one)} 123 x", 1),
        (f"{spaced} 12/27", f"{moved} 12/27", 1),
        (f"order 12 {one}", f"order 12 {card(one)}", 1),
        (f"12 {spaced} 123 {two} 7", f"12 {moved} 123 {card(two)} 7", 2),
        (f"{one} {one}-{two}", f"{card(one)} {card(one)}-{card(two)}", 3),
        (f"{one} 2000-02-29", f"{card(one)} {day(date(2000, 2, 29))}", 1),
        (f"{one} 123-45-6789", f"{card(one)} {fill('000-00-0000', number('123456789', 'security'))}", 1),
        ("no 1234567890123456 78", "no 1234567890123456 78", 0),
        ("4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", fill("0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0", card(one)), 1),
    ]
    got = {row[0]: row for row in replaced(spark, [(k, text) for k, (text, _, _) in enumerate(cases)])}
    assert [(got[k][-1], got[k][1]) for k in range(len(cases))] == [(text, n) for _, text, n in cases]


def test_telephone_numbers_end_at_their_length(spark):
    plain = fill("+0 000 000 0000", "1" + number("5551234567", "phone"))
    got = [row[-1] for row in replaced(spark, [(1, "+1 555 123 4567"), (2, "+1 555 123 4567 89 x"), (3, "+33 1 23 45 67 89")])]
    assert got[:2] == [plain, plain + " 89 x"] and got[2] != "+33 1 23 45 67 89"


def test_one_telephone_number_in_several_spellings(spark):
    rows = [
        ["+49 30 12345678", "+493012345678", "+49-30-12345678", "+4930 1234 5678"],
        ["+44 20 7946 0958", "+442079460958", "+44 (20) 7946-0958"],
        ["+33 1 23 45 67 89", "+33123456789", "+33 123 456 789"],
        ["+351 21 234 5678", "+351212345678"],
        ["+1 (988) 555-2485", "+19885552485", "+1.988.555.2485"],
    ]
    texts = [(k * 10 + n, text) for k, spellings in enumerate(rows) for n, text in enumerate(spellings)]
    got = {row[0]: re.sub(r"\D", "", row[-1]) for row in replaced(spark, texts)}
    known = {k: re.sub(r"\D", "", text) for k, text in texts}
    for k, code in enumerate(["49", "44", "33", "351", "1"]):
        digits = known[k * 10]
        assert {got[i] for i in got if i // 10 == k} == {code + number(digits[len(code) :], "phone")}


def test_no_plan_shows_the_key(spark):
    secret = "Kellerschluessel-4711"
    rows = [(1, "pay 4539578763621486 on 2000-02-29, mail a.b@c.org, call +49 170 1234567 from 10.0.0.1"), (2, None)]
    found = pii.pseudonymise(documents(spark, rows), secret)
    plans = [found._jdf.queryExecution().toString()]
    got = found.collect()
    plans += [found._jdf.queryExecution().toString(), found._jdf.queryExecution().executedPlan().treeString()]
    assert got[0].text != rows[0][1] and sum(got[0][k] for k in range(1, 1 + len(pii.KINDS))) == 5
    for plan in plans:
        assert secret not in plan and "4711" not in plan and "Python" not in plan
    assert replaced(spark, rows, secret) != replaced(spark, rows, "another")


def test_runs_of_any_length_need_no_stack(spark):
    """A recursive pattern ended the executor on these: digits, groups by spaces and hyphens, labels of a domain."""
    n, valid = 20_000, "4539578763621486"
    plain = ["1" * n, "1 " * n, "12-" * n + "12", "1 " * n + "x", f"{valid} " + "1 " * n]
    got = [row[-1] for row in replaced(spark, [(k, text) for k, text in enumerate([*plain, "x@" + "a." * n + "de"])])]
    assert got[:4] == plain[:4] and got[4] == plain[4].replace(valid, card(valid), 1)
    assert re.fullmatch(r"[a-z]@(?:a\.){20000}de", got[5])


def test_runs_end_before_a_group_with_letters(spark):
    one = "4111111111111111"
    spaced = "4111 1111 1111 1111"
    moved = fill("0000 0000 0000 0000", card(one))
    cases = [(f"{spaced} 7x", f"{moved} 7x"), (f"{spaced} 7-8x", f"{moved} 7-8x"), (f"{spaced}x", f"{spaced}x"), ("12345678 901234x", "12345678 901234x")]
    assert [row[-1] for row in replaced(spark, [(k, text) for k, (text, _) in enumerate(cases)])] == [want for _, want in cases]
