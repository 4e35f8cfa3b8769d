"""Personal data replaced by keyed pseudonyms of the same format.

Candidates are found by one pattern and then validated by kind: payment cards by their check digit, dates by the calendar,
IPv4 addresses by their octets, telephone and social security numbers by their digits, e-mail addresses by their form. A valid
value is split in two halves that go through a keyed Feistel network, so every value has exactly one pseudonym of its format
and no two values share one: equal values stay linked across documents, whatever separators they are written with.
Cards keep a valid check digit, dates stay dates of the same 400 years, e-mail addresses keep their domain. What does not
validate is left as it is. Runs of digit groups are searched for every card in them, so one followed by another number is found.
The country code of a telephone number follows from its digits, not from its separators.

All of it is column expressions: the text is split at the matches and put together again with their pseudonyms. The key is no
literal of them but the one value of a local table, which a scalar subquery reads: plans, and with them logs and the
web interface, do not show it.

Defined results: null text stays null and counts no values; empty text stays empty. Dates outside 1800 to 2199 are left. Rows are
treated one by one, repeated ones alike; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersheaf.functions.binding import bind

ROUNDS = 10
KINDS = ("card", "phone", "address", "date", "security", "email")
LOCAL = r"[A-Za-z0-9._%+\-]"
# national numbers of one length, whatever follows them
FIXED = "|".join(
    rf"(?:{codes})(?:[ .\-()]{{0,2}}\d){{{count}}}(?!\d)"
    for codes, count in (("1|7|44|52|90|91", 10), ("31|33|34|41|48|61", 9), ("45|47", 8))
)
# what a run of card digits does not go on with
OTHER = (
    rf"{LOCAL}++@|\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?!\w|\.\d)|\d{{3}}-\d{{2}}-\d{{4}}(?!\w|-\d)"
    r"|(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?!\w|[./\-]\d)"
)
# digit groups joined by hyphens; repeated groups are possessive, as the others take a stack frame for each turn and end the executor on long runs
HYPHENED = r"\d++(?:-\d++)*+"
PATTERNS = {
    "email": rf"(?<!{LOCAL}){LOCAL}++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "phone": rf"(?<![\w+])\+(?:{FIXED}|\d{{1,3}}[ .\-]?\(?\d{{2,4}}\)?(?:[ .\-]?\d{{2,4}}){{2,3}}(?!\d))",
    "date": r"(?<![\w./\-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?!\w|[./\-]\d)",
    "address": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "security": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?!\w|-\d)",
    # a run of groups, see card_pieces: 13 digits or more, up to the last space or end that no letter stands before
    "card": rf"(?<![\w\-])(?=\d(?:(?:-| (?!{OTHER}))?\d){{12}}\d*+(?:-\d++)*+(?!\w)){HYPHENED}(?: (?!{OTHER}){HYPHENED}(?!\w))*+",
}
RUN = r"^\d(?:[ \-]?\d){12,}+$"
CANDIDATE = "|".join(PATTERNS.values())
# ITU country codes of one and two digits; all others have three
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
CARD_SHAPE = "^(?:\\d{13,19}|\\d{4}([ -])\\d{4}\\1\\d{4}\\1\\d{4}(?:\\1\\d{3})?|\\d{4}([ -])\\d{6}\\2\\d{4,5}|\\d{4}([ -])\\d{3}\\3\\d{3}\\3\\d{3})$"
CARD_DIGITS = (13, 19)
DATE_FORMATS = {r"^\d{4}-": "yyyy-MM-dd", r"^\d{2}\.\d{2}\.": "dd.MM.yyyy", r"^\d{2}/\d{2}/": "dd/MM/yyyy"}
FIRST_DAY = "1800-01-01"
DAY_PARTS = (189, 773)  # their product is the number of days in 400 years


def _hash(secret: str | Column, kind: str, *parts: Column) -> Column:
    key = F.lit(secret) if isinstance(secret, str) else secret
    return F.sha2(F.concat_ws("|", key, F.lit(kind), *(p.cast("string") for p in parts)), 256)


def feistel(a: Column, b: Column, sizes: tuple[Column, Column], secret: str | Column, kind: str) -> Column:
    """A keyed permutation of all pairs with ``0 <= a < sizes[0]`` and ``0 <= b < sizes[1]``, as a struct of ``a`` and ``b``."""

    def turn(pair: Column, number: Column) -> Column:
        size = F.when(number % 2 == 0, sizes[0]).otherwise(sizes[1])
        added = F.conv(F.substring(_hash(secret, kind, *sizes, number, pair["b"]), 1, 15), 16, 10).cast("bigint")
        return F.struct(pair["b"].alias("a"), ((pair["a"] + added) % size).alias("b"))

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def digits_pseudonym(digits: Column, secret: str | Column, kind: str) -> Column:
    """A string of 2 to 36 digits permuted within its length."""

    def permuted(digits: Column, half: Column, rest: Column) -> Column:
        left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest)
        sizes = F.struct(*(F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("bigint").alias(c) for c, k in (("a", half), ("b", rest))))
        pair = bind(
            sizes, lambda size: feistel(left.cast("bigint"), right.cast("bigint"), (size["a"], size["b"]), secret, kind)
        )
        return bind(
            pair,
            lambda p: F.concat(F.lpad(p["a"].cast("string"), half, F.lit("0")), F.lpad(p["b"].cast("string"), rest, F.lit("0"))),
        )

    return bind(digits, lambda d: bind(F.floor(F.length(d) / 2).cast("int"), lambda half: permuted(d, half, F.length(d) - half)))


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in order."""
    return bind(digits, lambda known: _refilled(shape, known))


def _refilled(shape: Column, digits: Column) -> Column:
    filled = F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("text"), F.lit(1).alias("next")),
        lambda state, char: F.when(
            char.rlike(r"^\d$"),
            F.struct(F.concat(state["text"], F.substring(digits, state["next"], F.lit(1))).alias("text"), (state["next"] + 1).alias("next")),
        ).otherwise(F.struct(F.concat(state["text"], char).alias("text"), state["next"].alias("next"))),
    )
    return filled["text"]


def luhn_sum(digits: Column) -> Column:
    """The sum of a number's digits, every second from the last but one doubled, with the digits of doubles added."""
    return bind(digits, _luhn_sum)


def _luhn_sum(digits: Column) -> Column:
    def value(place: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - place, F.lit(1)).cast("int")
        return F.when(place % 2 == 0, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda total, place: total + value(place))


def card_pseudonym(digits: Column, secret: str | Column) -> Column:
    """All digits but the last permuted, then the check digit that makes the number valid."""
    body = digits_pseudonym(F.substring(digits, F.lit(1), F.length(digits) - 1), secret, "card")
    return bind(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))


def card_pieces(run: Column) -> Column:
    """A run of digit groups as ``(match, kind)`` pieces: the valid cards in it, and what is between them.

    From left to right each group starts the longest valid card of a usual form, else the longest other one that holds none of
    a usual form. Others are the whole run or have three digits in each group.
    """

    def pieces(parts: Column) -> Column:  # groups at odd places, one sign between two of them
        count = F.size(parts)
        places = F.sequence(F.lit(1), count, F.lit(2))
        most = 2 * CARD_DIGITS[1] - 2

        def ending(start: Column) -> Column:
            def span(stop: Column) -> Column:
                return F.struct(stop.alias("stop"), F.array_join(F.slice(parts, start, stop - start + 1), "").alias("text"))

            def valid(found: Column) -> Column:
                digits = only_digits(found["text"])
                form = found["text"].rlike(CARD_SHAPE) | ~found["text"].rlike(r"(?:^|\D)\d{1,2}(?:\D|$)")
                whole = (start == 1) & (found["stop"] == count)
                size = F.length(digits).between(*CARD_DIGITS)
                return F.when(size & (form | whole), luhn_sum(digits) % 10 == 0).otherwise(False)

            spans = F.filter(F.transform(F.sequence(start, F.least(start + most, count), F.lit(2)), span), valid)
            usual = F.filter(spans, lambda found: found["text"].rlike(CARD_SHAPE))
            return bind(
                F.struct(spans.alias("all"), usual.alias("usual")),
                lambda s: F.struct(
                    start.alias("start"),
                    F.array_max(F.transform(s["usual"], lambda f: f["stop"])).alias("usual"),
                    F.array_max(F.transform(s["all"], lambda f: f["stop"])).alias("other"),
                ),
            )

        def chosen(ends: Column) -> Column:
            def step(state: Column, end: Column) -> Column:
                after = F.slice(ends, F.floor(end["start"] / 2).cast("int") + 2, F.floor((end["other"] - end["start"]) / 2).cast("int"))
                other = F.when(~F.exists(after, lambda e: e["usual"].isNotNull()), end["other"])
                stop = F.when(end["start"] >= state["next"], F.coalesce(end["usual"], other))
                here = F.struct(end["start"].alias("start"), stop.alias("stop"))
                return F.when(
                    stop.isNotNull(),
                    F.struct((stop + 2).alias("next"), F.concat(state["cards"], F.array(here)).alias("cards")),
                ).otherwise(state)

            none = F.array().cast("array<struct<start:int,stop:int>>")
            return F.aggregate(ends, F.struct(F.lit(1).alias("next"), none.alias("cards")), step)["cards"]

        def cut(cards: Column) -> Column:
            def piece(first: Column, last: Column, kind: Column) -> Column:
                text = F.array_join(F.slice(parts, first, F.greatest(last - first + 1, F.lit(0))), "")
                return F.struct(text.alias("match"), kind.alias("kind"))

            no = F.lit(None).cast("string")

            def with_gap(card: Column, number: Column) -> Column:
                before = F.when(number > 0, F.element_at(cards, F.greatest(number, F.lit(1)))["stop"] + 1).otherwise(1)
                return F.array(piece(before, card["start"] - 1, no), piece(card["start"], card["stop"], F.lit("card")))

            rest = F.coalesce(F.try_element_at(cards, F.lit(-1))["stop"] + 1, F.lit(1))
            return F.concat(F.flatten(F.transform(cards, with_gap)), F.array(piece(rest, count, no)))

        return bind(bind(F.transform(places, ending), chosen), cut)

    return bind(F.regexp_extract_all(run, F.lit(r"\d+|[ \-]"), F.lit(0)), pieces)


def address_pseudonym(address: Column, secret: str | Column) -> Column:
    octet = [F.element_at(F.split(address, r"\."), k).cast("bigint") for k in (1, 2, 3, 4)]
    size = F.lit(65536).cast("bigint")
    moved = feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], (size, size), secret, "address")

    def written(pair: Column) -> Column:
        parts = [F.shiftright(pair["a"], 8), pair["a"] % 256, F.shiftright(pair["b"], 8), pair["b"] % 256]
        return F.concat_ws(".", *(p.cast("string") for p in parts))

    return bind(moved, written)


def _date(text: Column) -> Column:
    """The calendar day of a date in one of the formats; null if there is none."""
    return F.coalesce(
        *(F.when(text.rlike(start), F.try_to_timestamp(text, F.lit(form)).cast("date")) for start, form in DATE_FORMATS.items())
    )


def _day(text: Column) -> Column:
    return F.date_diff(_date(text), F.lit(FIRST_DAY).cast("date")).cast("bigint")


def date_pseudonym(text: Column, secret: str | Column) -> Column:
    many, few = DAY_PARTS
    sizes = F.lit(many).cast("bigint"), F.lit(few).cast("bigint")
    pair = bind(_day(text), lambda day: feistel(F.floor(day / few), day % few, sizes, secret, "date"))
    moved = bind(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * few + p["b"]).cast("int")))

    def written(date: Column) -> Column:
        return F.coalesce(*(F.when(text.rlike(start), F.date_format(date, form)) for start, form in DATE_FORMATS.items()))

    return bind(moved, written)


def _shifted(half: Column, digest: Column) -> Column:
    """Each letter and digit moved within its own alphabet."""

    def char(place: Column) -> Column:
        return bind(F.ascii(F.substring(half, place, F.lit(1))), lambda code: moved_char(code, place))

    def moved_char(code: Column, place: Column) -> Column:
        first = F.when(code.between(48, 57), 48).when(code.between(65, 90), 65).when(code.between(97, 122), 97)
        size = F.when(code < 58, 10).otherwise(26)
        moved = F.conv(F.substring(digest, place * 2 % 60 + 1, F.lit(2)), 16, 10).cast("int")
        return F.coalesce(F.char(first + (code - first + moved) % size), F.substring(half, place, F.lit(1)))

    places = F.when(F.length(half) > 0, F.sequence(F.lit(1), F.length(half))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, char), "")


def _email_turn(pair: Column, number: Column, secret: str | Column) -> Column:
    digest = _hash(secret, "email", F.length(pair["a"]), F.length(pair["b"]), number, pair["b"])
    return bind(digest, lambda known: F.struct(pair["b"].alias("a"), _shifted(pair["a"], known).alias("b")))


def email_pseudonym(address: Column, secret: str | Column) -> Column:
    """The part before the sign permuted, each character within letters of its case or digits."""
    local = F.substring_index(address, "@", 1)
    half = F.floor(F.length(local) / 2).cast("int")
    start = F.struct(F.substring(local, F.lit(1), half).alias("a"), F.substring(local, half + 1, F.length(local)).alias("b"))
    turned = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, lambda pair, number: _email_turn(pair, number, secret))
    return bind(turned, lambda p: F.concat(p["a"], p["b"], F.lit("@"), F.substring_index(address, "@", -1)))


def kind_of(match: Column) -> Column:
    """The kind of a candidate that validates, else null; cards are found by ``card_pieces``."""

    def whole(kind: str) -> Column:
        return match.rlike(f"^(?:{PATTERNS[kind]})$")

    octets = F.split(match, r"\.")
    return (
        F.when(match.contains("@"), "email")
        .when(match.startswith("+"), "phone")
        .when(whole("date"), F.when(_day(match).between(0, DAY_PARTS[0] * DAY_PARTS[1] - 1), "date"))
        .when(whole("address"), F.when(F.forall(octets, lambda o: (o.cast("int") < 256) & (o.cast("int").cast("string") == o)), "address"))
        .when(whole("security"), "security")
    )


def pseudonym(match: Column, kind: Column, secret: str | Column) -> Column:
    """The pseudonym of a validated candidate, or the candidate itself where ``kind`` is null."""
    digits = only_digits(match)

    def phone(country: Column) -> Column:
        national = F.substring(digits, F.length(country) + 1, F.length(digits))
        return refilled(match, F.concat(country, digits_pseudonym(national, secret, "phone")))

    return (
        F.when(kind == "email", email_pseudonym(match, secret))
        .when(kind == "phone", bind(F.regexp_extract(digits, COUNTRY, 0), phone))
        .when(kind == "date", date_pseudonym(match, secret))
        .when(kind == "address", address_pseudonym(match, secret))
        .when(kind == "security", refilled(match, digits_pseudonym(digits, secret, "security")))
        .when(kind == "card", refilled(match, card_pseudonym(digits, secret)))
        .otherwise(match)
    )


def pseudonymise(documents: DataFrame, secret: str) -> DataFrame:
    """``(doc_id, n_card, .., n_email, text)`` with every validated value replaced. ``secret`` is the key of the permutations."""
    text = F.col("text")
    key = documents.sparkSession.createDataFrame(pa.table({"key": pa.array([secret], pa.string())})).scalar()
    some = text.rlike("[0-9@]")
    found = documents.select(
        "doc_id",
        "text",
        F.when(some, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).alias("matches"),
        F.when(some, F.split(text, CANDIDATE, -1)).alias("gaps"),
        key.alias("key"),
    )
    def named(match: Column) -> Column:
        one = F.array(F.struct(match.alias("match"), kind_of(match).alias("kind")))
        return F.when(match.rlike(RUN) & one[0]["kind"].isNull(), card_pieces(match)).otherwise(one)

    named = F.when(F.size("matches") > 0, F.transform("matches", named))
    found = found.select("doc_id", "text", "gaps", named.alias("matches"), "key")
    replaced = F.transform("matches", lambda m: F.array_join(F.transform(m, lambda x: pseudonym(x["match"], x["kind"], F.col("key"))), ""))
    pieces = F.zip_with("gaps", F.concat(replaced, F.array(F.lit(""))), lambda gap, value: F.concat(gap, value))
    counts = [
        F.when(F.col("matches").isNull(), 0).otherwise(F.size(F.filter(F.flatten("matches"), lambda m: m["kind"] == kind))).alias(f"n_{kind}")
        for kind in KINDS
    ]
    whole = F.when(F.col("matches").isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    return found.select("doc_id", *counts, whole.alias("text"))
