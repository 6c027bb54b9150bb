"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations, with DataFrame functions only.

Candidates are found by regular expressions, in passes over what is left of a text, and then validated: addresses by the
range of their parts, dates by the calendar, account numbers (IBAN) by their check digits, social security numbers by
their parts, telephone numbers by their number of digits. Card numbers are sought in whole runs of digits: every part of
13 to 19 digits between separators is held against its check digit, those in usual groups before and all others after
the telephone numbers, so a number beside a card hides neither.

Each value is then permuted within its format. A value with a number (addresses, dates, telephone and social security
numbers) is two halves below a and b, and each round adds to one half, in turn, a hash of key, kind, round and the
other half. Any other value is one network too, however long it is: its halves are its first and last characters, and a
round shifts each letter and digit of one half within its alphabet, by a hash of key, kind, round and the whole other
half. As these are permutations of each format, different values keep different pseudonyms, and equal values get the
same pseudonym in every document, so links stay while the values go. A card number keeps its first digit and gets a
fitting check digit; separators stay where they are.

Dates of one format are permuted among themselves: 13/5/2020, which can only have the day first, stays such a date, so
it never meets one that is read month first. Mail addresses that differ in case only keep their case and are otherwise
equal; their domains stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: A local part has 64 characters at most. Loops are possessive or bounded, so a long run of letters is read once.
EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]++\.){1,31}[A-Za-z]{2,}"
KEY = r"\bAKIA[0-9A-Z]{16}\b"
VALUE = r"""[^\s"'<>,;&]{5,}[^\s"'<>,;&.:!?)\]]"""
SECRET = "|".join(
    (
        rf"""(?<=[="'])(?<=(?i:passw(?:or)?d|pwd)["']?=["']?){VALUE}""",
        r"""(?<=[=:]\s{0,3}["'])(?=[^"']*\d)(?:[0-9a-f]{32,}|(?=[^"']*[A-Za-z])[A-Za-z0-9+/_=-]{32,})(?=["'])""",
    )
)
#: A value behind a label; it must have a digit, which is judged after it is found, so that no value is read twice.
LABELLED = rf"""(?<=[=:"'\s])(?<=(?i:passw(?:or)?d|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key)["']?\s{{0,3}}[=:]\s{{0,3}}["']?){VALUE}"""
IP = rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?!\w|\.\d)"
DATE = r"(?<![\w.-])(?<!\d/)(?:(?:19|20)\d\d-\d\d-\d\d(?:(?=[Tt]\d)|(?![\w-]|\.\d))|\d\d?([./])\d\d?\1(?:19|20)\d\d(?![\w-]|\.\d))"
SSN = r"(?<![\w.-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-]|\.\d)"
IBAN = r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
#: Numbers in groups of 3, 3 and 4; with a country code; with a leading 0 and other groups; of ten bare digits.
PHONE = "|".join(
    (
        r"(?:(?=\()|(?<![\w+.]))(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?:(?!\w|-\w)|(?= ?x\d))",
        r"(?<![\w+.])(?:\+|00)[1-9](?:[ ./()-]{0,3}\d){6,14}(?!\w|-\w)",
        r"(?<![\w+.-])\(?0[1-9]\d{0,3}\)?(?:[ /-]{1,2}\d{2,8}){1,5}(?!\w|-\w|[./]\d)",
        r"(?<![\w+.-])1?\d{10}(?!\w|[.-]\w)",
    )
)
#: A run of digits with single separators, not behind a + unless it's too long for a telephone number; the possessive
#: loop takes no stack, however long the run.
WHOLE = r"(?=\d++(?![^\W\d]|-[^\W\d]))"
RUN = rf"(?:(?<![\w.+-])|(?<=\+)(?=\d{{4}}[ -]?\d{{4}}[ -]?\d{{4}}[ -]?\d{{4}})){WHOLE}\d(?:(?:[ -]{WHOLE})?\d){{12,}}+"
CARD_DIGITS = range(13, 20)
USUAL = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ -])\d{6}\2\d{4,5})$"
ISSUER = r"^(?:4|5[1-5]|22[2-9]|2[3-6]|27[012]|3[0-9]|6)"
COUNTRY = r"^(?:7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
MARKED, PARTED = "|".join((EMAIL, KEY, SECRET)), "|".join((IBAN, SSN, DATE, IP))
PIECES = "array<struct<text:string,kind:string>>"
KINDS = ("email", "key", "secret", "phone", "card", "ip", "date", "ssn", "iban")
DIGITS, LOWER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
UPPER = LOWER.upper()
#: Days of 1900 to 2099, and those after the 12th of their month, with halves whose product isn't much above.
FIRST_DAY, DAYS, DAY_HALVES = "1900-01-01", 73049, (17, 4297)
LATE_DAYS, LATE_HALVES = DAYS - 12 * 2400, (210, 211)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tag: Column) -> Column:
    """struct(l, r): the permuted halves of a number left * b + right below a * b."""
    def f(i: Column, half: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tag, i.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")

    def turn(acc: Column, i: Column) -> Column:
        new_left = F.pmod(acc["l"] + F.pmod(f(i, acc["r"]), a), a)
        step = F.struct(new_left.alias("l"), acc["r"].alias("r"))
        new_right = F.pmod(acc["r"] + F.pmod(f(i, acc["l"]), b), b)
        return F.when(i % 2 == 0, step).otherwise(F.struct(acc["l"].alias("l"), new_right.alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _shifted(c: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    """A character moved within its alphabet; one of none stays."""
    out = c
    for a in alphabets:
        at = F.call_function("instr", F.lit(a), c)
        out = F.when(at > 0, F.substring(F.lit(a), (F.pmod(at - 1 + by, F.lit(len(a))) + 1).cast("int"), F.lit(1))).otherwise(out)
    return out


def enciphered(text: Column, alphabets: tuple[str, ...], key: str, tag: Column, fold: bool = False) -> Column:
    """``text`` with its characters permuted, each within its alphabet, by one network over all of them.

    With ``fold``, texts that differ in case only give such texts again.
    """
    def moved(half: Column, other: Column, i: Column) -> Column:
        whole = F.array_join(other, "")
        first = F.sha2(F.concat_ws("|", F.lit(key), tag, i.cast("string"), F.size(half).cast("string"), F.lower(whole) if fold else whole), 256)

        def blocks(d: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(half) - 1) / 8).cast("int"), F.lit(0))), lambda j: F.when(j == 0, d).otherwise(F.sha2(F.concat_ws("|", d, j.cast("string")), 256)))

        def all_moved(hashes: Column) -> Column:
            def one(c: Column, p: Column) -> Column:
                by = F.conv(F.substring(F.get(hashes, F.floor(p / 8).cast("int")), (p % 8) * 8 + 1, F.lit(8)), 16, 10).cast("long")
                return _shifted(c, by, alphabets)

            return F.transform(half, one)

        return let(let(first, blocks), all_moved)

    def turn(acc: Column, i: Column) -> Column:
        left = F.struct(moved(acc["l"], acc["r"], i).alias("l"), acc["r"].alias("r"))
        right = F.struct(acc["l"].alias("l"), moved(acc["r"], acc["l"], i).alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    def network(chars: Column) -> Column:
        half = F.floor(F.size(chars) / 2).cast("int")
        start = F.struct(F.slice(chars, F.lit(1), half).alias("l"), F.slice(chars, half + 1, F.size(chars)).alias("r"))
        return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn), lambda h: F.concat(F.array_join(h["l"], ""), F.array_join(h["r"], "")))

    def alone(c: Column) -> Column:
        """A single character has no other half; its alphabet is put in the order of a keyed hash."""
        out = c
        for a in alphabets:
            order = F.array_sort(F.transform(F.array(*map(F.lit, a)), lambda x: F.struct(F.sha2(F.concat_ws("|", F.lit(key), tag, F.lower(x) if fold else x), 256).alias("h"), x.alias("c"))))
            at = F.call_function("instr", F.lit(a), c)
            out = F.when(at > 0, F.get(order, at - 1)["c"]).otherwise(out)
        return out

    characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.when(F.length(text) > 1, let(characters, network)).when(F.length(text) == 1, alone(text)).otherwise(text)


def refill(shape: Column, wanted: str, new: Column) -> Column:
    """``shape`` with its characters of a class replaced, in order, by those of ``new``."""
    def both(p: Column) -> Column:
        def char(i: Column) -> Column:
            c = F.substring(p["shape"], i, F.lit(1))
            rank = F.length(F.regexp_replace(F.substring(p["shape"], F.lit(1), i), f"[^{wanted}]", ""))
            return F.when(c.rlike(f"[{wanted}]"), F.substring(p["new"], rank, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(p["shape"])), char), "")

    return let(F.struct(shape.alias("shape"), new.alias("new")), both)


def luhn_sum(digits: Column) -> Column:
    """Sum of a number's digits with every second, from the one before the last, doubled (and 9 taken off above 9)."""
    def total(d: Column) -> Column:
        def value(i: Column) -> Column:
            x = F.greatest(F.ascii(F.substring(d, i, F.lit(1))) - 48, F.lit(0))
            return F.when(i % 2 == 0, (x * 2) % 10 + F.floor(x / 5).cast("int")).otherwise(x)

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), lambda a, i: a + value(i))

    return let(F.reverse(digits), total)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _card(m: Column, key: str) -> Column:
    def number(d: Column) -> Column:
        payload = F.concat(F.substring(d, 1, 1), enciphered(F.substring(d, F.lit(2), F.length(d) - 2), (DIGITS,), key, F.concat(F.lit("card"), F.substring(d, 1, 1))))
        return let(payload, lambda p: F.concat(p, F.pmod(F.lit(10) - luhn_sum(F.concat(p, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    return refill(m, "0-9", let(_digits(m), number))


def _phone(m: Column, key: str) -> Column:
    """Ten digits, with or without a 1 before, are area, exchange and line. Numbers of the North American plan (area
    and exchange from 200 on) stay such numbers; of the others, those with an area below 200 and those with an exchange
    below 200 stay among themselves, so no two values meet. Other numbers keep leading zeros and country code."""
    def number(d: Column) -> Column:
        area, exchange, line = (F.substring(d, F.length(d) - 9 + s, F.lit(n)).cast("long") for s, n in ((0, 3), (3, 3), (6, 4)))

        def choose(low_area: Column | int, low_exchange: Column | int, valid: Column | int) -> Column:
            return F.when(area < 200, low_area).when(exchange < 200, low_exchange).otherwise(valid)

        parts = F.struct(
            choose(F.lit("phone1"), F.lit("phone2"), F.lit("phone")).alias("tag"), choose(0, 200, 200).alias("area0"), choose(0, 0, 200).alias("exchange0"), choose(1000, 200, 800).alias("span"),
            choose(40000, 40000, 80000).alias("a"), choose(50000, 40000, 80000).alias("b"), area.alias("area"), exchange.alias("exchange"), line.alias("line"),
        )

        def permute(p: Column) -> Column:
            x = ((p["area"] - p["area0"]) * p["span"] + p["exchange"] - p["exchange0"]) * 10000 + p["line"]

            def text(h: Column) -> Column:
                y = h["l"] * p["b"] + h["r"]
                front = F.call_function("div", y, F.lit(10000))
                return F.concat(F.lpad((F.call_function("div", front, p["span"]) + p["area0"]).cast("string"), 3, "0"), F.lpad((front % p["span"] + p["exchange0"]).cast("string"), 3, "0"), F.lpad((y % 10000).cast("string"), 4, "0"))

            return let(feistel(F.call_function("div", x, p["b"]), x % p["b"], p["a"], p["b"], key, p["tag"]), text)

        return F.concat(F.substring(d, F.lit(1), F.length(d) - 10), let(parts, permute))

    def other(d: Column) -> Column:
        zeros = F.regexp_extract(d, "^0*", 0)
        national = F.substring(d, F.length(zeros) + 1, F.length(d))
        front = F.when(m.startswith("+") | m.startswith("00"), F.concat(zeros, F.regexp_extract(national, COUNTRY, 0))).otherwise(zeros)
        return let(front, lambda f: F.concat(f, enciphered(F.substring(d, F.length(f) + 1, F.length(d)), (DIGITS,), key, F.concat(F.lit("phone+"), F.ltrim(f, F.lit("0"))))))

    def either(d: Column) -> Column:
        abroad = m.startswith("+") | m.startswith("00")
        ten = (~abroad & (F.length(d) == 10)) | (~m.startswith("00") & (F.length(d) == 11) & d.startswith("1"))
        return F.when(ten, number(d)).otherwise(other(d))

    return refill(m, "0-9", let(_digits(m), either))


def _ip(m: Column, key: str) -> Column:
    p = [F.split_part(m, F.lit("."), F.lit(i)).cast("long") for i in (1, 2, 3, 4)]
    half = F.lit(65536)

    def text(h: Column) -> Column:
        return F.concat_ws(".", *[F.call_function("div", h[s], F.lit(256)).cast("string") if high else (h[s] % 256).cast("string") for s in "lr" for high in (True, False)])

    return let(feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], half, half, key, F.lit("ip")), text)


def _as_date(m: Column) -> Column:
    """The date, or null; 05/06/2020 is read month first and 05.06.2020 day first."""
    day_first = F.coalesce(F.try_to_timestamp(F.regexp_replace(m, "/", "."), F.lit("d.M.yyyy")), F.lit(None).cast("timestamp"))
    return F.when(m.contains("-"), F.try_to_timestamp(m, F.lit("yyyy-MM-dd"))).when(m.contains("/"), F.coalesce(F.try_to_timestamp(m, F.lit("M/d/yyyy")), day_first)).otherwise(day_first).cast("date")


def _late_day(x: Column) -> Column:
    """The date with number x among those after the 12th of their month."""
    first = F.lit(FIRST_DAY).cast("date")

    def among(x: Column) -> Column:
        guess = F.floor(x * 2400 / LATE_DAYS).cast("int")
        months = F.filter(F.sequence(guess - 2, guess + 2), lambda k: F.date_diff(F.add_months(first, k), first) - 12 * k <= x)
        return F.date_add(first, (x + 12 * (F.array_max(months) + 1)).cast("int"))

    return let(x, among)


def _date(m: Column, key: str) -> Column:
    """A date in its own format; of those with slashes, only a first number above 12 is read as the day."""
    a, b = DAY_HALVES
    late_a, late_b = LATE_HALVES
    day = _as_date(m)
    month_first = m.contains("/") & F.try_to_timestamp(m, F.lit("M/d/yyyy")).isNotNull()
    x = F.date_diff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    months = (F.year(day) - 1900) * 12 + F.month(day)

    def any_day(x: Column) -> Column:
        mixed = feistel(F.call_function("div", x, F.lit(b)), x % b, F.lit(a), F.lit(b), key, F.lit("date"))
        return let(mixed, lambda h: F.date_add(F.lit(FIRST_DAY).cast("date"), (h["l"] * b + h["r"]).cast("int")))

    def late_day(x: Column) -> Column:
        """The halves hold a few numbers more: one of these is permuted again."""
        def again(x: Column, i: Column) -> Column:
            mixed = feistel(F.call_function("div", x, F.lit(late_b)), x % late_b, F.lit(late_a), F.lit(late_b), key, F.lit("date after the 12th"))
            return F.when((i == 1) | (x >= LATE_DAYS), let(mixed, lambda h: h["l"] * late_b + h["r"])).otherwise(x)

        return _late_day(F.aggregate(F.sequence(F.lit(1), F.lit(8)), x, again))

    def written(new: Column) -> Column:
        def parts(month: str, of_day: str) -> Column:
            dotted = F.when(m.contains("/"), F.date_format(new, f"{of_day}/{month}/yyyy")).otherwise(F.date_format(new, f"{of_day}.{month}.yyyy"))
            return F.when(month_first, F.date_format(new, f"{month}/{of_day}/yyyy")).otherwise(dotted)

        return F.when(m.contains("-"), F.date_format(new, "yyyy-MM-dd")).when(F.length(m) < 10, parts("M", "d")).otherwise(parts("MM", "dd"))

    late = m.contains("/") & ~month_first
    return let(F.when(late, late_day((x - 12 * months).cast("long"))).otherwise(any_day(x)), written)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(i)).cast("long") for i in (1, 2, 3))
    a, b = 898, 99 * 9999

    def text(h: Column) -> Column:
        new = h["l"] + 1 + F.when(h["l"] >= 665, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(new.cast("string"), 3, "0"), F.lpad((F.call_function("div", h["r"], F.lit(9999)) + 1).cast("string"), 2, "0"), F.lpad((h["r"] % 9999 + 1).cast("string"), 4, "0"))

    return let(feistel(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, F.lit(a), F.lit(b), key, F.lit("ssn")), text)


def _mod_97(text: Column) -> Column:
    """The remainder of the number that digits, and letters from A = 10 on, write."""
    def add(acc: Column, c: Column) -> Column:
        letter = F.call_function("instr", F.lit(UPPER), c)
        return F.when(letter > 0, (acc * 100 + 9 + letter) % 97).otherwise((acc * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97)

    return F.aggregate(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.lit(0), add)


def _is_iban(m: Column) -> Column:
    bare = F.replace(m, F.lit(" "), F.lit(""))
    return m.rlike(rf"^(?:{IBAN})$") & (_mod_97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1)


def _iban(m: Column, key: str) -> Column:
    """The country stays, and the check digits fit."""
    bare = F.replace(m, F.lit(" "), F.lit(""))
    land = F.substring(bare, 1, 2)

    def number(account: Column) -> Column:
        check = F.lpad((98 - _mod_97(F.concat(account, land, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(land, check, account)

    return refill(m, "A-Z0-9", let(enciphered(F.substring(bare, F.lit(5), F.length(bare)), (UPPER, DIGITS), key, F.concat(F.lit("iban"), land)), number))


def _email(m: Column, key: str) -> Column:
    return F.concat(enciphered(F.substring_index(m, "@", 1), (LOWER, UPPER, DIGITS), key, F.lit("email"), fold=True), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> Column:
    """Hexadecimal values stay such; of others, small and capital letters and digits stay such. One of these that
    comes out hexadecimal is permuted again, so it doesn't meet a hexadecimal one."""
    def mixed(value: Column) -> Column:
        return enciphered(value, (LOWER, UPPER, DIGITS), key, F.lit("secret"))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(6)), m, lambda v, i: F.when((i == 1) | v.rlike("^[0-9a-f]+$"), mixed(v)).otherwise(v))
    return F.when(m.rlike("^[0-9a-f]+$"), enciphered(m, (HEX,), key, F.lit("hexadecimal"))).otherwise(walked)


def _piece(text: Column, kind: str | None = None) -> Column:
    return F.struct(text.alias("text"), F.lit(kind).cast("string").alias("kind"))


def _labelled(m: Column, key: str) -> Column:
    return F.array(F.when(m.rlike(r"\d"), _piece(_secret(m, key), "secret")).otherwise(_piece(m)))


def _marked(m: Column, key: str) -> Column:
    return F.array(
        F.when(m.rlike(rf"^(?:{EMAIL})$"), _piece(_email(m, key), "email"))
        .when(m.rlike(rf"^(?:{KEY})$"), _piece(F.concat(F.lit("AKIA"), enciphered(F.substring(m, 5, 16), (DIGITS + UPPER,), key, F.lit("key"))), "key"))
        .otherwise(_piece(_secret(m, key), "secret"))
    )


def _parted(m: Column, key: str) -> Column:
    date = F.when(_as_date(m).isNotNull(), _piece(_date(m, key), "date")).otherwise(_piece(m))
    ssn = F.when(m.rlike(rf"^{SSN}$"), _piece(_ssn(m, key), "ssn")).otherwise(date)
    return F.array(F.when(m.rlike(rf"^{IP}$"), _piece(_ip(m, key), "ip")).when(_is_iban(m), _piece(_iban(m, key), "iban")).otherwise(ssn))


def _phones(m: Column, key: str) -> Column:
    """A leading 0 without a country code takes 9 to 11 digits."""
    short = m.rlike(r"^\(?0[1-9]") & ~F.length(_digits(m)).between(9, 11)
    return F.array(F.when(short, _piece(m)).otherwise(_piece(_phone(m, key), "phone")))


def _cards(m: Column, key: str, usual: bool) -> Column:
    """The pieces of a run of digits: its card numbers and what is between them. Of valid parts that overlap, one that
    begins like an issuer's goes before others, then a longer one, then the first."""
    tokens = F.regexp_extract_all(m, F.lit(r"\d+[ -]?"), F.lit(0))

    def in_tokens(t: Column) -> Column:
        def parts(i: Column) -> Column:
            window = F.array_join(F.slice(t, i, F.lit(CARD_DIGITS[-1] + 1)), "")

            def heads(w: Column) -> Column:
                texts = F.array(*[F.regexp_extract(w, rf"^\d(?:[ -]?\d){{{n - 1}}}(?!\d)", 0) for n in CARD_DIGITS])
                right = F.filter(texts, lambda x: (x != "") & (x.rlike(USUAL) if usual else F.lit(True)) & ~x.rlike("^[0 -]+$") & (luhn_sum(_digits(x)) % 10 == 0))
                return F.transform(right, lambda x: F.struct((~_digits(x).rlike(ISSUER)).cast("int").alias("rank"), (-F.length(_digits(x))).alias("less"), i.alias("at"), F.size(F.split(x, "[ -]")).alias("n"), x.alias("text")))

            return let(window, heads)

        spot, part = (f"array<struct<{x}>>" for x in ("at:int,n:int,text:string", "rank:int,less:int,at:int,n:int,text:string"))

        def settled(met: Column) -> Column:
            """The parts that stay of some that meet, in their order."""
            def take(acc: Column, c: Column) -> Column:
                meets = F.exists(acc, lambda p: (p["at"] < c["at"] + c["n"]) & (c["at"] < p["at"] + p["n"]))
                return F.when(meets, acc).otherwise(F.concat(acc, F.array(F.struct(c["at"].alias("at"), c["n"].alias("n"), c["text"].alias("text")))))

            return F.array_sort(F.aggregate(F.array_sort(met), F.array().cast(spot), take))

        def add(state: Column, c: Column) -> Column:
            """``met`` has the last parts, each of which meets one before; a part behind their end settles them."""
            end = F.greatest(state["end"], c["at"] + c["n"])
            met = F.struct(end.alias("end"), F.concat(state["met"], F.array(c)).alias("met"), state["cards"].alias("cards"))
            new = F.struct(end.alias("end"), F.array(c).alias("met"), F.concat(state["cards"], settled(state["met"])).alias("cards"))
            return F.when(c["at"] < state["end"], met).otherwise(new)

        valid = F.flatten(F.transform(F.sequence(F.lit(1), F.size(t)), parts))
        start = F.struct(F.lit(1).alias("end"), F.array().cast(part).alias("met"), F.array().cast(spot).alias("cards"))
        taken = F.aggregate(valid, start, add, lambda state: F.concat(state["cards"], settled(state["met"])))

        def in_taken(c: Column) -> Column:
            def around(k: Column) -> Column:
                start = F.coalesce(F.get(c, k)["at"], F.size(t) + 1)
                before = F.when(k > 0, F.get(c, k - 1)["at"] + F.get(c, k - 1)["n"]).otherwise(F.lit(1))
                mark = F.when(k > 0, F.regexp_extract(F.get(t, before - 2), "[ -]?$", 0)).otherwise("")
                gap = _piece(F.concat(mark, F.array_join(F.slice(t, before, start - before), "")))
                return F.when(k < F.size(c), F.array(gap, _piece(_card(F.get(c, k)["text"], key), "card"))).otherwise(F.array(gap))

            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(c)), around))

        return let(taken, in_taken)

    return let(tokens, in_tokens)


def _usual_cards(m: Column, key: str) -> Column:
    return _cards(m, key, True)


def _other_cards(m: Column, key: str) -> Column:
    return _cards(m, key, False)


def _scan(pieces: Column, pattern: str, judge, key: str) -> Column:
    """``pieces``, where those without a kind are cut at the finds of a pattern, and ``judge`` gives the pieces of a find."""
    def cut(p: Column) -> Column:
        finds = F.transform(F.regexp_extract_all(p["text"], F.lit(pattern), F.lit(0)), lambda m: judge(m, key))
        parts = F.zip_with(F.split(p["text"], pattern, -1), finds, lambda gap, f: F.concat(F.array(_piece(gap)), F.coalesce(f, F.array().cast(PIECES))))
        return F.when(p["kind"].isNull() & p["text"].rlike(pattern), F.flatten(parts)).otherwise(F.array(p))

    return F.flatten(F.transform(pieces, cut))


def _is(kind: str):
    return lambda f: f["kind"] == kind


def pseudonymise(df: DataFrame, key: str, text: str = "text", counts: str | None = None) -> DataFrame:
    """``df`` with pseudonyms in its text; ``counts`` names a further column, a map from kind to number of values.

    Null and empty texts stay as they are, and so does everything that fails validation. Very long texts are read whole,
    in linear time but for clusters of overlapping card numbers, which take the square of their number. Local parts of
    more than 64 characters, addresses with other letters than ASCII and IPv6 stay readable. Rows are independent of
    each other, so ties, repeated rows, empty tables and further columns need no rule.
    """
    # Only texts with a digit, an @ or a password can hold a candidate.
    some = F.col(text).rlike(r"[0-9@]|(?i:passw(?:or)?d|pwd)")
    name = "_found"
    while name in df.columns:
        name += "_"
    out = df.withColumn(name, F.coalesce(F.when(some, F.array(_piece(F.col(text)))), F.array().cast(PIECES)))
    # One column after the other, as the analyzer goes through one level of lambdas at a time and not through more than a hundred.
    for pattern, judge in ((MARKED, _marked), (LABELLED, _labelled), (PARTED, _parted), (RUN, _usual_cards), (PHONE, _phones), (RUN, _other_cards)):
        out = out.withColumn(name, _scan(F.col(name), pattern, judge, key))
    out = out.withColumn(text, F.when(F.size(name) > 0, F.array_join(F.transform(name, lambda p: p["text"]), "")).otherwise(F.col(text)))
    if counts is not None:
        out = out.withColumn(counts, F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*[F.size(F.filter(name, _is(k))) for k in KINDS])))
    return out.drop(name)
