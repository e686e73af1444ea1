"""Personal numbers, dates and addresses replaced by keyed pseudonyms of the same format.

A value is a list of places, each with its own number of symbols: a digit has ten, a letter 26, an
octet 256, a day its share of two centuries. A Feistel network cuts the list in two and, round by
round, shifts each place of one half by a keyed hash of the other, so that it permutes the values of a
format: equal values stay equal in all documents, different ones different. Values are first validated
(check digits, ranges, calendar); what is no valid value stays as it is.

Not looked for, and so left in clear: names, postal addresses, IPv6, dates before 1900 or after 2099, dates with
the month in words, numbers from abroad that are written with 00 in place of the plus sign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

#: The shapes that are looked for, in the order in which they are tried at one place.
SHAPES = {
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d-]|[./]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d|-\d)",
    "abroad": r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w.-])(?:\d[ -]?){12,18}\d(?![\w]|[.-]\d)",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
}


#: A card that begins behind a dash, up to six digits into a run of digits that is no card as a whole.
LATER = r"(?<=(?<![\w.-])\d[\d-]{0,7}-)(?:\d[ -]?){12,18}\d(?![\w]|[.-]\d)"


def _starts() -> tuple[str, list[int]]:
    """A pattern of no width, found wherever a shape begins, and the number of its group for each shape and for LATER."""
    shapes, groups, out = [*SHAPES.values(), LATER], 0, []

    def counted(shape):
        nonlocal groups
        own = shape.count("([-/.])")
        for k in range(own, 0, -1):
            shape = shape.replace(rf"\{k}", rf"\{k + groups}")
        groups += own
        return shape

    pattern = "(?=" + "|".join(map(counted, shapes)) + ")"
    for shape in shapes:
        groups += 1
        out.append(groups)
        pattern += f"(?=({counted(shape)})?)"
    return pattern, out


STARTS, GROUPS = _starts()
#: What every shape holds; texts without it are not searched.
SIGN = r"\d[ .-]?\d|\+\d|@"
#: Begins the marks put into a text; where a text has it already, it is followed by "!" meanwhile.
MARK = "\x1a"
#: Places that are woven together at a time.
TOGETHER = 64
#: Values of a half that are hashed as they are; of more, the digest.
SPELT = 40
#: Days from the first of January 1900 to the end of 2099: 17 * 4297.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def _named(value: Column, use) -> Column:
    """`use(value)`, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _noise(key: str, kind: str, turn: Column, place: Column, said: Column) -> Column:
    text = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), place.cast("string"), said)
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _said(half: Column) -> Column:
    """What a round hashes of the other half: its values, or their digest where they are many."""
    joined = F.array_join(F.transform(half, lambda v: v.cast("string")), ",")
    return F.when(F.size(half) > SPELT, F.sha2(joined, 256)).otherwise(joined)


def feistel(places: Column, sizes: Column, key: str, kind: str) -> Column:
    """Permutes lists of longs, place i below sizes[i]; a list of one place is shifted by a constant.

    The work grows with the number of places: halves, sizes and what is hashed of the other half are computed
    once a round.
    """
    def halved(values):
        half = F.floor(F.size(values) / 2).cast("int")
        return F.struct(F.slice(values, 1, half).alias("l"), F.slice(values, half + 1, F.size(values) - half).alias("r"))

    def rounds(limits):
        def turn(s, i):
            def moved(own, other, own_sizes):
                return _named(_said(other), lambda said: F.transform(own, lambda v, j: F.pmod(v + _noise(key, kind, i, j, said), F.get(own_sizes, j))))

            return F.when(i % 2 == 0, F.struct(moved(s["l"], s["r"], limits["l"]).alias("l"), s["r"].alias("r"))).otherwise(
                F.struct(s["l"].alias("l"), moved(s["r"], s["l"], limits["r"]).alias("r"))
            )

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halved(places), turn, lambda s: F.concat(s["l"], s["r"]))

    return _named(halved(sizes), rounds)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _longs(text: Column) -> Column:
    return F.transform(_chars(text), lambda c: c.cast("long"))


def _filled(shape: Column, new: Column, mark: str) -> Column:
    """The characters of `shape` that match `mark` replaced, in turn, by those of the string `new`."""
    def put(chars):
        marked = F.filter(chars, lambda c: c["hit"])
        fresh = F.zip_with(marked, _chars(new), lambda c, n: F.struct(c["at"], F.when(c["char"].rlike("^[A-Z]$"), F.upper(n)).otherwise(n).alias("char")))
        rest = F.transform(F.filter(chars, lambda c: ~c["hit"]), lambda c: F.struct(c["at"], c["char"]))
        return F.array_join(F.transform(F.array_sort(F.concat(fresh, rest)), lambda c: c["char"]), "")

    placed = F.transform(_chars(shape), lambda c, i: F.struct(i.alias("at"), c.alias("char"), c.rlike(f"^[{mark}]$").alias("hit")))
    return _named(placed, put)


def _joined(places: Column) -> Column:
    return F.array_join(F.transform(places, lambda v: v.cast("string")), "")


def _tens(digits: Column) -> Column:
    return F.transform(_chars(digits), lambda c: F.lit(10).cast("long"))


def _permuted_digits(digits: Column, key: str, kind: str) -> Column:
    return _joined(feistel(_longs(digits), _tens(digits), key, kind))


def _luhn_digit(body: Column) -> Column:
    """The digit that makes `body` and it pass the Luhn test."""
    def add(s, i):
        d = F.substring(body, F.length(body) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return s + F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(body) - 1), F.lit(0), add)
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def _card(match: Column, key: str) -> Column:
    def of(d):
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        valid = (F.length(d).between(13, 19)) & (_luhn_digit(body) == F.right(d, F.lit(1))) & ~d.rlike(r"^(\d)\1*$")
        first = F.substring(d, 1, 1)
        fresh = F.concat(first, _permuted_digits(F.substring(body, F.lit(2), F.length(body)), key, "card"))
        return F.when(valid, _named(fresh, lambda b: _filled(match, F.concat(b, _luhn_digit(b)), "0-9")))

    return _named(_digits(match), of)


def _ip(match: Column, key: str) -> Column:
    octets = F.transform(F.split(match, r"\."), lambda o: o.cast("long"))
    valid = F.forall(octets, lambda o: o < 256) & ~match.rlike(r"(^|\.)0\d")
    return F.when(valid, F.array_join(F.transform(feistel(octets, F.array_repeat(F.lit(256).cast("long"), 4), key, "ip"), lambda o: o.cast("string")), "."))


def _ssn(match: Column, key: str) -> Column:
    def of(p):
        area = p[0] - F.when(p[0] > 666, 2).otherwise(1)
        valid = p[0].between(1, 899) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0)
        sizes = F.array(*(F.lit(n).cast("long") for n in (898, 99, 9999)))
        fresh = feistel(F.array(area, p[1] - 1, p[2] - 1), sizes, key, "ssn")
        return F.when(valid, _named(fresh, lambda f: F.format_string("%03d-%02d-%04d", f[0] + F.when(f[0] > 664, 2).otherwise(1), f[1] + 1, f[2] + 1)))

    return _named(F.transform(F.split(match, "-"), lambda x: x.cast("long")), of)


def _phone(match: Column, key: str) -> Column:
    """Ten digits, with or without the leading 1: an area that doesn't begin with 0, an office from 200 on.

    Areas below 200 are not given out, but numbers written like this are taken for numbers all the same.
    """
    def of(d):
        valid = d.rlike(r"^[1-9]\d{2}[2-9]\d{6}$")
        sizes = F.array(*(F.lit({0: 9, 3: 8}.get(i, 10)).cast("long") for i in range(10)))
        shift = lambda i: F.when(i == 0, 1).when(i == 3, 2).otherwise(0)
        places = F.transform(_longs(d), lambda v, i: v - shift(i))
        fresh = F.transform(feistel(places, sizes, key, "phone"), lambda v, i: v + shift(i))
        lead = F.when(F.length(_digits(match)) == 11, "1").otherwise("")
        return F.when(valid, _filled(match, F.concat(lead, _joined(fresh)), "0-9"))

    return _named(F.right(_digits(match), F.lit(10)), of)


def _abroad(match: Column, key: str) -> Column:
    """Any other international number of 8 to 15 digits: the first two, with the country, stay."""
    def of(d):
        tail = F.substring(d, F.lit(3), F.length(d))
        fresh = F.concat(F.substring(d, 1, 2), _permuted_digits(tail, key, "abroad"))
        return F.when(F.length(d).between(8, 15), _filled(match, fresh, "0-9"))

    return _named(_digits(match), of)


def _mod_97(text: Column) -> Column:
    """Of an account number, letters read as 10 to 35."""
    def add(s, c):
        value = F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (s * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(_chars(text), F.lit(0), add)


def _iban(match: Column, key: str) -> Column:
    def of(t):
        country, body = F.substring(t, 1, 2), F.substring(t, F.lit(5), F.length(t))
        valid = F.length(t).between(15, 34) & (_mod_97(F.concat(body, F.substring(t, 1, 4))) == 1)

        def with_check(b):
            check = F.lpad((98 - _mod_97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
            return _filled(match, F.concat(country, check, b), "A-Z0-9")

        fresh = _filled(body, _permuted_digits(_digits(body), key, "iban"), "0-9")
        return F.when(valid, _named(fresh, with_check))

    return _named(F.replace(match, F.lit(" "), F.lit("")), of)


def _date(match: Column, key: str) -> Column:
    """Year first; or day first where dots part it or the month would be above 12, else month first."""
    def of(p):
        year_first = F.length(p[0]) == 4
        first_is_day = match.contains(".") | (p[0].cast("int") > 12)
        year = F.when(year_first, p[0]).otherwise(p[2])
        month = F.when(year_first | first_is_day, p[1]).otherwise(p[0])
        day = F.when(year_first, p[2]).otherwise(F.when(first_is_day, p[0]).otherwise(p[1]))
        found = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")

        def moved(n):
            sizes = F.array(*(F.lit(x).cast("long") for x in DAYS))
            fresh = feistel(F.array(F.floor(n / DAYS[1]), n % DAYS[1]), sizes, key, "date")
            return _named(F.date_add(F.lit(FIRST_DAY).cast("date"), (F.element_at(fresh, 1) * DAYS[1] + F.element_at(fresh, 2)).cast("int")), written)

        def written(d):
            mark = F.regexp_extract(match, r"[-/.]", 0)
            pad = lambda x, like: F.lpad(x.cast("string"), F.greatest(F.length(like), F.length(x.cast("string"))), "0")
            y = F.lpad(F.year(d).cast("string"), 4, "0")
            a = F.when(year_first, y).otherwise(pad(F.when(first_is_day, F.day(d)).otherwise(F.month(d)), p[0]))
            b = pad(F.when(year_first | first_is_day, F.month(d)).otherwise(F.day(d)), p[1])
            c = F.when(year_first, pad(F.day(d), p[2])).otherwise(y)
            return F.concat(a, mark, b, mark, c)

        inside = found.between(F.lit(FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date"))
        return F.when(inside, _named(F.datediff(found, F.lit(FIRST_DAY).cast("date")).cast("long"), moved))

    return _named(F.split(match, r"[-/.]"), of)


def _email(match: Column, key: str) -> Column:
    """Letters and digits before the @ are permuted, whatever their case; the domain stays."""
    def of(name):
        plain = F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))
        letter = lambda c: c.rlike("^[a-z]$")

        def by_char(chars):
            places = F.transform(chars, lambda c: F.when(letter(c), F.ascii(c) - 97).otherwise(F.ascii(c) - 48).cast("long"))
            sizes = F.transform(chars, lambda c: F.when(letter(c), 26).otherwise(10).cast("long"))
            fresh = feistel(places, sizes, key, "email")
            shown = F.zip_with(fresh, chars, lambda v, c: F.when(letter(c), F.char(v + 97)).otherwise(v.cast("string")))
            return F.concat(_filled(name, F.array_join(shown, ""), "A-Za-z0-9"), F.lit("@"), F.substring_index(match, "@", -1))

        return F.when(plain != "", _named(_chars(plain), by_char))

    return _named(F.substring_index(match, "@", 1), of)


WAYS = {"ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "abroad": _abroad, "iban": _iban, "card": _card, "email": _email}


#: What may part a value from a short token behind it, for shapes that would take both, and the symbols of a value.
PARTED = {"abroad": ("[ .-]", "[^0-9]", 8, 15), "iban": (" ", " ", 15, 34), "card": ("[ -]", "[^0-9]", 13, 19)}


def _forms(kind: str, match: Column) -> Column:
    """The match, and what remains of it when its last groups are taken off one by one, if not too short or too long."""
    if kind not in PARTED:
        return F.array(match)
    parted, other, least, most = PARTED[kind]
    ends = F.filter(F.sequence(F.length(match), F.lit(1), F.lit(-1)), lambda p: F.substring(match, p + 1, F.lit(1)).rlike(f"^(?:{parted}|)$"))
    forms = F.transform(ends, lambda p: F.substring(match, F.lit(1), p))
    return F.filter(forms, lambda f: F.length(F.regexp_replace(f, other, "")).between(least, most))


def _candidates(caps: Column) -> Column:
    """(kind, form) of what may be a value at one place: kinds in their order, forms from the longest.

    A card that is not all of its match, or not the first shape of its place, is parted by blanks alone or
    by dashes alone.
    """
    out = []
    for i, kind in enumerate(WAYS):
        match, fits = F.get(caps, i), lambda f: F.lit(True)
        if kind == "card":
            alone = (F.array_join(F.slice(caps, 1, i), "") == "") & (match != "")
            whole, match = match, F.when(match != "", match).otherwise(F.get(caps, len(WAYS)))
            fits = lambda f: (alone & (f == whole)) | ~(f.contains(" ") & f.contains("-"))
        forms = F.filter(_forms(kind, match), fits) if kind == "card" else _forms(kind, match)
        some = F.transform(forms, lambda f: F.struct(F.lit(kind).alias("kind"), f.alias("form")))  # noqa: B023
        out.append(F.when(match != "", some).otherwise(F.array().cast("array<struct<kind:string,form:string>>")))
    return F.concat(*out)


def _answer(kind: Column, form: Column, key: str) -> Column:
    """The pseudonym of a value; null where it is not valid."""
    out = None
    for k, way in WAYS.items():
        out = F.when(kind == k, way(form, key)) if out is None else out.when(kind == k, way(form, key))
    return out


def _woven(places: Column) -> Column:
    """(text, values) of the text from the first place on; a place has the text to the next and its value, if any."""
    pairs = "array<struct<kind:string,pseudonym:string>>"

    # What begins inside a value that was replaced is part of it.
    def put(state, place):
        body, free = place["body"], state["inside"] <= 0
        new = free & place["value"].isNotNull()
        inside = F.when(new, place["value"]["n"]).otherwise(state["inside"])
        rest = F.substring(body, F.greatest(inside, F.lit(0)) + 1, F.length(body))
        return F.struct(
            (inside - F.length(body)).alias("inside"),
            F.concat(state["text"], F.array(F.when(new, F.concat(place["value"]["pseudonym"], rest)).otherwise(rest))).alias("text"),
            F.when(new, F.concat(state["values"], F.array(F.struct(place["value"]["kind"], place["value"]["pseudonym"])))).otherwise(state["values"]).alias("values"),
        )

    # Some places at a time, so that lists that grow by every place stay short.
    def some(state, first):
        begin = F.struct(state["inside"].alias("inside"), F.array().cast("array<string>").alias("text"), F.array().cast(pairs).alias("values"))
        return F.aggregate(F.slice(places, first, F.lit(TOGETHER)), begin, put, lambda s: F.struct(
            s["inside"].alias("inside"), F.concat(state["text"], F.array(F.array_join(s["text"], ""))).alias("text"),
            F.concat(state["values"], F.array(s["values"])).alias("values"),
        ))

    start = F.struct(F.lit(0).alias("inside"), F.array().cast("array<string>").alias("text"), F.array().cast(f"array<{pairs}>").alias("values"))
    firsts = F.sequence(F.lit(1), F.size(places), F.lit(TOGETHER))
    return F.aggregate(firsts, start, some, lambda s: F.struct(F.array_join(s["text"], "").alias("text"), F.flatten(s["values"]).alias("values")))


def _once(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once: a generator keeps it from being put in wherever it is used."""
    return frame.select("*", F.explode(F.array(value)).alias(name))


def with_pseudonyms(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, text with all valid values replaced, n_values, and `values` in order.

    Values are looked for wherever a shape begins, also within one that was no valid value and behind the
    end of a shorter one that was. `values` holds (kind, pseudonym), never what stood there before. A null
    text stays null, with no values. Texts are read whole. Null ids and repeated rows are rows like others;
    an empty table gives no rows. Whoever has the key can link a value to its pseudonym: keep it apart from
    the data.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shown = MARK + ";" + (MARK + ":").join(f"${g}" for g in GROUPS) + MARK + ";"
    marked = F.regexp_replace(F.replace("text", F.lit(MARK), F.lit(MARK + "!")), F.lit(STARTS), F.lit(shown))
    # The text to the first place, then in turn the shapes of a place and the text to the next.
    parts = _once(rows, "parts", F.when(F.col("text").rlike(SIGN), F.split(marked, MARK + ";", -1)))
    odd = F.when(F.size("parts") > 1, F.sequence(F.lit(1), F.size("parts") - 2, F.lit(2)))
    tried = _once(parts, "tried", F.transform(odd, lambda i: _named(F.split(F.get("parts", i), MARK + ":", -1), _candidates)))

    def first_valid(forms):
        answers = F.transform(forms, lambda c: F.struct(c["kind"].alias("kind"), _answer(c["kind"], c["form"], key).alias("pseudonym"), F.length(c["form"]).alias("n")))
        return F.get(F.filter(answers, lambda a: a["pseudonym"].isNotNull()), F.lit(0))

    answered = _once(tried, "answers", F.transform("tried", first_valid))
    places = _once(answered, "places", F.transform("answers", lambda a, i: F.struct(F.get("parts", 2 * i + 2).alias("body"), a.alias("value"))))
    woven = _once(places, "woven", F.when(F.col("places").isNotNull(), _woven(F.col("places"))))
    whole = F.replace(F.concat(F.get("parts", F.lit(0)), "woven.text"), F.lit(MARK + "!"), F.lit(MARK))
    return (
        woven.select("doc_id", F.when(F.size("woven.values") > 0, whole).otherwise(F.col("text")).alias("text"),
                     F.coalesce("woven.values", F.array().cast("array<struct<kind:string,pseudonym:string>>")).alias("values"))
        .select("doc_id", "text", F.size("values").cast("long").alias("n_values"), "values")
    )
