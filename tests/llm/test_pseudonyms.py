import datetime as dt
import hashlib
import re

import pytest
from llm_rows import docs, rows_of  # noqa: F401

from fleetgauge.llm.pseudonyms import DAYS, ROUNDS, with_pseudonyms

KEY = "test key"


def feistel(places, sizes, kind, key=KEY):
    half = len(places) // 2
    sides, limits = [list(places[:half]), list(places[half:])], [sizes[:half], sizes[half:]]
    for i in range(ROUNDS):
        own, other = i % 2, 1 - i % 2
        said = ",".join(map(str, sides[other]))
        said = hashlib.sha256(said.encode()).hexdigest() if len(sides[other]) > 40 else said
        sides[own] = [(v + int(hashlib.sha256(f"{key}|{kind}|{i}|{j}|{said}".encode()).hexdigest()[:15], 16)) % limits[own][j] for j, v in enumerate(sides[own])]
    return sides[0] + sides[1]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def only(docs, *texts):
    return [r["text"] for r in rows_of(with_pseudonyms(docs(list(enumerate(texts))), KEY))]


def test_like_brute_force(docs):
    got = only(docs, "10.0.0.255", "1999-12-31", "tel 212-555-0123", "c 4539148803436467", "ssn 123-45-6789", "Ab.9@x.org")
    assert got[0] == ".".join(map(str, feistel([10, 0, 0, 255], [256] * 4, "ip")))
    a, b = feistel([*divmod((dt.date(1999, 12, 31) - dt.date(1900, 1, 1)).days, DAYS[1])], list(DAYS), "date")
    assert got[1] == str(dt.date(1900, 1, 1) + dt.timedelta(a * DAYS[1] + b))
    f = feistel([1, 1, 2, 3, 5, 5, 0, 1, 2, 3], [9, 10, 10, 8, *[10] * 6], "phone")
    digits = "".join(str(v + {0: 1, 3: 2}.get(i, 0)) for i, v in enumerate(f))
    assert got[2] == f"tel {digits[:3]}-{digits[3:6]}-{digits[6:]}"
    body = "4" + "".join(map(str, feistel([int(c) for c in "53914880343646"], [10] * 14, "card")))
    assert got[3].startswith("c " + body) and luhn(got[3][2:])
    x, y, z = feistel([122, 44, 6788], [898, 99, 9999], "ssn")
    assert got[4] == f"ssn {x + (2 if x > 664 else 1):03d}-{y + 1:02d}-{z + 1:04d}"
    e = feistel([0, 1, 9], [26, 26, 10], "email")
    assert got[5] == f"{chr(65 + e[0])}{chr(97 + e[1])}.{e[2]}@x.org"


def test_formats_share_a_pseudonym(docs):
    (text,) = only(docs, "+1 (212) 555-0123 212-555-0123 212.555.0123 | 4539 1488 0343 6467 4539148803436467 | 1980-02-29 29.02.1980 2/29/1980")
    phones, cards, dates = text.split(" | ")
    assert len(set(re.findall(r"\d{10}", re.sub(r"[^\d+ ]|(?<=\)) ", "", phones.replace("+1 ", ""))))) == 1
    assert len({cards.replace(" ", "")[:16], cards.replace(" ", "")[16:]}) == 1
    year, day, month = dates.split(" ")
    y, m, d = map(int, year.split("-"))
    assert day == f"{d:02d}.{m:02d}.{y}" and month.split("/")[2] == str(y) and [int(x) for x in month.split("/")[:2]] == [m, d]


def test_octets_are_permuted(docs):
    texts = [f"{a}.0.{b}.7" for a in range(20) for b in range(20)]
    assert len(set(only(docs, *texts))) == 400


@pytest.mark.parametrize(
    "text",
    ["300.1.1.1 1.2.3.4.5 v1.02.3.4", "2021-02-29 1850-01-01 13/13/2000 2020-1/2", "000-12-3456 666-12-3456 900-12-3456 123-00-4567", "4539148803436468 0000000000000000",
     "012-555-0123 and 212-155-0123", "DE89370400440532013001", "992695314 106335957369 2654884", "no numbers @ all", "@x.org a@b", "order 12345678901234567890123"],
)
def test_what_is_not_valid_stays(docs, text):
    assert only(docs, text) == [text]


def test_account_numbers_stay_valid(docs):
    (text,) = only(docs, "GB82WEST12345698765432 and DE89 3704 0044 0532 0130 00")
    for number in text.replace(" ", "").split("and"):
        assert int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1
    assert "GB82WEST12345698765432" not in text and "WEST" in text


def test_odd_rows(docs):
    mail = "bo.7@mail.example.com"
    long_text = f"{mail} " + "filler text, " * 30_000 + mail
    frame = docs([(1, None), (2, ""), (None, mail), (4, mail), (4, mail), (5, long_text), (6, "a" * 50_000 + "@")])
    got = rows_of(with_pseudonyms(frame, KEY))
    assert [r["n_values"] for r in got] == [0, 0, 1, 1, 2, 0, 1] and got[0]["text"] is None and got[1]["text"] == ""
    same = {r["text"] for r in got if r["n_values"] == 1}
    (new,) = same
    assert new != mail and got[4]["text"] == long_text.replace(mail, new)
    assert got[2]["values"] == [{"kind": "email", "pseudonym": new}]
    assert rows_of(with_pseudonyms(docs([]), KEY)) == []
    assert rows_of(with_pseudonyms(frame, "another"))[2]["text"] != new


def test_stays_in_the_jvm(docs):
    plan = with_pseudonyms(docs([(1, "x")]), KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_values_of_single_digits(docs):
    """No two digits side by side and no @."""
    alone = only(docs, "ask 8.8.8.8 first", "ask 8.8.8.8 first, 12 times", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1")
    new = ".".join(map(str, feistel([8] * 4, [256] * 4, "ip")))
    assert alone[:2] == [f"ask {new} first", f"ask {new} first, 12 times"]
    assert alone[2] != "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1" and luhn(alone[2].replace(" ", ""))


CARD, AMEX, IBAN = "4111 1111 1111 1111", "3782 822463 10005", "AT61 1904 3002 3473 2021"


BESIDE = [
    (f"{CARD} 12/27", [CARD]), (f"{CARD} 124", [CARD]), (f"{CARD}-124 x", [CARD]), (f"5 {CARD}", [CARD]), (f"12-{CARD}", [CARD]), (f"{AMEX} {AMEX}.", [AMEX, AMEX]),
    (f"{CARD} 01/02/2020", [CARD, "01/02/2020"]), (f"{IBAN} BIC", [IBAN]), (f"{IBAN} BICCODEX", [IBAN]), (f"DE12 {IBAN}", [IBAN]),
    (f"+44 20 7946 0958 2021 {CARD}", ["+44 20 7946 0958", CARD]), ("4539148803436468@x.org", ["4539148803436468@x.org"]), (f"\x1a!\x1a;{CARD} 12/27\x1a:", [CARD]),
    ("8.8.8.8, " * 1000, ["8.8.8.8"] * 1000),
]


def test_values_beside_short_tokens(docs):
    values = sorted({v for _, some in BESIDE for v in some})
    got = only(docs, *values, *(text for text, _ in BESIDE))
    new = dict(zip(values, got))
    assert all(a != b for a, b in new.items())
    for (text, some), shown in zip(BESIDE, got[len(values):]):
        want, rest = "", text
        for v in some:
            before, rest = rest.split(v, 1)
            want += before + new[v]
        assert shown == want + rest


def test_long_values(docs):
    """Work grows with the length of a value: names of 50,000 letters, and numbers of 5000 groups, take seconds."""
    names = ["ab1" * 40, "a" * 300, "a" * 50_000, "x.Y-" * 10_000 + "z"]
    got = only(docs, *(f"to {n}@x.com now" for n in names), "+44" + " 1234" * 5000, "1234 " * 20_000, "4111 " * 5000)
    for name, text in zip(names, got):
        assert len(text) == len(name) + 13 and text.startswith("to ") and text.endswith("@x.com now")
        shown = text[3:-10]
        assert [c.isalpha() for c in shown] == [c.isalpha() for c in name] and [c.isupper() for c in shown] == [c.isupper() for c in name]
        plain = [c for c in name.lower() if c.isalnum()]
        places = feistel([ord(c) - (97 if c.isalpha() else 48) for c in plain], [26 if c.isalpha() else 10 for c in plain], "email")
        assert [c for c in shown.lower() if c.isalnum()] == [chr(v + (97 if c.isalpha() else 48)) for v, c in zip(places, plain)]
