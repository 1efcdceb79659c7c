import hashlib
import random
import re

from placelink.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(9)
    parts = ["1", "2", "25", "4", "0", ".", ".", "@", "a", "b", " ", "-", "+", "(", ")", "é", "http://", "4242424242424242", "x@y.z", "٣", "IBAN "]
    for _ in range(8_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert [s for s in pii.find(text) if s[0] in pii.BASE] == plain(text), repr(text)


def test_more_kinds():
    text = "see https://u:p@host.example.org/a?b=1), IBAN: GB82 WEST 1234 5698 7654 32, ssn 123-45-6789, account no: 12345678, accounts 5"
    got = {k: text[a:b] for k, a, b in pii.find(text)}
    assert got["url"] == "https://u:p@host.example.org/a?b=1" and got["iban"] == "GB82 WEST 1234 5698 7654 32"
    assert got["ssn"] == "123-45-6789" and got["account"] == "12345678"
    assert pii.find("IBAN GB82 WEST 1234 5698 7654 33 ssn 000-12-1234") == []
    assert pii.redact("mail a@b.cd now") == "mail <email> now"


def test_cues_in_any_case_and_secrets():
    text = "IbAN GB82WEST12345698765432; Token = \"f3ef4d6b2755a36d\" client_secret: 'Abc-123456789' API-Key=0123456789abcdef Authorization: Bearer abcdef0123456789.x"
    got = [(k, text[a:b]) for k, a, b in pii.find(text)]
    assert got == [("iban", "GB82WEST12345698765432"), ("secret", "f3ef4d6b2755a36d"), ("secret", "Abc-123456789"), ("secret", "0123456789abcdef"), ("secret", "abcdef0123456789.x")]
    assert pii.find("the secret of understanding tokens 123456789012 and a password: correcthorsebattery") == []
    assert pii.find("İİİ token=abcdefgh1234") == [("secret", 10, 22)]


def test_spans_of_two_kinds_at_one_start_stand_in_order():
    text = "account 12345678901234567 token: 4242424242424242a ssn 123-45-6789"
    found = pii.find(text)
    assert found == sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0]))) and {"account", "secret", "ssn"} <= {k for k, _, _ in found}
    tied = pii.find("account 4242424242424242")
    assert [(k, a) for k, a, _ in tied] == [("card", 8), ("account", 8)]


def test_report(spark):
    rows = [(1, "é a@b.cd 10.0.0.1", "x"), (2, None, "y"), (3, "", None), (None, "+1 (706) 555-3138", "z"), (1, "é a@b.cd 10.0.0.1", "x"), (4, "9" * 200_000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in pii.report(df).collect()}
    assert got == {(1, 1, 1, 0, 0, "email:2:8,ip:9:17"), (2, 0, 0, 0, 0, ""), (3, 0, 0, 0, 0, ""), (None, 0, 0, 0, 1, "phone:0:17"), (4, 0, 0, 0, 0, "")}
    first = pii.report(df).where("doc_id = 1").collect()
    assert len(first) == 2 and first[0].base_sha256 == hashlib.sha256(b"email:2:8,ip:9:17").hexdigest()
    assert pii.report(df.limit(0)).count() == 0
