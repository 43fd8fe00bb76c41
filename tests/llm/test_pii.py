import pytest

from recolta.llm import pii as P

CASES = [
    ("write to jane.doe+x@mail.example.org now", {"email"}), ("a_b (at) example [dot] com", {"email"}), ("cc SPELL@EXAMPLE.ORG", {"email"}), ("martin07＠example．com", {"email"}),
    ("Please call (212) 555-0181 before noon.", {"phone"}), ("Text me on +17205550193", {"phone"}), ("01.99.00.60.18", {"phone"}), ("llama al 400 000 106", {"phone"}), ("0049/30/23125253", {"phone"}), ("+44 (0)117 496 0831", {"phone"}),
    ("My SSN 000-26-4898", {"id_number"}), ("Reisepass-Nr. F52027253, bitte", {"id_number"}), ("DNI: 32.951.376-U", {"id_number"}), ("NI number QQ 54 35 25 B", {"id_number"}), ("carte d'identité 879974741884", {"id_number"}), ("passport no. C98146527", {"id_number"}), ("My 987-65-4373 is on it", {"id_number"}),
    ("moved to 141 Elder Court, Flat 23, Mardorf", {"address"}), ("geht an Kirchstr. 3a, 00515 Ober", {"address"}), ("8 rue des Tilleuls, Wes", {"address"}), ("Calle Mayor, 5, Solmar", {"address"}), ("Via Roma 12", {"address"}), ("Kerkstraat 8", {"address"}),
    ("I met Dr. Tina F. Lorvholt-Tolv there", {"name"}), ("business card of Galddahl, Laura", {"name"}), ("form says: thomas sorvvik / x", {"name"}), ("M​arco Fennin​ck called", {"name"}),
]
NONE = ["", None, "Shout out to @sega64 and #sega64", "Order no. 5803-2562 finally shipped.", "Tracking code 7024291640242 has not moved", "ISBN 979-0-4150-1485-17", "The build number is 8112.3357.12", "Set the port to 9270 and 8394 ms", "Invoice 8113/6374 is paid, 30,60 euro.", "Main Street was closed again", "We counted 38482637 rows", "Martin Desk 2 opens", "Request ID: 797663300", "frank words and linda casa", "Moved 53 files in 15 minutes", "on 12.05.2026 at 18:17"]


@pytest.mark.parametrize(("text", "kinds"), CASES)
def test_found(text, kinds):
    assert {f.kind for f in P.find(text)} == kinds


def test_not_found():
    assert [t for t in NONE if P.find(t)] == []


def test_checksums():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")
    assert P.iban_valid("DE89 3704 0044 0532 0130 00") and not P.iban_valid("DE88 3704 0044 0532 0130 00")
    assert P.spanish_valid("12345678Z") and not P.spanish_valid("12345678A")
    assert {f.kind for f in P.find("pay with 4111 1111 1111 1111 or DE89370400440532013000")} == {"card", "iban"}


def test_redaction_keeps_the_rest():
    text = "Hé, Ｔｉｎａ Lor​vholt: é +1 415 555 0164!"
    assert P.redact(text, P.find(text)) == "Hé, [NAME]: é [PHONE]!"


def test_frame(spark):
    rows = [("1", "mail a@b.example", ["a cat", "call +1 415 555 0164", None], "x"), ("1", "mail a@b.example", None, "x"), ("2", None, [], "x"), ("3", "", [""], "x"), (None, "word " * 20000 + "a@b.example", ["a@b.example", "a@b.example"], None)]
    df = spark.createDataFrame(rows, "id string, text_content string, image_captions array<string>, field string")
    got = sorted((r.id or "~", r.field, r.position, r.pii_type) for r in P.findings(df, "id", ["text_content", "image_captions"]).collect())
    assert got.count(("1", "text_content", None, "email")) == 2 and ("1", "image_captions", 1, "phone") in got and got.count(("~", "image_captions", 0, "email")) == got.count(("~", "image_captions", 1, "email")) == 1 and len(got) == 6
    clean = [tuple(r) for r in P.redacted(df, "id", ["text_content", "image_captions"]).collect()]
    assert clean[0] == ("1", "mail [EMAIL]", ["a cat", "call [PHONE]", None]) and clean[2] == ("2", None, []) and clean[4][1].endswith("word [EMAIL]") and len(clean) == 5
    assert P.findings(df.limit(0), "id", ["text_content"]).count() == 0
