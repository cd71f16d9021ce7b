"""Messages of many builds, and names of five scripts."""

import pytest

from leadlens.functions.transliteration import latin, table
from leadlens.sources import mail

NESTED = b"""Content-Type: multipart/report; report-type=delivery-status; boundary="o"
Delivered-To: Old@a.example

--o
Content-Type: multipart/alternative; boundary=i

--i
Content-Type: text/plain; charset=iso-8859-1
Content-Transfer-Encoding: quoted-printable

Stra=DFe =40 unknown, see me=40b.example
--i
Content-Type: text/html; charset=no-such
Content-Transfer-Encoding: base64

PGI+c2VlZEBhLmV4YW1wbGU8L2I+
--i--
--o
Content-Type: message/delivery-status

Reporting-MTA: dns; mx

Final-Recipient: rfc822; Gone@c.example
Status: 5.1.1

Final-Recipient: rfc822; full@c.example
Status: 4.2.2

--o
Content-Type: message/rfc822

From: bounce+Tok.1@seed.example
Subject: =?utf-8?q?x?=

hello
--o--
"""


def test_parts(spark):
    rows = spark.createDataFrame([("n", bytearray(NESTED)), ("none", None), ("broken", bytearray(b"Content-Type: multipart/mixed; boundary=x\n\nno boundary \xff"))], "id string, raw binary")
    got = {r["id"]: [] for r in rows.collect()}
    for r in sorted(mail.parts(rows).collect(), key=lambda r: (r["id"], r["part"])):
        got[r["id"]].append((r["depth"], r["kind"], r["text"]))
    assert [(d, k) for d, k, _ in got["n"]] == [(0, "multipart/report"), (1, "multipart/alternative"), (2, "text/plain"), (2, "text/html"), (1, "message/delivery-status"), (2, "text/plain"), (2, "text/plain"), (2, "text/plain"), (1, "message/rfc822"), (2, "text/plain")]
    assert got["n"][2][2].startswith("Straße @ unknown") and got["n"][3][2] == "<b>seed@a.example</b>" and got["n"][9][2].strip() == "hello"
    assert len(got["none"]) == 1 and len(got["broken"]) == 1


def test_reports(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.eml").write_bytes(NESTED)
    found = mail.reports(mail.messages(spark, f"file://{tmp_path}/m"), ("Seed@a.example",))
    r = found.first()
    assert (r["code"], r["reason"], r["hard"], r["tokens"]) == ("5.1.1", None, True, ["tok.1"])
    assert r["recipients"] == ["full@c.example", "gone@c.example", "me@b.example", "old@a.example"]
    assert sorted(map(tuple, mail.suppressed(found.union(found)).collect()))[0] == ("full@c.example", "seed_bounce", "bounce_monitor")
    assert mail.reports(spark.createDataFrame([], "id string, raw binary")).count() == 0


@pytest.mark.parametrize(
    "name, spelt",
    [("Александр Щербаков", "aleksandr shcherbakov"), ("Γεώργιος Παπαδόπουλος", "georgios papadopoulos"), ("Μπάμπης", "babis"), ("გიორგი ბერიძე", "giorgi beridze"), ("김민준", "gimminjun"), ("Łukasz Straße Øre", "lukasz strasse ore"), ("José ﬁ ＡＢ", "jose fi ab"), ("李 Li", " li"), ("Ёлкин Ћ", "elkin c"), ("", "")],
)
def test_latin(name, spelt):
    assert latin(name) == spelt


def test_longest_letters_first():
    assert latin("αυα") == "aua" and max(map(len, table())) == 2
