"""Problem 1: forms of each kind, look-alikes, and the round trip of replacing."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomlog.llm import pii
from tests.conftest import TESTDATA

D = pii.Detector(["talvik", "brenna", "mirabeth"], ["lindemar", "ashgrove-linn", "castrovel"])


def found(s):
    return [(k, s[a:b]) for k, a, b in D.text(s)]


def starts(s):
    return [(k, a) for k, a, _ in D.text(s)]


@pytest.mark.parametrize(
    "text,exp",
    [
        ("mail odrin+hook@dev.example.net now", ("email", "odrin+hook@dev.example.net")),
        ("to ODRIN_X@EXAMPLE.COM.", ("email", "ODRIN_X@EXAMPLE.COM")),
        ("x bszalavin at ops dot test y", ("email", "bszalavin at ops dot test")),
        ("連絡先は elowen dot grantley-voss at dev dot example dot net です", ("email", "elowen dot grantley-voss at dev dot example dot net")),
        ("a odrin(at)lab(dot)test b", ("email", "odrin(at)lab(dot)test")),
        ("a odrin [at] mail.example.org b", ("email", "odrin [at] mail.example.org")),
        ("a odrin＠mail.example.org b", ("email", "odrin＠mail.example.org")),
        *[(f"call {p} now", ("phone", p)) for p in ["+1 (212) 555-0188", "415.555.0141", "0491-570-445", "+33 1 99 00 57 77", "01.99.00.53.29", "+61 491 570 799", "+44 20 7946 0827", "001 206 555 0171", "030/23125466", "+49 30 23125 340", "07700 900 069", "+447700900621", "(646) 555-0130", "＋１ ２０６ ５５５ ０１５４", "+1-503-555-0199 ext. 566"]],
        *[(f"has SSN {n} in", ("idnum", n)) for n in ["944-21-5267", "944 21 5267", "944215267", "QQ 27 90 94 B", "QQ268754C", "99645747-H", "99404836D", "ZZ1064110", "zz 8057482"]],
        ("id no. 937263678 x", ("idnum", "937263678")),
        ("live at Apt 2, 341 Oakhaven Drive, Vaubriel, so", ("address", "Apt 2, 341 Oakhaven Drive, Vaubriel")),
        ("at 97 Oakhaven Rd please", ("address", "97 Oakhaven Rd")),
        ("at 313A Pinder Drive, Ludhaven 00314 is", ("address", "313A Pinder Drive, Ludhaven 00314")),
        ("at Birkenring 287, so", ("address", "Birkenring 287")),
        ("at Seestr. 217 ok", ("address", "Seestr. 217")),
        ("at 18 rue des Sarments, 00701 Vaubriel please", ("address", "18 rue des Sarments, 00701 Vaubriel")),
        ("at Calle Tormenal 387, 8º A, 00814 Pontefell.", ("address", "Calle Tormenal 387, 8º A, 00814 Pontefell")),
        ("Owner: Xan Ypsilon; address", ("name", "Xan Ypsilon")),
        ("Maintainer: Ypsilon, Xan", ("name", "Ypsilon, Xan")),
        ('owner = "x. ypsilon"', ("name", "x. ypsilon")),
        ("Dr. Xan E. Ypsilon reported it", ("name", "Xan E. Ypsilon")),
        ("so talvik lindemar said", ("name", "talvik lindemar")),
        ("by Brenna Ashgrove-Linn today", ("name", "Brenna Ashgrove-Linn")),
    ],
)
def test_found(text, exp):
    assert found(text) == [exp]


@pytest.mark.parametrize("text", ["git@code.example:team/ember.git", "left-rail@1.3.684", "@app.route moved", "mail the digest at 8 dot 30 at night", "offset 998098012 is past", "Job 202601-306-44 is green", "ticket 4471-4810", "elapsed 555.0243 ms over 243 rows", "the 12 Factor Road map file", "Sync Street is only the codename of step 2", "80575937-efe8-91c9-aa57-1da5abcc90bb", "toolu_d10e2f3dd4ec855cdb98cc1c", "", "look at config.toml", "Nightly Build"])
def test_not_found(text):
    assert found(text) == []


@pytest.mark.parametrize(
    "cwd,exp",
    [
        ("/home/talvik.lindemar/work/x", [("name", "talvik.lindemar")]), ("C:\\Users\\Brenna Castrovel\\src", [("name", "Brenna Castrovel")]), ("/mnt/c/Users/Xan%20Ypsilon/repos", [("name", "Xan%20Ypsilon")]), ("/Users/mirabethcastrovel/dev", [("name", "mirabethcastrovel")]),
        ("file:///home/brenna-lindemar/x", [("name", "brenna-lindemar")]), ("/mnt/share/Castrovel_Brenna/x", [("name", "Castrovel_Brenna")]), ("/data/cases/910-05-6243/x", [("idnum", "910-05-6243")]), ("/srv/mail/nerys@example.net/x", [("email", "nerys@example.net")]),
        ("/home/ubuntu/x", []), ("/home/dev/amber-board", []), ("/Users/runner/work/x", []), ("C:\\Users\\build\\src", []), ("/work/amber-board", []), ("/root/x", []), ("", []),
    ],
)
def test_folders(cwd, exp):
    assert [(k, cwd[a:b]) for k, a, b in D.folder(cwd)] == exp


def test_long_texts_end():
    for s in ("a" * 300_000, "A " * 100_000, "1 " * 100_000, "('" * 50_000, "a.b@" * 50_000, "Brenna " * 30_000, "x at " * 40_000, "12 Aa " * 40_000):
        D.text(s)
    assert found("x " * 100_000 + "call 415.555.0141")[-1] == ("phone", "415.555.0141")


def test_digits_are_a_permutation():
    seen = {pii.digits(b"k", "phone", f"{i:04d}") for i in range(10_000)}
    assert len(seen) == 10_000 and pii.digits(b"k", "phone", "0042") != pii.digits(b"q", "phone", "0042")


def test_distinct_entities_get_distinct_surrogates_none_of_the_data(spark, monkeypatch):
    cs, hints = spark.read.parquet(f"{TESTDATA}/claude_session.parquet"), spark.read.parquet(f"{TESTDATA}/name_hints.parquet")
    rows = pii.entities(cs, hints, "k").select("pii_kind", "entity", "surrogate").distinct().collect()
    assert len({(r[0], r[1]) for r in rows}) == len({(r[0], r[2]) for r in rows}) == len(rows) > 20
    assert not {(r[0], r[1]) for r in rows} & {(r[0], pii.canonical(r[0], r[2])) for r in rows}
    # Numbers of three digits of which a half is in the data: every round leaves some open, the last gets a number worked in.
    few = spark.createDataFrame([("phone", str(i), "") for i in range(100, 1000, 2)] + [("name", "a b", g) for g in "fm"], "pii_kind string, entity string, gender string")
    monkeypatch.setattr(pii, "ROUNDS", 3)
    out = [tuple(r) for r in pii.assign(few, "k").collect()]
    assert len(out) == 451 == len({(k, s) for k, _, s in out}) and not {(k, s) for k, _, s in out} & {(k, e) for k, e, _ in out}
    assert any("-" in s for _, _, s in out)


@pytest.mark.parametrize("key", [None, ""])
def test_no_key_no_surrogates(spark, key):
    with pytest.raises(ValueError):
        pii.assign(spark.createDataFrame([("name", "a b", "")], "pii_kind string, entity string, gender string"), key)


@pytest.mark.parametrize("mode", ["placeholder", "surrogate"])
def test_round_trip(spark, mode):
    """The redacted text is the text with each value, and nothing else, replaced by its surrogate as it is worn."""
    cs, hints = spark.read.parquet(f"{TESTDATA}/claude_session.parquet"), spark.read.parquet(f"{TESTDATA}/name_hints.parquet")
    spans = {}
    for r in pii.entities(cs, hints, "k").collect():
        spans.setdefault((r.record_id, r.field_name), []).append((r.start_at - 1, r.length, r.pii_kind, r.surrogate))
    texts = {r.record_id: r for r in cs.collect()}
    got = {(r.record_id, r.field_name): r.redacted for r in pii.redact(cs, hints, "k", mode).collect()}
    assert got.keys() == spans.keys() and len(got) > 50
    for (i, field), s in got.items():
        back, t = s, texts[i][field]
        for at, n, kind, sur in sorted(spans[i, field]):
            worn = pii.dress(kind, sur, t[at : at + n])
            worn = f"<{kind.upper()}:{worn}>" if mode == "placeholder" else worn
            assert back[at:].startswith(worn) and worn != t[at : at + n]
            back = back[:at] + t[at : at + n] + back[at + len(worn) :]
        assert back == t


@pytest.mark.parametrize("kind, value, form", [
    ("phone", "+44 20 7946 0454", r"\+44 \d\d \d{4} \d{4}"), ("phone", "0044 20 7946 0454", r"0044 \d\d \d{4} \d{4}"), ("phone", "+1-503-555-0199 ext. 566", r"\+1-\d{3}-\d{3}-\d{4} ext\. 000"), ("phone", "0491-570-445", r"0\d{3}-\d{3}-\d{3}"),
    ("phone", "＋１ ２０６ ５５５ ０１５４", r"＋１ [０-９]{3} [０-９]{3} [０-９]{4}"), ("phone", "+353 20 912 3456", r"\+353 \d\d \d{3} \d{4}"),
    ("idnum", "QQ 27 90 94 B", r"[A-Z]{2} \d\d \d\d \d\d [A-D]"), ("idnum", "99645747-H", r"\d{8}-[A-Z]"), ("idnum", "zz 8057482", r"[a-z]{2} \d{7}"),
    ("name", "Юрий Петров", r"[А-Я][а-я]+ [А-Я][а-я]+"), ("name", "山田 太郎", r"[\u4e00-\u9fff]+ [\u4e00-\u9fff]+"), ("name", "Ελένη Δούκα", r"[Α-Ω][α-ω]+ [Α-Ω][α-ω]+"), ("name", "LINDEMAR, TALVIK", r"[A-Z]+, [A-Z]+"), ("name", "t. lindemar", r"[a-z]\. [a-z]+"),
    ("name", "Xan E. Ypsilon", r"[A-Z][a-z]+ [A-Z]\. [A-Z][a-z]+"), ("name", "Xan%20Ypsilon", r"[A-Z][a-z]+%20[A-Z][a-z]+"), ("name", "brenna-lindemar", r"[a-z]+-[a-z]+"), ("name", "Brenna Ashgrove-Linn", r"[A-Z][a-z]+ [A-Z][a-z]+-[A-Z][a-z]+"),
    ("address", "Apt 2, 341 Oakhaven Drive, Vaubriel", r"Apt \d, \d{3} [A-Z][a-z]+ Drive, [A-Z][a-z]+"), ("address", "18 rue des Sarments, 00701 Vaubriel", r"\d\d rue des [A-Z][a-z]+, 0\d{4} [A-Z][a-z]+"), ("address", "Birkenring 287", r"[A-Z][a-z]+ring \d{3}"), ("address", "Seestr. 217", r"[A-Z][a-z]+str\. \d{3}"), ("address", "Calle Tormenal 387, 8º A, 00814 Pontefell", r"Calle [A-Z][a-z]+ \d{3}, \dº [A-Z], 0\d{4} [A-Z][a-z]+"),
    ("email", "odrin at lab dot test", r"[a-z]+ dot [a-z]+ at example dot com"), ("email", "a＠b.org", r"[a-z.]+＠example\.com"),
])
def test_surrogates_keep_the_form(kind, value, form):
    entity = pii.canonical(kind, value)
    worn = pii.dress(kind, pii.surrogate(kind, entity, "k"), value)
    assert re.fullmatch(form, worn), worn
    assert worn != pii.dress(kind, pii.surrogate(kind, entity, "other"), value) and (kind != "idnum" or not re.fullmatch(r"\d{8}-[A-Z]", worn) or worn[-1].lower() == pii.DNI_LETTERS[int(worn[:8]) % 23])


def test_gender_and_coreference(spark, session_rows):
    hints = spark.createDataFrame([("Otto", "given")], "name_part string, part_kind string")
    rows = [{"record_id": 1, "item_text": "Frau Mira Castrovel spoke to Otto Grünwald; O. Grünwald <og@example.org> and Mr. Xan Ypsilon agree"}, {"record_id": 2, "item_text": "O. Grünwald <og@example.org> left", "cwd": "/home/mira.castrovel/x"}]
    got = {}
    for r in pii.entities(session_rows(rows), hints, "k").filter("pii_kind = 'name'").collect():
        got.setdefault(r.entity, set()).add(r.surrogate)
    assert set(got) == {"mira castrovel", "otto grünwald", "xan ypsilon", "o grünwald"} and all(len(v) == 1 for v in got.values())
    given = {k: next(iter(v)).split(" ")[0] for k, v in got.items()}
    assert given["mira castrovel"].endswith("a") and given["xan ypsilon"].endswith("o") and given["otto grünwald"].endswith("e")


@pytest.mark.parametrize("text, exp", [
    ("Please talk to Ingeborg Halvorsen about the move.", ["Ingeborg Halvorsen"]), ("It was approved by Marek Dvorak on Friday.", ["Marek Dvorak"]), ("The card is assigned to Jane Roe.", ["Jane Roe"]), ("my mobile is 0151 23456789, thanks", ["0151 23456789"]),
    ("We met at Via Garibaldi 12, 20121 Milano yesterday", ["Via Garibaldi 12, 20121 Milano"]), ("Kind regards,\nAmina Yusuf", ["Amina Yusuf"]), ("I spoke with Tomás Ó Briain and it is fine", ["Tomás Ó Briain"]), ("Thanks to Anna van der Berg for it", ["Anna van der Berg"]), ("according to Priya Raman, it fails", ["Priya Raman"]),
    ("id: 123456789 build", []), ("thanks to Data Team for this", []), ("contact Support Team", []), ("ask the team", []), ("called With Retry", []), ("reviewed by CI Bot", []),
])
def test_texts_of_other_making(text, exp):
    assert [text[a:b] for _, a, b in pii.Detector().text(text)] == exp


def test_many_hints_find_the_same(spark, session_rows, monkeypatch):
    cs, hints = spark.read.parquet(f"{TESTDATA}/claude_session.parquet"), spark.read.parquet(f"{TESTDATA}/name_hints.parquet")
    keep = ["record_id", "field_name", "pii_kind", "start_at", "length", "entity"]
    few = {tuple(r) for r in pii.detect(cs, hints).select(keep).collect()}
    monkeypatch.setattr(pii, "MOST_HINTS", 10)
    assert pii.known_parts(hints) is None and {tuple(r) for r in pii.detect(cs, hints).select(keep).collect()} == few
    odd = session_rows([{"record_id": None, "item_text": "so Talvik Lindemar"}, {"record_id": 1}, {"record_id": 1, "cwd": "/Users/mirabethcastrovel/dev"}])
    names = spark.createDataFrame([(w, k) for k, ws in {"given": ["Talvik", "Mirabeth", *"abcdefghij"], "family": ["Lindemar"]}.items() for w in ws], "name_part string, part_kind string")
    assert {r.value for r in pii.detect(odd, names).collect()} == {"Talvik Lindemar", "mirabethcastrovel"}


def test_empty_nulls_and_clashing(session_rows, spark):
    hints = spark.createDataFrame([(None, "given"), ("Talvik", None), ("Lindemar", "family")], "name_part string, part_kind string")
    rows = [{"record_id": 1, "item_text": "so Talvik Lindemar"}, {"record_id": None, "cwd": "/home/talvik.lindemar"}, {}, {"record_id": 2, "item_text": ""}, {"record_id": 1, "item_text": "x Talvik Lindemar"}]
    cs = session_rows(rows, "value string, entity string, surrogate string, mark long")
    assert sorted((str(r.record_id), r.field_name) for r in pii.entities(cs, hints, "k").collect()) == [("1", "item_text"), ("1", "item_text"), ("None", "cwd")]
    assert pii.entities(session_rows([]), hints, "k").count() == 0 and pii.redact(session_rows([]), hints.limit(0), "k").count() == 0
    got = sorted(r.redacted for r in pii.redact(cs, hints, "k", mode="surrogate").collect())
    assert len(got) == 3 and not any("talvik" in r.lower() for r in got) and got[1][:3] == "so " and got[2][:2] == "x "


GATES = [
    (pii.EMAIL, pii._MAY_EMAIL), (pii.PHONE, pii._MAY_PHONE), (pii.IDNUM, pii._MAY_IDNUM), (pii.CUED_IDNUM, pii._MAY_IDNUM),
    (pii.ADDRESS, pii._MAY_ADDRESS), (pii.CUED_NAME, pii._MAY_NAME), (pii.FRAMED_NAME, pii._MAY_NAME), (pii.SAID_NAME, pii._MAY_NAME),
]


@pytest.mark.parametrize("pattern, gate", GATES)
def test_gates_let_pass_what_patterns_match(pattern, gate):
    @settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(pattern))
    def check(s):
        assert gate.search(s), s

    check()


@pytest.mark.parametrize("kind, s", [
    ("address", "Berliner Ring 5"), ("address", "Am Ufer 12"), ("address", "Berliner Strasse 4"), ("address", "12 bis rue de la Paix"), ("address", "12B rue Monge"),
    ("idnum", "NINO QQ 279094 B"), ("idnum", "SSN: 123.45.6789"), ("idnum", "passport A123456"), ("phone", "01-99-00-53-29"), ("name", "Mira Castrovel <mc@example.org>"), ("name", "Mira Castrovel reported it"),
])
def test_values_alone_in_a_text(kind, s):
    assert kind in {k for k, *_ in pii.Detector().text(s)}
