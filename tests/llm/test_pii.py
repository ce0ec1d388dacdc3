from __future__ import annotations

import pytest

from kinsift.llm import pii
from kinsift.llm.pii import Lexicon, find_pii, label, redact, spans_of, train

GIVEN, FAMILY = ["Alba", "Corvin", "Оскарий"], ["Hollin", "de Marsh", "Соттерин", "泠"]
LEXICON = Lexicon(GIVEN, FAMILY, ["the", "das", "die", "we", "please", "call", "deliver", "bitte"], {"云": 0.9, "舟": 0.8})


def _corpus():
    """Rows in which rules can label some items, as a corpus has them."""
    out = []
    for i in range(60):
        a, b = 100 + 7 * i % 900, 1000 + 37 * i % 9000
        out += [
            f"Phone: 555-0{a}-{b} The seed store opens.", f"Call 555-0{a}-{b} after six.", f"Tel. (555) 01{i % 10}-{b} is open.", f"Call (555) 01{i % 10}-{b} after six.",
            f"Mobile 020 7946 {b}.", f"order 020 7946 {b} came.", f"invoice 030 7946 {b} came.", f"Phone 12 34 {10 + i % 90} 78 90.", f"Call 12 34 {10 + i % 90} 78 90 after six.",
            f"National ID {a}-{10 + i % 90}-{b}, copy attached.", f"ID {a} {10 + i % 90} {b} is on the form.", f"Passport AB {10 + i % 90} 34 56 C is valid.", f"SSN {a}-{10 + i % 90}-{b}, copy attached.",
            f"build 31-{a}, part number {a}-{10 + i % 90}-{b}.", f"It took {a} {b} {a} steps.", f"run at 2024-05-15 02:45, node 192.0.2.{i}.",
            f"Deliver it to Apt {i + 1}, {a} Sedge Street, Nether Wold; ring twice.", f"Bitte liefern an Kieselweg {a} b, Talheide; zweimal klingeln.", f"收件地点是青溪市旧窑巷{a}号。",
            "We asked Alba Hollin about it.", "We asked Corvin Hollin about it.", "We asked Corvin de Marsh about it.", "We asked A. Hollin about it.", "Dr. Alba K. HOLLIN disagreed.", "请联系泠云舟老师。",
            f"Write to <a.hollin+{i}@mail.example> now.", f"We painted {'North East South West'.split()[i % 4]} Harbour orange. Copper Pipe {i} shines. They met Old Gate there.", "The Seed Store opens. The Old Gate and the Hollin filter was used.",
        ]
    return out


WEIGHTS = train(_corpus(), LEXICON)


def found(text):
    return [(text[b:e], k) for b, e, k in spans_of(text, LEXICON, WEIGHTS)]


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("Write to <a.hollin+x@mail.example> now.", [("a.hollin+x@mail.example", "email")]),
        ("Ask c_1 [at] mail dot lab dot example today.", [("c_1 [at] mail dot lab dot example", "email")]),
        ("Call 555-0147-6537 ext. 108 after six.", [("555-0147-6537 ext. 108", "phone")]),
        ("Call (555) 016-4130 after six.", [("(555) 016-4130", "phone")]),
        ("National ID 943 05 8468, copy attached.", [("943 05 8468", "id_number")]),
        ("build 31-149, part number 206-60-4512.", []),
        ("page 55, ISBN-like code 979-0-7584-123-9.", []),
        ("Deliver it to Apt 9, 98 Sedge Street, Nether Wold; ring twice.", [("Apt 9, 98 Sedge Street, Nether Wold", "address")]),
        ("Bitte liefern an Kieselweg 129 b, Talheide; zweimal klingeln.", [("Kieselweg 129 b, Talheide", "address")]),
        ("收件地点是青溪市旧窑巷183号。", [("青溪市旧窑巷183号", "address")]),
        ("We asked Alba Hollin about it.", [("Alba Hollin", "name")]),
        ("Dr. Alba K. HOLLIN disagreed.", [("Alba K. HOLLIN", "name")]),
        ("the Hollin filter was used", []),
        ("请联系泠云舟老师。", [("泠云舟", "name")]),
        ("The seed store opens the gate: run at 2024-05-15 02:45, node 192.0.2.216.", []),
        ("", []),
    ],
)
def test_items(text, items):
    assert found(text) == items


def test_long_runs_of_numbers():
    ids = [f"{i}23-45-678{i}" for i in range(1, 8)]
    assert found("SSN " + " ".join(ids) + ", copy attached.") == [(i, "id_number") for i in ids]
    phones = [f"555-01{i}7-6537" for i in range(1, 9)]
    assert found("Call " + " ".join(phones) + " after six.") == [(p, "phone") for p in phones]
    phones = [f"(555) 01{i}-6537" for i in range(1, 6)]
    assert found("Call " + " ".join(phones) + " after six.") == [(p, "phone") for p in phones]
    assert found("PLEASE SEND YOUR PASSPORT BACK WITH AB 12 34 56 C AS SOON AS YOU CAN DO SO THIS WEEK.") == [("AB 12 34 56 C", "id_number")]
    assert found("build 1 22 333 4444 55 666 7777 88 999 1 22 333 4444 55 666.") == []


@pytest.mark.parametrize("window", [37, 50, 64, 101])
def test_windows_cut_no_item(monkeypatch, window):
    line = "We asked A. Hollin about it. Deliver it to P. O. Box 12, Nether Wold; ring twice. Call 555-0147-6537 ext. 108 after six. 请联系泠云舟老师。收件地点是青溪市旧窑巷183号。 "
    whole = found(line * 6)
    assert len(whole) == 30
    monkeypatch.setattr(pii, "WINDOW", window)
    assert found(line * 6) == whole
    phones = "Call " + "12 34 56 78 90 " * 60 + "after six."
    assert found(phones) == [("12 34 56 78 90", "phone")] * 60
    digits = "12 34 56 78 90 " * 40 + "Call 555-0147-6537 after six."
    assert found(digits)[-1] == ("555-0147-6537", "phone")


def test_an_item_across_position_20000():
    for item, kind, head in (("a.hollin+x@mail.example", "email", "Write to "), ("Alba K. HOLLIN", "name", "Dr. ")):
        for shift in range(0, len(item) + 2, 5):
            text = "word " * ((pii.WINDOW - len(head) - shift) // 5)
            text += "x" * (pii.WINDOW - len(head) - shift - len(text) - 1) + " " + head + item + " now. " + "word " * 500
            assert found(text) == [(item, kind)], (item, shift)


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("It rang at +44 20 7946 0958 twice.", [("+44 20 7946 0958", "phone")]),
        ("It rang at +33 1 99 00 12 34 twice.", [("+33 1 99 00 12 34", "phone")]),
        ("Call 020 7946 0958 after six.", [("020 7946 0958", "phone")]),
        ("It took 020 7946 0958 steps.", []),
        ("Wir fragten Frau Müller danach.", [("Müller", "name")]),
        ("We wrote to Dr. Smith then.", [("Smith", "name")]),
        ("We wrote to Dr. Kaede Zorn then.", [("Kaede Zorn", "name")]),
        ("We asked Alba de la Cruz about it.", [("Alba de la Cruz", "name")]),
        ("We asked Alba García Hollin about it.", [("Alba García Hollin", "name")]),
        ("Mr. Łukasz Kowalski disagreed.", [("Łukasz Kowalski", "name")]),
        ("Mr. Ἀλέξης Ζορμπᾶς disagreed.", [("Ἀλέξης Ζορμπᾶς", "name")]),
    ],
)
def test_forms_outside_the_sample(text, items):
    assert found(text) == items


def test_labels_come_from_rules_alone():
    text = "Phone: 555-0147-6537 We asked Alba Hollin about it. part 206-60-4512"
    segments = pii.candidates(text, LEXICON)
    by = {(text[c[0] : c[1]], c[2]): m for c, m in zip(segments, label(segments))}
    assert by["555-0147-6537", "phone"] == pii.RIGHT and by["555-0147-6537", "id_number"] == pii.WRONG
    assert by["Alba Hollin", "name"] == pii.RIGHT
    assert by["206-60-4512", "phone"] == pii.WRONG and by["206-60-4512", "id_number"] == pii.WRONG


def test_frames_are_learned_from_the_corpus():
    """`call` names no kind of number in the rows that teach it; an unknown name is found where known ones stand."""
    assert WEIGHTS["name"]["b1=asked"] > 0
    assert found("We asked Ilvane Lindqvale about it.") == [("Ilvane Lindqvale", "name")]
    assert found("We painted Ilvane Lindqvale orange.") == []


def test_find_and_redact(spark):
    docs = [(1, "Call 555-0147-6537 after six.", "x"), (2, None, "x"), (3, "", "x"), (4, "Nothing here.", None), (1, "Call 555-0147-6537 after six.", "x"), (5, ("word " * 30_000) + "Write to a@b.example now.", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, kind string")
    hints = spark.createDataFrame([("Alba", "given"), (None, "family"), ("Hollin", None)], "token string, kind string")
    got = sorted((r.doc_id, r.kind, r.pii_text) for r in find_pii(df, hints).collect())
    assert got == [(1, "phone", "555-0147-6537")] * 2 + [(5, "email", "a@b.example")]
    clean = {r.doc_id: r.text for r in redact(df, hints).collect()}
    assert clean[1] == "Call [PHONE] after six." and clean[2] is None and clean[3] == "" and clean[4] == "Nothing here."
    assert clean[5].endswith("Write to [EMAIL] now.")
    assert find_pii(df.limit(0), hints.limit(0)).count() == 0
