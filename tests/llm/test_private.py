"""Spans of personal information on literal texts."""

import pytest

from lakeloom.llm import private as P


def spans(text):
    return [(s.kind, text[s.start : s.end]) for s in P.find(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail a.b+c@mail.example, ok", [("email", "a.b+c@mail.example")]), ("x(at)corp.example", [("email", "x(at)corp.example")]), ("cc jo [at] mail [dot] example and", [("email", "jo [at] mail [dot] example")]), ("jo at mail dot example", [("email", "jo at mail dot example")]),
        ("column user@v2 is a label", []), ("call +44 7700 900123 now", [("phone", "+44 7700 900123")]), ("(512) 555-0184", [("phone", "(512) 555-0184")]), ("0044 (0)7700 900389", [("phone", "0044 (0)7700 900389")]), ("12 / 555-0150", [("phone", "555-0150")]), ("13125550108", [("phone", "13125550108")]),
        ("on call (+33 1 99 00 57 05)", [("phone", "+33 1 99 00 57 05")]), ("4315", []), ("position 1650651291533 looks stuck", []), ("build 20240617 is out", []), ("ticket says 81 000 rows, I count 375 002", []), ("as of 2024-03-16 14:06", []), ("order no 958898", []),
        ("card 4111-1111-1111-1111", [("id_number", "4111-1111-1111-1111")]), ("it is 4111111111111112 now", []), ("SSN 666-29-9307", [("id_number", "666-29-9307")]), ("tax id 00 951 270 195", [("id_number", "00 951 270 195")]), ("account GB82 WEST 1234 5698 7654 32 is", [("id_number", "GB82 WEST 1234 5698 7654 32")]),
        ("NI number QQ 13 49 70 C", [("id_number", "QQ 13 49 70 C")]), ("passport no. Z7681297", [("id_number", "Z7681297")]), ("see PO-7704468", []),
        ("ship to 12B Old Mill Road, Apt 5, Town", [("address", "12B Old Mill Road, Apt 5")]), ("at 9 elm street", [("address", "9 elm street")]), ("Ahornweg 12", [("address", "Ahornweg 12")]), ("21, rue des Lilas", [("address", "21, rue des Lilas")]), ("Calle del Sol 7", [("address", "Calle del Sol 7")]),
        ("ask Wanda, they wrote it", [("name", "Wanda")]), ("talk to olga van about the plan", [("name", "olga van")]), ("Dr. Brown signed off", [("name", "Dr. Brown")]), ("who? I think Frau Holm or Ben", [("name", "Frau Holm"), ("name", "Ben")]), ("Mira A. Holm?", [("name", "Mira A. Holm")]), ("I'd rather keep the old field id", []),
        ("der Lauf hängt seit 3 Stunden", []), ("🙂 ask Wanda, they know", [("name", "Wanda")]),
    ],
)
def test_spans(text, want):
    assert spans(text) == want


@pytest.mark.parametrize("text", ["447700900923", "2075550160", "07700900923", "5550184"])
def test_bare_numbers_of_the_phone_field(text):
    assert [(s.kind, s.start, s.end) for s in P.find(text, "sender_ph")] == [("phone", 0, len(text))] and P.redact(text, "sender_ph") == "[PHONE]" and spans(text) == []


@pytest.mark.parametrize("card", ["4222222222222", "378282246310005", "3782 822463 10005", "30569309025904", "4111 1111 1111 1111", "6304 0000 0000 0000 000"])
def test_cards_of_all_lengths(card):
    assert spans(f"paid with {card} today") == [("id_number", card)]
    assert spans("my card 6304000000000000000 today") == [("id_number", "6304000000000000000")] and spans("the one at 4376834997347810821, type upsert") == []


@pytest.mark.parametrize("text", ["it is 4111 1111 1111 1112 now", "card 4111-1111-1111-1112", "account GB83 WEST 1234 5698 7654 32 is", "it is 378282246310006 now", "position 4222222222222 hangs"])
def test_wrong_check_digits_are_no_cards(text):
    assert "id_number" not in dict(spans(text))


@pytest.mark.parametrize("name", ["Čeněk Novák", "Şule İnce", "Анна Петрова", "Ελένη Παππά", "June Miller", "August Brandt", "Wanda Mill"])
def test_names_of_all_capitals_and_months(name):
    assert spans(f"we saw that {name} has the key") == [("name", name)] and spans(f"talk to {name} about the plan") == [("name", name)]


def test_months_alone_are_no_names():
    assert spans("it ran in June and in May, we saw") == [] and spans("talk to may about the plan") == []


#: Sentences and names written apart from the detector and from the test tables.
FRAMES = [
    "please escalate this to {} before noon", "{} reset the cluster password yesterday", "I had lunch with {} near the depot", "according to {} the bucket is empty", "let's wait until {} is back", "the ticket belongs to {}", "can you forward the invoice to {}?", "{} hasn't answered since monday",
    "sorry {}, wrong channel", "did {} approve the rollout", "I just met {} at the gate", "ping {} when it is green", "regards, {}", "the patient, {}, arrived late", "our new analyst {} starts next week", "good morning {}", "{} and the team will look into it", "this was reported by {}", "see the note from {}",
    "{}'s laptop is broken", "I work for {} now", "we should thank {} for the fix", "the parcel was signed for by {}", "no idea, maybe {} knows", "{} wrote that the table is stale", "assigned: {}", "{} please restart it", "he married {} last year", "reach out to {} if it fails again", "the interview with {} is on tuesday",
]
PEOPLE = ["Agnieszka Wojcik", "Thabo Mokoena", "Ingrid", "Rajesh Iyer", "Yusuf Demir", "Chloe Dubois", "Dr. Okonkwo", "Matteo Ricci", "Siobhan Kelly", "Nikolai", "Lakshmi Menon", "Mrs. Haverford", "Kwame", "Beatriz Figueiredo", "Hiroshi Tanaka"]


@pytest.mark.parametrize(("form", "least"), [(str, 0.95), (str.lower, 0.9)])
def test_names_in_other_sentences(form, least):
    said = [(form(f.format(p)), f.index("{")) for i, f in enumerate(FRAMES) for p in (PEOPLE[(i * 7 + j * 3) % len(PEOPLE)] for j in range(5))]
    assert sum(any(s.kind == "name" and s.start == at for s in P.find(t)) for t, at in said) >= least * len(said)


@pytest.mark.parametrize("text", ["we run Apache Spark here", "moved to Microsoft Azure", "Paris is nice", "we use Snapshot Isolation", "Kafka and Flink are up", "the Delta Lake table", "by Friday", "from kinesis to redshift", "the retry has a backfill", "NO ROWS LOST THIS TIME", "4 in a row, 530 rows in place", "12 rows merged. row 3 is late", "don't can't we'll", "clave ausente en los archivos pequeños"])
def test_no_persons(text):
    assert spans(text) == []


@pytest.mark.parametrize(("text", "want"), [("john smith lives at 12 elm grove", [("name", "john smith"), ("address", "12 elm grove")]), ("Yesterday Marta Kowalska left", [("name", "Marta Kowalska")]), ("Anna has the key.", [("name", "Anna")]), ("the reviewer was nadia petrova", [("name", "nadia petrova")]), ("gestern hat Herr Schmidt bezahlt", [("name", "Herr Schmidt")]), ("contact dr. lin tomorrow", [("name", "dr. lin")])])
def test_sentences(text, want):
    assert spans(text) == want


def test_long_mail_names_are_taken_whole():
    for mail in ("a" * 90 + "@mail.example", "jo@" + ".".join("abcdefgh") + ".example", "jo [at] " + " [dot] ".join("abcdefgh")):
        assert spans(f"to {mail} now") == [("email", mail)]


def test_positions_count_characters():
    assert P.find("🙂🙂 a@b.example")[0].start == 3


def test_empty_and_long():
    assert P.find(None) == [] and P.find("") == [] and P.redact(None) is None and P.redact("") == ""
    assert P.find("a" * 200_000) == [] and P.find("1 " * 50_000) == [] and len(P.find("a@b.example " * 2_000)) == 2_000


def test_checksums():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112") and P.mod97("GB82WEST12345698765432") and not P.mod97("GB83WEST12345698765432")


def test_redaction_keeps_the_rest():
    assert P.redact("talk to Ann Lee about 555-0150,  please") == "talk to [NAME] about [PHONE],  please"


def test_frames(spark, rows):
    df = spark.createDataFrame([(1, "ask Wanda, they know", "12 / 555-0150", "x"), (2, None, None, None), (3, "", " ", "y"), (1, "ask Wanda, they know", None, "again")], "row_id long, message string, sender_ph string, kind string")
    assert rows(P.found_spans(df)) == [(1, "message", "name", 4, 9), (1, "message", "name", 4, 9), (1, "sender_ph", "phone", 5, 13)]
    out = P.redacted(df).orderBy("kind").collect()
    assert [r["message"] for r in out] == [None, "ask [NAME], they know", "ask [NAME], they know", ""] and out[2]["sender_ph"] == "12 / [PHONE]" and P.redacted(df).columns == df.columns
    assert P.found_spans(df.limit(0)).count() == 0
    big = spark.createDataFrame([(2**62 + 1, "a@b.example", None), (None, "a@b.example", None)], "row_id long, message string, sender_ph string").coalesce(1)
    assert {r["row_id"] for r in P.found_spans(big).collect()} == {2**62 + 1, None}
