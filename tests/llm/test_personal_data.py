import hashlib
import random
import re

import pytest

from sourcerank.llm import personal_data as pd

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1]))
        return 12 <= len(digits) <= 19 and doubled % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    """The contract's patterns as they are written."""
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if holds(kind, m.group())]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def ours(text):
    return [(s.kind, s.start, s.end) for s in pd.find(text) if s.kind in pd.BASE]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    letters = ["a", "B", "7", "0", "25", "255", "1.", ".", "-", "_", "%", "+", "@", "@", " ", "(", ")", "4111 1111 1111 1111", "a@b.c", "1.2.3.4", "+1 (555) 555-0100", "é", "日"]
    for _ in range(6000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        assert ours(text) == base_spans(text), text


@pytest.mark.parametrize("unit", ["a", "@", "a@", "1", "1.", "1 ", "+1", "+1 ", "A1", "a.", "1-", "1:", "DE00 ", "1/1/"])
def test_long_runs_take_linear_time(unit):
    text = unit * 200_000
    assert isinstance(pd.find(text), list)


def kinds(text):
    return {(s.kind, text[s.start : s.end]) for s in pd.find(text)}


def test_checksums():
    assert pd.luhn("4111111111111111") and not pd.luhn("4111111111111112")
    assert pd.mod97("DE89370400440532013000") and not pd.mod97("DE89370400440532013001")


def test_added_kinds_need_a_check_and_words_nearby():
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00 AND MORE") == {("iban", "DE89 3704 0044 0532 0130 00")}
    assert not kinds("IBAN: DE89 3704 0044 0532 0130 01")
    assert kinds("social security number 123-45-6789.") == {("ssn", "123-45-6789")}
    assert not kinds("part 123-45-6789") and not kinds("social security 000-45-6789")
    assert kinds("Tel. 030 1234 5678") == {("local_phone", "030 1234 5678")}
    assert not kinds("plain 030 1234 5678") and not kinds("tel order 030 1234 5678")
    assert kinds("host 2001:db8::8a2e:370:7334 up") == {("ipv6", "2001:db8::8a2e:370:7334")}
    assert not kinds("at 12:30:45 host")
    assert kinds("née 12.03.1980") == {("birthdate", "12.03.1980")}
    assert not kinds("born 31.02.1980") and not kinds("on 12.03.1980")


def test_base_spans_stay_and_push_others_out():
    text = "call tel +49 30 1234 5678, mail a.b@c.de, 192.168.0.1, card 4111 1111 1111 1111"
    assert kinds(text) == {("phone", "+49 30 1234 5678"), ("email", "a.b@c.de"), ("ip", "192.168.0.1"), ("card", "4111 1111 1111 1111")}
    assert all(0 <= s.score <= 1 for s in pd.find(text))
    assert pd.score("card 4", "card", 5, 6) > pd.score("x 4", "card", 2, 3) > pd.score("order 4", "card", 6, 7)


def test_digest_over_odd_rows(spark, docs, no_docs, texts):
    rows = pd.digest(pd.spans(docs)).collect()
    assert len(rows) == len(texts)
    assert pd.digest(pd.spans(no_docs)).count() == 0 and pd.masked(no_docs).count() == 0
    told = lambda found: ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    text = "日本 a@b.co 1.2.3.4 née 1.2.1990 IBAN DE89370400440532013000"
    df = spark.createDataFrame([(1, text), (2, None), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pd.digest(pd.spans(df)).collect()}
    assert (got[1]["n_email"], got[1]["n_ip"], got[1]["n_card"], got[1]["n_phone"]) == (1, 1, 0, 0)
    assert got[1]["base_sha256"] == hashlib.sha256(told(base_spans(text)).encode()).hexdigest()
    assert got[1]["spans"] == told((s.kind, s.start, s.end) for s in pd.find(text)) and "iban" in got[1]["spans"]
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    hidden = {r["doc_id"]: r["text"] for r in pd.masked(df).collect()}
    assert hidden[1] == "日本 [EMAIL] [IP] née [BIRTHDATE] IBAN [IBAN]" and hidden[2] == ""


def test_whole_table_equals_the_plain_patterns(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    for r in pd.digest(pd.spans(table)).collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pd.BASE] == [sum(w[0] == k for w in want) for k in pd.BASE]
