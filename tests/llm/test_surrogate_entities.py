"""More entities than short surrogates, and mentions of one entity in several forms."""

from __future__ import annotations

import string

from windrose.llm import pii


def test_surrogates_do_not_run_out(spark, monkeypatch):
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["ba", "be"])
    names = [f"Mr. X{a}{b}" for a in "abcdefgh" for b in "abcde"]
    mails = [f"{a}@{b}.com" for a in string.ascii_lowercase for b in string.ascii_lowercase]
    docs = spark.createDataFrame(list(enumerate(names + mails)), "doc_id long, text string")
    rows = pii.surrogates(docs, "k").collect()
    assert len({r.text for r in rows}) == len(rows) == len(names + mails)
    assert not {r.text for r in rows} & set(names + mails) and all(r.n_entities == 1 for r in rows)


def test_mentions_of_one_entity_agree(spark):
    texts = [
        "Mr. John Smith met Dr. John Smith. Later Smith's friend Anna saw John, and Mr. Smith wrote to Ann.B@Mail.example.com or ann.b@mail.example.com",
        "call (017) 555-7713 or 017-555-7713, card 4929348385146306 or 4929 3483 8514 6306",
        "Госпожа Анна Иванова пришла. Анна ушла, а г-н Петров и Петров остались.",
        "Smith and Anna stay where nobody has a title, 0\u00011",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.surrogates(docs, "k").orderBy("doc_id").collect()
    w = rows[0].text.split()
    given, name = w[1], w[2]
    assert not {"John", "Smith"} & set(rows[0].text.replace("'", " ").replace(",", " ").replace(".", " ").split())
    assert w[:3] == ["Mr.", given, name] and w[3:7] == ["met", "Dr.", given, name + "."]
    assert w[7:16] == ["Later", name + "'s", "friend", "Anna", "saw", given + ",", "and", "Mr.", name]
    assert w[-3].lower() == w[-1] != "ann.b@mail.example.com" and [c.isupper() for c in w[-3]] == [c.isupper() for c in "Ann.B@Mail.example.com"]
    assert rows[0].n_entities == 7
    digits = ["".join(filter(str.isdigit, x)) for x in rows[1].text.replace("card", "or").replace(",", " or").split(" or ") if any(map(str.isdigit, x))]
    assert len(digits) == 4 and digits[0] == digits[1] != "0175557713" and digits[2] == digits[3] != "4929348385146306"
    c = rows[2].text.replace(".", "").split()
    assert c[0] == "Госпожа" and c[1] == c[4] != "Анна" and c[8] == c[10] != "Петров" and "Иванова" not in c and c[7] == "г-н", c
    assert rows[3].text == texts[3] and rows[3].n_entities == 0
