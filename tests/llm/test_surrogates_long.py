"""PII in very long entities, in capitals, and with check digits."""

import pytest

from arborix.llm import surrogates

MILLION = 1_000_000
LONG = {
    "name": "Mr. A" + "b" * MILLION,
    "names": "Mr. " + "Ab'" * (MILLION // 3),
    "many names": "Mr. Ab Cd " * (MILLION // 10),
    "capitals": "A" * MILLION,
    "local part": "a" * MILLION + "@example.org",
    "labels": "a@" + "b." * (MILLION // 2) + "com",
    "label": "a@" + "b" * MILLION + ".com",
    "mails": "a@b.cd " * (MILLION // 7),
    "iban": "DE89" + "3704 " * (MILLION // 5),
    "phone": "+49 " + "30 " * (MILLION // 3),
    "digits": "1" * MILLION,
    "dotted": "1." * (MILLION // 2),
    "dashed": "123-45-" * (MILLION // 7),
    "card": "4111 1111 " * (MILLION // 10),
    "letters and digits": "a1" * (MILLION // 2),
    "secret": "password=" + "x9" * (MILLION // 2),
    "blanks": " " * MILLION,
}


@pytest.mark.parametrize("kind", sorted(LONG))
def test_a_million_characters(spark, kind):
    rows = [(1, LONG[kind]), (2, "short, from a@b.org")]
    out = {r.doc_id: r for r in surrogates.op4_pii_surrogates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[2].n_email == 1 and "a@b.org" not in out[2].text
    if kind in ("name", "names", "capitals", "label", "local part", "digits", "dashed", "letters and digits", "blanks"):
        assert out[1].text == LONG[kind] and out[1].n_entities == 0  # no entity has this form
    if kind == "secret":
        assert out[1].text.startswith("password=") and len(out[1].text) == len(LONG[kind]) and out[1].text != LONG[kind] and "x9x9x9x9" not in out[1].text
    if kind == "mails":
        assert out[1].n_email == MILLION // 7 and "a@b.cd" not in out[1].text
    if kind == "many names":
        assert out[1].n_person == MILLION // 10


def test_names_at_their_bound(spark):
    fits, over = "A" + "b" * 63, "A" + "b" * 64
    rows = [(1, f"Mr. {fits} and Dr. {over} and Mrs. Eva {over}")]
    text = surrogates.op4_pii_surrogates(spark.createDataFrame(rows, "doc_id long, text string")).first().text
    assert fits + " and" not in text and f"Dr. {over}" in text and "Mrs. Eva" not in text and text.endswith(over)


def test_names_in_capitals(spark):
    rows = [(1, "Dr. Anna Smith signed. ANNA SMITH, the sender; SMITH alone; SMITHSONIAN"), (2, "ANNA SMITH of another text")]
    out = {r.doc_id: r.text for r in surrogates.op4_pii_surrogates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    given, last = out[1].split()[1:3]
    assert out[1] == f"Dr. {given} {last} signed. {given.upper()} {last.upper()}, the sender; {last.upper()} alone; SMITHSONIAN" and out[2] == rows[1][1]


def valid(iban):
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_ibans_keep_their_check_digits(spark):
    good, bad = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606"], ["DE88 3704 0044 0532 0130 00"]
    assert all(map(valid, good)) and not any(map(valid, bad))
    out = [r.text for r in surrogates.op4_pii_surrogates(spark.createDataFrame(list(enumerate(good + bad)), "doc_id int, text string")).orderBy("doc_id").collect()]
    for old, new in zip(good, out, strict=False):
        assert new != old and new[:2] == old[:2] and valid(new) and [c == " " for c in new] == [c == " " for c in old]
    assert not valid(out[-1]) or out[-1] != bad[0]


def test_versions_are_no_addresses(spark):
    rows = [(1, "v1.2.3.4 of the program, not 10.1.2.3")]
    text = surrogates.op4_pii_surrogates(spark.createDataFrame(rows, "doc_id long, text string")).first().text
    assert text.startswith("v1.2.3.4 of") and "10.1.2.3" not in text


def test_the_key_decides(spark):
    table = spark.createDataFrame([(1, "Mrs. Anna Smith, a@b.org, password: 0123456789abcdef0123456789abcdef")], "doc_id long, text string")
    one, two, again = (surrogates.replace_pii(table, key=k).first().text for k in ("first", "second", "first"))
    assert one == again != two
    held = spark.conf.get(surrogates.KEY_SETTING)
    spark.conf.unset(surrogates.KEY_SETTING)
    try:
        with pytest.raises(ValueError, match="key"):
            surrogates.replace_pii(table)
        assert surrogates.op4_pii_surrogates(table).count() == 1
    finally:
        spark.conf.set(surrogates.KEY_SETTING, held)


def test_long_secrets_are_drawn_in_one_pass(spark):
    """The same letters give the same surrogate, whatever else the table holds, and hexadecimal stays so."""
    secret = "0f" * 5000
    rows = [(1, f"token={secret}"), (2, f"x token={secret} y")]
    out = [r.text for r in surrogates.op4_pii_surrogates(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    new = out[0].removeprefix("token=")
    assert len(new) == len(secret) and set(new) <= set("0123456789abcdef") and out[1] == f"x token={new} y"
    assert len({new[k : k + 64] for k in range(0, len(new), 64)}) > 150
