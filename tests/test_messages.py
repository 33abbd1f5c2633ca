import pytest

from quernstone.operators import messages, rules

PARSER = messages.Vocabulary().parser()


@pytest.mark.parametrize("line,want", [
    ("انشيه سالكه", [("انشيه", "open", "both")]),
    ("مراح رياح مغلق", [("مراح رياح", "closed", "both")]),
    ("جناتا تل الربيع سالكه", [("جناتا تل الربيع", "open", "both")]),
    ("حوارة ✅", [("حوارة", "open", "both")]),
    ("🔴 حوارة", [("حوارة", "closed", "both")]),
    ("حوارة سالكه ✅", [("حوارة", "open", "both")]),
    ("✅ حاجز حوارة الحمدلله", [("حوارة", "open", "both")]),
    ("بيتا ✅ الحمدلله يا شباب", [("بيتا", "open", "both")]),
    ("🟣 حوارة", [("حوارة", "idf", "both")]),
    ("🟠 حوارة", [("حوارة", "congested", "both")]),
    ("✅✅فرش الهوى سالك", [("فرش الهوى", "open", "both")]),
    ("❌❌العروب مغلق", [("العروب", "closed", "both")]),
    ("بيت فوريك سالك بالاتجاهين", [("بيت فوريك", "open", "both")]),
    ("يتما الداخل مسكر الخارج سالك", [("يتما", "closed", "inbound"), ("يتما", "open", "outbound")]),
    ("عناب (عنبتا): الداخل: سالك - الخارج مغلق", [("عناب", "open", "inbound"), ("عناب", "closed", "outbound")]),
    ("بزاريا: ✅ سالك بالاتجاهين", [("بزاريا", "open", "both")]),
    ("بوابة كفل حارس:  مغلق بالاتجاهين ❌️❌️", [("بوابة كفل حارس", "closed", "both")]),
    ("يسعد صباحك اخي عين سينيا سالك", [("عين سينيا", "open", "both")]),
    ("السلام عليكم بيتا مغلق", [("بيتا", "closed", "both")]),
    ("زعترة مش سالك", [("زعترة", "closed", "both")]),
    ("زعترة: سالك للداخل، مغلق للخارج", [("زعترة", "open", "inbound"), ("زعترة", "closed", "outbound")]),
    ("بيتا مُغْلق", [("بيتا", "closed", "both")]), ("بيتـا: مغــلق", [("بيتـا", "closed", "both")]),
    ("✅", []), ("", []), ("hello world", []), ("صباح الخير يا شباب", []), ("كافه حواجز اريحا مغلقه", []), ("باقي حواجز اريحا سالكه", []),
    (":", []), ("سالك", []), ("- : -", []), ("الداخل مغلق", []), ("one two three four five six مغلق", []),
])
def test_lines(line, want):
    assert PARSER.line(line) == want


def test_message(spark):
    text = "حوارة ✅\nبيتا 🔴\nعقربا ✅\nحواره مغلق\n\nبيتا: سالك للداخل"
    rows = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z")], "id int, text string, status string")
    got = messages.message_statuses(rows).collect()
    assert sorted((r.id, r.line_no, r.name, r.status, r.direction) for r in got) == [
        (1, 0, "حواره", "open", "both"), (1, 1, "بيتا", "closed", "both"), (1, 2, "عقربا", "open", "both"), (1, 5, "بيتا", "open", "inbound"),
    ]
    assert messages.message_statuses(rows.limit(0)).collect() == []


def test_keys():
    assert messages.place_key("حوارة") == messages.place_key("حواره")
    assert messages.place_key("ومدخل بزاريا") == messages.place_key("مدخل بزاريا")
    assert messages.place_key("واد قانا") == "واد_قانا"


def test_other_vocabularies(spark):
    words = messages.Vocabulary({"open": "open", "closed": "closed", "not open": "closed"}, {}, {"inbound": "in", "outbound": "out"}, (), (), (), ())
    rows = spark.createDataFrame([(1, "Zaatara: open inbound, closed outbound\nNorth Gate not open")], "id int, text string")
    got = messages.message_statuses(rows, words=words).collect()
    assert sorted((r.name, r.status, r.direction) for r in got) == [("north_gate", "closed", "both"), ("zaatara", "closed", "out"), ("zaatara", "open", "in")]


def test_colon_lines_keep_every_status(spark):
    rows = spark.createDataFrame([(1, "Zaatara: open inbound, closed outbound\nBeit-El: closed - open outbound")], "id int, t string")
    got = rules.parse_statuses(rows, "id", "t", {"closed": "closed", "open": "open"}, {"inbound": "inbound", "outbound": "outbound"}).collect()
    assert sorted((r.name, r.status, r.direction) for r in got) == [
        ("beit-el", "closed", "both"), ("beit-el", "open", "outbound"), ("zaatara", "closed", "outbound"), ("zaatara", "open", "inbound"),
    ]
