from penmark.functions.emoji import emoji_table, single_codepoint_class


def test_table_size_and_members(spark):
    t = emoji_table(spark)
    assert len(t) == 5037
    for s in ["©", "©️", "↔", "👍🏽", "🇺🇸", "#️⃣", "#⃣", "👨‍👩‍👧"]:
        assert s in t, s
    for s in ["#", "5", "🏽", "→"]:
        assert s not in t, s


def test_single_codepoint_class_covers_table(spark):
    import regex

    import re

    py = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m.group(1), 16)), single_codepoint_class())
    rx = regex.compile(py)
    singles = [s for s in emoji_table(spark) if len(s) == 1 and s not in "#*0123456789"]
    assert singles and all(rx.fullmatch(s) for s in singles)
    for s in "#5→•À":
        assert not rx.fullmatch(s)
