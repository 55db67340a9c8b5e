"""Characters in their compatibility forms."""

import re
import unicodedata

from inkspark.functions import text


def test_class_of_characters_is_short_and_whole():
    python = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), text._SEVERAL_CLASS) + "]")
    assert len(text._SEVERAL_CLASS) < 6000 and text._SEVERAL_CLASS.count("-") < 300
    assert all(bool(python.match(chr(n))) == (chr(n) in text._SEVERAL) for n in range(0x110000) if not 0xD800 <= n < 0xE000)


def test_every_folded_character(spark):
    chars = [*text._SEVERAL, *text._WIDE, "가", "\x80", "a"]
    rows = spark.createDataFrame([(c + "b" + c,) for c in chars], "v string").select("v", text.compatible(text.F.col("v")).alias("c")).collect()
    assert len(rows) == len(chars) and all(r.c == "".join(unicodedata.normalize("NFKC", x) for x in r.v) for r in rows)
