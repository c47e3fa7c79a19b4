import pytest
from pyspark.sql import functions as F

from cadenza.functions import artists, text


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "given, name",
    [
        ("{'i': 'A', 'j': 'B'}", "A"),
        ("{'i': \"Guns N' Roses\"}", "Guns N' Roses"),
        ("{'i': \"A's: Live\"}", "Live"),
        ("{'i': 'A', 'j': \"B's\"}", "B's"),
        ("{}", None),
        ("{'i': u\"Edgar Winter's White Trash\"}", "u\"Edgar Winter's White Trash"),
        ("{'i': 'The Beach Boys'}", "The Beach Boys"),
        ('["A","B"]', "A"),
        ("311", "311"),
        ("A, B", "A"),
        ("", None),
        (None, None),
        ("{'i':'A'} x", "A'} x"),
        ("{'i':'A'} {'j':'B'}", "B"),
        ("null", "None"),
        ("true", "True"),
        ("[]", None),
        ('[{"i":"A"}]', "A"),
        ("[{'i':'A'}]", "[{'i':'A'}]"),
        ('{"a":"X","a":"Y","b":"Z"}', "Y"),
        ("1] , [2", "1]"),
    ],
)
def test_first_artist(spark, given, name):
    assert one(spark, given, artists.first_artist) == name


@pytest.mark.parametrize(
    "given, key",
    [("{'id1': 'A', 'id2': 'B'}", "id1"), ("plain", "plain"), ("O'Neil, x", "Neil, x"), (None, None)],
)
def test_first_quoted(spark, given, key):
    assert one(spark, given, text.first_quoted) == key


@pytest.mark.parametrize("given, name", [("A (feat. B), C", "A"), ("A, B", "A"), ("", None), (None, None)])
def test_first_artist_simple(spark, given, name):
    assert one(spark, given, artists.first_artist_simple) == name


def test_clean_artist(spark):
    assert one(spark, " A (feat. B)", artists.clean_artist) == "A"


@pytest.mark.parametrize("given, bare", [("\t a b\n", "a b"), ("   ", ""), ("x", "x")])
def test_strip(spark, given, bare):
    assert one(spark, given, text.strip) == bare


def test_words(spark):
    assert one(spark, "Don't STOP_me, Ça 3.14!", text.words) == ["don't", "stop_me", "ça", "3.14"]
    assert one(spark, None, text.words) == []
    assert one(spark, "'quoted' end. a.b rock’n’roll", text.words) == ["quoted", "end", "a.b", "rock’n’roll"]
    # A combining accent and a vowel sign belong to their letter.
    assert one(spark, "e\u0301te\u0301 \u0939\u093f\u0928", text.words) == ["e\u0301te\u0301", "\u0939\u093f\u0928"]


@pytest.mark.parametrize(
    "given, found",
    [
        ("東京タワーの夜", ["東", "京", "タワー", "の", "夜"]),
        ("ひらがなとカタカナ", ["ひ", "ら", "が", "な", "と", "カタカナ"]),
        ("日本語abc123カナ", ["日", "本", "語", "abc123", "カナ"]),
        ("ภาษาไทย ไม่มี abcไทย", ["ภาษาไทย", "ไม่มี", "abc", "ไทย"]),
        ("ລາວ ខ្មែរ မြန်မာ", ["ລາວ", "ខ្មែរ", "မြန်မာ"]),
        ("한국어 노래abc", ["한국어", "노래abc"]),
        ("が\u3099 か\u3099き", ["が\u3099", "か\u3099", "き"]),
        ("a:b 1,000.5 3.a a.3 a,b 1:2", ["a:b", "1,000.5", "3", "a", "a", "3", "a", "b", "1", "2"]),
        ("__ _a_ a__1 1_", ["_a_", "a__1", "1_"]),
        ("привет Ελλάδα שלום مرحبا", ["привет", "ελλάδα", "שלום", "مرحبا"]),
        ("½ ² Ⅷ 〇 x\u00ady", ["ⅷ", "〇", "x\u00ady"]),
        ("", []),
    ],
)
def test_words_by_script(spark, given, found):
    assert one(spark, given, text.words) == found


def test_long_words_are_cut(spark):
    assert [len(w) for w in one(spark, "x" * 300 + " y " + "z" * 255, text.words)] == [255, 45, 1, 255]
    assert [len(w) for w in one(spark, "ไ" * 600, text.words)] == [255, 255, 90]
    # No deep stack for words of very many parts.
    assert len(one(spark, "a1" * 200_000 + "_a" * 100_000, text.words)) == -(-600_000 // 255)
    assert len(one(spark, "a." * 200_000, text.words)) == -(-399_999 // 255)


@pytest.mark.parametrize("note, lyrics, whole", [("", "x", "x"), ("b", "", "b\n\n"), (None, None, ""), ("b", "x", "b\n\nx")])
def test_embedding_text(spark, note, lyrics, whole):
    df = spark.createDataFrame([(note, lyrics)], "n string, l string")
    assert df.select(text.embedding_text(F.col("n"), F.col("l"))).first()[0] == whole


@pytest.mark.parametrize(
    "given, clipped", [("a b c", "a b"), (" a\nb ", " a\nb "), ("a", "a"), ("", ""), ("a  b\n\nc d", "a  b")]
)
def test_clip_words(spark, given, clipped):
    assert one(spark, given, lambda c: text.clip_words(c, 2)) == clipped


def test_clip_long_text(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    assert one(spark, long, lambda c: text.clip_words(c, 400)) == " ".join(f"w{i}" for i in range(400))


def test_clean_keywords(spark):
    df = spark.createDataFrame([([" a ", "", None, "b c\n"],), (None,)], "k array<string>")
    assert [r[0] for r in df.select(text.clean_keywords(F.col("k"))).collect()] == [["a", "b c"], []]


def test_or_else(spark):
    df = spark.createDataFrame([(0.0, 0.4, "", None), (0.2, 0.4, "u", "v")], "a double, b double, s string, t string")
    got = df.select(text.or_else(F.col("a"), F.col("b"), 0), text.or_else(F.col("s"), F.col("t"), "")).collect()
    assert [tuple(r) for r in got] == [(0.4, None), (0.2, "u")]


@pytest.mark.parametrize(
    "one_text, other, same",
    [("Élan  ", "elan", True), ("Straße", "STRASE", True), ("ΆΛΦΑ", "αλφα", True), ("Ñandú", "nandu", True), ("Ệ", "e", True),
     (" a", "a", False), ("a\t", "a", False), ("ø", "o", False), ("e\u0301", "e", False), ("", "  ", True), ("й", "и", False)],
)
def test_collation_key(spark, one_text, other, same):
    assert (one(spark, one_text, text.collation_key) == one(spark, other, text.collation_key)) is same
    assert one(spark, None, text.collation_key) is None


def test_a_text_is_searched_once_for_words(spark):
    df = spark.createDataFrame([("a b",)], "t string").select(text.words(F.col("t")).alias("w"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_words_by_common_ranges_are_those_by_script(spark):
    texts = ["Über naïve жук ёж", "東京タワーのラ1", "กาไทย๑ ฿9", "a_b 3.14 don't #x `y` {z}", "x" * 300 + " y", "鿿鿽 a", "áb"]
    expected = [
        ["über", "naïve", "жук", "ёж"], ["東", "京", "タワー", "の", "ラ", "1"], ["กาไทย", "๑", "9"],
        ["a_b", "3.14", "don't", "x", "y", "z"], ["x" * 255, "x" * 45, "y"], ["a"], ["áb"],
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.words(F.col("t")).alias("w"))
    assert [r.w for r in rows.orderBy("i").collect()] == expected


def test_plain_words_are_those_of_the_whole_pattern(spark):
    import random

    rng = random.Random(5)
    # Of every class of the pattern, and what is next to the ranges of the short ways.
    signs = (
        "abz bd\n\t\x00\x7f.,:;'_-/!`{[^@09\u066b\u00e9\u00df\u0101\u0301\u00ad\u200d\u2019\u00b7"
        "\u0e01\u0e17\u0e30\u0e31\u0e32\u0e33\u0e34\u0e3a\u0e3f\u0e40\u0e46\u0e47\u0e4e\u0e50\u0e81\u0eb1\u1000\u1780"
        "\u4e00\u6771\u9fef\u9ff0\u3007\u3400\u3041\u3096\u3099\u309b\u309d\u30a0\u30a1\u30bf\u30fa\u30fb\u30fc\u30fd\uff70\uff9e"
        "\u0939\u093f\uac00\u0431\u03b1\u2160\U00020000\U0001f600"
    )
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 12))) for _ in range(20_000)]
    # Every pair of them after a letter of each script.
    texts += [f + a + b for f in "b\u6771\u0e17\u30bf" for a in signs for b in signs]
    whole = text.WORD.replace(text.PLAIN_WORD + "|", "")
    assert len(whole) < len(text.WORD)
    rows = spark.createDataFrame([(t,) for t in texts], "v string")
    both = rows.select("v", text.words(F.col("v")).alias("a"), text.words(F.col("v"), whole).alias("b"))
    assert both.filter("a <> b").count() == 0 and both.selectExpr("sum(size(a))").first()[0] > 40_000
