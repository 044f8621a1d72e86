import hashlib

from pyspark.sql import functions as F

from skarn.functions import hashing, markup, text, times


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_normalize_text(spark):
    raw = "Á b  c\r\n\r\n ​d\t\te  \rf"
    assert one(spark, text.normalize_text(F.col("t")), t=raw) == "Á b c\nd e\nf"
    assert one(spark, text.normalize_text(F.lit(None).cast("string")), t="") == ""
    assert one(spark, text.normalize_inline(F.col("t")), t="a\nb") == "a b"


def test_titles(spark):
    assert one(spark, text.normalized_title(F.col("t")), t=" Straße X ") == "strasse x"
    for title, expected in (("untitled", True), ("без названия", True), ("", True), ("x", False)):
        assert one(spark, text.is_placeholder_title(F.col("t")), t=title) is expected
    assert one(spark, text.title_tokens(F.col("t")), t="ab абв x_y 123 абв") == ["абв", "x_y", "123"]


def test_lines_cut_at_all_line_ends(spark):
    long = "x" * 30
    assert one(spark, text.blocking_lines(F.col("t")), t=f"{long}\x1c{long}1\x0b{long}2 short") == [long, long + "1", long + "2"]
    assert one(spark, text.distinctive_lines(F.col("t")), t="y" * 15 + "\nz") == ["y" * 15]


def test_hashes(spark):
    assert one(spark, hashing.digest(F.col("t")), t="ö") == hashlib.sha256("ö".encode()).hexdigest()
    assert one(spark, hashing.stable_id("page", F.col("t"), F.lit("b")), t="a") == "backup-page-" + hashlib.sha256(b"a\0b").hexdigest()[:32]
    assert hashing.canonical_json({"b": [1, None], "a": "ö"}) == '{"a":"ö","b":[1,null]}'
    assert one(spark, hashing.canonical_row("b", "a"), b="x", a="y") == '{"a":"y","b":"x"}'


def test_times(spark):
    assert one(spark, times.iso_from_epoch_ms(F.col("t")), t=1_700_000_000_999) == "2023-11-14T22:13:20Z"
    assert one(spark, times.iso_from_epoch_ms(F.col("t")), t=0) is None
    assert one(spark, times.epoch_seconds(F.col("t")), t="2023-11-14T22:13:20Z") == 1_700_000_000
    assert one(spark, times.epoch_seconds(F.col("t")), t="2023-11-14 22:13:20") is None
    assert one(spark, times.iso_from_string(F.col("t")), t="2023-11-14T22:13:20+02:00") == "2023-11-14T20:13:20Z"
    assert one(spark, times.iso_from_string(F.col("t")), t="nonsense") is None


def test_markup(spark):
    body = ":/ABCDEF0123456789abcdef0123456789 and :/abcdef0123456789abcdef0123456789 :/" + "1" * 32
    assert one(spark, markup.resource_refs(F.col("t")), t=body) == ["abcdef0123456789abcdef0123456789", "1" * 32]
    assert one(spark, markup.embedded_id(F.col("t"), F.lit("")), t="onenote://page/a%20b") == "a b"
    assert one(spark, markup.embedded_id(F.lit(""), F.col("t"), "tool-x"), t="x tool-x:onenote_page_id=p%2F1 y") == "p/1"
    assert one(spark, markup.embedded_id(F.lit(""), F.col("t"), "other"), t="x tool-x:onenote_page_id=p%2F1 y") is None
    assert one(spark, markup.embedded_id(F.lit(""), F.col("t")), t="x tool-x:onenote_page_id=p%2F1 y") is None
    assert one(spark, markup.quote_url(F.col("t")), t="a b*~/") == "a%20b%2A~%2F"
    assert one(spark, markup.is_safe_url(F.col("t")), t=" HTTPS://x") is True
    assert one(spark, markup.is_safe_url(F.col("t")), t="javascript:x") is False
    assert one(spark, markup.escape_html(F.col("t"), attribute=True), t="<&'\">") == "&lt;&amp;&#x27;&quot;&gt;"
    assert one(spark, markup.logical_title(F.col("t")), t="A (b) (On 1-2-2024)") == "A (b)"
    assert one(spark, markup.logical_title(F.col("t")), t="(1.2.2024)") == "(1.2.2024)"
    assert one(spark, markup.safe_extension(F.col("t")), t="a\\b/c.PnG") == ".png"
    assert one(spark, markup.media_type(F.col("t")), t="c.png") == "image/png"
    assert one(spark, markup.content_format(F.lit(1), F.col("t")), t="a <b>") == "mixed"
    assert one(spark, markup.content_format(F.lit(None).cast("int"), F.col("t")), t="a") == "unknown"
