import random

from pyspark.sql import functions as F
import pytest

from scopeflow.functions import text as tx


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ("pan=4111111111111111 end", "pan=411111xxxxxx1111end"),
        ("card 414718xxxxxx3942 ok", "card 414718xxxxxx3942 ok"),
        ("4111-1111-1111-1111", "411111xxxxxx1111"),
        ("4111111111111111 123", "4111111111111111 123"),  # one run of 19 digits, whose check digit is wrong
        ("a 4111111111111111, b 4111111111111112", "a 411111xxxxxx1111, b 4111111111111112"),
        ("", ""),
        (None, None),
    ],
)
def test_sanitize(spark, text, masked):
    assert one(spark, tx.sanitize_text, text) == masked


def test_sanitize_is_idempotent(spark):
    once = one(spark, tx.sanitize_text, "x 4111111111111111 y")
    assert one(spark, tx.sanitize_text, once) == once


@pytest.mark.parametrize(("digits", "ok"), [("4111111111111111", True), ("4111111111111112", False), ("411111111111", False), ("", False), (None, False)])
def test_luhn(spark, digits, ok):
    assert one(spark, tx.luhn_ok, digits) is ok


@pytest.mark.parametrize(("text", "found"), [("UA - x", "UA"), ("8ABC", "8ABC"), ("U/H", None), ("Ooikn", None), ("ABCDEFG", None), ("8A_x", None), (None, None)])
def test_extract_id(spark, text, found):
    assert one(spark, tx.extract_id, text) == found


@pytest.mark.parametrize(("text", "yes"), [(" Yes", True), ("y", True), ("TRUE", True), ("1", True), ("no", False), ("", False), (None, False)])
def test_is_yes(spark, text, yes):
    assert one(spark, tx.is_yes, text) is yes


def test_leaks_never_show_the_number(spark):
    df = spark.createDataFrame([(1, "ok", "pan 4111111111111111 x"), (2, None, "none")], "id int, a string, b string")
    rows = tx.scan_for_leaks(df, "id").collect()
    assert [(r.id, r.column, r.masked) for r in rows] == [(1, "b", "411111xxxxxx1111")]
    assert "4111111111111111" not in rows[0].context
    with pytest.raises(tx.PanLeakError):
        tx.raise_if_leaked(tx.scan_for_leaks(df, "id"))
    tx.raise_if_leaked(tx.scan_for_leaks(tx.mask_all_cells(df).drop("masked_cells"), "id"))


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ("+1 (269) 555-3296 4524132264652876 and", "+1 (269) 555329xxx2413xxxxxx2876and"),  # 555-3296 and the six digits that stay pass the check
        ("4111111111111111 4111111111111111", "411111xxxxxx1111 411111xxxxxx1111"),
        ("4111111111111112", "4111111111111112"),
        (None, None),
    ],
)
def test_masks_make_no_new_card_number(spark, text, masked):
    df = spark.createDataFrame([(1, text)], "id int, a string")
    out = tx.mask_all_cells(df)
    row = out.first()
    assert (row.a, row.masked_cells) == (masked, int(text is not None and text != masked))
    assert tx.scan_for_leaks(out.drop("masked_cells"), "id").count() == 0


def test_masks_in_a_chain(spark):
    draw = random.Random(5)
    texts = [" ".join("".join(draw.choices("0123456789", k=draw.choice((3, 4, 6, 7)))) for _ in range(400)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, a string")
    once = df.withColumn("a", tx.sanitize_text(F.col("a")))
    assert tx.scan_for_leaks(once, "id").count() > 0
    assert tx.scan_for_leaks(tx.mask_all_cells(df).drop("masked_cells"), "id").count() == 0


@pytest.mark.parametrize("between", [",", "\n", "é", "--"])
def test_a_card_right_after_another_run_is_found(spark, between):
    """The number before it fails the check, and the one character between them belongs to neither."""
    df = spark.createDataFrame([(1, f"4111111111111112{between}4111111111111111")], "doc_id int, text string")
    assert [r.masked for r in tx.scan_for_leaks(df, "doc_id").collect()] == ["411111xxxxxx1111"]
