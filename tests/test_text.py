"""Text functions on the traps they exist for."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from phonolake.functions import text as txt


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "pieces, words",
    [
        ("##A DON ' T QU ##ILT ##ER", "A DON'T QUILTER"),
        ("", ""),
        ("A", "A"),
        ("WE ##L ##CO ##ME", "WELCOME"),
        ("IT ' S ' T", "IT'S'T"),
        ("YES . NO , WHY ?", "YES. NO, WHY?"),
        ("he 's it 've", "he's it've"),
    ],
)
def test_pieces_to_words(spark, pieces, words):
    assert one(spark, pieces, txt.pieces_to_words) == words


def test_cleanup_can_be_left_out(spark):
    assert one(spark, "YES . NO", lambda c: txt.pieces_to_words(c, cleanup=False)) == "YES . NO"


def test_letters_to_words(spark):
    assert one(spark, "| A T | T H I S |", txt.letters_to_words) == "AT THIS"
    df = spark.createDataFrame([("A |", ["B", "C"]), ("A |", None)], "u string, w array<string>")
    got = [r[0] for r in df.select(txt.letters_to_words(F.col("u"), F.col("w"))).collect()]
    assert got == ["B C", "A"]


def test_unknown_label_kind_is_an_error(spark):
    with pytest.raises(Exception, match="unknown label kind"):
        one(spark, "A", lambda c: txt.units_to_words(c, F.lit("xyz")))


def test_tokens(spark):
    text = " a b\t c\x1cd\n "
    assert one(spark, text, txt.tokens) == text.split()
    assert one(spark, "", txt.tokens) == [] and one(spark, "", txt.tokens_strict) == [""]
    assert one(spark, "a  b", txt.tokens_strict) == ["a", "", "b"]


@pytest.mark.parametrize("path", ["/d/103-1240.flac", "x.tar.gz", "plain", "/a/.hidden", "/a.b/c"])
def test_path_stem(spark, path):
    from pathlib import PurePosixPath

    assert one(spark, path, txt.path_stem) == PurePosixPath(path).stem


@pytest.mark.parametrize("text", ["abc", "", "nbest: 1\n", "é"])
def test_fingerprint(spark, text):
    want = int(hashlib.md5(text.encode()).hexdigest(), 16) % 1_000_000
    assert one(spark, text, txt.fingerprint) == want
    if text == "abc":
        assert want == 803570
