import pytest
from pyspark.sql import functions as F

from linkloom.functions import text

LINKS = [
    ("see [[apple|fruit]] and [[Banana#History|b]]", {"Apple", "Banana"}),
    ("{{Infobox|x=[[Hidden]]}} [[shown]]", {"Shown"}),
    ("{{a {{b}} [[X]] }} [[y]]", {"Y"}),
    ("{{a [[X]]", {"X"}),
    ("[[File:p.png|cap [[Inner]] tail]] [[z]]", {"Z"}),
    ("[[foo|a:b]]", set()),
    ("[[#sec]]", {""}),
    ("[[é]]", {"é"}),
    ("[[ a ]]", {" a "}),
    ("[[x_y]]", {"X_y"}),
    ("[[a [[b]]", {"A [[b"}),
    ("[[a", set()),
    ("[[a]] {{t}} [[b]]", {"A", "B"}),
    ("[[A]] [[a]] [[A#q]]", {"A"}),
    ("", set()),
    (None, set()),
]


@pytest.mark.parametrize("wiki, want", LINKS)
def test_links(wiki, want):
    assert set(text.links_of(wiki)) == want


def test_columns(spark):
    raw = ["'A_b'", r"'It\'s'", r"'q\"q'", r"'a\\b'", "'a,b'", "'_lead'", "'trail_'", r"'a\nb'"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k int, r string")
    got = [r[0] for r in df.orderBy("k").select(text.clean_title(F.col("r"))).collect()]
    assert got == ["A b", "It's", 'q"q', "a\\b", "a,b", "lead", "trail", "a\\nb"]
    one = spark.createDataFrame([("hello", "é", "x-20221201-p.gz", 0.4, 17.0, 2500.0)], "h string, e string, n string, a double, b double, c double")
    r = one.select(
        text.first_upper(F.col("h")), text.first_upper(F.col("e")), text.dump_date(F.col("n")), text.show_date(F.lit(221201)),
        text.slice_text(F.col("h"), 1, -1), text.slice_text(F.col("h"), -2), text.slice_text(F.col("h"), 4, 2), text.find_text(F.col("h"), F.lit("l")), text.find_text(F.col("h"), F.lit("l"), 3),
        text.find_text(F.col("h"), F.lit("z")), text.show_duration(F.col("a")), text.show_duration(F.col("b")), text.show_duration(F.col("c")), text.to_id(F.lit("x1")), text.to_id(F.lit("12")),
    ).first()
    assert tuple(r) == ("Hello", "é", 221201, "2022.12.01", "ell", "lo", "", 2, 3, -1, "1ms", "17ms", "2.5 sec", 0, 12)
