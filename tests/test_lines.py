"""Word lists read as tables, against the reader of one process."""

from __future__ import annotations

import pytest

from dictspark.sources import Dictionary, misspellings_of, parse_rules, read_words
from dictspark.sources.lines import parsed_lines

DIC = """9
plan/SD\tpo:noun ph:plann
and\\/or/S  is:x is:y :lone bare 1
/etc/x
two/parts/many
 spaced out/D ph:spacd* st:a:b
Oslo\tpo:name
NATO
tidy/DD ph:tydy->tidy
tidy/DD ph:tydy->tidy
straße/S

größe 
ab ph:q*
"""
STYLES = {
    "short": ("", {"SD": "SD", "S": "S", "D": "D", "DD": "DD"}),
    "long": ("FLAG long\n", {"SD": "S1D1", "S": "S1", "D": "D1", "DD": "D1D1x"}),
    "num": ("FLAG num\n", {"SD": "1,22", "S": "1", "D": "22", "DD": "22,22"}),
    "UTF-8": ("FLAG UTF-8\n", {"SD": "ŠD", "S": "Š", "D": "D", "DD": "DD"}),
    "aliases": ("AF 2\nAF SD\nAF D\nAM 1\nAM po:verb al:b\n", {"SD": "1", "S": "1", "D": "2", "DD": "2"}),
    "ignored": ("IGNORE aeo\n", {"SD": "SD", "S": "S", "D": "D", "DD": "DD"}),
    "sharps": ("CHECKSHARPS\n", {"SD": "SD", "S": "S", "D": "D", "DD": "DD"}),
}


def _as_rows(df):
    return [(r["stem"], r["flags"], r["data"], r["alt_spellings"], r["captype"]) for r in df.orderBy("line_no").collect()]


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO8859-1"])
@pytest.mark.parametrize("style", sorted(STYLES))
def test_read_words(spark, tmp_path, style, encoding):
    extra, names = STYLES[style]
    if (style, encoding) == ("UTF-8", "ISO8859-1"):
        pytest.skip("flags in UTF-8 mean texts in UTF-8")
    text = DIC if encoding == "UTF-8" else DIC.replace(" ", "\xa0")
    for old, new in sorted(names.items(), key=lambda x: -len(x[0])):
        text = "\n".join(line.replace(f"/{old}\t", f"/{new}\t").replace(f"/{old} ", f"/{new} ") if f"/{old}\t" in line or f"/{old} " in line else line[: -len(old)] + new if line.endswith(f"/{old}") and "\\" not in new else line for line in text.split("\n"))
    aff, dic = f"SET {encoding}\n{extra}".encode(encoding), text.encode(encoding)
    (tmp_path / "x.dic").write_bytes(dic)
    own = Dictionary.from_bytes(aff, dic)
    got = read_words(spark, str(tmp_path / "x.dic"), parse_rules(aff))
    assert _as_rows(got) == _as_rows(own.words(spark)) and got.columns == own.words(spark).columns
    pairs = [(r["pattern"], r["replacement"]) for r in misspellings_of(got).orderBy("line_no", "place").collect()]
    assert pairs == [(p.pattern, new) for p, new in own.rules.rep]


def test_many_splits(spark, tmp_path):
    """A file in many pieces keeps all its lines and loses its count only; a first line that is no count stays."""
    words = [f"w{k}/S" for k in range(20_000)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        for head in (["\ufeff20000"], []):
            (tmp_path / "y.dic").write_text("\n".join(head + words))
            got = read_words(spark, str(tmp_path / "y.dic"), parse_rules(b"SET UTF-8\n"))
            assert got.rdd.getNumPartitions() > 4
            rows = got.select("line_no", "stem").orderBy("line_no").collect()
            assert [r["stem"] for r in rows] == [w[:-2] for w in words] and len({r["line_no"] for r in rows}) == len(words)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_odd_lines(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \t ", "x"), (4, "12", "x"), (5, "a" * 100_000 + "/S", "x"), (5, "b", "x")], "line_no int, value string, stem string")
    rows = {r["stem"][:2]: r["flags"] for r in parsed_lines(df, parse_rules(b"SET UTF-8\n")).collect()}
    assert rows == {"12": [], "aa": ["S"], "b": []}
    assert parsed_lines(df.limit(0), parse_rules(b"")).count() == 0
    with pytest.raises(Exception, match="no such alias"):
        parsed_lines(spark.createDataFrame([(1, "a/7")], "line_no int, value string"), parse_rules(b"AF 1\nAF S\n")).collect()
