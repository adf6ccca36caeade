import zipfile
from xml.etree import ElementTree

import pytest

from scopeflow.functions.sql import register
from scopeflow.plans.engine import Engine
from scopeflow.plans.estate import Estate
from scopeflow.sinks.pdf import write_pdf
from scopeflow.sinks.xlsx import write_xlsx

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(Estate.of_star(spark, "/root/testdata/sf0.01"))


def cells(path, sheet):
    with zipfile.ZipFile(path) as z:
        root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    return [["".join(c.itertext()) for c in row.findall("m:c", NS)] for row in root.iter(f"{{{NS['m']}}}row")]


def test_workbook(spark, tmp_path):
    df = spark.createDataFrame([("a<b> & c", 1, 2.5, True, None), ("=1\x01", -3, 0.0, False, "x")], "a string, b long, c double, d boolean, e string")
    path = tmp_path / "t.xlsx"
    write_xlsx(path, {"one/two": df, "empty": df.limit(0)})
    assert cells(path, 1) == [["a", "b", "c", "d", "e"], ["a<b> & c", "1", "2.5", "1"], ["=1", "-3", "0.0", "0", "x"]]
    assert cells(path, 2) == [["a", "b", "c", "d", "e"]]


def test_report_files(engine, tmp_path):
    engine.write_workbook(str(tmp_path / "r.xlsx"))
    with zipfile.ZipFile(tmp_path / "r.xlsx") as z:
        names = ElementTree.fromstring(z.read("xl/workbook.xml"))[0]
    assert len(names) == len(engine.sheets()) + 2
    assert cells(tmp_path / "r.xlsx", 1)[1] == ["systems", "100"]
    engine.write_report(str(tmp_path / "r.pdf"))
    raw = (tmp_path / "r.pdf").read_bytes()
    assert raw.startswith(b"%PDF-") and raw.rstrip().endswith(b"%%EOF") and b"53 of 100 systems" in raw


def test_pdf_places_of_objects(tmp_path):
    write_pdf(tmp_path / "p.pdf", "# head (x)\n" + "\n".join(f"line {i} \u20ac \\" for i in range(150)))
    raw = (tmp_path / "p.pdf").read_bytes()
    table = raw[int(raw.split(b"startxref\n")[1].split()[0]) :].split(b"\n")
    for i, line in enumerate(table[3 : 3 + int(table[1].split()[1]) - 1], 1):
        assert raw[int(line.split()[0]) :].startswith(b"%d 0 obj" % i)
    assert raw.count(b"/Type /Page ") == 3


def test_sql_functions(spark, engine):
    names = register(spark, engine.estate)
    r = spark.sql("select mask_pan('4111 1111 1111 1111') a, mask_pan('12-3') b, extract_id(' AB1 - x') c, extract_id('x') d, is_yes(' Yes') e, is_yes(null) f, luhn_ok('4111111111111111') g, luhn_ok('12') h").first()
    assert tuple(r) == ("411111xxxxxx1111", "xxx", "AB1", None, True, False, True, False)
    root = engine.estate.pairs.where("src <> dst").first().src
    want = {(x.dst, x.hops) for x in engine.estate.pairs.where(f"src = '{root}' and dst <> src").collect()}
    assert {tuple(x) for x in spark.sql(f"select * from reach('{root}')").collect()} == want
    assert spark.sql(f"select a.id from reach('{root}') r, lateral ancestors(r.id) a where a.id = '{root}'").count() == len(want) and len(names) == 6
