"""Readers and sinks on small files."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from strandmill.sources import readers as R
from strandmill.sources import sinks as K

FASTA = ">sp|P1|A_HUMAN first\nMKv\nlaaR\n\n>Q2|k=v\naaMM\n>lone\nACD\n"


def put(path, text, gz=False):
    path.write_bytes(gzip.compress(text.encode()) if gz else text.encode())
    return str(path)


@pytest.mark.parametrize("gz", [False, True])
def test_fasta(spark, tmp_path, gz):
    path = put(tmp_path / ("a.fa.gz" if gz else "a.fa"), FASTA, gz)
    got = {r.accession: r.sequence for r in R.fasta(spark, path, strict=not gz).collect()}
    assert got == {"P1": "MKvlaaR", "Q2": "aaMM", "lone": "ACD"}
    runs = sorted((r.accession, r.start, r.end) for r in R.masked_intervals(R.fasta(spark, path)).collect())
    assert runs == [("P1", 3, 6), ("Q2", 1, 2)]
    with pytest.raises(ValueError, match="header"):
        R.fasta(spark, put(tmp_path / "bad.fa", "MKV\n>x\nAA\n"), strict=True)


def test_delimited(spark, tmp_path):
    path = put(tmp_path / "t.tsv.gz", "a\tb\n1\tx\n", gz=True)
    assert R.delimited(spark, path, sep="\t").collect() == [("1", "x")]
    sniffed = R.sniffed(spark, put(tmp_path / "s.csv", "﻿a;b\n1;x\n2;y\n"))
    assert sniffed.columns == ["a", "b"] and sniffed.count() == 2


def test_domain_table(spark, tmp_path):
    full = "PF1 PF00001.3 50 prot - 300 1e-9 30.0 0.1 1 2 1e-8 1e-3 25.0 0.0 1 40 10 60 8 62 0.95 a longer description"
    path = put(tmp_path / "d.txt", f"# comment\n\n{full}\n{' '.join(full.split()[:22])}\n")
    rows = R.domtblout(spark, path, short="pad").collect()
    assert len(rows) == 2 and rows[0].i_evalue == 1e-3 and rows[0].description == "a longer description" and rows[1].description is None
    assert R.domtblout(spark, path, short="skip").count() == 1
    with pytest.raises(Exception, match="too few fields"):
        R.domtblout(spark, path).collect()


def test_annotations(spark, tmp_path):
    line = '1\th\t{}\t5\t9\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; {}'
    path = put(tmp_path / "a.gtf", "#!x\n" + line.format("transcript", 'tag "MANE_Select"; tag "Ensembl_canonical";') + "\n" + line.format("exon", "") + "\n")
    row = R.gtf(spark, path).first()
    assert (row.gene_id, row.is_mane, row.is_canonical, row.protein_id) == ("G1", True, True, None)
    path = put(tmp_path / "p.dat", "# STOCKHOLM 1.0\n#=GF ID   KH_1\n#=GF AC   PF00013.32\n#=GF DE   KH domain\n//\n# STOCKHOLM 1.0\n#=GF ID   X\n#=GF AC   PF2.1\n//\n")
    assert {tuple(r) for r in R.stockholm(spark, path).collect()} == {("KH_1", "PF00013", "KH domain"), ("X", "PF2", None)}
    assert R.hmm_versions(spark, put(tmp_path / "h.hmm", "NAME x\nACC   PF00013.32\n")).first() == ("PF00013", "PF00013.32")
    path = put(tmp_path / "r.json", json.dumps({"protein_id": "P", "results": [{"method": "m", "regions": [{"start": 1, "end": 5, "description": None}]}]}) + "\n")
    assert R.regions(spark, path).first() == ("P", "m", 1, 5, None)


def test_workbook(spark, tmp_path):
    path = tmp_path / "w.xlsx"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><t>n</t></si><si><t>x</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>5</v></c></row><row><c r="B3"><v>6</v></c></row></sheetData></worksheet>')
    got = R.workbook(spark, str(path), "S")
    assert got.columns == ["name", "n"] and sorted(map(tuple, got.collect()), key=str) == [("x", "5"), (None, "6")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("h1", "A" * 70, "g1"), ("h1", "A" * 70, "g1"), ("h2", "", "g2")], "header string, sequence string, g string")
    K.fasta(df, str(tmp_path / "f"))
    back = R.fasta(spark, str(tmp_path / "f")).collect()
    assert [(r.header, len(r.sequence)) for r in back] == [("h1", 70)]
    K.per_group(df, "g", str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).where("g = 'g1'").count() == 2
    K.tables(str(tmp_path / "t"), {"a/b": df, "a:b": df})
    K.delimited(df.withColumn("l", F.array(F.lit("x"), F.lit("y"))), str(tmp_path / "c"))
    assert R.delimited(spark, str(tmp_path / "c")).where("header = 'h2'").first().l == "x;y"
    K.manifest(spark, [put(tmp_path / "in.txt", "abc")], str(tmp_path / "m"), k=1)
    assert spark.read.json(str(tmp_path / "m")).first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert {r.metric: r.value for r in K.report(df, rows=F.count(F.lit(1))).collect()} == {"rows": 3.0}
    assert K.sanitised(["a/b", "A:b", "x" * 40]) == ["a_b", "A_b_2", "x" * 31]
    kept = K.filtered_fasta(df.withColumnRenamed("header", "accession").withColumn("header", F.lit("h")), spark.createDataFrame([("h1", 4)], "accession string, n int"), annotate={"n": "n"})
    assert kept.first().header == "h|n=4"
    built = R.reuse(spark, str(tmp_path / "cache"), lambda: df)
    assert built.count() == 3 and R.reuse(spark, str(tmp_path / "cache"), lambda: 1 / 0).count() == 3
    assert "file" in R.under(spark, str(tmp_path / "cache")).columns
    assert R.through_program(df, "g", lambda x: __import__("pandas").DataFrame({"up": [v.upper() for v in x]}), "up string").count() == 3


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "b & <c>", 1.5, ["x", "y"]), (1, None, None, []), (3, " sp\x01ace ", float("nan"), None)], "n int, s string, x double, l array<string>").coalesce(1).orderBy("n")
    wide = spark.createDataFrame([tuple(range(60))], ", ".join(f"c{i} int" for i in range(60)))
    path = K.workbook(spark, str(tmp_path / "out"), "a/b", {"one": df, "two/3": [("counts", df.select("n")), ("wide", wide)], "none": df.limit(0)})
    assert path.endswith("a_b.xlsx")
    back = R.workbook(spark, path, "one")
    assert back.columns == ["n", "s", "x", "l"]
    assert [tuple(r) for r in back.orderBy("n").collect()] == [("1", None, None, None), ("2", "b & <c>", "1.5", "x;y"), ("3", " space ", "NaN", None)]
    rows = {r.row: r.cells for r in R.sheet_rows(spark, path).where("sheet = 'two_3'").collect()}
    assert [rows[i] for i in range(5)] == [["counts"], ["n"], ["1"], ["2"], ["3"]] and rows[8] == ["wide"] and rows[10] == [str(i) for i in range(60)]
    assert R.workbook(spark, path, "ONE ", fuzzy=True).count() == 3 and R.workbook(spark, path, "none").count() == 0
    with pytest.raises(ValueError, match="no such sheet"):
        R.workbook(spark, path, "absent")


def test_external_program(spark, tmp_path):
    import sys

    df = spark.createDataFrame([("ab",), (None,), ("c",), ("",)], "x string")
    assert sorted(r.value for r in R.external(df, "x", [sys.executable, "-c", "import sys\nfor l in sys.stdin: print(l.strip().upper())"], rows=1).collect()) == ["AB", "C"]
    once = tmp_path / "once"
    flaky = f"import os, sys\nif not os.path.exists({str(once)!r}): open({str(once)!r}, 'w').close(); print('half'); sys.exit(3)\nprint(len(sys.stdin.read()))"
    assert [r.value for r in R.external(df.coalesce(1), "x", [sys.executable, "-c", flaky]).collect()] == ["5"]
    with pytest.raises(Exception, match="status 4: no such model"):
        R.external(df, "x", [sys.executable, "-c", "import sys; print('no such model', file=sys.stderr); sys.exit(4)"]).collect()
    with pytest.raises(Exception, match="no end within 0.2 s"):
        R.external(df, "x", [sys.executable, "-c", "import time; time.sleep(30)"], seconds=0.2, tries=1).collect()
    with pytest.raises(Exception, match="a line end"):
        R.external(spark.createDataFrame([("a\nb",)], "x string"), "x", ["cat"]).collect()


def test_fasta_in_order_of_first_sight(spark, tmp_path):
    df = spark.createDataFrame([(3, "h1", "AA"), (1, "h2", "CC"), (5, "h2", "CC"), (2, "h3", "DD"), (4, "h3", "DD")], "at int, header string, sequence string").repartition(3)
    K.fasta(df, str(tmp_path / "f"), order=["at"])
    assert [r.value for r in spark.read.text(str(tmp_path / "f")).coalesce(1).collect() if r.value[0] == ">"] == [">h2", ">h3", ">h1"]


def test_annotated_subset_has_records_without_letters_and_every_label(spark, tmp_path):
    from strandmill.plans import catalog

    documents = [(1, "ab C", "en", "s"), (2, "12 34", "en", "s"), (3, None, "de", "s"), (4, "ab", "en", "s"), (5, "x" * 130, "en", "s")]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 1), (4, 0), (5, 1), (9, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [r.header for r in catalog.QUERIES["annotated_subset"](spark, str(tmp_path)).orderBy("header").collect()]
    assert got == [f"sp|D{i}|S lang={lang}|quality=1" for i, lang in ((1, "en"), (1, "en"), (2, "en"), (3, "de"), (5, "en"))]
