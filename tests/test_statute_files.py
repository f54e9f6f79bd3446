"""Files of statutes read record by record, against the files read whole."""

import random

from lexgrain.sources import statute_xml

STATUTES = "abk string, slug string, titel string"


def norm(draw, k):
    heading = draw.choice(["", "", "", f"<gliederungseinheit><gliederungsbez>Teil {k}</gliederungsbez><gliederungstitel>Über &amp; {k}</gliederungstitel></gliederungseinheit>"])
    label = draw.choice([f"<enbez>§ {k}</enbez>", f"<enbez>§ {k}</enbez>", "", "<enbez>Inhaltsübersicht</enbez>"])
    title = draw.choice([f"<titel>Titel {k}</titel>", ""])
    text = draw.choice(["", f"<text><Content><P>(1) Satz ä {k}.</P><P>Mehr.</P><P>(2) {'lang ' * draw.randrange(200)}</P></Content></text>"])
    return f'<norm doknr="{k}"><metadaten>{heading}{label}{title}</metadaten><textdaten>{text}</textdaten></norm>'


def written(folder, seed, n, end="</dokumente>"):
    draw = random.Random(seed)
    head = '<?xml version="1.0"?>\n<dokumente builddate="20240131010101" doknr="x">' if seed % 2 else "<dokumente>"
    dated = '<norm builddate="20230228"></norm><normalfall>kein</normalfall>' if seed % 3 == 0 else ""
    (folder / f"g{seed}.xml").write_text(head + "\n".join(norm(draw, k) for k in range(n)) + dated + end, encoding="utf-8")


def test_records_are_those_of_whole_files(spark, tmp_path):
    for seed, (n, end) in enumerate([(120, "</dokumente>"), (80, "<norm><metadaten><enbez>§ 999</enbez><titel>offen"), (40, ""), (0, "nichts"), (1, "\n"), (300, "</dokumente>\n")]):
        written(tmp_path, seed, n, end)
    (tmp_path / "leer.xml").write_text("")
    statutes = spark.createDataFrame([(f"G{k}", f"g{k}", f"Gesetz {k}") for k in range(6)] + [("F", "fehlt", "Fehlt"), ("L", "leer", "Leer")], STATUTES)
    wanted = statute_xml.parse(statute_xml.read_folder(spark, f"file://{tmp_path}", statutes))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = statute_xml.read_norms(spark, f"file://{tmp_path}", statutes)
        assert got.columns == wanted.columns and got.dtypes == wanted.dtypes
        one = [tuple(r) for r in got.orderBy("slug", "norm_seq").collect()]
        tasks = spark.read.option("lineSep", statute_xml.RECORD_END).text(f"file://{tmp_path}/g5.xml").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tasks > 10 and len(one) > 100
    assert one == [tuple(r) for r in wanted.orderBy("slug", "norm_seq").collect()]
