"""Data sources over files, and the sink that writes all files or none."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tagloom.operators import exports
from tagloom.sources import files, formats

DOC = '<x:exchange-document xmlns:x="u" country="EP" doc-number="{0}" kind="A1" family-id="{0}"><bibliographic-data><invention-title lang="en">T{0}</invention-title></bibliographic-data></x:exchange-document>'


@pytest.fixture
def folder(tmp_path):
    for n in range(3):
        docs = "".join(DOC.format(10 * n + i) for i in range(4))
        (tmp_path / f"r{n}.xml").write_text(f'<s total-result-count="{n + 4}">{docs}</s>')
    (tmp_path / "broken.xml").write_text("<s>" + DOC.format(99) + "<open")
    (tmp_path / "nameless.xml").write_text("<s>" + DOC.format(98) + "<exchange-document kind='B'/></s>")
    (tmp_path / "_hidden.xml").write_text(DOC.format(97))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "r.xml").write_text(DOC.format(50))
    return str(tmp_path)


def test_publications_of_files(spark, folder):
    rows = formats.read_publications(spark, folder).collect()
    good = {r.docdb_id: r for r in rows if r.error is None}
    assert set(good) == {f"EP.{10 * n + i}.A1" for n in range(3) for i in range(4)} | {"EP.50.A1"}
    assert good["EP.21.A1"].titles == {"en": "T21"} and good["EP.21.A1"].file.endswith("r2.xml")
    # a response with a fault gives nothing but the fault
    assert sorted(os.path.basename(r.file) for r in rows if r.error) == ["broken.xml", "nameless.xml"]
    assert formats.read_publications(spark, folder, "DROPMALFORMED").count() == 13
    with pytest.raises(PySparkException):
        formats.read_publications(spark, folder, "FAILFAST").collect()
    # the same rows as from a frame of responses
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.lit(1).alias("id"), F.col("value").alias("xml"))
    want = files.parse_publications(raw).where("error IS NULL").drop("id", "error")
    got = formats.read_publications(spark, folder).where("error IS NULL").drop("file", "error")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_partitions_columns_and_single_files(spark, folder):
    formats.register_formats(spark)
    read = spark.read.format("publication_xml").option("partition_bytes", 1)
    assert read.load(folder).rdd.getNumPartitions() == 6
    few = read.schema("docdb_id string, file string").load(f"{folder}/r1.xml")
    assert few.columns == ["docdb_id", "file"] and few.count() == 4
    assert spark.read.format("publication_xml").load(f"file://{folder}/deep").count() == 1
    totals, publications = formats.read_search_pages(spark, folder)
    assert {os.path.basename(r.file): r.total for r in totals.where("error IS NULL").collect()} == {"r0.xml": 4, "r1.xml": 5, "r2.xml": 6}
    assert totals.where("error IS NOT NULL").count() == 3 and publications.count() == 15
    with pytest.raises(PySparkException):
        spark.read.format("publication_xml").load(f"{folder}/none").collect()
    with pytest.raises(PySparkException):
        spark.read.format("publication_xml").option("mode", "other").load(folder).collect()


def test_texts_parts_and_drawings(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        """<f><description lang="EN"><heading>HEAD</heading><p>A <b>bold</b>  text</p><p>x<tables/></p></description><claims lang="de"><claim><claim-text>Eins</claim-text></claim></claims>
        <fulltext-instance lang="en" desc="Description"/><fulltext-instance lang="en" desc="other"/><document-instance desc="Drawing" link="l" number-of-pages="6"/></f>"""
    )
    path = str(tmp_path)
    assert formats.read_texts(spark, path, "description", "en").first().text == "HEAD\nA bold text\n[Table 2 not reproduced]"
    assert [(r.lang, r.text) for r in formats.read_texts(spark, path, "claims", "de").collect()] == [("de", "Eins")]
    assert formats.read_texts(spark, path, "claims", "fr").first().text is None
    assert [(r.lang, r.part) for r in spark.read.format("fulltext_parts_xml").load(path).collect()] == [("en", "description")]
    assert [(r.desc, r.link, r.pages) for r in spark.read.format("drawings_xml").load(path).collect()] == [("Drawing", "l", 6)]


def test_number_lists_and_their_stream(spark, tmp_path):
    formats.register_formats(spark)
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "b.txt").write_bytes(b"US2\r\n\r\n  EP3 \n")
    (source / "a.csv").write_bytes("﻿EP1\n".encode())
    rows = spark.read.format("number_list").load(str(source)).orderBy("line_no").collect()
    assert [r.input_raw for r in rows] == ["EP1", "US2", "EP3"] and rows[2].line_no == (1 << 33) + 2

    def run() -> list[str]:
        stream = spark.readStream.format("number_list").load(str(source))
        query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(90)
        return sorted(r.input_raw for r in spark.read.parquet(str(out)).collect())

    assert run() == ["EP1", "EP3", "US2"]
    time.sleep(0.05)
    (source / "0.txt").write_text("WO9\n")
    assert run() == ["EP1", "EP3", "US2", "WO9"]  # the new file, and no file twice


def tree(path) -> dict[str, str]:
    out = {}
    for above, _, names in os.walk(path):
        for n in names:
            with open(os.path.join(above, n), encoding="utf-8", newline="") as f:
                out[os.path.relpath(os.path.join(above, n), path)] = f.read()
    return out


def test_text_files_all_or_none(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(f"d{i % 3}/{i}/{i}.txt", f"é{i}\r\n") for i in range(40)], "path string, text string").repartition(4)
    formats.write_text_files(rows, path)
    want = {f"d{i % 3}/{i}/{i}.txt": f"é{i}\r\n" for i in range(40)}
    assert tree(path) == want

    def fails(extra, cut: bool = False):
        bad = spark.createDataFrame(extra, "path string, text string")
        new = spark.createDataFrame([(f"new/{i}", "x") for i in range(20)], "path string, text string")
        frame = bad.unionByName(new)
        with pytest.raises(PySparkException):
            (frame.repartition(5) if cut else frame).write.format("text_files").mode("append").save(path) if cut else formats.write_text_files(frame, path)
        assert tree(path) == want and not [n for n in os.listdir(path) if n.startswith("_")]

    fails([("d0/0/0.txt", "again")])  # there already
    fails([("twice", "a"), ("twice", "b")])
    fails([("twice", "a"), ("twice", "b")], cut=True)  # by two tasks
    fails([("../out", "a")])
    fails([("/out", "a")])
    fails([(None, "a")])

    def broken(frames):
        for f in frames:
            yield f.iloc[:1]
            raise RuntimeError("a task dies")

    with pytest.raises(PySparkException):
        rows.mapInPandas(broken, "path string, text string").write.format("text_files").mode("append").save(path)
    assert tree(path) == want and not [n for n in os.listdir(path) if n.startswith("_")]
    formats.write_text_files(rows.where("path LIKE 'd1%'").withColumn("text", F.lit(None).cast("string")), path, overwrite=True)
    assert tree(path) == {k: "" for k in want if k.startswith("d1")}
    formats.write_text_files(rows.limit(0), path)


def test_layout_and_lists_as_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "EP1"), (2, "EP2"), (3, "EP3")], "doc_id bigint, pub_key string")
    labels = spark.createDataFrame([(1, 1, "pos"), (1, 2, "pos"), (2, 1, "pos"), (2, 2, "neg"), (3, 3, "pos")], "doc_id bigint, tag_id bigint, state string")
    tags = spark.createDataFrame([(1, "Lamps", False), (2, "lamps", False), (3, "old", True)], "tag_id bigint, name string, archived boolean")
    texts = docs.select("doc_id", F.concat(F.lit("text of "), "pub_key").alias("text"))
    layout = exports.document_layout(docs, labels, tags)
    exports.write_layout(layout, texts, str(tmp_path / "tree"))
    got = tree(tmp_path / "tree")
    assert got == {
        "Lamps/EP1/EP1.txt": "text of EP1", "lamps (2)/EP1/EP1.txt": "text of EP1", "Lamps/EP2/EP2.txt": "text of EP2", "_untagged/EP3/EP3.txt": "text of EP3",
    }
    exports.write_tag_lists(exports.tag_lists(labels, docs), str(tmp_path / "lists"))
    back = spark.read.text(str(tmp_path / "lists"))
    assert sorted((r.tag_id, r.value) for r in back.collect()) == [(1, "EP1"), (1, "EP2"), (2, "EP1"), (3, "EP3")]


def test_many_small_files(spark, tmp_path):
    """Small files are read some hundred a task, and moved by tasks, not by the driver's commit."""
    path = str(tmp_path / "t")
    rows = spark.range(3000, numPartitions=3).select(F.format_string("%d/x.txt", F.col("id") % 3000).alias("path"), F.col("id").cast("string").alias("text"))
    formats.write_text_files(rows, path)
    read = spark.read.format("text_files").load(path)
    assert 2 <= read.rdd.getNumPartitions() <= 30
    assert read.select(F.regexp_extract("path", "([0-9]+)/x.txt$", 1).alias("n"), "text").where("n = text").distinct().count() == 3000
    sizes = [len(g.places) for g in formats.grouped(formats.listed(path), formats.PARTITION_BYTES)]
    assert sum(sizes) == 3000 and max(sizes) <= formats.PARTITION_BYTES // formats.OPEN_BYTES
