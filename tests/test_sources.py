"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from mechpairs.sources import readers

XML = """<drugbank><drug><drugbank-id>DB9</drugbank-id><drugbank-id primary="true">DB1</drugbank-id><name>Alpha</name><synonyms><synonym>Al</synonym></synonyms>
<international-brands><international-brand><name>Alphax</name></international-brand></international-brands>
<drug-interactions><drug-interaction><drugbank-id>DB2</drugbank-id><name>Beta</name><description>Alpha and Beta meet.</description></drug-interaction><drug-interaction><drugbank-id>DB3</drugbank-id></drug-interaction></drug-interactions>
<pathways><pathway><smpdb-id>S1</smpdb-id><name>P</name><drugs><drug><drugbank-id>DB7</drugbank-id></drug></drugs></pathway></pathways>
<enzymes><enzyme><id>E1</id><name>CYP</name><actions><action>inhibitor</action></actions></enzyme></enzymes></drug>
<drug><drugbank-id>DB2</drugbank-id><name>Beta</name></drug><drug><name>NoId</name></drug></drugbank>"""


def test_nested_xml(spark, tmp_path):
    (tmp_path / "x.xml").write_text(XML)
    rows = readers.read_entities(spark, f"file://{tmp_path}/x.xml")
    assert sorted(r.entity_id for r in rows.collect()) == ["DB1", "DB2"]
    t = readers.entity_tables(rows)
    assert [tuple(r) for r in t["interactions"].collect()] == [("DB1", "Alpha", "DB2", "Beta", "Alpha and Beta meet.")]
    assert [(r.role, r.protein_id, r.actions) for r in t["proteins"].collect()] == [("enzymes", "E1", ["inhibitor"])]
    assert t["pathways"].first().pathway_id == "S1"
    assert {r.entity_id: r.aliases for r in readers.aliases(rows, t["synonyms"], t["brands"]).collect()} == {"DB1": ["Alphax", "Alpha", "Al"], "DB2": ["Beta"]}


def test_template_takes_longest_alias_first(spark):
    df = spark.createDataFrame([("Alpha acid  raises Beta, not Betamax.", ["Alpha acid", "Alpha"], ["Beta"])], "t string, a array<string>, b array<string>")
    assert df.select(readers.normalized_template(F.col("t"), F.col("a"), F.col("b")).alias("x")).first().x == "<A> raises <B>, not Betamax."


def test_json_lines_strict_and_lenient(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\nbroken\n{"id": 2}\n')
    schema, path = StructType([StructField("id", LongType()), StructField("t", StringType())]), f"file://{tmp_path}/a.jsonl"
    assert sorted(r.id for r in readers.read_jsonl(spark, path, schema, strict=False).collect()) == [1, 2]
    assert [r.value for r in readers.bad_lines(spark, path, schema).collect()] == ["broken"]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.read_jsonl(spark, path, schema).collect()
    readers.write_jsonl(spark.range(3), f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 3


def test_csv_links_and_manifests(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name_A, Level\nx,Major\n")
    (tmp_path / "b.csv").write_text(" level,name_a\nMinor,y\n")
    got = readers.read_csv_union(spark, [f"file://{tmp_path}/a.csv", f"file://{tmp_path}/b.csv"]).select("name_a", "level").collect()
    assert sorted(map(tuple, got)) == [("x", "Major"), ("y", "Minor")]
    (tmp_path / "l.tsv").write_text("dr:D1\tpath:hsa1\n")
    assert tuple(readers.read_links(spark, f"file://{tmp_path}/l.tsv", "drug", "pathway").first()) == ("D1", "hsa1")
    (tmp_path / "m.json").write_text(json.dumps({"train": ["a|b"], "test": ["c|d", "e|f"]}))
    rows = readers.read_manifest(spark, f"file://{tmp_path}/m.json", "json")
    assert rows.where("split = 'test'").count() == 2
    readers.write_table(rows, f"file://{tmp_path}/m.parquet", ["split"])
    assert sorted(map(tuple, readers.read_manifest(spark, f"file://{tmp_path}/m.parquet", "parquet").collect())) == [("a|b", "train"), ("c|d", "test"), ("e|f", "test")]


def test_digest_ignores_order_and_sees_changes(spark):
    a = spark.range(100).withColumn("x", F.col("id") % 7)
    one, two = readers.content_digest(a).first(), readers.content_digest(a.repartition(5).select("x", "id")).first()
    assert one == two and readers.content_digest(a.withColumn("x", F.col("x") + 1)).first().digest != one.digest


def test_properties_and_severity(spark):
    long = spark.createDataFrame([("e", "logP", "1", "ALOGPS", 0), ("e", "logP", "2", "ChemAxon", 1), ("e", "logP", "3", "ChemAxon", 2), ("e", "logS", "9", None, 3)], "entity_id string, kind string, value string, source string, pos int")
    assert readers.pivot_properties(long, ["logP", "pKa"]).first().asDict() == {"entity_id": "e", "logP": "3", "pKa": None}
    assert readers.measured_properties(long).first().exp_logp == "3"
    ent = spark.createDataFrame([("D1", "Alpha", 1), ("D2", "Beta", 2)], "entity_id string, name string, ord int")
    syn = spark.createDataFrame([("D1", "Beta", 0), ("D2", "Bee", 1)], "entity_id string, synonym string, ord int")
    rows = spark.createDataFrame([("alpha", "BEE", "Minor"), ("Beta", "Alpha", "Major"), ("x", "y", "Major"), ("Alpha", "y", "Minor")], "name_a string, name_b string, level string")
    done = readers.resolve_names(rows, ent, syn)
    assert sorted(r.outcome for r in done.collect()) == ["both", "both", "none", "only_a"]
    assert tuple(readers.severity(done).first()) == ("D1|D2", "Major")
