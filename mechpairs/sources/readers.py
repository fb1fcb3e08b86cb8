"""Readers and writers of the library's file forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt"
# Property sources by rank, the two spellings of one measured property.
SOURCE_RANK = {"ChemAxon": 2, "ALOGPS": 1}
MEASURED = {"logp": "exp_logp", "logp/hydrophobicity": "exp_logp", "logs": "exp_logs", "melting point": "exp_melting_point", "boiling point": "exp_boiling_point", "water solubility": "exp_water_solubility"}
ROLES = ("targets", "enzymes", "transporters", "carriers")

ENTITY_SCHEMA = """`drugbank-id` array<struct<_VALUE: string, _primary: boolean>>, name string,
synonyms struct<synonym: array<string>>, `international-brands` struct<`international-brand`: array<struct<name: string>>>,
`drug-interactions` struct<`drug-interaction`: array<struct<`drugbank-id`: string, name: string, description: string>>>,
`external-identifiers` struct<`external-identifier`: array<struct<resource: string, identifier: string>>>,
`calculated-properties` struct<property: array<struct<kind: string, value: string, source: string>>>,
`experimental-properties` struct<property: array<struct<kind: string, value: string, source: string>>>,
pathways struct<pathway: array<struct<`smpdb-id`: string, name: string, category: string>>>,
""" + ", ".join(f"{r} struct<{r[:-1]}: array<struct<id: string, name: string, actions: struct<action: array<string>>>>>" for r in ROLES)


def read_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """JSON lines with a declared schema; a bad line fails the job, or (lenient) is left out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The lines that ``read_jsonl`` leaves out when lenient."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", StructType([*schema.fields, StructField(CORRUPT, StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.where(parsed[CORRUPT].isNotNull()).select("value")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("errorifexists").partitionBy(*(partition_by or [])).parquet(path)


def read_csv_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several CSV files with headers as one; header names trimmed and lower-cased, by name."""
    out = None
    for p in paths:
        df = spark.read.option("header", True).csv(p)
        df = df.toDF(*(c.strip().lower() for c in df.columns))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_links(spark: SparkSession, path: str, left: str, right: str) -> DataFrame:
    """Two tab-separated columns, prefixes such as ``dr:`` or ``path:`` stripped."""
    rows = spark.read.option("sep", "\t").schema("a string, b string").csv(path)
    return rows.select(F.regexp_replace("a", "^[a-z]+:", "").alias(left), F.regexp_replace("b", "^[a-z]+:", "").alias(right)).where(f"{left} is not null and {right} is not null")


def read_manifest(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(pair_id, split) from parquet, one JSON object of id lists, or JSON lines."""
    if kind == "parquet":
        return spark.read.parquet(path).select("pair_id", "split")
    if kind == "json":
        whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("split", "ids"))
        return whole.select(F.explode("ids").alias("pair_id"), "split")
    return spark.read.schema("pair_id string, split string").json(path).where("pair_id is not null")


def restricted(rows: DataFrame, manifest: DataFrame, section: str) -> DataFrame:
    return rows.join(manifest.where(F.col("split") == section).select("pair_id"), "pair_id", "left_semi")


def content_digest(df: DataFrame) -> DataFrame:
    """(n, digest): a digest of a table's rows whatever their order: sums of the four
    parts of each row's SHA-256."""
    names = sorted(df.columns)
    h = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(h, 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)") for k in range(4)]
    sums = [F.sum(p).cast("decimal(38,0)").cast("string") for p in parts]
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256).alias("digest"))


def count_gate(counts: dict[str, DataFrame], want: dict[str, int]) -> DataFrame:
    """(name, n, wanted, ok) of each table."""
    out = None
    for name, df in counts.items():
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.lit(want[name]).cast("long").alias("wanted"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("ok", F.col("n") == F.col("wanted"))


def adapt_flat(rows: DataFrame) -> DataFrame:
    """Flat records (pair_id, family, subtype, direction_tag, rationale) as a trace of one
    step and a final prediction; the direction defaults to bidirectional."""
    step = F.struct(F.lit(1).alias("step_id"), F.lit("conclusion").alias("role"), F.coalesce("rationale", F.lit("")).alias("claim"), F.array().cast("array<string>").alias("evidence_ids"))
    final = F.struct("family", "subtype", F.coalesce("direction_tag", F.lit("bidirectional")).alias("direction_tag"), F.col("family").isNull().alias("abstain"))
    return rows.select("pair_id", F.struct(F.array(step).alias("steps"), final.alias("final_answer")).alias("trace"), final.alias("final_prediction"))


def read_entities(spark: SparkSession, path: str, tag: str = "drug") -> DataFrame:
    """One row for each outermost ``tag`` of an XML file, with ``entity_id``: the id
    marked primary, else the first; rows without an id are left out."""
    rows = spark.read.format("xml").option("rowTag", tag).schema(ENTITY_SCHEMA).load(path)
    ids = F.col("drugbank-id")
    first = F.coalesce(F.get(F.filter(ids, lambda i: i["_primary"]), F.lit(0))["_VALUE"], F.get(ids, F.lit(0))["_VALUE"])
    return rows.withColumn("entity_id", first).where("entity_id is not null")


def entity_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The long child tables of ``read_entities``, each with its own rule on nulls."""
    def items(parent: str, child: str) -> Column:
        return F.col(f"`{parent}`")[child]

    inter = rows.select("entity_id", "name", F.inline(items("drug-interactions", "drug-interaction"))).toDF("a_id", "a_name", "b_id", "b_name", "description")
    proteins = None
    for role in ROLES:
        part = rows.select("entity_id", F.lit(role).alias("role"), F.inline(items(role, role[:-1]))).select("entity_id", "role", F.col("id").alias("protein_id"), F.col("name").alias("protein_name"), F.col("actions.action").alias("actions"))
        proteins = part if proteins is None else proteins.unionByName(part)
    return {
        "interactions": inter.where("b_id is not null and description is not null"), "proteins": proteins.where("protein_id is not null"),
        "xref": rows.select("entity_id", F.inline(items("external-identifiers", "external-identifier"))).where("resource is not null and identifier is not null"),
        "pathways": rows.select("entity_id", F.inline(items("pathways", "pathway"))).withColumnRenamed("smpdb-id", "pathway_id"),
        "synonyms": rows.select("entity_id", F.explode(items("synonyms", "synonym")).alias("synonym")).where("synonym is not null"),
        "brands": rows.select("entity_id", F.explode(items("international-brands", "international-brand")).alias("b")).select("entity_id", F.col("b.name").alias("brand")).where("brand is not null"),
    }


def pivot_properties(long: DataFrame, kinds: list[str]) -> DataFrame:
    """``long(entity_id, kind, value, source, pos)`` as one column for each kind: the value
    of the highest source, the later one on a tie."""
    rank = F.lit(0)
    for name, k in SOURCE_RANK.items():
        rank = F.when(F.col("source") == name, k).otherwise(rank)
    best = long.groupBy("entity_id", "kind").agg(F.max_by("value", F.struct(rank, F.col("pos"))).alias("v"))
    return best.groupBy("entity_id").pivot("kind", kinds).agg(F.first("v"))


def measured_properties(long: DataFrame) -> DataFrame:
    """Measured properties under their names, the last value of each."""
    name = F.lit(None).cast("string")
    for k, v in MEASURED.items():
        name = F.when(F.lower("kind") == k, v).otherwise(name)
    kept = long.withColumn("name", name).where("name is not null").groupBy("entity_id", "name").agg(F.max_by("value", "pos").alias("v"))
    return kept.groupBy("entity_id").pivot("name", sorted(set(MEASURED.values()))).agg(F.first("v"))


def aliases(entities: DataFrame, synonyms: DataFrame, brands: DataFrame) -> DataFrame:
    """(entity_id, aliases): name, synonyms and international brands, trimmed, distinct,
    longest first and then by text."""
    names = entities.select("entity_id", F.col("name").alias("a")).unionByName(synonyms.select("entity_id", F.col("synonym").alias("a"))).unionByName(brands.select("entity_id", F.col("brand").alias("a")))
    rows = names.select("entity_id", F.trim("a").alias("a")).where("a <> ''").distinct()
    packed = rows.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("a")).alias("l"), "a"))).alias("x"))
    return packed.select("entity_id", F.transform("x", lambda x: x["a"]).alias("aliases"))


def normalized_template(text: Column, subject: Column, obj: Column) -> Column:
    """``text`` with every alias of the subject as ``<A>`` and of the object as ``<B>``, the
    longest of both first (the subject's on a tie), whole names only; white space collapsed.
    ``subject`` and ``obj`` are alias lists."""
    def tagged(names: Column, tag: str, side: int) -> Column:
        return F.transform(names, lambda a: F.struct((-F.length(a)).alias("l"), F.lit(side).alias("s"), a.alias("a"), F.lit(tag).alias("t")))

    ordered = F.array_sort(F.concat(tagged(subject, "<A>", 0), tagged(obj, "<B>", 1)))
    hits = F.filter(ordered, lambda x: F.contains(text, x["a"]))

    def swap(t: Column, x: Column) -> Column:
        return F.regexp_replace(t, F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), x["a"], F.lit(r"\E(?![A-Za-z0-9])")), x["t"])

    return F.trim(F.regexp_replace(F.aggregate(hits, text, swap), r"\s+", " "))


def cross_references(xref: DataFrame, links: DataFrame, resource: str, source: str) -> DataFrame:
    """(entity_id, source, pathway_id) over the last identifier that an entity has in a
    resource (``xref(entity_id, resource, identifier, pos)``, ``links(identifier, pathway_id)``)."""
    last = xref.where(F.col("resource") == resource).groupBy("entity_id").agg(F.max_by("identifier", "pos").alias("identifier"))
    return last.join(links, "identifier").select("entity_id", F.lit(source).alias("source"), "pathway_id").distinct()


def resolve_names(rows: DataFrame, entities: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``rows(name_a, name_b, level)`` with ids by name, else by synonym (the first entity
    that has it, ``ord``), and how the match went."""
    named = entities.select(F.lower("name").alias("k"), "entity_id", F.lit(0).alias("kind"), "ord").unionByName(synonyms.select(F.lower("synonym").alias("k"), "entity_id", F.lit(1).alias("kind"), "ord"))
    best = named.groupBy("k").agg(F.min_by("entity_id", F.struct("kind", "ord")).alias("id"))
    a, b = (best.select(F.col("k").alias(f"k_{s}"), F.col("id").alias(f"id_{s}")) for s in "ab")
    out = rows.withColumns({"k_a": F.lower(F.trim("name_a")), "k_b": F.lower(F.trim("name_b"))}).join(a, "k_a", "left").join(b, "k_b", "left")
    how = F.when(F.col("id_a").isNull() & F.col("id_b").isNull(), "none").when(F.col("id_a").isNull(), "only_b").when(F.col("id_b").isNull(), "only_a").when(F.col("id_a") == F.col("id_b"), "same").otherwise("both")
    return out.select("name_a", "name_b", "level", "id_a", "id_b", how.alias("outcome"))


def severity(resolved: DataFrame) -> DataFrame:
    """Worst level of each unordered pair: Major, Moderate, Minor, Unknown."""
    rank = F.when(F.col("level") == "Major", 3).when(F.col("level") == "Moderate", 2).when(F.col("level") == "Minor", 1).otherwise(0)
    rows = resolved.where("outcome = 'both'").select(F.least("id_a", "id_b").alias("a_id"), F.greatest("id_a", "id_b").alias("b_id"), rank.alias("r"))
    names = F.array(*map(F.lit, ("Unknown", "Minor", "Moderate", "Major")))
    return rows.groupBy("a_id", "b_id").agg(F.max("r").alias("r")).select(F.concat_ws("|", "a_id", "b_id").alias("pair_id"), F.get(names, F.col("r")).alias("level"))
