"""Tables in and out: declared schemas, forgiving headers, snapshots that are swapped in whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Declared schemas of the directory's tables; a reader never infers one.
SCHEMAS = {
    "companies": "id string, slug string, name string, sector string, sectorFull string, city string, state string, postcode string, suburb string, "
    "address string, lat double, lng double, website string, blurb string, stage string, hiring boolean, verified boolean, founders array<string>, "
    "investors array<string>, cohorts array<string>, tech_stack array<string>, foundedYear int, team_size int, remote_policy string, company_status string, "
    "hiring_status string, hiring_verified_at string, last_funding_date string, last_role_seen_at string, last_verified_at string, show_on_map boolean",
    "sources": "id string, kind string, url string, title string, publisher string, retrieved_at string, note string",
    "evidence": "id string, company_id string, field string, value variant, source_id string, confidence string, verified_at string, status string, note string",
    "identifiers": "id string, company_id string, scheme string, value string, source_id string, note string",
    "jobs": "id string, company_id string, title string, location string, employment_type string, remote boolean, posted_at string, apply_url string, "
    "status string, source_id string, provider string, external_id string, canonical_url string, first_seen_at string, last_confirmed_at string, "
    "absent_reads int, status_changed_at string, locations array<string>, workplace_type string, team string",
    "investors": "id string, name string, slug string, status string, website string, aliases array<string>, stages array<string>, sectors array<string>, "
    "cheque_min double, cheque_max double, currency string",
    "investments": "id string, investor_organisation_id string, company_id string, round string, investment_date string, amount double, currency string, "
    "source_id string, verification_status string",
}


def read_json(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of JSON arrays, with `_pos`, the row's place in the file; an empty table where there is no file."""
    schema = T.StructType.fromDDL(SCHEMAS[name])
    try:
        df = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/{name}.json")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df = spark.createDataFrame([], schema)
    return df.withColumn("_pos", F.monotonically_increasing_id())


def read_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_json(spark, folder, name) for name in SCHEMAS}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header: quotes, doubled quotes, line feeds in cells; all columns are text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def rename_by_synonyms(rows: DataFrame, synonyms: dict[str, tuple[str, ...]]) -> tuple[DataFrame, list[str]]:
    """Columns under their own names, whichever synonym a file uses, and the columns that none claims.

    Of several synonyms in a file the first non-empty cell counts.
    """
    plain = {"".join(c for c in name.lower() if c.isalnum()): name for name in rows.columns}
    used, out = set(), []
    for target, names in synonyms.items():
        found = [plain[k] for k in ("".join(c for c in n.lower() if c.isalnum()) for n in (target, *names)) if k in plain]
        used.update(found)
        cells = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in dict.fromkeys(found)]
        out.append((F.coalesce(*cells) if cells else F.lit(None).cast("string")).alias(target))
    return rows.select(*out), [c for c in rows.columns if c not in used]


def records_of(lines: DataFrame, column: str, path: str, fields: dict[str, str]) -> DataFrame:
    """Records of a JSON answer: the array at `path`, with fields by their own paths ('a.b')."""
    dotted = lambda p: "$." + p if p else "$"
    rows = lines.select(F.explode(F.try_variant_get(F.try_parse_json(column), dotted(path), "array<variant>")).alias("r"))
    return rows.select(*[F.try_variant_get("r", dotted(p), "string").alias(k) for k, p in fields.items()])


def write_snapshot(tables: dict[str, DataFrame], folder: str, version: str) -> str:
    """All tables under a folder of the version; readers that hold another version are not disturbed."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{version}/{name}")
    return f"{folder}/{version}"


def empty_like(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromDDL(SCHEMAS[name]))
