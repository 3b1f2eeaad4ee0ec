"""Table schemas, enumerations and additive migration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the enumerations of the data model
SOURCE_TYPES = ("url", "pasted", "file", "transcript")
STATUSES = ("pending", "kept", "partial", "discarded")
SNIPPET_KINDS = ("excerpt", "synthesis", "rejection")
ENTITY_KINDS = ("self", "person", "pet", "vehicle", "place", "org", "thing")


_KINDS = {"BIGINT": T.LongType(), "STRING": T.StringType(), "TIMESTAMP": T.TimestampType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "ARRAY<FLOAT>": T.ArrayType(T.FloatType())}


def _table(spec: str) -> T.StructType:
    """A schema from `name TYPE [NOT NULL], ...`, without a session."""
    fields = (f.split(maxsplit=2) for f in spec.split(", "))
    return T.StructType([T.StructField(name, _KINDS[kind], not rest) for name, kind, *rest in fields])


DOCUMENTS = _table(
    "id BIGINT NOT NULL, url STRING, title STRING, source_type STRING NOT NULL, ingested_at TIMESTAMP NOT NULL, raw_text STRING NOT NULL, "
    "structured_text STRING, agent_summary STRING, status STRING NOT NULL, source_metadata STRING"
)
SNIPPETS = _table(
    "id BIGINT NOT NULL, document_id BIGINT NOT NULL, content STRING NOT NULL, kind STRING NOT NULL, chunk_index INT, tags STRING, "
    "created_at TIMESTAMP NOT NULL, embedding ARRAY<FLOAT>, embedding_model STRING"
)
ENTITIES = _table("id BIGINT NOT NULL, name STRING NOT NULL, kind STRING NOT NULL, relation STRING, full_name STRING, aliases STRING, note STRING, created_at TIMESTAMP NOT NULL")
OBSERVATIONS = _table("id BIGINT NOT NULL, entity_id BIGINT NOT NULL, attribute STRING, value STRING, body STRING, source STRING, observed_at TIMESTAMP NOT NULL, superseded BOOLEAN NOT NULL")
SEARCH_RESULT = _table(
    "snippet_id BIGINT, document_id BIGINT, kind STRING, content STRING, chunk_index INT, document_title STRING, document_url STRING, "
    "ingested_at TIMESTAMP, context_before STRING, context_after STRING, score DOUBLE"
)
TABLES = {"documents": DOCUMENTS, "snippets": SNIPPETS, "entities": ENTITIES, "observations": OBSERVATIONS}
DEFAULTS = {"status": "pending", "kind": "excerpt", "superseded": False}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def migrate(df: DataFrame, name: str) -> DataFrame:
    """Add the table's missing columns, as null or as their default; keep what is there."""
    missing = [f for f in TABLES[name].fields if f.name not in df.columns]
    return reduce(lambda d, f: d.withColumn(f.name, F.lit(DEFAULTS.get(f.name)).cast(f.dataType)), missing, df)


def create_store(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Open the store's tables under a folder, creating the missing ones empty."""
    tables = {}
    for name, schema in TABLES.items():
        path = f"{root}/{name}"
        try:
            tables[name] = migrate(spark.read.parquet(path), name)
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            empty(spark, name).write.mode("ignore").parquet(path)
            tables[name] = spark.read.schema(schema).parquet(path)
    return tables
