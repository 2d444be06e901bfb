"""The tables of a workspace: documents, their elements, relationships and references to other documents.

Results that depend on order carry it as data: `ord` orders documents, `pos` elements and references, `rel_index` relationships.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def _texts(*names: str) -> dict[str, T.DataType]:
    return dict.fromkeys(names, T.StringType())


_LONG, _LIST = T.LongType(), T.ArrayType(T.StringType())
CHECKSUM = _struct(**_texts("algorithm", "value"))
REFERENCE = _struct(**_texts("category", "type", "locator"))

DOCUMENT = _struct(
    doc_id=T.StringType(), ord=_LONG, **_texts("model", "version", "serialization", "spdx_id", "name", "namespace", "created"), creators=_LIST, **_texts("comment", "data_license"), describes=_LIST,
    **_texts("sha1", "file_name"),
)
ELEMENT = _struct(
    doc_id=T.StringType(), pos=_LONG,
    **_texts("spdx_id", "kind", "name", "version", "purl", "supplier", "originator", "download_location", "license_concluded", "license_declared", "copyright", "purpose", "description", "comment"),
    checksums=T.ArrayType(CHECKSUM), external_refs=T.ArrayType(REFERENCE), extra_identity=T.MapType(T.StringType(), T.StringType()),
)
RELATIONSHIP = _struct(doc_id=T.StringType(), rel_index=_LONG, **_texts("type", "from_kind", "from_ref", "from_id", "to_kind", "to_ref", "to_id", "comment"))
EXT_REF = _struct(doc_id=T.StringType(), pos=_LONG, **_texts("doc_ref", "uri", "checksum_alg", "checksum_value"))
DIAGNOSTIC = _struct(doc_id=T.StringType(), seq=_LONG, **_texts("severity", "code", "message"), line=_LONG)
BINDING = _struct(**_texts("doc_id", "doc_ref", "target_doc_id"))

TABLES = {"document": DOCUMENT, "element": ELEMENT, "relationship": RELATIONSHIP, "ext_ref": EXT_REF, "diagnostic": DIAGNOSTIC, "binding": BINDING}


@dataclass(frozen=True)
class Workspace:
    """A snapshot: plans over these tables see it as it is, and changes give a new one."""

    document: DataFrame
    element: DataFrame
    relationship: DataFrame
    ext_ref: DataFrame
    diagnostic: DataFrame
    binding: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Workspace:
        return cls(**{name: spark.createDataFrame([], schema) for name, schema in TABLES.items()})

    def with_tables(self, **tables: DataFrame) -> Workspace:
        return replace(self, **tables)

    def register(self, prefix: str = "") -> None:
        """Make the tables visible to Spark SQL."""
        for name in TABLES:
            getattr(self, name).createOrReplaceTempView(prefix + name)
