"""Descriptor, properties and process files as tables; every parser also works on a text column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

# fixed values: field names a descriptor may use, per level, and what each one holds
DESCRIPTOR_FIELDS = {
    "$": {"name": "string", "resource": "string", "topology": "object", "sla": "object", "contextProperties": "object"},
    "$.topology": {"schema": "string", "instances": "int", "partitions": "int", "backupsPerPartition": "int"},
    "$.sla": {"requiresIsolation": "boolean", "zones": "array<string>", "maxInstancesPerVM": "int",
              "maxInstancesPerMachine": "int", "maxInstancesPerZone": "string"},
}
# fixed values: properties files looked for in a folder, and the layer each one feeds
SHARED_FILES = {"shared-public.properties": "shared_config", "shared-secrets.properties": "shared_secrets"}
DEFAULT_XPATH = "/process/script/environment"


def read_texts(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Whole files below ``folder`` whose name matches: (directory, file_name, text)."""
    files = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .text(folder, wholetext=True)
    )
    return files.select(
        F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]*$", 1).alias("directory"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("value").alias("text"),
    )


# --- descriptors ------------------------------------------------------------------

def unknown_fields(text: Column) -> Column:
    """Field paths a descriptor must not have."""

    def extra_at(path: str, known: Iterable[str]) -> Column:
        keys = F.json_object_keys(text if path == "$" else F.get_json_object(text, path))
        extra = F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*[F.lit(k) for k in known]))
        return F.transform(extra, lambda k: F.concat(F.lit(path + "."), k))

    return F.concat(*[extra_at(path, known) for path, known in DESCRIPTOR_FIELDS.items()])


def _scalar(kind: Column) -> Column:
    return ~kind.rlike("^(OBJECT|ARRAY)")


def _fits(value: Column, kind: Column, wanted: str) -> Column:
    """Whether a JSON value can be read as ``wanted``; ``kind`` is its own type.

    Numbers may be text, fractions are cut to whole numbers, empty text counts as no number, and any scalar is text.
    """
    text = F.try_variant_get(value, "$", "string")
    if wanted == "object":
        return kind.startswith("OBJECT")
    if wanted == "array<string>":
        items = F.try_variant_get(value, "$", "array<variant>")
        return kind.startswith("ARRAY") & F.forall(items, lambda x: x.isNull() | _scalar(F.schema_of_variant(x)))
    if wanted == "int":
        number = F.try_variant_get(value, "$", "int").isNotNull() | ((kind == "STRING") & (F.trim(text) == ""))
        return _scalar(kind) & (kind != "BOOLEAN") & number
    if wanted == "boolean":
        return kind.isin("BOOLEAN", "BIGINT") | ((kind == "STRING") & F.lower(F.trim(text)).isin("true", "false", ""))
    return _scalar(kind)


def wrong_types(whole: Column) -> Column:
    """Path and type of each descriptor field that holds something else than it should; null is always allowed."""

    def problem(path: str, wanted: str) -> Column:
        value = F.try_variant_get(whole, path, "variant")
        kind = F.schema_of_variant(value)
        # a whole text that is null is no descriptor either
        bad = ~_fits(value, kind, wanted) & (F.lit(path == "$") | (kind != "VOID"))
        return F.when(F.coalesce(bad, F.lit(False)), F.concat(F.lit(path + " is "), kind))

    fields = {"$": "object"}
    for level, known in DESCRIPTOR_FIELDS.items():
        fields.update({f"{level}.{name}": wanted for name, wanted in known.items()})
    return F.array_compact(F.array(*[problem(*field) for field in fields.items()]))


def _typed_descriptor(whole: Column) -> Column:
    def part(level: str) -> Column:
        fields = []
        for name, wanted in DESCRIPTOR_FIELDS[level].items():
            path = f"{level}.{name}"
            if path in DESCRIPTOR_FIELDS:
                kind = F.schema_of_variant(F.try_variant_get(whole, path, "variant"))
                fields.append(F.when(kind.startswith("OBJECT"), part(path)).alias(name))
            elif wanted != "object":
                fields.append(F.try_variant_get(whole, path, wanted).alias(name))
        return F.struct(*fields)

    return part("$")


def _plain_shape() -> str:
    """Pattern of the schema of a descriptor without unknown fields, with every value of the very type it should have.

    Names come in alphabetical order there. Context properties may be any scalars.
    """
    kinds = {"string": "STRING", "int": "BIGINT", "boolean": "BOOLEAN", "array<string>": "ARRAY<STRING>"}

    def level(path: str) -> str:
        fields = []
        for name, wanted in sorted(DESCRIPTOR_FIELDS[path].items()):
            inner = level(f"{path}.{name}") if f"{path}.{name}" in DESCRIPTOR_FIELDS else "OBJECT<[^<>]*>"
            fields.append(f"(?:{name}: (?:VOID|{inner if wanted == 'object' else kinds[wanted]})(?:, |(?=>)))?")
        return f"OBJECT<{''.join(fields)}>"

    return f"^{level('$')}$"


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a column that is computed once a row: later columns that use it several times cannot be merged with it."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def parse_descriptors(files: DataFrame, text: str = "text", strict: bool = True) -> DataFrame:
    """Add ``descriptor`` and ``context``; ``strict`` fails on bad JSON, wrong types and unknown fields, else ``problem`` names them.

    ``context`` keeps each property's type, because 1 and "1" are different values.
    """
    json, whole = F.col(text), F.col("_whole")
    parsed = _once(files, F.try_parse_json(json), "_whole")
    wrong, extra = wrong_types(whole), unknown_fields(json)

    def listed(title: str, paths: Column) -> Column:
        return F.when(F.size(paths) > 0, F.concat(F.lit(title), F.array_join(paths, ", ")))

    found = F.concat_ws("; ", listed("wrong types: ", F.col("_found.wrong")), listed("unknown fields: ", F.col("_found.extra")))
    problem = F.when(json.isNull(), F.lit(None)).when(whole.isNull(), F.lit("not valid JSON")).when(found != "", found)
    if strict:
        message = F.concat(problem, F.lit(" in "), json)
        problem = F.when(problem.isNotNull(), F.raise_error(message).cast("string"))
    properties = F.map_entries(F.try_variant_get(whole, "$.contextProperties", "map<string,variant>"))
    context = F.transform(properties, lambda e: F.struct(
        e["key"].alias("key"),
        F.try_variant_get(e["value"], "$", "string").alias("value"),
        F.schema_of_variant(e["value"]).alias("value_type"),
    ))
    # most texts are plain, and one look at their schema says so; numbers of ten digits may not fit
    plain = F.coalesce(F.schema_of_variant(whole).rlike(_plain_shape()) & ~json.rlike("[0-9]{10}"), F.lit(False))
    none = F.array().cast("array<string>")
    looked = F.when(plain, F.struct(none.alias("wrong"), none.alias("extra"))).otherwise(F.struct(wrong.alias("wrong"), extra.alias("extra")))
    judged = _once(_once(parsed, looked, "_found"), problem, "problem")
    read = F.when(F.col("problem").isNull() & json.isNotNull(), F.struct(_typed_descriptor(whole).alias("descriptor"), context.alias("context")))
    return _once(judged, read, "_read").select(
        *files.columns, "problem", F.col("_read.descriptor").alias("descriptor"), F.col("_read.context").alias("context"))


def read_descriptors(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """``<pu>.json`` files: (pu, descriptor, context, problem)."""
    files = read_texts(spark, folder, "*.json").withColumn("pu", F.regexp_extract("file_name", r"^(.*)\.json$", 1))
    return parse_descriptors(files, strict=strict).select("pu", "descriptor", "context", "problem")


def descriptors_of(pu: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Every PU with its descriptor; no file gives a null descriptor and a note."""
    found = descriptors.withColumn("_found", F.lit(True))
    missing = F.when(F.col("_found").isNull(), F.lit("no descriptor file"))
    return pu.join(found, "pu", "left").withColumn("problem", F.coalesce("problem", missing)).drop("_found")


def descriptor_layers(descriptors: DataFrame) -> DataFrame:
    """Context properties as layer rows: (entity, key, value, value_type)."""
    return descriptors.select(F.col("pu").alias("entity"), F.explode("context").alias("_e")).select("entity", "_e.*")


def descriptor_json(descriptor: Column, context: Column | None = None) -> Column:
    """Indented JSON without null fields, closed by CR LF; ``context`` (key, value, value_type) is written with its types."""
    if context is not None:
        def typed(e: Column) -> Column:
            quoted = F.to_json(F.array(e["value"]))
            plain = F.concat(F.lit("["), F.coalesce(e["value"], F.lit("null")), F.lit("]"))
            item = F.when(e["value_type"] == "STRING", quoted).otherwise(plain)
            return F.struct(e["key"], F.variant_get(F.parse_json(item), "$[0]", "variant"))

        properties = F.map_from_entries(F.transform(context, typed))
        descriptor = F.when(descriptor.isNotNull(), descriptor.withField("contextProperties", properties))
    return F.concat(F.to_json(descriptor, {"pretty": "true", "ignoreNullFields": "true"}), F.lit("\r\n"))


# --- properties -------------------------------------------------------------------

_BLANK = r"[ \t\f]*+"
# a comment line, or an entry with its continuation lines
_LOGICAL_LINE = (
    r"(?:^|\n)" + _BLANK + r"(?:[#!][^\n]*+|(?:[^\\\n]++|\\[^\n]|\\\n" + _BLANK + r"|\\(?![\s\S]))*+)"
)
_ENTRY = r"(?s)^((?:[^\\=: \t\f]++|\\.)*+)" + _BLANK + r"[=:]?+" + _BLANK + r"(.*)$"


def _unescaped(text: Column) -> Column:
    r"""Resolve \t \n \r \f \uXXXX; a backslash before any other character is dropped."""
    kept = F.regexp_replace(text, r"(\\[tnrfu\\])|\\(.|$)", "$1$2")
    quoted = F.concat(F.lit('["'), F.replace(kept, F.lit('"'), F.lit('\\"')), F.lit('"]'))
    value = F.get(F.from_json(quoted, "array<string>", {"allowUnquotedControlChars": "true"}), F.lit(0))
    return F.coalesce(value, F.raise_error(F.concat(F.lit("bad escape in properties text: "), text)).cast("string"))


def parse_properties(files: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text column by ``key`` and ``value``, one row per entry; a repeated key keeps its last value."""
    kept = [c for c in files.columns if c != text]
    body = F.regexp_replace(F.col(text), "\r\n?", "\n")
    lines = F.transform(
        F.regexp_extract_all(body, F.lit(_LOGICAL_LINE), 0),
        # what is left of a line feed now joins a continuation line
        lambda line: F.regexp_replace(F.regexp_replace(line, r"^\n?[ \t\f]*", ""), r"\\\n[ \t\f]*", ""),
    )
    entries = F.filter(lines, lambda line: (line != "") & ~line.rlike("^[#!]"))
    return (
        files.select(*kept, F.posexplode(entries).alias("_position", "_line"))
        .select(
            *kept, "_position",
            _unescaped(F.regexp_extract("_line", _ENTRY, 1)).alias("key"),
            _unescaped(F.regexp_extract("_line", _ENTRY, 2)).alias("value"),
        )
        .groupBy(*kept, "key")
        .agg(F.max_by("value", "_position").alias("value"))
    )


def read_shared_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Both shared files of every directory below ``folder``: (directory, layer_name, key, value, is_secret)."""
    names = F.create_map(*[F.lit(x) for pair in SHARED_FILES.items() for x in pair])
    files = (
        read_texts(spark, folder, "*.properties")
        .withColumn("layer_name", F.try_element_at(names, F.col("file_name")))
        .where("layer_name IS NOT NULL")
        .select("directory", "layer_name", "text")
    )
    return parse_properties(files).withColumn("is_secret", F.col("layer_name") == "shared_secrets")


# --- process files ----------------------------------------------------------------

def xml_text(xml: Column, xpath: str = DEFAULT_XPATH) -> Column:
    """Text of the first match, empty when nothing matches."""
    return F.xpath_string(xml, F.lit(xpath))


def read_process_files(spark: SparkSession, folder: str, drop: str, xpath: str = DEFAULT_XPATH) -> DataFrame:
    """``*.xml`` files with their text at ``xpath`` and its JVM arguments without the placeholder ``drop``."""
    files = read_texts(spark, folder, "*.xml")
    return files.select("directory", "file_name", xml_text(F.col("text"), xpath).alias("environment")).withColumn(
        "jvm_args", X.filter_jvm_args(F.col("environment"), drop)
    )
