"""Schemas that drift between the successive files of a feed: every change listed, all rows in one consistent table.

Each file gets a fingerprint: which field stands there under which name and with which JSON type. Fingerprints come from
one map-side combined aggregation over (feed, file, name), so rows are never gathered by feed; all further steps work on
these summaries. A run of equal fingerprints is one version of the feed's schema. Versions follow each other by explicit
steps - added, removed, renamed, retyped - which are a table (``migration_steps``) and the report of all changes. How rows
are read is a table too (``reading_steps``): rename to the field, default where the version lacks it, cast and factor of
the unit. Every row is routed through the steps of its own file's version, in place: no row is moved or taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.common import NULL_TOKENS, fresh, lookup_join
from roadloom.functions.scalars import parse_boolean
from roadloom.schema import ALIASES, KILOMETRE_NAMES, field_keys, loose
from roadloom.session import cut_lineage

_FILE = ["feed", "file_seq"]

#: Fields with a column of their own in ``whole_table``; every other field of a row stands in its map.
WIDE_FIELDS = (*ALIASES, "BinViewerVersion", "tsdSlope2000", "compositeModulus200")
#: How fields are cast; all others stay text. Times do too: feeds name no zone and no order of day and month.
CASTS = {"Chainage": "metres", "StartChainage": "number", "EndChainage": "number", "Ignore": "flag", "tsdSlope2000": "number", "compositeModulus200": "number"}
_NUMBER_TYPES = "^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"
_NUMBER = r"^([+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:[.][0-9]+)?(?:[eE][+-]?[0-9]{1,3})?) ?([kK]?[mM])?$"


def field_of(name: Column) -> Column:
    """The field that a name stands for: that of an alias without case, blanks, ``_`` and ``-``, else the bare name itself."""
    key = F.lower(F.regexp_replace(name, r"[\s_-]", ""))
    table = F.create_map(*[F.lit(x) for pair in field_keys().items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key)


def json_pairs(df: DataFrame, payload: str = "payload") -> DataFrame:
    """``df`` exploded to one row per key of its JSON objects: ``name``, ``kind`` (string, number, boolean, other, null), ``value``."""
    parsed = df.withColumn("__json", F.try_parse_json(F.col(payload)))
    kind = F.schema_of_variant("__value")
    typed = (
        F.when(kind == "VOID", F.lit(None))
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.rlike(_NUMBER_TYPES), "number")
        .otherwise("other")
    )
    parsed = parsed.where(F.schema_of_variant("__json").startswith("OBJECT"))
    pairs = parsed.lateralJoin(spark_variant_explode(df))
    return pairs.select(*df.columns, F.col("__key").alias("name"), typed.alias("kind"), F.try_variant_get("__value", "$", "string").alias("value"))


def spark_variant_explode(df: DataFrame) -> DataFrame:
    return df.sparkSession.tvf.variant_explode(F.col("__json").outer()).toDF("__pos", "__key", "__value")


def file_names(df: DataFrame) -> DataFrame:
    """(feed, file_seq, name, kind, n, field): how often each file has each name with each JSON type. All else is made from this.

    One map-side combined aggregation. Rows without feed or number of file have no place in a sequence and are left out.
    """
    rows = df.where("feed is not null and file_seq is not null").select(*_FILE, "payload")
    names = json_pairs(rows).groupBy(*_FILE, "name", "kind").agg(F.count(F.lit(1)).alias("n"))
    return names.withColumn("field", field_of(F.col("name")))


def _versions_of(names: DataFrame) -> DataFrame:
    by_name = names.groupBy(*_FILE, "field", "name").agg(F.sum("n").alias("n"))
    named = by_name.groupBy(*_FILE, "field").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("name"), F.sum("n").alias("n"))
    by_kind = names.where("kind is not null").groupBy(*_FILE, "field", "kind").agg(F.sum("n").alias("n"))
    kinds = by_kind.groupBy(*_FILE, "field").agg(F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("kind"))
    return named.join(kinds, [*_FILE, "field"], "left").select(*_FILE, "field", "name", "kind", "n")


def schema_versions(df: DataFrame) -> DataFrame:
    """(feed, file_seq, field, name, kind, n): the schema of every file.

    A file has the fields that any of its rows has. Where a field stands under several names in one file, the most used
    name counts (ties: the first by alphabet), and likewise its kind; a field that is null throughout has no kind. Rows
    without feed or number of file are left out; payloads that are no JSON object have no fields. Duplicate rows change
    nothing but counts.
    """
    return _versions_of(file_names(df))


def _files(df: DataFrame) -> DataFrame:
    return df.where("feed is not null and file_seq is not null").select(*_FILE).distinct()


def _fingerprints_of(schemas: DataFrame, files: DataFrame) -> DataFrame:
    entry = F.struct("field", "name", "kind")
    every = files.join(schemas, _FILE, "left")
    prints = every.groupBy(*_FILE).agg(F.md5(F.to_json(F.sort_array(F.collect_list(F.when(F.col("field").isNotNull(), entry))))).alias("fingerprint"))
    w = W.partitionBy("feed").orderBy("file_seq")
    fresh_one = F.when(F.lag("fingerprint").over(w).eqNullSafe(F.col("fingerprint")), 0).otherwise(1)
    return prints.withColumn("__new", fresh_one).withColumn("version", F.sum("__new").over(w).cast("int")).select(*_FILE, "version", "fingerprint")


def version_fingerprints(df: DataFrame) -> DataFrame:
    """(feed, file_seq, version, fingerprint): files of a feed with the same names and kinds in a row share a version; one without fields is a version too."""
    return _fingerprints_of(schema_versions(df), _files(df))


def migration_steps(df: DataFrame) -> DataFrame:
    """(feed, version, file_seq, field, change, old_name, new_name, old_kind, new_kind): what leads from each version of a feed to the next.

    ``file_seq`` is the first file of the version. ``added`` and ``removed`` (the other name empty), ``renamed`` (same field,
    other name), ``retyped`` (both names the present one: its kind differs from that in the last earlier version where it
    had any). Only versions are compared, not files: as long as the fingerprint stays the same nothing has changed. The
    first version has no steps.
    """
    schemas = cut_lineage(schema_versions(df))
    versions = _fingerprints_of(schemas, _files(df)).groupBy("feed", "version").agg(F.min("file_seq").alias("file_seq"))
    versions = cut_lineage(versions)
    fields = versions.join(schemas, _FILE).select("feed", "version", "field", "name", "kind")
    before = fields.select("feed", (F.col("version") + 1).alias("version"), "field", F.col("name").alias("old"), F.col("kind").alias("old_kind"))
    both = before.join(fields.withColumnsRenamed({"name": "new", "kind": "new_kind"}), ["feed", "version", "field"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "renamed")
    named = both.select("feed", "version", "field", change.alias("change"), F.coalesce("old", F.lit("")).alias("old_name"), F.coalesce("new", F.lit("")).alias("new_name"), "old_kind", "new_kind")
    last = F.lag("kind").over(W.partitionBy("feed", "field").orderBy("version"))
    typed = fields.where("kind is not null").withColumn("old_kind", last).where("old_kind <> kind")
    retyped = typed.select("feed", "version", "field", F.lit("retyped").alias("change"), F.col("name").alias("old_name"), F.col("name").alias("new_name"), "old_kind", F.col("kind").alias("new_kind"))
    steps = named.where("change is not null and version > 1").unionByName(retyped)
    return steps.join(versions, ["feed", "version"]).select("feed", "version", "file_seq", "field", "change", "old_name", "new_name", "old_kind", "new_kind")


def schema_changes(df: DataFrame) -> DataFrame:
    """(feed, file_seq, change, old_name, new_name): every change of a file against the one before it in its feed, from ``migration_steps``."""
    return migration_steps(df).select(*_FILE, "change", "old_name", "new_name")


def _field_key(field: str) -> str:
    """The name that ``field_of`` gives to a field."""
    return field_keys().get(loose(field), loose(field))


def _rule(name: Column, casts: dict[str, str]) -> Column:
    """How a name is read: the field it stands for, the cast, and the exponent of ten (3 for chainages under a name in kilometres, else 0)."""
    field = field_of(name)
    labels = F.create_map(*[F.lit(x) for f in WIDE_FIELDS for x in (_field_key(f), f)])
    label = F.coalesce(F.try_element_at(labels, field), field)
    cast = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in casts.items() for x in p]), field), F.lit("text")) if casts else F.lit("text")
    far = (field == "Chainage") & F.lower(F.regexp_replace(name, r"[\s_-]", "")).isin(*{loose(n) for n in KILOMETRE_NAMES})
    return F.struct(label.alias("field"), cast.alias("cast"), F.when(far, 3).otherwise(0).alias("exponent"))


def reading_steps(df: DataFrame, casts: dict[str, str] = CASTS, defaults: dict[str, str] | None = None) -> DataFrame:
    """(feed, version, field, old_name, new_name, default, cast, exponent): how each version of each feed is read.

    One row per name that stands in a file of the version: it is renamed to ``new_name``, cast, and multiplied by ten to
    the ``exponent``. One row without ``old_name`` per field of ``defaults`` that no file of the version has. Steps lead
    from a version straight to the one common schema: through the versions between, renames and factors would cancel out,
    and a field removed later would be lost on the way.
    """
    names = cut_lineage(file_names(df))
    return _steps_of(names, _fingerprints_of(_versions_of(names), _files(df)), casts, defaults)


def _steps_of(names: DataFrame, versions: DataFrame, casts: dict[str, str], defaults: dict[str, str] | None) -> DataFrame:
    found = names.select(*_FILE, "name").join(versions.drop("fingerprint"), _FILE).select("feed", "version", "name").distinct()
    steps = found.withColumn("rule", _rule(F.col("name"), casts)).select(
        "feed", "version", F.col("rule.field").alias("field"), F.col("name").alias("old_name"), F.col("rule.field").alias("new_name"),
        F.lit(None).cast("string").alias("default"), "rule.cast", "rule.exponent",
    )
    for field, default in (defaults or {}).items():
        has = steps.where(F.col("old_name").isNotNull()).groupBy("feed", "version").agg(F.max(F.col("field") == field).alias("__has"))
        every = versions.select("feed", "version").distinct()
        lacking = every.join(has, ["feed", "version"], "left").where(~F.coalesce("__has", F.lit(False)))
        added = lacking.select(
            "feed", "version", F.lit(field).alias("field"), F.lit(None).cast("string").alias("old_name"), F.lit(field).alias("new_name"),
            F.lit(default).alias("default"), F.lit(casts.get(field, "text")).alias("cast"), F.lit(0).alias("exponent"),
        )
        steps = steps.unionByName(added)
    return steps


def _scaled(number: Column, exponent: Column) -> Column:
    """``number`` times ten to the ``exponent``, rounded once: the exponent is written behind the digits."""
    plain = F.concat(number, F.lit("e"), exponent.cast("string")).try_cast("double")
    return F.when(number.rlike("[eE]"), number.try_cast("double") * F.pow(F.lit(10.0), exponent)).otherwise(plain)


def _cast_number(text: Column, cast: str, exponent: Column) -> Column:
    """Double of a text; metres may be written with their unit, which goes before that of the name."""
    digits = F.regexp_replace(F.regexp_extract(text, _NUMBER, 1), ",", "")
    unit = F.lower(F.regexp_extract(text, _NUMBER, 2))
    power = F.when(unit == "km", 3).when(unit == "m", 0).otherwise(exponent)
    return F.when(text.rlike(_NUMBER) & ((unit == "") | F.lit(cast == "metres")), _scaled(digits, power))


def _routed(df: DataFrame, id_col: str, casts: dict[str, str], defaults: dict[str, str] | None = None) -> tuple[DataFrame, str, str]:
    """All rows of ``df`` with their version and their values, read by the steps of it; (table, name of the map, name of the sorted entries).

    The steps of a file are one row (a map of its names), which meets the file's rows in a join of measured size: rows are
    not taken apart, moved or put together again. The map has field to (text, exponent), the entries (field, text).
    """
    (rules, extra, version, found, read, by_field) = fresh("rules", "extra", "version", "found", "read", "by_field")
    names = cut_lineage(file_names(df))
    versions = cut_lineage(_fingerprints_of(_versions_of(names), _files(df)).drop("fingerprint"))
    steps = _steps_of(names, versions, casts, defaults)
    value = F.struct(F.col("new_name").alias("field"), "cast", "exponent")
    lacking = F.struct(F.lit("").alias("name"), F.col("new_name").alias("field"), F.col("default").alias("value"), F.col("exponent").alias("exponent"))
    per_version = steps.groupBy("feed", "version").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("old_name").isNotNull(), F.struct("old_name", value.alias("v")))))).alias(rules),
        F.sort_array(F.collect_list(F.when(F.col("old_name").isNull(), lacking))).alias(extra),
    )
    per_file = versions.join(per_version, ["feed", "version"], "left").select(*_FILE, F.col("version").alias(version), rules, extra)
    rows = lookup_join(df.select(id_col, *_FILE, "payload"), per_file, _FILE)
    pairs = F.map_entries(F.try_variant_get(F.try_parse_json(F.col("payload")), "$", "map<string,variant>"))

    def one(e: Column) -> Column:
        kind = F.schema_of_variant(e["value"])
        text = F.try_variant_get(e["value"], "$", "string")
        number = kind.rlike(_NUMBER_TYPES)
        rule = F.coalesce(F.try_element_at(F.col(rules), e["key"]), _rule(e["key"], casts))  # rows without a file have no steps
        return F.when(
            kind != "VOID",
            F.struct(e["key"].alias("name"), rule["field"].alias("field"), F.when(number, F.regexp_replace(text, r"\.0+$", "")).otherwise(text).alias("value"), rule["exponent"].alias("exponent")),
        )

    own = F.col(extra)
    if defaults:
        # A row without a file is a version of its own.
        given = F.array(*[F.struct(F.lit("").alias("name"), F.lit(f).alias("field"), F.lit(v).alias("value"), F.lit(0).alias("exponent")) for f, v in defaults.items()])
        has = lambda f: F.coalesce(F.exists(pairs, lambda e: _rule(e["key"], casts)["field"] == f), F.lit(False))
        own = F.when(F.col(rules).isNull(), F.filter(given, lambda e: ~has(e["field"]))).otherwise(own)
    # Of one field under two names the first name by alphabet counts.
    rows = rows.withColumn(found, F.array_sort(F.concat(F.array_compact(F.transform(F.coalesce(pairs, F.array()), one)), F.coalesce(own, F.array()))))
    first = lambda e, i: ~F.exists(F.slice(F.col(found), F.lit(1), i), lambda x: x["field"] == e["field"])
    rows = rows.withColumn(read, F.filter(found, first))
    rows = rows.withColumn(by_field, F.map_from_entries(F.transform(read, lambda e: F.struct(e["field"].alias("key"), F.struct(e["value"].alias("value"), e["exponent"].alias("exponent")).alias("v")))))
    return rows.withColumnRenamed(version, "version").drop(rules, extra, found, "payload"), by_field, read


def _text_map(entries: Column) -> Column:
    return F.map_from_entries(F.sort_array(F.transform(entries, lambda e: F.struct(e["field"].alias("key"), e["value"].alias("value")))))


def unified_values(df: DataFrame, id_col: str = "feed_row_id") -> DataFrame:
    """(``id_col``, feed, file_seq, field, value, kind): all values of all rows under their fields, nulls left out.

    ``kind`` is the one kind of the field over all feeds and files: its own where it never changed, else ``string``. Rows
    without feed or number of file are left out.
    """
    listed = df.where("feed is not null and file_seq is not null")
    rows, _, read = _routed(listed, id_col, {})
    kinds = schema_versions(listed).where("kind is not null").groupBy("field").agg(F.min("kind").alias("a"), F.max("kind").alias("b"))
    labels = F.create_map(*[F.lit(x) for f in WIDE_FIELDS for x in (_field_key(f), f)])
    kinds = kinds.select(F.coalesce(F.try_element_at(labels, "field"), "field").alias("field"), F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("string").alias("kind"))
    values = rows.select(id_col, *_FILE, F.explode(read).alias("v")).select(id_col, *_FILE, "v.field", "v.value")
    return lookup_join(values, kinds, ["field"]).select(id_col, *_FILE, "field", "value", "kind")


def unified_table(df: DataFrame, fields: list[str], id_col: str = "feed_row_id") -> DataFrame:
    """One consistent table: feed, file_seq, ``id_col``, a column per wanted field, and the version of the row's file.

    Values are texts as written (numbers without trailing ``.0``, booleans ``true`` and ``false``). Rows without feed or
    number of file are left out. A row that holds one field under two names keeps the non-null value of the first name by alphabet.
    """
    rows, by_field, _ = _routed(df.where("feed is not null and file_seq is not null"), id_col, {})
    return rows.select(*_FILE, id_col, *[F.try_element_at(F.col(by_field), F.lit(f))["value"].alias(f) for f in fields], "version")


def whole_table(
    df: DataFrame, id_col: str = "feed_row_id", fields: tuple[str, ...] = WIDE_FIELDS, casts: dict[str, str] = CASTS, defaults: dict[str, str] | None = None
) -> DataFrame:
    """Every row with all its values: feed, file_seq, ``id_col``, version, a column per field of ``fields``, ``others``, ``unread``.

    A row is read by ``reading_steps`` of its own version: names become fields, fields that the version lacks get their
    default, values are cast by ``casts`` (``metres`` and ``number`` to double, ``flag`` to boolean, else text). What a cast
    cannot read is null in its column and stands as text in ``unread`` (field to text); null tokens of cast fields are null.
    ``others`` maps each further field to its text, in order of the fields (empty where there is none), so a field that a
    feed adds later is kept without being known here. Rows without feed or number of file are kept without a version, by
    the same rules, each for itself; payloads that are no JSON object have no values (but defaults). Nested values are
    kept as their JSON. A row that holds one field under two names keeps the non-null value of the first name by alphabet.
    """
    rows, by_field, read = _routed(df, id_col, casts, defaults)
    at = {f: F.try_element_at(F.col(by_field), F.lit(f)) for f in fields}
    columns, lost = {}, []
    for f in fields:
        cast, text = casts.get(f, "text"), at[f]["value"]
        clean = F.btrim(text, F.lit(" \t\n\r"))
        there = text.isNotNull() & ~clean.isin(*NULL_TOKENS)
        columns[f] = text if cast == "text" else parse_boolean(text) if cast == "flag" else F.when(there, _cast_number(clean, cast, at[f]["exponent"]))
        if cast != "text":
            lost.append(F.when(there & F.col(f"`{f}`").isNull(), F.struct(F.lit(f).alias("field"), text.alias("value"))))
    rows = rows.withColumns(columns)
    others = _text_map(F.filter(read, lambda e: ~e["field"].isin(*fields)))
    unread = _text_map(F.array_compact(F.array(*lost))) if lost else F.create_map().cast("map<string,string>")
    return rows.select(*_FILE, id_col, "version", *fields, others.alias("others"), unread.alias("unread"))
