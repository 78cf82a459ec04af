"""Predicates, projections and default filling shared by the catalog and retrieval jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


def equality_filter(df: DataFrame, conditions: dict) -> DataFrame:
    """Keep rows equal to every given value; a list means any of, ``None`` means no condition."""
    for name, value in conditions.items():
        if value is None:
            continue
        df = df.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def select_fields(df: DataFrame, fields: str | None, id_col: str = "_id") -> DataFrame:
    """Columns named in a comma separated list; the id is always kept."""
    names = [n.strip() for n in (fields or "").split(",") if n.strip()]
    if not names:
        return df
    return df.select(id_col, *[n for n in names if n != id_col])


def contains_ignore_case(column: str, text: str) -> Column:
    return F.contains(F.lower(F.col(column)), F.lower(F.lit(text)))


def _walk(schema: T.StructType, path: str) -> tuple[Column, T.DataType, str]:
    """Follow struct fields along ``path``; return the column reached, its type and the rest of the path."""
    parts = path.split(".")
    column, dtype = F.col(parts[0]), schema[parts[0]].dataType
    parts = parts[1:]
    while parts and isinstance(dtype, T.StructType) and parts[0] in dtype.names:
        column, dtype = column.getField(parts[0]), dtype[parts[0]].dataType
        parts = parts[1:]
    return column, dtype, ".".join(parts)


_VARIANT_TYPES = {bool: "boolean", int: "bigint", float: "double", str: "string"}


def path_column(df: DataFrame, path: str, like=None) -> Column:
    """Column for a dotted path, also into a variant; ``like`` fixes the type read from the variant."""
    path = path.removesuffix(".keyword")
    column, dtype, rest = _walk(df.schema, path)
    if not rest:
        return column
    if isinstance(dtype, T.VariantType):
        return F.try_variant_get(column, f"$.{rest}", _VARIANT_TYPES.get(type(like), "string"))
    if isinstance(dtype, T.MapType):
        return F.element_at(column, rest)
    raise ValueError(f"no field {path!r}")


_RANGE = {
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}


def clause_column(df: DataFrame, clause: dict) -> Column:
    """A filter clause (term, terms, range, exists, bool) as a Spark predicate."""
    (kind, body), = clause.items()
    if kind == "term":
        (path, value), = body.items()
        value = value["value"] if isinstance(value, dict) else value
        return F.coalesce(path_column(df, path, value) == F.lit(value), F.lit(False))
    if kind == "terms":
        (path, values), = body.items()
        return F.coalesce(path_column(df, path, values[0] if values else None).isin(list(values)), F.lit(False))
    if kind == "range":
        (path, limits), = body.items()
        column = path_column(df, path, next(iter(limits.values())))
        return F.coalesce(reduce(lambda a, b: a & b, [_RANGE[op](column, F.lit(v)) for op, v in limits.items()]), F.lit(False))
    if kind == "exists":
        return path_column(df, body["field"]).isNotNull()
    if kind == "bool":
        out = F.lit(True)
        for part in ("filter", "must"):
            for sub in _as_list(body.get(part)):
                out = out & clause_column(df, sub)
        should = [clause_column(df, sub) for sub in _as_list(body.get("should"))]
        if should and (body.get("minimum_should_match", 0 if ("filter" in body or "must" in body) else 1)) >= 1:
            out = out & reduce(lambda a, b: a | b, should)
        for sub in _as_list(body.get("must_not")):
            out = out & ~clause_column(df, sub)
        return out
    raise ValueError(f"unsupported clause {kind!r}")


def _as_list(value) -> list:
    return [] if value is None else value if isinstance(value, list) else [value]


def custom_filter(df: DataFrame, clauses: list[dict] | None) -> DataFrame:
    for clause in clauses or []:
        df = df.where(clause_column(df, clause))
    return df


def metadata_filter(df: DataFrame, project_id=None, kb_ids=None, page=None, level=None, parent=None) -> DataFrame:
    """Term filters of the chunk store; apply them before any ranking."""
    return equality_filter(
        df,
        {
            k: v
            for k, v in {
                "project_id": project_id, "kb_id": kb_ids or None, "page": page, "chunk_level": level, "parent_chunk_id": parent,
            }.items()
            if v is not None
        },
    )


def filled(value: str, default: str) -> Column:
    """The value, or the default where it is null or empty."""
    return F.coalesce(F.nullif(F.col(value), F.lit("")), F.col(default))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language_ok(column: str) -> Column:
    """``<language>-<locale>``: exactly two parts around one dash; a language need not be given."""
    return F.col(column).isNull() | (F.size(F.split(F.col(column), "-")) == 2)


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rejected rows with the names of the rules they break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    checked = df.withColumn("broken", broken)
    return checked.where(F.size("broken") == 0).drop("broken"), checked.where(F.size("broken") > 0)


def dotted_fields(schema: T.StructType, prefix: str = "") -> dict[str, Column]:
    """Leaf columns of nested structs under dotted names."""
    out: dict[str, Column] = {}
    for field in schema.fields:
        name = f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            out.update(dotted_fields(field.dataType, f"{name}."))
        else:
            out[name] = F.col(name)
    return out


def dotted_rows(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """Nested values of one struct column as (id, key, value) rows."""
    leaves = dotted_fields(df.select(column).schema)
    pairs = F.array(*[F.struct(F.lit(k.split(".", 1)[1]).alias("key"), c.cast("string").alias("value")) for k, c in leaves.items()])
    return df.select(id_col, F.inline(pairs))
