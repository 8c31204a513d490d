"""Specifications as structs: merged field by field, however deep."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def filled(value: Column, kind: T.DataType) -> Column:
    """The value says something: not null, not an empty text, list or map, and in a struct at least one field does."""
    if isinstance(kind, T.StructType):
        out = F.lit(False)
        for f in kind.fields:
            out = out | filled(value[f.name], f.dataType)
        return value.isNotNull() & out
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce(F.trim(value) != "", F.lit(False))
    return value.isNotNull()


def deep_merge(old: Column, new: Column, kind: T.DataType, keep: tuple[str, ...] = (), gather: tuple[str, ...] = (), at: str = "") -> Column:
    """new over old: scalars and lists override, structs and maps merge, and what is null or empty changes nothing.

    keep: paths (a.b) that stay as they are. gather: paths of lists that are united, the old items first, each once. A
    struct that both lack is null.
    """
    if at in keep:
        return old
    if isinstance(kind, T.StructType):
        fields = [deep_merge(old[f.name], new[f.name], f.dataType, keep, gather, f"{at}.{f.name}".lstrip(".")).alias(f.name) for f in kind.fields]
        return F.when(old.isNotNull() | new.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType):
        both = F.map_zip_with(F.coalesce(old, F.create_map().cast(kind)), F.coalesce(new, F.create_map().cast(kind)), lambda _, a, b: F.when(filled(b, kind.valueType), b).otherwise(a))
        return F.when(old.isNotNull() | new.isNotNull(), both)
    if at in gather:
        none = F.array().cast(kind)
        return F.when(old.isNotNull() | new.isNotNull(), F.array_distinct(F.concat(F.coalesce(old, none), F.coalesce(new, none))))
    return F.when(filled(new, kind), new).otherwise(old)


def paths_filled(value: Column, kind: T.StructType, at: str = "") -> list[tuple[str, Column]]:
    """Every path of a struct, and whether it says something."""
    out = []
    for f in kind.fields:
        path = f"{at}.{f.name}".lstrip(".")
        out.append((path, filled(value[f.name], f.dataType)))
        if isinstance(f.dataType, T.StructType):
            out += paths_filled(value[f.name], f.dataType, path)
    return out


def still_open(value: Column, kind: T.StructType, asked: Column) -> Column:
    """The paths in `asked` that say nothing yet; paths that the struct hasn't are dropped."""
    known = paths_filled(value, kind)
    empty = F.filter(F.array(*[F.when(~ok, F.lit(path)) for path, ok in known]), lambda p: p.isNotNull())
    return F.filter(F.array_distinct(asked), lambda p: F.array_contains(empty, p))
