"""Names and labels: rules, parsing, a key that tells series apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a metric name and a label key may hold, and how long they may be.
NAME = r"^[A-Za-z0-9_.-]{1,128}\z"
LABEL = r"^[A-Za-z0-9_.]{1,64}\z"


def valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(NAME), F.lit(False))


def valid_labels(labels: Column) -> Column:
    return F.coalesce(F.forall(F.map_keys(labels), lambda k: k.rlike(LABEL)), F.lit(False))


def trimmed(value: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+\z", "")


def trimmed_labels(labels: Column) -> Column:
    return F.transform_values(labels, lambda _, v: trimmed(v))


def parsed(text: Column) -> Column:
    """'k=v,k2=v2' as a map: pairs without = or with an empty key drop, the last of equal keys wins."""
    none = F.expr("cast(map() as map<string,string>)")
    pairs = F.filter(F.split(text, ","), lambda p: F.instr(p, "=") > 1)

    def put(found, p):
        k = F.substring_index(p, "=", 1)
        rest = F.map_filter(found, lambda old, _: old != k)
        return F.map_concat(rest, F.create_map(k, F.substring(p, F.length(k) + 2, F.length(p))))

    return F.coalesce(F.aggregate(pairs, none, put), none)


def key(labels: Column) -> Column:
    """Labels in key order as an array of entries: equal maps give equal keys, whatever their values hold."""
    return F.array_sort(F.map_entries(F.coalesce(labels, F.expr("cast(map() as map<string,string>)"))))


def shown(name: Column, labels: Column) -> Column:
    """name{a=1,b=2}, for people; key() is what identifies."""
    return F.concat(name, F.lit("{"), F.array_join(F.transform(key(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","), F.lit("}"))
