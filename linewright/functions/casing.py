"""Letter case of names: for lists on the driver and for columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


def words(name: str) -> list[str]:
    """Words end before a capital that follows a small letter or digit, before the last capital of a run
    that a small letter follows, and at everything that is no letter or digit."""
    name = re.sub(r"([a-z0-9ß-öø-ÿ])([A-ZÀ-ÖØ-Þ])", r"\1 \2", name)
    name = re.sub(r"([A-ZÀ-ÖØ-Þ])([A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])", r"\1 \2", name)
    return _WORD.findall(name)


def smart_snake_case(name: str) -> str:
    """snake_case; names in capitals stay so, with an underscore for each run of other characters."""
    plain = re.sub(r"([A-Z])\.+", r"\1", name).strip()
    if plain.upper() == plain:
        return re.sub(r"_{2,}", "_", re.sub(r"[^A-Za-z0-9_]+", "_", name))
    return "_".join(w.lower() for w in words(plain))


def smart_camel_case(name: str) -> str:
    """camelCase; names in capitals stay as they are."""
    if name.upper() == name:
        return name
    parts = [w.lower() for w in words(name)]
    return "".join(parts[:1] + [w.capitalize() for w in parts[1:]])


def smart_capital_case(name: str) -> str:
    """Capital Case; unchanged with an at sign or when uniformly cased."""
    if "@" in name or is_uniformly_cased(name):
        return name
    return " ".join(w.capitalize() for w in words(name))


def is_uniformly_cased(name: str | None) -> bool:
    return bool(name) and (name == name.upper() or name == name.lower())


def normalize_column_names(names: Iterable[str]) -> list[str]:
    """snake_case names, one for each input and all different: x, x_2, x_3.

    A suffixed name that is taken already gets the next number, so no column is lost.
    """
    out: list[str] = []
    for name in map(smart_snake_case, names):
        fresh, k = name, 1
        while fresh in out:
            k += 1
            fresh = f"{name}_{k}"
        out.append(fresh)
    return out


def words_col(name: Column) -> Column:
    """The same words, as an array column."""
    parted = F.regexp_replace(name, r"([a-z0-9ß-öø-ÿ])([A-ZÀ-ÖØ-Þ])", "$1 $2")
    parted = F.regexp_replace(parted, r"([A-ZÀ-ÖØ-Þ])([A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])", "$1 $2")
    return F.filter(F.split(parted, r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))


def snake_case_col(name: Column) -> Column:
    plain = F.trim(F.regexp_replace(name, r"([A-Z])\.+", "$1"))
    capitals = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_]+", "_"), "_{2,}", "_")
    return F.when(F.upper(plain) == plain, capitals).otherwise(F.lower(F.array_join(words_col(plain), "_")))


def camel_case_col(name: Column) -> Column:
    parts = words_col(name)
    joined = F.array_join(F.transform(parts, lambda w, i: F.when(i == 0, F.lower(w)).otherwise(_capital(w))), "")
    return F.when(F.upper(name) == name, name).otherwise(joined)


def uniformly_cased_col(name: Column) -> Column:
    return F.coalesce((name != "") & ((name == F.upper(name)) | (name == F.lower(name))), F.lit(False))


def capital_case_col(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("@")) | uniformly_cased_col(name), name).otherwise(F.array_join(F.transform(words_col(name), _capital), " "))


def normalize_names_col(names: Column) -> Column:
    """:func:`normalize_column_names` of an array column."""

    def add(out: Column, name: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(out) + 1), lambda k: F.when(k == 1, name).otherwise(F.concat(name, F.lit("_"), k.cast("string"))))
        return F.concat(out, F.slice(F.filter(tries, lambda t: ~F.array_contains(out, t)), F.lit(1), F.lit(1)))

    return F.aggregate(F.transform(names, snake_case_col), F.array().cast("array<string>"), add)
