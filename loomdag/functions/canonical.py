"""Canonical forms: JSON, hashes, big integers, fixed-scale decimals, base64."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE = 2**53 - 1


def number_text(x: float | int) -> str:
    """A number as ECMAScript writes it."""
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise TypeError("not a number")
    if isinstance(x, float):
        if not math.isfinite(x):
            raise ValueError("NaN and infinities have no canonical form")
        if x == int(x) and abs(x) < 1e21:
            return str(int(x))
        sign, digits, exponent = Decimal(repr(x)).as_tuple()
        text = "".join(map(str, digits)).rstrip("0") or "0"
        point = len(digits) + exponent
        if 0 < point <= 21:
            body = text.ljust(point, "0")[:point] + ("." + text[point:] if len(text) > point else "")
        elif -6 < point <= 0:
            body = "0." + "0" * -point + text
        else:
            e = point - 1
            body = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
        return "-" * sign + body
    return str(x)


def canonical_json(value: Any, keyed_arrays: bool = False) -> str:
    """Sorted keys, only backslash and quote escaped, no null.

    ``keyed_arrays`` orders array elements by their index written as text, a form that
    some hashes were made with.
    """
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, (list, tuple)):
        order = sorted(range(len(value)), key=str) if keyed_arrays else range(len(value))
        return "[" + ",".join(canonical_json(value[i], keyed_arrays) for i in order) + "]"
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(value[k], keyed_arrays)}" for k in keys) + "}"
    raise TypeError(f"{type(value).__name__} has no canonical form")


def sha(value: Any, keyed_arrays: bool = False) -> str:
    """SHA-256 of the canonical form, in base64."""
    return base64.b64encode(hashlib.sha256(canonical_json(value, keyed_arrays).encode()).digest()).decode()


def entry_hash(payload: Any, prev: list[str]) -> str:
    """The payload is hashed by itself; predecessors are a set."""
    return sha({"payloadHash": sha(payload), "prevEntryHashes": {p: "" for p in prev}})


def row_id(uuid: str, author: str | None = None) -> str:
    return sha({"uuid": uuid} if author is None else {"uuid": uuid, "author": author})


def row_id_column(uuid: Column, author: Column | None = None) -> Column:
    """``row_id`` as a native expression."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'([\\"])', r"\\$1"), F.lit('"'))
    alone = F.concat(F.lit('{"uuid":'), quote(uuid), F.lit("}"))
    text = alone if author is None else F.when(author.isNull(), alone).otherwise(
        F.concat(F.lit('{"author":'), quote(author), F.lit(',"uuid":'), quote(uuid), F.lit("}"))
    )
    return F.base64(F.unhex(F.sha2(text, 256)))


_BIG = re.compile(r"0|-?[1-9][0-9]*")
_DEC = re.compile(r"([+-]?)([0-9]+)(?:\.([0-9]+))?")


def bigint(text: str) -> str:
    """Canonical big integer: no plus, no leading zeros, no minus zero."""
    m = re.fullmatch(r"([+-]?)([0-9]+)", text)
    if not m:
        raise ValueError(f"{text!r} is no integer")
    digits = m[2].lstrip("0") or "0"
    return digits if m[1] != "-" or digits == "0" else "-" + digits


def is_bigint(text: object) -> bool:
    return isinstance(text, str) and bool(_BIG.fullmatch(text))


def decimal(text: str, scale: int, precision: int | None = None) -> str:
    """Canonical decimal of exactly ``scale`` places; more places are refused, not rounded."""
    m = _DEC.fullmatch(text)
    if not m:
        raise ValueError(f"{text!r} is no decimal")
    places = m[3] or ""
    if len(places) > scale:
        raise ValueError(f"{text!r} has more than {scale} places")
    whole = m[2].lstrip("0") or "0"
    places = places.ljust(scale, "0")
    if precision is not None and len(whole.lstrip("0") + places) > precision:
        raise ValueError(f"{text!r} has more than {precision} digits")
    body = whole + ("." + places if scale else "")
    return body if m[1] != "-" or not (whole + places).strip("0") else "-" + body


def is_decimal(text: object, scale: int) -> bool:
    try:
        return isinstance(text, str) and decimal(text, scale) == text
    except ValueError:
        return False


def is_base64(text: object) -> bool:
    try:
        return isinstance(text, str) and base64.b64encode(base64.b64decode(text, validate=True)).decode() == text
    except ValueError:
        return False


def is_bigint_column(c: Column) -> Column:
    return c.rlike(r"^(0|-?[1-9][0-9]*)\z")


def is_decimal_column(c: Column, scale: int) -> Column:
    places = rf"\.[0-9]{{{scale}}}" if scale else ""
    return c.rlike(rf"^-?(0|[1-9][0-9]*){places}\z") & ~c.rlike(r"^-[0.]*\z")


def is_base64_column(c: Column) -> Column:
    good = c.rlike(r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    return good & (F.regexp_replace(F.base64(F.unbase64(F.when(good, c))), r"\s", "") == c)


def sort_key(c: Column, scale: int = 0) -> Column:
    """A string whose binary order is the numeric order of canonical (big) numbers."""
    bare = F.regexp_replace(c, r"[-.]", "")
    bare = F.regexp_replace(bare, r"^0+(?=.)", "")
    width = F.lpad(F.length(bare).cast("string"), 10, "0")
    up = F.concat(F.lit("1"), width, bare)
    down = F.concat(F.lit("0"), F.translate(F.concat(width, bare), "0123456789", "9876543210"), F.lit("~"))
    return F.when(c.startswith("-"), down).otherwise(up)


# -- structural formats ---------------------------------------------------------


def check_format(value: Any, form: Any, at: str = "$") -> list[str]:
    """What is wrong with ``value``: ``form`` is a type name, {"const": x}, {"union": [..]},
    {"array": form, "max": n}, {"map": form, "max": n}, {"string": max length} or an
    object {name: form}, where a name that ends in "?" may be missing."""
    if isinstance(form, str):
        kinds = {"string": str, "boolean": bool, "object": dict, "array": list}
        if form == "number":
            ok = isinstance(value, (int, float)) and not isinstance(value, bool)
        elif form == "any":
            ok = value is not None
        else:
            ok = isinstance(value, kinds[form])
        return [] if ok else [f"{at}: not a {form}"]
    if "const" in form:
        return [] if value == form["const"] else [f"{at}: not {form['const']!r}"]
    if "union" in form:
        found = [check_format(value, f, at) for f in form["union"]]
        return [] if any(not f for f in found) else [f"{at}: fits no form"]
    if "string" in form and isinstance(form["string"], int):
        return [] if isinstance(value, str) and len(value.encode("utf-16-le")) // 2 <= form["string"] else [f"{at}: not a string of {form['string']} at most"]
    if "array" in form and "max" in form:
        if not isinstance(value, list) or len(value) > form["max"]:
            return [f"{at}: not an array of {form['max']} at most"]
        return [e for i, v in enumerate(value) for e in check_format(v, form["array"], f"{at}[{i}]")]
    if "map" in form and "max" in form:
        if not isinstance(value, dict) or len(value) > form["max"]:
            return [f"{at}: not a map of {form['max']} at most"]
        return [e for k, v in value.items() for e in check_format(v, form["map"], f"{at}.{k}")]
    if not isinstance(value, dict):
        return [f"{at}: not an object"]
    names = {k.rstrip("?"): (f, k.endswith("?")) for k, f in form.items()}
    out = [f"{at}.{k}: unknown" for k in value if k not in names]
    for k, (f, optional) in names.items():
        if k in value:
            out += check_format(value[k], f, f"{at}.{k}")
        elif not optional:
            out.append(f"{at}.{k}: missing")
    return out


def decimal_key(c: Column) -> Column:
    """The sort key of canonical decimals of unlike scales: the places are filled up to 64."""
    whole = F.substring_index(c, ".", 1)
    places = F.when(F.instr(c, ".") > 0, F.substring_index(c, ".", -1)).otherwise("")
    key = sort_key(F.concat(whole, F.rpad(places, 64, "0")))
    return F.when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?\z"), key)
