"""Element types, the promotion lattice and casting levels.

Spark coerces operand types by its own rules; array expressions cast explicitly to what this lattice says.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kind and size in bits, in order of promotion inside a kind.
KINDS = {
    "bool": ("b", 8),
    "int8": ("i", 8), "int16": ("i", 16), "int32": ("i", 32), "int64": ("i", 64),
    "uint8": ("u", 8), "uint16": ("u", 16), "uint32": ("u", 32), "uint64": ("u", 64),
    "float16": ("f", 16), "float32": ("f", 32), "float64": ("f", 64),
    "complex64": ("c", 64), "complex128": ("c", 128),
}

#: What holds each element type in Spark; unsigned types live in the next wider signed one.
SPARK = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float16": "float", "float32": "float", "float64": "double",
    "complex64": "struct<re:float,im:float>", "complex128": "struct<re:double,im:double>",
}


def _float_for(name: str) -> int:
    """The least float size that an integer type promotes to beside a float."""
    kind, bits = KINDS[name]
    if kind == "b":
        return 16
    return {8: 16, 16: 32}.get(bits, 64)


def promote(a: str, b: str) -> str:
    """The smallest type that both cast to safely."""
    if a == b:
        return a
    (ka, na), (kb, nb) = KINDS[a], KINDS[b]
    if ka == "b":
        return b
    if kb == "b":
        return a
    if ka == kb:
        return a if na >= nb else b
    if {ka, kb} == {"i", "u"}:
        signed, unsigned = (na, nb) if ka == "i" else (nb, na)
        need = max(signed, unsigned * 2)
        return f"int{need}" if need <= 64 else "float64"
    if "c" in (ka, kb):
        other, own = (b, na) if ka == "c" else (a, nb)
        size = KINDS[other][1] if KINDS[other][0] == "f" else _float_for(other)
        return "complex64" if own == 64 and size <= 32 else "complex128"
    other, own = (b, na) if ka == "f" else (a, nb)
    return f"float{max(own, _float_for(other))}"


def result_type(*names: str) -> str:
    out = names[0]
    for n in names[1:]:
        out = promote(out, n)
    return out


def can_cast(a: str, b: str, casting: str = "safe") -> bool:
    """Levels: no, equiv, safe, same_kind, unsafe."""
    if casting == "unsafe" or a == b:
        return True
    if casting in ("no", "equiv"):
        return False
    if promote(a, b) == b:
        return True
    rank = {"b": 0, "u": 1, "i": 2, "f": 3, "c": 4}
    return casting == "same_kind" and rank[KINDS[a][0]] <= rank[KINDS[b][0]]


def wrap(value: Column, name: str) -> Column:
    """An exact (decimal) integer brought into the type's range by wrapping around."""
    kind, bits = KINDS[name]
    size = F.lit(str(2**bits)).cast("decimal(38,0)")
    low = F.pmod(value.cast("decimal(38,0)"), size)
    if kind == "i":
        low = F.when(low >= F.lit(str(2 ** (bits - 1))).cast("decimal(38,0)"), low - size).otherwise(low)
    return low.cast(SPARK[name])


def astype(value: Column, source: str, target: str) -> Column:
    """A cast that wraps integers and truncates floats toward zero."""
    if KINDS[target][0] in "iu" and KINDS[source][0] in "iu":
        return wrap(value, target)
    if KINDS[target][0] in "iu" and KINDS[source][0] == "f":
        return wrap(F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)), target)
    if target == "bool":
        return value != 0
    return value.cast(SPARK[target])


def finfo(name: str) -> dict[str, float]:
    bits, digits = {"float16": (16, 10), "float32": (32, 23), "float64": (64, 52)}[name]
    top = 2 ** (bits - digits - 2) - 1
    return {"bits": bits, "eps": 2.0**-digits, "max": (2 - 2.0**-digits) * 2.0**top, "tiny": 2.0 ** (1 - top)}


def iinfo(name: str) -> dict[str, int]:
    kind, bits = KINDS[name]
    return {"bits": bits, "min": -(2 ** (bits - 1)) if kind == "i" else 0, "max": 2 ** (bits - (kind == "i")) - 1}
