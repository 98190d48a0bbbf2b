"""String functions over StringType columns; positions count from 0 and -1 means not found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = " \t\n\r\x0b\x0c"


def _part(a: Column, start: int = 0, end: int | None = None) -> Column:
    n = F.length(a)
    lo = F.greatest(n + start, F.lit(0)) if start < 0 else F.least(F.lit(start), n)
    hi = n if end is None else (F.greatest(n + end, F.lit(0)) if end < 0 else F.least(F.lit(end), n))
    return F.substring(a, lo + 1, F.greatest(hi - lo, F.lit(0)))


def slice_(a: Column, start: int = 0, stop: int | None = None, step: int = 1) -> Column:
    part = _part(a, start, stop)
    if step == 1:
        return part
    if step < 1:
        raise ValueError("only forward steps")
    return F.array_join(F.filter(F.split(part, ""), lambda _, i: i % step == 0), "")


def find(a: Column, sub: str, start: int = 0, end: int | None = None) -> Column:
    at = F.instr(_part(a, start, end), sub) - 1
    first = F.greatest(F.length(a) + start, F.lit(0)) if start < 0 else F.lit(start)
    return F.when(at < 0, -1).otherwise(at + first)


def rfind(a: Column, sub: str) -> Column:
    at = F.instr(F.reverse(a), sub[::-1])
    return F.when(at == 0, -1).otherwise(F.length(a) - at - len(sub) + 1)


def index(a: Column, sub: str) -> Column:
    return F.when(F.instr(a, sub) == 0, F.raise_error(F.lit("substring not found"))).otherwise(find(a, sub))


def rindex(a: Column, sub: str) -> Column:
    return F.when(F.instr(a, sub) == 0, F.raise_error(F.lit("substring not found"))).otherwise(rfind(a, sub))


def count(a: Column, sub: str) -> Column:
    """Occurrences that don't overlap; an empty one fits between all characters."""
    return F.length(a) + 1 if not sub else ((F.length(a) - F.length(F.replace(a, F.lit(sub), F.lit("")))) / len(sub)).cast("int")


def capitalize(a: Column) -> Column:
    return F.concat(F.upper(F.substring(a, 1, 1)), F.lower(F.substring(a, 2, 2**30)))


def swapcase(a: Column) -> Column:
    return F.array_join(F.transform(F.split(a, ""), lambda c: F.when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c))), "")


def title(a: Column) -> Column:
    """A capital after every character that is not a letter."""
    chars = F.split(a, "")
    folded = F.transform(chars, lambda c, i: F.when((i > 0) & F.element_at(chars, F.greatest(i, F.lit(1))).rlike(r"\p{L}"), F.lower(c)).otherwise(F.upper(c)))
    return F.array_join(folded, "")


def center(a: Column, width: int, fill: str = " ") -> Column:
    gap = F.greatest(F.lit(width) - F.length(a), F.lit(0))
    left = F.floor(gap / 2) + F.when((gap % 2 == 1) & F.lit(width % 2 == 1), 1).otherwise(0)
    return F.concat(F.repeat(F.lit(fill), left.cast("int")), a, F.repeat(F.lit(fill), (gap - left).cast("int")))


def ljust(a: Column, width: int, fill: str = " ") -> Column:
    return F.concat(a, F.repeat(F.lit(fill), F.greatest(F.lit(width) - F.length(a), F.lit(0))))


def rjust(a: Column, width: int, fill: str = " ") -> Column:
    return F.concat(F.repeat(F.lit(fill), F.greatest(F.lit(width) - F.length(a), F.lit(0))), a)


def zfill(a: Column, width: int) -> Column:
    signed = a.rlike("^[+-]")
    body = F.when(signed, F.substring(a, 2, 2**30)).otherwise(a)
    return F.concat(F.when(signed, F.substring(a, 1, 1)).otherwise(""), F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(a), F.lit(0))), body)


def strip(a: Column, chars: str = _SPACE) -> Column:
    return F.btrim(a, F.lit(chars))


def lstrip(a: Column, chars: str = _SPACE) -> Column:
    return F.ltrim(a, F.lit(chars))


def rstrip(a: Column, chars: str = _SPACE) -> Column:
    return F.rtrim(a, F.lit(chars))


def multiply(a: Column, n: Column | int) -> Column:
    return F.repeat(a, F.lit(n) if isinstance(n, int) else n)


def partition(a: Column, sep: str) -> Column:
    at = F.instr(a, sep)
    none = F.array(a, F.lit(""), F.lit(""))
    return F.when(at == 0, none).otherwise(F.array(F.substring(a, F.lit(1), at - 1), F.lit(sep), F.substring(a, at + len(sep), F.length(a))))


def rpartition(a: Column, sep: str) -> Column:
    at = rfind(a, sep)
    none = F.array(F.lit(""), F.lit(""), a)
    return F.when(at < 0, none).otherwise(F.array(F.substring(a, F.lit(1), at), F.lit(sep), F.substring(a, at + len(sep) + 1, F.length(a))))


def replace(a: Column, old: str, new: str, times: int = -1) -> Column:
    """All occurrences, or the first ``times`` of them."""
    if times < 0:
        return F.replace(a, F.lit(old), F.lit(new))
    parts = split(a, old)
    head, tail = F.slice(parts, 1, times + 1), F.slice(parts, times + 2, 2**30)
    return F.array_join(F.concat(F.array(F.array_join(head, new)), tail), old)


def expandtabs(a: Column, size: int = 8) -> Column:
    """Tabs filled up to the next multiple of ``size``, counted from the last line break."""
    parts = F.split(a, "\t")
    step = lambda acc, x: F.when(acc.isNull(), x).otherwise(F.concat(acc, F.repeat(F.lit(" "), F.lit(size) - F.length(F.substring_index(F.replace(acc, F.lit("\r"), F.lit("\n")), "\n", -1)) % size), x))
    return F.aggregate(parts, F.lit(None).cast("string"), step)


def translate(a: Column, table: dict[str, str], delete: str = "") -> Column:
    return F.translate(a, "".join(table) + delete, "".join(table.values()))


def split(a: Column, sep: str | None = None) -> Column:
    if sep is None:
        return F.filter(F.split(a, r"\s+"), lambda x: x != "")
    return F.split(a, "\\Q" + sep + "\\E", -1)


def splitlines(a: Column) -> Column:
    return F.split(F.regexp_replace(a, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n", -1)


def join(sep: str, parts: Column) -> Column:
    return F.array_join(parts, sep)


def _every(pattern: str):
    return lambda a: a.rlike(r"\A(?:" + pattern + r")+\z")


isalpha = _every(r"\p{L}")
isalnum = _every(r"[\p{L}\p{N}]")
isdigit = _every(r"[\p{Nd}²³¹⁰-⁹₀-₉]")
isdecimal = _every(r"\p{Nd}")
isnumeric = _every(r"\p{N}")
isspace = _every(r"[\s   -     　]")


def islower(a: Column) -> Column:
    return a.rlike(r"\p{Ll}") & ~a.rlike(r"[\p{Lu}\p{Lt}]")


def isupper(a: Column) -> Column:
    return a.rlike(r"\p{Lu}") & ~a.rlike(r"[\p{Ll}\p{Lt}]")


def istitle(a: Column) -> Column:
    return a.rlike(r"\p{Lu}") & (a == title(a))


FUNCTIONS = {
    "add": F.concat, "capitalize": capitalize, "center": center, "count": count, "decode": F.decode, "encode": F.encode, "endswith": lambda a, s: a.endswith(s), "equal": lambda a, b: a == b,
    "expandtabs": expandtabs, "find": find, "greater": lambda a, b: a > b, "greater_equal": lambda a, b: a >= b, "index": index, "isalnum": isalnum, "isalpha": isalpha, "isdecimal": isdecimal,
    "isdigit": isdigit, "islower": islower, "isnumeric": isnumeric, "isspace": isspace, "istitle": istitle, "isupper": isupper, "join": join, "less": lambda a, b: a < b, "less_equal": lambda a, b: a <= b,
    "ljust": ljust, "lower": F.lower, "lstrip": lstrip, "maximum": F.greatest, "minimum": F.least, "mod": lambda a, *v: F.format_string(a, *v), "multiply": multiply, "not_equal": lambda a, b: a != b, "partition": partition,
    "replace": replace, "rfind": rfind, "rindex": rindex, "rjust": rjust, "rpartition": rpartition, "rstrip": rstrip, "slice": slice_, "split": split, "splitlines": splitlines,
    "startswith": lambda a, s: a.startswith(s), "str_len": F.length, "strip": strip, "swapcase": swapcase, "title": title, "translate": translate, "upper": F.upper, "zfill": zfill,
}
