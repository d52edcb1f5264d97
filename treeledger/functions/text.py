"""Column expressions: parsing of listing lines, cells, paths and numbers.  All of them stay inside the JVM."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import U64, U64_MAX, WIDE, SnapshotError

PERMISSIONS = r"(?U)^\s*[-dlbcps][-rwxsStT]{9}"
_FIELDS = r"(?Us)^\s*" + r"(\S+)\s+" * 8 + r"(\S.*)$"


def permissions_record(line: Column) -> Column:
    """Whether the first token is a type character and nine permission characters, whatever follows them."""
    return line.rlike(PERMISSIONS)


def field(line: Column, k: int) -> Column:
    """Field k (1 to 9) of a listing line: eight tokens and the name with its inner spaces; empty if there are fewer."""
    return F.regexp_extract(line, _FIELDS, k)


def has_fields(line: Column) -> Column:
    return line.rlike(_FIELDS)


def joined_device(line: Column) -> Column:
    """Device lines with major and minor number as one token: white space behind the first comma goes."""
    return F.when(line.rlike("^[bc]"), F.regexp_replace(line, r"(?U)^([^,]*,)\s*", "$1")).otherwise(line)


def is_header(line: Column) -> Column:
    return line.endswith(":") & ~line.startswith("ls:") & ~line.startswith("total ") & ~line.startswith("합계 ")


def header(line: Column) -> Column:
    """The path of a header line."""
    return F.substr(line, F.lit(1), F.length(line) - 1)


def u64(text: Column) -> Column:
    """An unsigned 64-bit integer with an optional plus sign, else null."""
    digits = F.when(text.rlike(r"^\+?[0-9]+$"), F.regexp_replace(text, r"^\+?0*(?=[0-9])", ""))
    value = F.when(F.length(digits) <= 20, digits).cast(WIDE)
    return F.when(value <= F.lit(str(U64_MAX)).cast(WIDE), value).cast(U64)


def scaled(value: Column, factor: Column | int) -> Column:
    """value * factor if that is an unsigned 64-bit integer, else null."""
    product = value.cast(WIDE) * (F.lit(factor) if isinstance(factor, int) else factor).cast("decimal(18,0)")
    return F.when(product <= F.lit(str(U64_MAX)).cast(WIDE), product.cast(U64))


def encode_cell(cell: Column) -> Column:
    """Backslash, tab, line end and carriage return as two characters each; the backslash first."""
    out = cell
    for raw, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def decode_cell(cell: Column) -> Column:
    """The reverse in one pass: between pairs of backslashes, which split from the left, escapes can't overlap."""

    def part(p: Column) -> Column:
        for code, raw in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
            p = F.replace(p, F.lit(code), F.lit(raw))
        return p

    return F.array_join(F.transform(F.split(cell, r"\\\\"), part), "\\")


def valid_cell(cell: Column) -> Column:
    """Whether every backslash begins a known escape."""

    def bad(p: Column) -> Column:
        for code in ("\\t", "\\n", "\\r"):
            p = F.replace(p, F.lit(code), F.lit(""))
        return F.contains(p, F.lit("\\"))

    return ~F.exists(F.split(cell, r"\\\\"), bad)


def relative(path: Column, root: Column) -> Column:
    """path below root; null if it lies outside."""
    prefix = F.when(root == "/", "/").otherwise(F.concat(root, F.lit("/")))
    return F.when(path == root, ".").when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1))


def is_merged(path: Column) -> Column:
    """Whether five consecutive components read containers/storage/overlay/<any>/merged."""
    return path.rlike(r"(^|/)containers/storage/overlay/[^/]*/merged(/|$)")


def bucket(path: Column, depth: int) -> Column:
    return F.substring_index(path, "/", depth)


def full_path(directory: Column, name: Column) -> Column:
    return F.when(directory == ".", name).otherwise(F.concat(directory, F.lit("/"), name))


def snapshot_directory(path: Column) -> Column:
    return F.when(path == "", ".").otherwise(F.concat(F.lit("./"), path))


def human_column(size: Column) -> Column:
    """human() as a column: exact integer arithmetic, halves to even."""
    size = size.cast(WIDE)
    n = F.abs(size)
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, power in (("KiB", 10), ("MiB", 20), ("GiB", 30), ("TiB", 40)):
        scale = F.lit(1 << power).cast("decimal(18,0)")
        times = (n * F.lit(100).cast("decimal(3,0)")).cast(WIDE)
        whole = F.floor(times / scale).cast(WIDE)
        whole = F.when(whole * scale > times, whole - 1).otherwise(whole)
        rest = (times - whole * scale) * 2
        up = (rest > scale) | ((rest == scale) & (whole % 2 == 1))
        cents = (whole + F.when(up, 1).otherwise(0)).cast(WIDE)
        units = F.floor(cents / 100).cast(WIDE)
        text = F.concat(units.cast("string"), F.lit("."), F.lpad((cents - units * 100).cast("int").cast("string"), 2, "0"), F.lit(f" {unit}"))
        out = F.when(n >= scale, text).otherwise(out)
    return F.concat(F.when(size < 0, "-").otherwise(""), out)


def human(size: int) -> str:
    """A size with two decimals in the largest unit that it reaches; below 1024 in bytes."""
    n = abs(size)
    for unit, power in (("TiB", 40), ("GiB", 30), ("MiB", 20), ("KiB", 10)):
        if n >> power:
            text = f"{(Decimal(n) / (1 << power)).quantize(Decimal('0.01'), ROUND_HALF_EVEN)} {unit}"
            break
    else:
        text = f"{n} B"
    return f"-{text}" if size < 0 else text


def signed(size: int) -> str:
    return f"+{human(size)}" if size > 0 else human(size)


def daily_bytes(size: Column, days: int) -> Column:
    """The average a day as a column, halves away from zero."""
    return F.round(size / F.lit(days).cast("decimal(9,0)"))


def daily_growth(size: int, days: float) -> str:
    """The average a day, halves away from zero."""
    return signed(int(Decimal(size / days).quantize(Decimal(1), ROUND_HALF_UP)))


def memory_size(text: str) -> int:
    """Bytes of a size with unit, such as 512MiB."""
    units = {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30, "KB": 10**3, "MB": 10**6, "GB": 10**9}
    digits = text[: len(text) - len(text.lstrip("0123456789"))]
    if digits and text[len(digits) :] in units:
        n = int(digits) * units[text[len(digits) :]]
        if 0 < n < 1 << 61:
            return n
    raise SnapshotError("a memory limit is a positive integer with unit B, KiB, MiB, GiB, KB, MB or GB, such as 512MiB")
