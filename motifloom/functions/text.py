"""Small text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def memory_text(n_bytes: Column) -> Column:
    """Bytes as B, kB, MB or GB with one decimal."""
    out = F.format_string("%.1f GB", n_bytes / float(1 << 30))
    for unit, size in (("MB", 1 << 20), ("kB", 1 << 10)):
        out = F.when(n_bytes < size * 1024, F.format_string(f"%.1f {unit}", n_bytes / float(size))).otherwise(out)
    return F.when(n_bytes < 1024, F.format_string("%d B", n_bytes.cast("long"))).otherwise(out)


def time_text(seconds: Column) -> Column:
    """Seconds as days, hours, minutes and seconds, from the first that isn't zero."""
    s = seconds.cast("long")
    parts = ((s / 86400, 86400, "d"), (s % 86400 / 3600, 3600, "h"), (s % 3600 / 60, 60, "m"))
    texts = [F.when(s >= size, F.concat(F.floor(x).cast("string"), F.lit(unit))) for x, size, unit in parts]
    return F.concat_ws(" ", *texts, F.concat((s % 60).cast("string"), F.lit("s")))


def parse_slice_name(name: Column) -> dict[str, Column]:
    """Parts of a name like SPECIES|chromosome.start-end|...: species, region, start, stop, gene, crick."""
    parts = F.split(name, r"\|")
    slice_ = F.get(F.filter(parts, lambda p: p.rlike(r"\.-?\d+--?\d+$")), F.lit(0))
    gene = F.get(F.filter(parts, lambda p: p.rlike("^ENS[A-Z]*[0-9]+$")), F.lit(0))
    return {
        "species": parts[0],
        "region": F.regexp_extract(slice_, r"^(.*)\.-?\d+--?\d+$", 1),
        "start": F.regexp_extract(slice_, r"\.(-?\d+)--?\d+$", 1).try_cast("long"),
        "stop": F.regexp_extract(slice_, r"\.-?\d+-(-?\d+)$", 1).try_cast("long"),
        "gene": gene,
        "crick": F.exists(parts, lambda p: F.lower(p) == "crick"),
    }


def slice_length(name: Column) -> Column:
    parts = parse_slice_name(name)
    return parts["stop"] - parts["start"] + 1


def browser_link(name: Column, base: str = "https://www.ensembl.org") -> Column:
    """A genome browser's address for a slice name."""
    parts = parse_slice_name(name)
    return F.format_string(base + "/%s/Location/View?r=%s:%d-%d", parts["species"], parts["region"], parts["start"], parts["stop"])


def short_number(x: Column) -> Column:
    """A number with six significant digits and no trailing zeros."""
    digits = F.greatest(F.lit(0), F.least(F.lit(12), 5 - F.floor(F.log10(F.abs(x))).cast("int")))
    scale = F.pow(F.lit(10.0), digits)
    return F.when(x == 0, F.lit("0")).otherwise(F.regexp_replace(F.format_string("%.12f", F.round(x * scale) / scale), r"\.?0+$", ""))
