"""Modules as text for people: one row a module, made where the module is."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import align_strings

_LINE = 60
_AROUND = 10  # letters shown before and after a module


def _wrapped(names: list[str], rows: list[str], marks: str, starts: list[int]) -> str:
    out = ["\n".join(f"Sequence {i}: {n}" for i, n in enumerate(names, 1)), ""]
    at = [s + 1 for s in starts]
    for i in range(0, len(rows[0]) if rows else 0, _LINE):
        parts = [r[i : i + _LINE] for r in rows]
        out += [f"{p:7d} : {part}" for p, part in zip(at, parts, strict=True)]
        out += ["          " + marks[i : i + _LINE], ""]
        at = [p + len(part) - part.count("-") for p, part in zip(at, parts, strict=True)]
    return "\n".join(out)


def _between(pieces: list[str]) -> list[str]:
    """Two pieces are aligned letter by letter; more are only brought to one length."""
    if len(pieces) == 2:
        return list(align_strings(*pieces)[1:])
    width = max((len(p) for p in pieces), default=0)
    return [p.ljust(width, "-") for p in pieces]


def module_text(columns: pd.DataFrame, letters: dict[str, str] | None) -> str:
    """One module: a line a column, and the sequences under each other if all are known."""
    names = sorted(columns["seq"].unique())
    lines = []
    cols = [g.set_index("seq") for _, g in columns.sort_values(["col", "seq"]).groupby("col")]
    for i, g in enumerate(cols):
        where = " <=> ".join(f"({g.at[s, 'begin']},{g.at[s, 'end']})" if s in g.index else "[ ]" for s in names)
        first = g.iloc[0]
        lines.append(f"D[{i}]={first['cum_score']:.2f} {first['motif']} {where} {first['strand']}")
    out = "\n".join(lines) + "\n"
    if letters is None or any(s not in letters for s in names) or any(len(g) < len(names) for g in cols):
        return out
    starts = [max(int(cols[0].at[s, "begin"]) - 1 - _AROUND, 0) for s in names]
    ends = [min(int(cols[-1].at[s, "end"]) + _AROUND, len(letters[s])) for s in names]
    rows, marks, done = [""] * len(names), "", list(starts)
    for g in cols:
        begins = [int(g.at[s, "begin"]) - 1 for s in names]
        stops = [int(g.at[s, "end"]) for s in names]
        gap = _between([letters[s][a:b].lower() for s, a, b in zip(names, done, begins, strict=True)])
        site = [letters[s][a:b].upper() for s, a, b in zip(names, begins, stops, strict=True)]
        width = max(len(x) for x in site)
        rows = [r + x + y.ljust(width, "-") for r, x, y in zip(rows, gap, site, strict=True)]
        marks += " " * len(gap[0]) + g.iloc[0]["motif"][:width].ljust(width)
        done = stops
    last = _between([letters[s][a:b].lower() for s, a, b in zip(names, done, ends, strict=True)])
    return out + "\n" + _wrapped(names, [r + x for r, x in zip(rows, last, strict=True)], marks, starts)


def module_texts(columns: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """module, value: the text of each module. sequences: seq_id, seq."""
    rows = columns.select("module", "col", "seq", "motif", "strand", "begin", "end", "cum_score")
    if sequences is not None:
        rows = rows.join(sequences.select(F.col("seq_id").alias("seq"), F.col("seq").alias("letters")), "seq", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        letters = None
        if "letters" in pdf:
            letters = {s: x for s, x in zip(pdf["seq"], pdf["letters"], strict=True) if isinstance(x, str)}
        module = int(pdf["module"].iloc[0])
        return pd.DataFrame({"module": [module], "value": [f"### Alignment No {module} ###\n" + module_text(pdf, letters)]})

    return rows.groupBy("module").applyInPandas(run, "module int, value string")


def pairwise_base(columns: DataFrame, multiple: DataFrame) -> DataFrame:
    """columns with used: whether both sites of a pairwise column stand in one column of a multiple alignment."""
    spots = multiple.select(F.col("module").alias("m_"), F.col("col").alias("c_"), "seq", "begin", "end").distinct()
    met = columns.join(spots, ["seq", "begin", "end"]).groupBy("module", "col", "m_", "c_").agg(F.count_distinct("seq").alias("n"))
    used = met.where("n > 1").select("module", "col").distinct().withColumn("used", F.lit(True))
    return columns.join(used, ["module", "col"], "left").withColumn("used", F.coalesce("used", F.lit(False)))


def merged_texts(merged: DataFrame, least_pairs: int = 0) -> DataFrame:
    """component, nth, value: a table of each merged alignment, without the columns that fewer pairs support."""
    names = F.array_sort(F.collect_set("seq"))
    kept = merged.where(F.col("pairs") >= least_pairs)
    cells = kept.groupBy("component", "nth", "score", "modules", "col", "motif", "strand", "pairs").agg(F.array_sort(F.collect_list(F.struct("seq", "begin", "end"))).alias("at"))
    line = F.concat_ws("\t", "motif", "strand", F.col("pairs").cast("string"), F.array_join(F.transform("at", lambda s: F.format_string("%s:%d-%d", s["seq"], s["begin"], s["end"])), "\t"))
    all_names = kept.groupBy("component", "nth").agg(names.alias("names"))
    body = cells.groupBy("component", "nth", "score", "modules").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    head = F.format_string("score %.2f, %d modules, %s", "score", "modules", F.array_join("names", " "))
    return body.join(all_names, ["component", "nth"]).select("component", "nth", F.concat(head, F.lit("\n"), F.col("body")).alias("value"))
