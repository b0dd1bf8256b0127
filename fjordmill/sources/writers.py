"""Sinks: fixed column order, matrices, JSON documents, appended event lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, columns: list[str], strict: bool = False, sep: str = "\t") -> None:
    """The columns in this order; missing ones blank, others dropped (or refused)."""
    extra = [c for c in df.columns if c not in columns]
    if strict and extra:
        raise ValueError(f"unknown columns: {extra}")
    out = df.select(*((F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)) for c in columns))
    out.write.mode("overwrite").csv(path, sep=sep, header=True, emptyValue="", nullValue="", escape='"')


def write_matrix(long_: DataFrame, path: str, key: str, feature: str, value: str, features: list) -> None:
    """(key, feature, value) as a wide matrix, with one column per given feature and 0 where there is no value."""
    long_.groupBy(key).pivot(feature, features).agg(F.max(value)).fillna(0).write.mode("overwrite").csv(path, header=True)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_fasta(df: DataFrame, path: str, header: str, sequence: str, width: int = 60) -> None:
    body = F.regexp_replace(F.col(sequence), f"(.{{{width}}})", "$1\n")
    df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), body)).write.mode("overwrite").text(path)


def summary_json(df: DataFrame, name: str = "summary") -> DataFrame:
    """A one-row table as one JSON document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def _cells(df: DataFrame, most: int) -> tuple[list[str], list[list[str]]]:
    """A report's rows on the driver; more than ``most`` are refused, not cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: a report shows small tables only")
    text = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    return df.columns, [[text(v) for v in r] for r in rows]


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    names, rows = _cells(df, most)
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(names), line(["---"] * len(names)), *map(line, rows)]) + "\n"


def html_report(title: str, tables: dict[str, DataFrame], most: int = 1000) -> str:
    """A page with a table per small DataFrame; all text is escaped."""
    from html import escape

    parts = [f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for name, df in tables.items():
        names, rows = _cells(df, most)
        row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{escape(c)}</{tag}>" for c in cells) + "</tr>"
        parts.append(f"<h2>{escape(name)}</h2><table>{row(names, 'th')}{''.join(row(r, 'td') for r in rows)}</table>")
    return "".join(parts) + "</body></html>"
