"""What leaves the library: rows without gold answers, tables of cells, reports, and the files of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.sources.files import write_jsonl

# Fields that tell gold answers or scores.
EXCLUDED = """expected gold gold_answer gold_answers gold_doc_ids gold_doc_recall gold_source correctness correctness_exact completeness completeness_reason
grounding grounding_status citation_validity failure_category acceptable_answers expected_behavior answer_verified holdout_version robustness_category""".split()


def leaks(kind: T.DataType, path: str = "") -> list[str]:
    """Paths of excluded fields at any depth of a schema; no data is read."""
    if isinstance(kind, T.StructType):
        own = [f"{path}{f.name}" for f in kind.fields if f.name in EXCLUDED]
        return own + [p for f in kind.fields if f.name not in EXCLUDED for p in leaks(f.dataType, f"{path}{f.name}.")]
    if isinstance(kind, T.ArrayType):
        return leaks(kind.elementType, path)
    return leaks(kind.valueType, path) if isinstance(kind, T.MapType) else []


def _kept(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType) and leaks(kind):
        fields = [_kept(value[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name not in EXCLUDED]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else F.lit(None)
    if isinstance(kind, T.ArrayType) and leaks(kind):
        return F.transform(value, lambda item: _kept(item, kind.elementType))
    if isinstance(kind, T.MapType):
        value = F.map_filter(value, lambda k, v: ~k.cast("string").isin(EXCLUDED))
        return F.transform_values(value, lambda k, v: _kept(v, kind.valueType)) if leaks(kind.valueType) else value
    return value


def without_gold(rows: DataFrame) -> DataFrame:
    """rows without the excluded fields, wherever in structs, arrays and maps they are."""
    return rows.select(*[_kept(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in EXCLUDED])


def cells(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns as the cells of a table: nothing for NULL, true and false in lower case, nested values as JSON. Columns that rows lacks are empty."""

    def cell(name: str) -> Column:
        if name not in rows.columns:
            return F.lit("")
        nested = isinstance(rows.schema[name].dataType, (T.ArrayType, T.StructType, T.MapType))
        value = F.to_json(F.col(f"`{name}`")) if nested else F.col(f"`{name}`").cast("string")
        return F.coalesce(value, F.lit(""))

    return rows.select(*[cell(c).alias(c) for c in columns or rows.columns])


def submission(results: DataFrame) -> DataFrame:
    """One record of each result to hand in, without anything that tells the gold answer."""
    rows = without_gold(results)
    return rows.select(F.lit(1).alias("schema_version"), *[F.col(f"`{c}`") for c in rows.columns if c != "schema_version"])


def markdown(title: str, sections: dict[str, DataFrame]) -> str:
    """A report of summaries: a heading and a table for each. Give it summaries, whose rows are few by their grouping."""
    out = [f"# {title}"]
    for name, rows in sections.items():
        table = cells(rows)
        lines = [[c.replace("|", "\\|").replace("\n", " ") for c in r] for r in table.collect()]
        out += ["", f"## {name}", "", "| " + " | ".join(table.columns) + " |", "|" + "-|" * len(table.columns), *["| " + " | ".join(line) + " |" for line in sorted(lines)]]
    return "\n".join(out) + "\n"


def write_run(scored: DataFrame, sections: dict[str, DataFrame], path: str) -> None:
    """The files of a run: rows as JSON lines and as a table, and the report of its summaries."""
    write_jsonl(scored, f"{path}/results")
    cells(scored).write.mode("overwrite").option("header", True).csv(f"{path}/table")
    text = markdown("Run", sections)
    scored.sparkSession.createDataFrame([(line,) for line in text.splitlines()], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
