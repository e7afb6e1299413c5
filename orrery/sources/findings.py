"""Tool outputs as ``(tool, path, line, severity, message)`` rows.

Every reader takes a frame with one column ``value``: a whole JSON document, or one line.
Values that do not parse give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<file_name:string,line_start:int>>"
PLACE = "struct<path:string,file:string,line:int,start:struct<line:int>>"
DIAGNOSTIC = f"severity:string,description:string,message:string,span:{PLACE},location:{PLACE}"
SCHEMAS = {
    "eslint": "array<struct<filePath:string,messages:array<struct<line:int,severity:int,message:string>>>>",
    "cargo": f"struct<reason:string,message:struct<level:string,message:string,code:struct<code:string>,spans:{SPAN}>>",
    "ruff": "array<struct<filename:string,message:string,code:string,location:struct<row:int>>>",
    "pylint": "array<struct<path:string,line:int,type:string,message:string>>",
    "golangci": "struct<Issues:array<struct<Text:string,Severity:string,Pos:struct<Filename:string,Line:int>>>>",
    "diagnostics": f"array<struct<{DIAGNOSTIC}>>",
    "gitleaks": "array<struct<File:string,StartLine:int,RuleID:string,Description:string>>",
    "trufflehog": "struct<DetectorName:string,Verified:boolean,SourceMetadata:struct<Data:struct<Filesystem:struct<file:string,line:int>>>>",
}


def _rows(df: DataFrame, tool: str, path: Column, line: Column, severity: Column, message: Column, verified: Column | None = None) -> DataFrame:
    checked = (F.lit(None) if verified is None else verified).cast("boolean")
    out = df.select(
        F.lit(tool).alias("tool"), path.alias("path"), F.greatest(F.coalesce(line, F.lit(1)), F.lit(1)).cast("int").alias("line"),
        severity.alias("severity"), message.alias("message"), checked.alias("verified"),
    )
    return out.where("path IS NOT NULL")


def _parsed(values: DataFrame, tool: str) -> DataFrame:
    return values.select(F.from_json("value", SCHEMAS[tool]).alias("x"))


def eslint(values: DataFrame) -> DataFrame:
    files = _parsed(values, "eslint").select(F.explode("x").alias("f"))
    each = files.select("f.filePath", F.explode("f.messages").alias("m"))
    level = F.when(F.col("m.severity") == 2, "error").when(F.col("m.severity") == 1, "warning").otherwise("info")
    return _rows(each, "eslint", F.col("filePath"), F.col("m.line"), level, F.col("m.message"))


def cargo(lines: DataFrame) -> DataFrame:
    """Compiler messages by their first span; plain information without a code is left out."""
    m = _parsed(lines, "cargo").where("x.reason = 'compiler-message'").select("x.message.*").where(F.size("spans") > 0)
    level = F.when(F.startswith("level", F.lit("error")), "error").when(F.col("level") == "warning", "warning").otherwise("info")
    kept = m.withColumn("sev", level).where("NOT (sev = 'info' AND code IS NULL)")
    return _rows(kept, "cargo", F.col("spans")[0]["file_name"], F.col("spans")[0]["line_start"], F.col("sev"), F.col("message"))


def ruff(values: DataFrame) -> DataFrame:
    each = _parsed(values, "ruff").select(F.explode("x").alias("f"))
    return _rows(each, "ruff", F.col("f.filename"), F.col("f.location.row"), F.lit("warning"), F.concat_ws(" ", "f.code", "f.message"))


def pylint(values: DataFrame) -> DataFrame:
    each = _parsed(values, "pylint").select(F.explode("x").alias("f"))
    level = F.when(F.col("f.type").isin("error", "fatal"), "error").when(F.col("f.type").isin("warning", "convention"), "warning").otherwise("info")
    return _rows(each, "pylint", F.col("f.path"), F.col("f.line"), level, F.col("f.message"))


def colon_separated(lines: DataFrame, tool: str) -> DataFrame:
    """``path:line:column: message`` lines, as flake8 and staticcheck print them."""
    parts = F.split("value", ":", 4)
    cut = lines.select(parts.alias("p")).where((F.size("p") == 4) & F.regexp_like(F.get("p", F.lit(1)), F.lit(r"^\d+$")))
    return _rows(cut, tool, F.trim(F.get("p", F.lit(0))), F.get("p", F.lit(1)).cast("int"), F.lit("warning"), F.trim(F.get("p", F.lit(3))))


def golangci(values: DataFrame) -> DataFrame:
    each = _parsed(values, "golangci").select(F.explode("x.Issues").alias("i"))
    return _rows(each, "golangci", F.col("i.Pos.Filename"), F.col("i.Pos.Line"), F.coalesce(F.nullif("i.Severity", F.lit("")), F.lit("warning")), F.col("i.Text"))


def severity_of(name: Column) -> Column:
    """``error``, ``warning`` or ``info`` from what a tool calls them; a warning where it names none."""
    low = F.lower(name)
    return F.when(low.isNull() | low.isin("warn", "warning"), "warning").when(low.isin("err", "error", "fatal"), "error").otherwise("info")


def _diagnostics(values: DataFrame, tool: str, message: Column, bare: bool) -> DataFrame:
    """Rows of ``{"diagnostics": [...]}``, or of the bare array; a diagnostic without a place has an empty path and line 1."""
    text = F.trim("value")
    held = F.from_json(text, f"struct<diagnostics:{SCHEMAS['diagnostics']}>")["diagnostics"]
    whole = F.when(F.startswith(text, F.lit("[")), F.from_json(text, SCHEMAS["diagnostics"]) if bare else None).otherwise(held)
    each = values.select(F.explode(whole).alias("d"))
    place = F.coalesce("d.span", "d.location")
    path = F.replace(F.coalesce(place["path"], place["file"], F.lit("")), F.lit("\\"), F.lit("/"))
    return _rows(each, tool, path, F.coalesce(place["line"], place["start"]["line"]), severity_of(F.col("d.severity")), F.coalesce(message, F.lit("lint issue")))


def biome(values: DataFrame) -> DataFrame:
    return _diagnostics(values, "biome", F.coalesce("d.description", "d.message"), bare=False)


def oxlint(values: DataFrame) -> DataFrame:
    return _diagnostics(values, "oxlint", F.col("d.message"), bare=True)


def gitleaks(values: DataFrame) -> DataFrame:
    each = _parsed(values, "gitleaks").select(F.explode("x").alias("f"))
    return _rows(each, "gitleaks", F.col("f.File"), F.col("f.StartLine"), F.lit("error"), F.coalesce("f.Description", "f.RuleID"))


def trufflehog(lines: DataFrame, only_verified: bool = False, strict: bool = False) -> DataFrame:
    """Secrets of an object a line, or of a whole array in one value.

    Lines that are no JSON are log output and left out; with ``strict`` a broken line that begins
    like an object or array is an error.
    """
    schema = SCHEMAS["trufflehog"]
    text = F.trim("value")
    many, broken = F.startswith(text, F.lit("[")), F.try_parse_json(text).isNull() & F.regexp_like(text, F.lit(r"^[\[{]"))
    refused = F.raise_error(F.concat(F.lit("broken secret report: "), F.substring(text, 1, 80))).cast(f"array<{schema}>")
    one = F.when(F.startswith(text, F.lit("{")) & ~broken, F.array(F.from_json(text, schema)))
    each = lines.select(F.explode(F.when(broken & F.lit(strict), refused).when(many, F.from_json(text, f"array<{schema}>")).otherwise(one)).alias("x"))
    place = F.col("x.SourceMetadata.Data.Filesystem")
    out = _rows(each, "trufflehog", place["file"], place["line"], F.lit("error"), F.col("x.DetectorName"), F.col("x.Verified"))
    return out.where("verified") if only_verified else out


def verdict(findings: Column) -> Column:
    """Any secret fails."""
    return F.when(findings > 0, "fail").otherwise("pass")


def repaired_reviews(values: DataFrame) -> DataFrame:
    """``(rule_id, status, message, affected)`` of model answers (column ``value``), broken ones repaired."""
    from orrery.sources.answers import repaired

    return repaired(values.select("value"))
