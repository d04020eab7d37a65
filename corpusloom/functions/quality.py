"""Quality metrics of raw text and the level they imply (FN-14..17), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.ids import WS, WS_CHARS

#: Thresholds of the levels.
MIN_CHARS, MAX_CONTROL, GARBAGE_ALPHA, LOW_ALPHA, MEDIUM_ALPHA = 200, 0.10, 0.15, 0.40, 0.65
INSTITUTION = r"(?iu)MINISTÉRIO\s+DA\s+DEFESA"
PAGE_NUMBER = r"(?:^|\n)\s*[0-9]{1,3}\s*/\s*[0-9]{1,3}\s*(?:\n|$)"


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def quality_metrics(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with the counts and ratios of its content; a null content counts as empty."""
    text = F.coalesce(F.col(content), F.lit(""))
    lines = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))
    bare = lambda x: F.btrim(x, F.lit(WS_CHARS))
    size = lambda p: F.size(F.filter(lines, p)).cast("bigint")
    counted = df.withColumns(
        {
            "total_chars": F.length(text).cast("bigint"),
            "total_words": F.regexp_count(text, F.lit(f"[^{WS[1:]}+")).cast("bigint"),
            "total_lines": F.size(lines).cast("bigint"),
            "empty_lines": size(lambda x: bare(x) == ""),
            "alpha_count": F.regexp_count(text, F.lit(r"\p{L}")).cast("bigint"),
            "digit_count": F.regexp_count(text, F.lit(r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]")).cast("bigint"),
            "control_count": F.regexp_count(text, F.lit(r"[\p{C}&&[^\n\r\t]]")).cast("bigint"),
            "header_repetitions": F.regexp_count(text, F.lit(INSTITUTION)).cast("bigint"),
            "page_number_count": F.regexp_count(text, F.lit(PAGE_NUMBER)).cast("bigint"),
            "noise_lines": size(lambda x: (bare(x) != "") & ~x.rlike(r"\p{L}")),
            "short_lines": size(lambda x: F.length(bare(x)).between(1, 4)),
            "toc_lines": size(lambda x: F.regexp_count(x, F.lit(r"\.")) > 20),
        }
    )
    return counted.withColumns(
        {
            "alpha_ratio": ratio(F.col("alpha_count"), F.col("total_chars")),
            "control_ratio": ratio(F.col("control_count"), F.col("total_chars")),
            "noise_line_ratio": ratio(F.col("noise_lines"), F.col("total_lines")),
            "empty_line_ratio": ratio(F.col("empty_lines"), F.col("total_lines")),
        }
    )


def quality_level() -> Column:
    """Level of a row that has the metrics: ``garbage``, ``low``, ``medium`` or ``good``."""
    return (
        F.when(F.col("total_chars") == 0, "garbage")
        .when(F.col("total_chars") < MIN_CHARS, "low")
        .when((F.col("control_ratio") > MAX_CONTROL) | (F.col("alpha_ratio") < GARBAGE_ALPHA), "garbage")
        .when(F.col("alpha_ratio") < LOW_ALPHA, "low")
        .when(F.col("alpha_ratio") < MEDIUM_ALPHA, "medium")
        .otherwise("good")
    )


def reject_reason() -> Column:
    """Why a row that has the metrics is rejected, null if it isn't (FN-17)."""
    percent = lambda c: F.concat(F.format_string("%.1f", F.col(c) * 100), F.lit("%"))
    return (
        F.when(F.col("total_chars") == 0, "Empty content")
        .when(F.col("total_chars") < MIN_CHARS, F.concat(F.lit("Content too short ("), F.col("total_chars").cast("string"), F.lit(" chars)")))
        .when(F.col("control_ratio") > MAX_CONTROL, F.concat(F.lit("Excessive control characters ("), percent("control_ratio"), F.lit(")")))
        .when(F.col("alpha_ratio") < GARBAGE_ALPHA, F.concat(F.lit("Alpha ratio too low ("), percent("alpha_ratio"), F.lit(")")))
        .when(F.col("alpha_ratio") < LOW_ALPHA, F.concat(F.lit("Low text quality ("), percent("alpha_ratio"), F.lit(")")))
    )


def accepted(df: DataFrame, content: str = "content", cleaned: str | None = None, least: int = 50) -> DataFrame:
    """Rows whose raw text passes the quality gate and, if ``cleaned`` names it, whose cleaned text has ``least`` characters (FLT-09)."""
    columns = df.columns
    out = quality_metrics(df, content).filter(quality_level().isin("medium", "good")).select(*columns)
    return out if cleaned is None else out.filter(F.length(cleaned) >= least)


def warnings() -> Column:
    """What a row that has the metrics should be looked at for (FN-17)."""
    count = lambda c, text: F.concat(F.col(c).cast("string"), F.lit(text))
    return F.array_compact(
        F.array(
            F.when(F.col("header_repetitions") > 3, count("header_repetitions", " repeated institutional headers")),
            F.when(F.col("page_number_count") > 5, count("page_number_count", " embedded page numbers")),
            F.when(F.col("noise_line_ratio") > 0.3, F.concat(F.format_string("%.0f", F.col("noise_line_ratio") * 100), F.lit("% of lines have no alphabetic content"))),
            F.when(F.col("toc_lines") > 10, count("toc_lines", " table-of-contents lines")),
        )
    )
