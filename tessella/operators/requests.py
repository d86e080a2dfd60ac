"""Requests to tools as JSON, checked against typed parameters: what is missing, of a wrong type or out of range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A test takes a parameter's value and the name of its JSON type, and tells its problem or null.
Test = Callable[[Column, Column], Column]

WRONG, RANGE, MISSING = "wrong type", "out of range", "missing"


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def text(choices: tuple[str, ...] = (), pattern: str | None = None) -> Test:
    def test(value: Column, kind: Column) -> Column:
        good = _text(value).isin(*choices) if choices else _text(value).rlike(pattern) if pattern else F.lit(True)
        return F.when(kind != "STRING", WRONG).when(~good, RANGE)

    return test


def flag(value: Column, kind: Column) -> Column:
    return F.when(kind != "BOOLEAN", WRONG)


def number(least: float | None = None, most: float | None = None, above: float | None = None, coerced: bool = False) -> Test:
    """A finite number; ``coerced`` takes texts of numbers too, the empty text and null as 0 and flags as 0 or 1."""

    def test(value: Column, kind: Column) -> Column:
        plain = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        amount = F.when(plain, F.try_variant_get(value, "$", "double"))
        if coerced:
            words = F.trim(_text(value))
            amount = F.coalesce(
                amount,
                F.when(kind == "STRING", F.when(words == "", 0.0).otherwise(F.when(words.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), words.try_cast("double")))),
                F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")),
                F.when(kind == "VOID", F.lit(0.0)),
            )
        good = amount < float("inf")
        for edge, fits in ((least, lambda a, e: a >= e), (most, lambda a, e: a <= e), (above, lambda a, e: a > e)):
            if edge is not None:
                good = good & fits(amount, F.lit(float(edge)))
        return F.when(amount.isNull(), WRONG).when(~good, RANGE)

    return test


def either(*tests: Test) -> Test:
    """One of several; the problem told is the last one's."""

    def test(value: Column, kind: Column) -> Column:
        problems = [t(value, kind) for t in tests]
        out = problems[-1]
        for p in problems[:-1]:
            out = F.when(p.isNull(), F.lit(None)).otherwise(out)
        return out

    return test


def array_of(item: Test) -> Test:
    def test(value: Column, kind: Column) -> Column:
        items = F.try_variant_get(value, "$", "array<variant>")
        bad = F.array_compact(F.transform(items, lambda x: item(x, F.schema_of_variant(x))))
        return F.when(~kind.startswith("ARRAY"), WRONG).otherwise(F.get(bad, F.lit(0)))

    return test


def fields(**tests: Test) -> Test:
    """An object whose fields, all needed but for those whose name ends in an underscore, pass their tests."""

    def test(value: Column, kind: Column) -> Column:
        found = []
        for name, inner in tests.items():
            part = F.try_variant_get(value, f"$.{name.rstrip('_')}", "variant")
            absent = F.lit(None) if name.endswith("_") else F.lit(MISSING)
            found.append(F.when(part.isNull(), absent).otherwise(inner(part, F.schema_of_variant(part))))
        return F.when(~kind.startswith("OBJECT"), WRONG).otherwise(F.coalesce(F.lit(None).cast("string"), *found))

    return test


# The tools, their parameters, and what each takes. A name with an asterisk is needed; a point stands for a field of an object.
LABEL = r"^\d{2}:\d{2}:\d{2}(\.\d+)?$"
_MODE = text(("low", "mid", "high", "max"))
_WIDTH = number(128, 2048, coerced=True)
_ROI = either(text(("auto", "per-window")), text(pattern=r"^\d+,\d+,\d+,\d+$"))
_AUTO_FLAG = either(flag, text(("auto",)))
_SIGNALS = ("scene_changes", "black_intervals", "silence", "freeze", "motion", "blur", "exposure", "loudness", "transcription")
TOOLS: dict[str, dict[str, Test]] = {
    "inspect": {"path*": text(), "exact_tokens": flag, "model": text()},
    "analyze": {"path*": text(), "filters*": fields(), **{f"filters.{s}": flag for s in _SIGNALS}},
    "watch": {
        "path*": text(),
        "mode": _MODE,
        "fps": either(number(above=0, coerced=True), text(("auto",))),
        "resolution": _WIDTH,
        "frame_format": text(("jpeg", "png")),
        "start_time": text(pattern=LABEL),
        "end_time": text(pattern=LABEL),
        "skip_audio": flag,
        "skip_metadata": flag,
        "skip_cached": flag,
        "segments": array_of(fields(start=text(pattern=LABEL), end=text(pattern=LABEL), fps=number(above=0), resolution_=number(128, 2048))),
        "view_sample": number(1),
        "view": array_of(text(pattern=LABEL)),
        "narrative_mode": flag,
        "roi": _ROI,
        "adaptive_sampling": flag,
        "probe_calibration": flag,
    },
    "measure": {"path*": text(), "mode": _MODE, "resolution": _WIDTH, "view_sample": number(1), "start_time": text(pattern=LABEL), "end_time": text(pattern=LABEL), "narrative_mode": flag, "adaptive_sampling": flag, "roi": _ROI, "model": text()},
    "configure": {
        "backend": text(("local", "gemini-api", "none")),
        "whisper_model": text(("tiny", "base", "small", "medium", "large-v3-turbo", "large-v3", "auto")),
        "default_mode": _MODE,
        "default_narrative_mode": _AUTO_FLAG,
        "default_adaptive_sampling": _AUTO_FLAG,
        "clear_sessions": flag,
    },
}


def problems(requests: DataFrame) -> DataFrame:
    """(series_id, tool, parameter, problem) of requests (series_id, tool, params JSON): each parameter that is missing, of a wrong type or out of range.

    Parameters that a tool does not know are passed over. 'unknown tool' and 'not an object' stand for the whole request, with a null parameter; a null
    request is an object without parameters. A JSON null is a value, of a wrong type for all but coerced numbers.
    """
    read = requests.select("series_id", "tool", F.try_parse_json(F.coalesce("params", F.lit("{}"))).alias("doc")).withColumn("fits", F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False)))
    told = lambda name, problem: F.struct(F.lit(name).alias("parameter"), problem.alias("problem"))
    by_tool = F.array(told(None, F.lit("unknown tool")))
    for tool, tests in TOOLS.items():
        found = []
        for name, test in tests.items():
            value = F.try_variant_get("doc", f"$.{name.rstrip('*')}", "variant")
            problem = F.when(value.isNull(), F.lit(MISSING) if name.endswith("*") else F.lit(None)).otherwise(test(value, F.schema_of_variant(value)))
            found.append(F.when(problem.isNotNull(), told(name.rstrip("*"), problem)))
        by_tool = F.when(F.col("tool") == tool, F.array_compact(F.array(*found))).otherwise(by_tool)
    whole = F.when(~F.col("fits") & F.col("tool").isin(*TOOLS), F.array(told(None, F.lit("not an object")))).otherwise(by_tool)
    return read.select("series_id", "tool", F.inline(whole))


def accepted(requests: DataFrame) -> DataFrame:
    """The requests (series_id, ...) without a problem."""
    return requests.join(problems(requests).select("series_id").distinct(), "series_id", "left_anti")
