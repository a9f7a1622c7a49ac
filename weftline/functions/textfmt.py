"""Log parsing and text formatting. Column expressions, but for parse_log, which reads a table of whole log texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("test_loss", "test_accuracy", "auc", "aupr", "precision", "recall", "f1")
NUMBER = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"


def duration(seconds: Column) -> Column:
    """1h02m03s, 2m03s or 3s; negative counts as 0s."""
    s = F.floor(F.greatest(seconds, F.lit(0))).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))


def ellipsize(s: Column, n: int) -> Column:
    """At most n characters, the last three of a longer text dots; n of 3 or less leaves no room for these."""
    if n <= 3:
        return F.substring(s, 1, max(0, n))
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n - 3), F.lit("...")))


def safe_filename(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9_.-]+", "_")


def percent(x: Column, digits: int = 1) -> Column:
    return F.when(x.isNull() | F.isnan(x), "N/A").otherwise(F.format_string(f"%.{digits}f%%", x * 100))


def log_fields(text: Column, stem: Column | None = None) -> dict[str, Column]:
    """label (stem, the file's name, if the text has none), split sizes, label counts, metrics and stop epoch of one log text; null where a line is missing."""
    field = lambda pattern, g=1: F.nullif(F.regexp_extract(text, pattern, g), F.lit(""))
    sizes = r"Split sizes: train=([0-9]+), val=([0-9]+), test=([0-9]+)"
    counts = r"Label distribution test=\{0: ([0-9]+), 1: ([0-9]+)\}"
    label = field(r"=== (.+?) ===")
    out = {"label": label if stem is None else F.coalesce(label, stem)}
    out |= {f"n_{n}": field(sizes, k + 1).cast("long") for k, n in enumerate(("train", "val", "test"))}
    out |= {f"test_{k}": field(counts, k + 1).cast("long") for k in (0, 1)}
    out |= {m: field(rf"(?:^|\s){m}={NUMBER}").cast("double") for m in METRICS}
    out["stop_epoch"] = field(r"epoch=([0-9]+)[^\n]*\(STOP\)").cast("long")
    return out


#: The columns of the table of strata, in order.
STRATUM_COLUMNS = ("stratum", "n", "accuracy", "auc", "aupr", "precision", "recall", "f1")


def stratum_rows(logs: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """The table after `Per-cas_subtype test metrics:`: name and STRATUM_COLUMNS, one row a stratum; `nan` is NaN. Its heading and other lines are no rows."""
    head = "Per-cas_subtype test metrics:"
    tail = F.expr(f"substring(`{text}`, instr(`{text}`, '{head}') + {len(head)})")
    number = r"\s+([0-9.]+|nan)"
    row = rf"(?m)^(\S+)\s+([0-9]+){number * 6}"
    lines = logs.where(F.col(text).contains(head)).select(name, F.explode(F.regexp_extract_all(tail, F.lit(row), F.lit(0))).alias("line"))
    part = lambda k: F.regexp_extract("line", row, k)
    value = lambda k: F.when(part(k) == "nan", F.lit(float("nan"))).otherwise(part(k).try_cast("double"))
    return lines.select(name, part(1).alias("stratum"), part(2).cast("long").alias("n"), *[value(k + 1).alias(c) for k, c in enumerate(STRATUM_COLUMNS) if k > 1])
