"""PII scan and findings operators (rows B1-B3, B7, D1-D6).

The scan is one narrow pass: the table is unpivoted into
``(dataset, key, column, cell)`` (an ``Expand``, no shuffle), every active
pattern is applied to each cell with ``regexp_extract_all`` and the matches are
exploded into one finding per match.  Column rules (safe / risky / e-mail /
numeric) are metadata and travel as literals inside each cell's struct, so
no per-row lookup is needed and the expression stays the same size however
wide the table is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import frame
from ..frame import DATASET, col
from ..functions import pii
from ..profiles import get_profile

FINDING_COLUMNS = ["dataset", "row_key", "column", "pii_type", "match_idx", "raw_value",
                   "masked", "confidence", "risk", "reason"]


def scan_cells(df: DataFrame, key: str | None = None, columns: list[str] | None = None,
               attrs: dict | None = None) -> DataFrame:
    """Long form ``(dataset, row_key, column, kind, [attrs...], cell)`` of every scannable, non-null cell (B2).

    Each cell travels as one struct with its column's name, kind and any extra
    per-column ``attrs`` (``{attr: {column: value}}``) as literals, so no
    per-row lookup by column name is needed however wide the table is.
    """
    df = frame.with_dataset(df)
    df, key = frame.with_row_key(df, key)
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    names = columns if columns is not None else frame.value_columns(df, key)
    kinds = {c: pii.text_kind(types[c]) for c in names}
    names = [c for c in names if kinds[c] is not None]
    extra = list((attrs or {}).items())
    fields = ["column", "kind"] + [a for a, _ in extra] + ["cell"]
    if not names:
        return (df.select(F.col(DATASET), col(key).alias("row_key"))
                .select(DATASET, "row_key", *[F.lit(None).cast("string").alias(f) for f in fields]).limit(0))

    def lit_sql(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        return "CAST(NULL AS STRING)" if v is None else pii.sql_str(str(v))

    def cell_struct(i, c):
        vals = [f"'column', {pii.sql_str(c)}", f"'kind', {pii.sql_str(kinds[c])}"]
        vals += [f"{pii.sql_str(a)}, {lit_sql(per_col.get(c))}" for a, per_col in extra]
        vals.append(f"'cell', {pii.as_text_sql(c, types[c])}")
        return f"named_struct({', '.join(vals)}) AS c{i}"

    # one SQL expression per column, parsed JVM-side: plan building stays fast for thousands of columns;
    wide = (df.select(F.col(DATASET), col(key).alias("row_key"), *[col(c) for c in names])
                        .selectExpr(DATASET, "row_key", *[cell_struct(i, c) for i, c in enumerate(names)]))
    long = wide.unpivot([DATASET, "row_key"], [f"c{i}" for i in range(len(names))], "slot", "v")
    return (long.select(DATASET, "row_key", *[F.col("v").getField(f).alias(f) for f in fields])
            .where(F.col("cell").isNotNull()))


def scan_pii(df: DataFrame, profile="cli", sensitivity: str = "medium", key: str | None = None,
             columns: list[str] | None = None, keep_cell: bool = False) -> DataFrame:
    """One finding per pattern match in any cell.

    Result columns: dataset, row_key, column, pii_type, match_idx (position of
    the match within its cell, pattern order then match order), raw_value,
    masked, confidence, risk, reason (null for the ``function`` profile).
    """
    prof = get_profile(profile)
    types = prof.active_types(sensitivity)                       # B1
    names = columns
    if names is None:
        d = frame.with_dataset(df)
        d, k = frame.with_row_key(d, key)
        names = frame.value_columns(d, k)
    attrs = {"col_class": {c: pii.column_class(c, prof) for c in names},
             "is_email": {c: pii.is_email_column(c, prof) for c in names}}
    cells = scan_cells(df, key, columns, attrs)
    is_text = F.col("kind") == "text"
    # B3 e-mail exemption; numeric cells can only ever hold a card number
    guards = {t: is_text for t in types if t != "CREDIT_CARD"}
    if "EMAIL" in guards:
        guards["EMAIL"] = is_text & ~F.col("is_email")
    facts = pii.prefilter_columns(F.col("cell"))
    guards = pii.and_guards(guards, pii.prefilter_guards(types, F.col("has_digit"), F.col("has_at")))
    conf = pii.confidence(F.col("col_class"), F.col("cell"), prof)
    reason = (pii.reason(F.col("col_class"), F.col("column")) if prof.with_reason
              else F.lit(None).cast("string"))
    # Each stage is one projection: prefilter facts, matches, confidence (per
    # cell, before the explode), then the findings.  posexplode_outer + a
    # filter on the generated column: a plain explode makes the optimizer
    # infer ``size(matches) > 0`` and push it below the projection, which
    # would run every regex twice.
    out = (cells
           .select("*", facts["has_digit"].alias("has_digit"), facts["has_at"].alias("has_at"))
           .select("*", pii.match_structs(F.col("cell"), types, prof, guards).alias("matches"))
           .select("*", F.when(F.size("matches") > 0, conf).alias("confidence"))
           .select(DATASET, "row_key", "column", "col_class", "confidence",
                   *([F.col("cell")] if keep_cell else []),
                   F.posexplode_outer("matches").alias("match_idx", "m"))
           .where(F.col("m").isNotNull()))
    return out.select(DATASET, "row_key", "column", F.col("m.pii_type").alias("pii_type"),
                      F.col("match_idx").cast("int").alias("match_idx"),
                      F.col("m.raw_value").alias("raw_value"), F.col("m.masked").alias("masked"),
                      "confidence", pii.risk_tier(F.col("confidence")).alias("risk"), reason.alias("reason"),
                      *(["cell"] if keep_cell else []))


def actionable(findings: DataFrame) -> DataFrame:
    """Findings of risk HIGH or MEDIUM."""
    return findings.where(F.col("risk").isin("HIGH", "MEDIUM"))


def sort_findings(findings: DataFrame) -> DataFrame:
    """Report order -- risk, then column, then row and match position."""
    return findings.orderBy(pii.risk_rank(F.col("risk")), "column", "row_key", "match_idx")


def ranked_findings(findings: DataFrame) -> DataFrame:
    """D2 as a column: ``position`` of each finding in the report order of its dataset."""
    w = Window.partitionBy(DATASET).orderBy(pii.risk_rank(F.col("risk")), "column", "row_key", "match_idx")
    return findings.withColumn("position", F.row_number().over(w))


def count_by_type(findings: DataFrame) -> DataFrame:
    """D3 + D4: instances per type and the dominant (worst) risk of the type."""
    return (findings.groupBy(DATASET, "pii_type")
            .agg(F.count(F.lit(1)).alias("instances"),
                 F.min(pii.risk_rank(F.col("risk"))).alias("_r"))
            .withColumn("dominant_risk", F.when(F.col("_r") == 0, "HIGH").when(F.col("_r") == 1, "MEDIUM")
                        .otherwise("LOW"))
            .drop("_r"))


#: States per (dataset, type) that are merged to its first findings and their number.
TOP_STATES = 256


def top_per_type(findings: DataFrame, k: int = 15, states: int = TOP_STATES) -> DataFrame:
    """First ``k`` findings per type in report order, plus the overflow count, in one pass over the findings.

    Findings are dealt to ``states`` states per (dataset, type) by a hash of their place; each state
    is its ``k`` first findings and its count.  Merging them reads ``k * states`` rows per type at
    most, whatever the number of findings, and a type that holds a third of all findings is
    spread over as many tasks.
    """
    order = [pii.risk_rank(F.col("risk")), F.col("column"), F.col("row_key"), F.col("match_idx")]
    state = [DATASET, "pii_type", "_state"]
    dealt = findings.withColumn("_state", F.pmod(F.xxhash64("row_key", "column", "match_idx"), F.lit(states)))
    kept = (dealt.withColumn("_first", F.row_number().over(Window.partitionBy(*state).orderBy(*order)))
            .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*state)))
            .where(F.col("_first") <= k))
    whole = Window.partitionBy(DATASET, "pii_type")
    return (kept.withColumn("rank", F.row_number().over(whole.orderBy(*order)))
            .withColumn("_all", F.sum(F.when(F.col("_first") == 1, F.col("_n"))).over(whole))
            .where(F.col("rank") <= k)
            .withColumn("more_instances", F.greatest(F.col("_all") - k, F.lit(0)))
            .drop("_state", "_first", "_n", "_all"))


def risk_counts(findings: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """HIGH / MEDIUM / LOW counts per dataset (zeros for datasets without findings)."""
    agg = (findings.groupBy(DATASET)
           .agg(F.count_if(F.col("risk") == "HIGH").alias("pii_high"),
                F.count_if(F.col("risk") == "MEDIUM").alias("pii_medium"),
                F.count_if(F.col("risk") == "LOW").alias("pii_low")))
    if datasets is None:
        return agg
    return (datasets.select(DATASET).distinct().join(agg, DATASET, "left")
            .fillna(0, ["pii_high", "pii_medium", "pii_low"]))


def remediation_preview(findings: DataFrame) -> DataFrame:
    """What will change -- risk, column, row, will-become, for actionable findings."""
    return actionable(findings).select(DATASET, "risk", "column", "row_key",
                                       F.col("masked").alias("will_become"))


def remediation_counts(findings: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Rows before and after dedup, and values to be changed, per dataset (datasets without findings included)."""
    todo = actionable(findings).groupBy(DATASET).agg(
        F.count(F.lit(1)).alias("values"), F.count_distinct("row_key").alias("rows_changed"))
    return (duplicates.select(DATASET, F.col("total_rows").alias("rows_before"),
                              (F.col("total_rows") - F.col("exact_duplicates")).alias("rows_after"))
            .join(todo, DATASET, "left").fillna(0, ["values", "rows_changed"]))
