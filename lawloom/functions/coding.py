"""Quantisation and code lengths as columns, sequence codes as windows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantize_index(value: Column, step: str | Column) -> Column:
    """Index of the nearest multiple of the step, halves away from zero, in decimals read from the number's text."""
    step = F.lit(Decimal(step)).cast("decimal(18,9)") if isinstance(step, str) else step.cast("decimal(18,9)")
    return F.round(value.cast("string").cast("decimal(28,9)") / step).cast("long")


def representative(index: Column, step: str) -> Column:
    return (index.cast("decimal(20,0)") * F.lit(Decimal(step)).cast("decimal(18,9)")).cast("double")


def natural_bits(n: Column) -> Column:
    """floor(log2(n+1)) + 2 floor(log2(floor(log2(n+1)) + 1)) + 1 by the length of the binary text (exact)."""
    log2 = lambda c: F.length(F.bin(c + 1)) - 1
    first = log2(n)
    return first + 2 * log2(first.cast("long")) + 1


def zigzag(z: Column) -> Column:
    return F.when(z >= 0, 2 * z).otherwise(-2 * z - 1)


def signed_bits(z: Column) -> Column:
    return natural_bits(zigzag(z))


def string_bits(text: Column) -> Column:
    """Code of the byte count plus codes of the bytes."""
    n = F.octet_length(text)
    hexes = F.hex(text.cast("binary"))
    byte = lambda i: F.conv(F.substring(hexes, 2 * i - 1, F.lit(2)), 16, 10).cast("long")
    bytes_ = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), byte)).otherwise(F.array().cast("array<bigint>"))
    return natural_bits(n.cast("long")) + F.aggregate(bytes_, F.lit(0), lambda a, b: a + natural_bits(b).cast("int"))


def program_bits(text: Column) -> Column:
    """Code of the token count plus the text's code."""
    tokens = F.filter(F.split(F.translate(text, "()", "  "), r"\s+"), lambda t: t != "")
    return natural_bits(F.size(tokens).cast("long")) + string_bits(text)


def natural_code_length(n: int) -> int:
    """The same code on the driver."""
    first = (n + 1).bit_length() - 1
    return first + 2 * ((first + 1).bit_length() - 1) + 1


def sequence_bits(indices: DataFrame, by: list[str], index: str = "index") -> DataFrame:
    """Code of the length plus codes of the indices: data_bits of each group."""
    m = indices.groupBy(*by).agg(F.count("*").alias("n"), F.sum(signed_bits(F.col(index))).alias("_b"))
    return m.select(*by, "n", (natural_bits(F.col("n")) + F.col("_b")).cast("long").alias("data_bits"))


def prequential_rows(indices: DataFrame, by: list[str], order: str, index: str = "index") -> DataFrame:
    """Adaptive Laplace code: bits of each row from counts of earlier rows, by three windows."""
    w = Window.partitionBy(*by).orderBy(order)
    same = Window.partitionBy(*by, index).orderBy(order)
    rows = indices.withColumn("prefix_count", F.row_number().over(w) - 1).withColumn("symbol_count", F.row_number().over(same) - 1)
    new = F.when(F.col("symbol_count") == 0, 1).otherwise(0)
    rows = rows.withColumn("alphabet_size", F.coalesce(F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    den = F.greatest(F.col("prefix_count") + F.col("alphabet_size") + new, F.lit(1))
    return rows.withColumn("bits", -F.log2((F.col("symbol_count") + 1) / den))


def escape_rows(indices: DataFrame, by: list[str], order: str, index: str = "index") -> DataFrame:
    """Adaptive code with an explicit escape: a new symbol pays the escape and its own signed code."""
    rows = prequential_rows(indices, by, order, index)
    p, a, c = F.col("prefix_count"), F.col("alphabet_size"), F.col("symbol_count")
    escape = F.when(p + a == 0, F.lit(0.0)).otherwise(-F.log2(F.when(a > 0, a) / (p + a)))
    seen = -F.log2(F.when(c > 0, c) / F.when(p + a > 0, p + a))
    return rows.withColumn("bits", F.when(c == 0, escape + signed_bits(F.col(index))).otherwise(seen))


REFERENCES = ("raw_quantized_transformed_sequence", "naive_last_observation", "seasonal_naive", "differenced_local_linear")


def reference_indices(indexed: DataFrame, step: str, period: int = 1) -> DataFrame:
    """Residual indices of the four naive references: entity, idx, reference, index."""
    w = Window.partitionBy("entity").orderBy("idx")
    y, lag = F.col("target"), lambda k: F.lag("target", k).over(w)
    local = F.when(F.col("idx") == 0, 0.0).when(F.col("idx") == 1, lag(1)).otherwise(lag(1) + (lag(1) - lag(2)))
    base = [F.lit(0.0), F.coalesce(lag(1), F.lit(0.0)), F.coalesce(lag(period), F.lit(0.0)), local]
    out = indexed.select("entity", "idx", F.array(*(F.struct(F.lit(r).alias("reference"), (y - b).alias("residual")) for r, b in zip(REFERENCES, base))).alias("_r"))
    out = out.select("entity", "idx", F.explode("_r").alias("r")).select("entity", "idx", "r.reference", "r.residual")
    return out.withColumn("index", quantize_index(F.round("residual", 9), step))


def reference_bits(indexed: DataFrame, step: str, period: int = 1) -> DataFrame:
    """reference_bits of each entity and reference: the choice among the references plus the data."""
    m = sequence_bits(reference_indices(indexed, step, period), ["entity", "reference"])
    return m.withColumn("reference_bits", F.col("data_bits") + natural_code_length(len(REFERENCES)))


def description_gain(fitted: DataFrame, indexed: DataFrame, step: str, bank: int = 4, minimum: float = 0.0) -> DataFrame:
    """Bits that each family saves against the raw reference, and whether that is over the minimum.

    fitted: entity, idx, target, family, fitted, n_parameters. A parameter costs the code of its count
    on a unit lattice (one index each), the family the code of the bank's size.
    """
    idx = fitted.withColumn("index", quantize_index(F.round(F.col("target") - F.col("fitted"), 9), step))
    bits = sequence_bits(idx, ["entity", "family", "n_parameters"])
    ref = reference_bits(indexed, step).where(F.col("reference") == REFERENCES[0]).select("entity", "reference_bits")
    total = F.col("data_bits") + natural_code_length(bank) + natural_bits(F.col("n_parameters").cast("long"))
    out = bits.join(ref, "entity").withColumn("total_bits", total.cast("long"))
    gain = F.col("reference_bits") - F.col("total_bits")
    return out.select("entity", "family", "data_bits", "total_bits", "reference_bits", gain.alias("gain_bits"), (gain > minimum).alias("admitted"))


def decimal_text(value: Decimal | str) -> str:
    """A decimal without exponent or trailing zeros."""
    text = format(Decimal(value).normalize(), "f")
    return (text.rstrip("0").rstrip(".") if "." in text else text) or "0"


def resolve_step(rows: DataFrame, mode: str, column: str = "target", step: str | None = None, resolution: str | None = None, fraction: str | None = None, fallback: str = "0.5") -> str:
    """The quantiser's step by policy: fixed, the measurement's resolution, or a share of the largest magnitude (one aggregate reaches the driver)."""
    given = {"fixed_step_mid_tread": step, "measurement_resolution_mid_tread": resolution, "scale_adaptive_mid_tread": fraction}
    if mode not in given:
        raise ValueError(f"unsupported quantization mode: {mode}")
    if given[mode] is None or Decimal(given[mode]) <= 0:
        raise ValueError(f"invalid_quantization_step: {mode} needs a positive decimal")
    if mode != "scale_adaptive_mid_tread":
        return decimal_text(given[mode])
    largest = rows.agg(F.max(F.abs(column)).alias("m")).first()["m"]
    return scale_adaptive_step(largest or 0.0, given[mode], fallback)


def lattice_steps(residual_step: str, parameter_step: str | None = None, state_step: str | None = None) -> dict[str, str]:
    """Steps on which parameters and states are coded: their own, or else the residuals'."""
    return {"parameter": decimal_text(parameter_step or residual_step), "state": decimal_text(state_step or residual_step)}


def literal_bits(value, step: str, kind: str = "scalar") -> int:
    """Code length of one literal on the driver, by its type: programs, truth values, whole numbers, lattice numbers, text."""
    zig = lambda z: natural_code_length(2 * z if z >= 0 else -2 * z - 1)
    text = lambda s: natural_code_length(len(s.encode())) + sum(map(natural_code_length, s.encode()))
    if kind == "program":
        return natural_code_length(len(str(value).replace("(", " ").replace(")", " ").split())) + text(str(value))
    if value is None or isinstance(value, bool):
        return 1
    if isinstance(value, int):
        return zig(value)
    if isinstance(value, float):
        return zig(int((Decimal(str(value)) / Decimal(step)).to_integral_value(rounding="ROUND_HALF_UP")))
    if isinstance(value, str):
        return text(value)
    raise ValueError(f"unsupported_literal_code_value: {type(value).__name__}")


def map_bits(values: Column, step: str) -> Column:
    """Codes of a map's numbers on a lattice."""
    return F.aggregate(F.map_values(values), F.lit(0).cast("long"), lambda a, v: a + signed_bits(quantize_index(v, step)).cast("long"))


def codelength_terms(rows: DataFrame, steps: dict[str, str], bank: int = 4) -> DataFrame:
    """rows: structure_bits, literal_bits, parameters and state (maps), data_bits. Adds the six terms and their sum."""
    terms = {
        "l_family": F.lit(natural_code_length(bank)), "l_structure": F.col("structure_bits"), "l_literals": F.col("literal_bits"),
        "l_params": map_bits(F.col("parameters"), steps["parameter"]), "l_state": map_bits(F.col("state"), steps["state"]), "l_data": F.col("data_bits"),
    }
    total = sum((c.cast("long") for c in terms.values()), F.lit(0).cast("long"))
    return rows.withColumns({k: c.cast("long") for k, c in terms.items()}).withColumn("l_total", total)


def row_set_id(rows: DataFrame) -> DataFrame:
    """One row: a digest of which rows were coded, whatever their order and files: count and wrapping sums of four hashes of each row, hashed."""
    body = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ("entity", "event_time", "available_at", "target")]
    sha = F.sha2(F.concat_ws("|", *body), 256)
    lanes = [F.sum(F.conv(F.substring(sha, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return rows.agg(F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *(F.coalesce(x, F.lit("0")) for x in lanes)), 256)).alias("row_set_id"))


#: What must agree before code lengths may be compared, in the order in which a mismatch is reported.
COMPARISON_FIELDS = (
    "quantization_mode", "quantization_step", "reference_scope", "reference_family_id", "reference_policy_id", "data_code_family", "support_kind", "horizon_geometry", "coding_row_set_id",
    "residual_history_construction", "parameter_lattice_step", "state_lattice_step", "runtime_signature",
)


def comparable(keys: DataFrame) -> DataFrame:
    """One row: whether all comparison keys agree, and else the first field that doesn't. Columns that the table lacks count as equal."""
    own = [c for c in COMPARISON_FIELDS if c in keys.columns]
    differs = [F.when(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))) > 1, F.lit(f"{c}_mismatch")) for c in own]
    reason = F.coalesce(*differs) if differs else F.lit(None).cast("string")
    return keys.agg(reason.alias("reason_code")).select(F.col("reason_code").isNull().alias("comparable"), "reason_code")


def scale_adaptive_step(max_abs: float, fraction: str = "0.01", fallback: str = "0.5") -> str:
    """Quantisation step as a share of the largest magnitude; the fallback where that is zero."""
    if max_abs == 0:
        return fallback
    return format((Decimal(str(max_abs)) * Decimal(fraction)).normalize(), "f")
