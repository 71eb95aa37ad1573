"""Slippage limits read from swap instructions, by a table of rules, and the share of them that swaps consumed.

A rule names a program, the bytes its instruction starts with, the place of the 64-bit limit and how its kind is told.
The table has a row for every instruction that carries a limit, some forty, and is joined by program.

Defined cases: data cut short of the limit, unknown programs and unknown instructions decode to null; a limit of zero on
an output is a swap without protection, on an input a bound that no swap can keep.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import byte_at, normalised_label, ratio, u64_le

# Programs by the name of their venue.
PROGRAMS = {
    "pumpfun": ["6EF8rrecthR5Dkzon8Nwu78hRvfCKubJ14M5uBEwF6P"],
    "pumpfun_amm": ["pAMMBay6oceH9fJKBRHGP5D4bD4sWpmSwMn52FMfXEA"],
    "raydium_v4": ["675kPX9MHTjS2zt1qfr1NYHuzeLXfQM9H24wFSUt1Mp8"],
    "raydium_cpmm": ["CPMMoo8L3F4NbTegBCKVNunggL7H1ZpdTHKxQB5qKP1C"],
    "raydium_clmm": ["CAMMCzo5YL8w4VFF8KVHrK22GGUsp5VTaW7grrKgrWqK"],
    "meteora_dbc": ["dbcij3LWUppWqq96dh6gJWwBifmcGfLSB5D4DuSMaqN"],
    "meteora_damm_v2": ["cpamdpZCGKUy5JxQXB4dcpGPiikHawvSWAd6mEn1sGG"],
    "meteora_dlmm": ["LBUZKhRxPF3XUpBCjp4YzTKgLccjZhTSDM9YuVaPwxo"],
    "whirlpool": ["whirLbMiicVdio4qvUfM5KAg6Ct8VwpYzGff3uctyCc"],
    "orca_token_swap": ["DjVE6JNiYqPL2QXyCUUh8rNjHrbz9hXHNYt99MQ59qw1", "9W959DqEETiGZocYWCQPaJ6sBmUzgfxXfqGeTEdp3aQP"],
    "pancakeswap": ["HpNfyc2Saw7RKkQd8nEL4khUcuPhQ7WwY1B2qjx8jxFq"],
}
# Fixed values: (venue, method or first byte, least length, place of the limit, place of the byte that tells its kind,
# the kind).  output and input are kinds; "output if set" needs the byte, "input if 2" takes output where there is none.
RULES = (
    ("pumpfun", "buy", 24, 16, None, "input"), ("pumpfun", "sell", 24, 16, None, "output"), ("pumpfun", "buy_exact_sol_in", 24, 16, None, "output"),
    ("pumpfun_amm", "buy", 24, 16, None, "input"), ("pumpfun_amm", "sell", 24, 16, None, "output"), ("pumpfun_amm", "buy_exact_quote_in", 24, 16, None, "output"), ("pumpfun_amm", "sell_exact_quote_out", 24, 16, None, "input"),
    ("raydium_v4", 9, 17, 9, None, "output"), ("raydium_v4", 16, 17, 9, None, "output"), ("raydium_v4", 11, 17, 1, None, "input"), ("raydium_v4", 17, 17, 1, None, "input"),
    ("raydium_cpmm", "swap_base_input", 24, 16, None, "output"), ("raydium_cpmm", "swap_base_output", 16, 8, None, "input"),
    ("raydium_clmm", "swap", 41, 16, 40, "output if set"), ("raydium_clmm", "swap_v2", 41, 16, 40, "output if set"),
    ("meteora_dbc", "swap", 24, 16, None, "output"), ("meteora_dbc", "swap2", 24, 16, 24, "input if 2"),
    ("meteora_damm_v2", "swap", 24, 16, None, "output"), ("meteora_damm_v2", "swap2", 24, 16, 24, "input if 2"),
    ("meteora_dlmm", "swap", 24, 16, None, "output"), ("meteora_dlmm", "swap2", 24, 16, None, "output"), ("meteora_dlmm", "swap_exact_out", 16, 8, None, "input"), ("meteora_dlmm", "swap_exact_out2", 16, 8, None, "input"),
    ("whirlpool", "swap", 41, 16, 40, "output if set"), ("whirlpool", "swap_v2", 41, 16, 40, "output if set"), ("whirlpool", "two_hop_swap", 27, 16, 24, "output if set"), ("whirlpool", "two_hop_swap_v2", 27, 16, 24, "output if set"),
    ("orca_token_swap", 1, 17, 9, None, "output"),
    ("pancakeswap", "swap", 41, 16, 40, "output if set"), ("pancakeswap", "swap_v2", 41, 16, 40, "output if set"),
)
CEILING_TOLERANCE, FLOOR = 1e-9, 0.01
#: What stands for a sandwich without a figure, most urgent first.
STATES = ("missing_inner", "ambiguous", "unsupported", "out_of_range")
DECIMALS = 9


def rules(spark: SparkSession) -> DataFrame:
    """(r_program, venue, tag, least, place, mode_at, mode); tag in hex."""
    rows = [(program, venue, tag if isinstance(tag, str) else None, None if isinstance(tag, str) else f"{tag:02X}", least, place, at, mode) for venue, tag, least, place, at, mode in RULES for program in PROGRAMS[venue]]
    table = spark.createDataFrame(rows, "r_program string, venue string, method string, byte string, least int, place int, mode_at int, mode string")
    named = F.upper(F.substring(F.sha2(F.concat(F.lit("global:"), F.col("method")).cast("binary"), 256), 1, 16))
    return table.select("r_program", "venue", F.coalesce("byte", named).alias("tag"), "least", "place", "mode_at", "mode")


def decode(instructions: DataFrame) -> DataFrame:
    """Instructions (program, data, ...) with venue, limit_type, limit_raw decimal(20,0) and no_protection, or nulls."""
    table = F.broadcast(rules(instructions.sparkSession))  # a row a rule
    fits = (F.col("program") == F.col("r_program")) & F.hex("data").startswith(F.col("tag")) & (F.octet_length("data") >= F.col("least"))
    met = instructions.join(table, fits, "left")
    flag = byte_at(F.col("data"), F.col("mode_at"))
    kind = F.when(F.col("mode") == "output if set", F.when(flag != 0, "output").otherwise("input")).when(F.col("mode") == "input if 2", F.when(flag == 2, "input").otherwise("output")).otherwise(F.col("mode"))
    limit = u64_le(F.col("data"), F.col("place"))
    return met.select(*instructions.columns, "venue", kind.alias("limit_type"), limit.alias("limit_raw"), ((kind == "output") & (limit == 0)).alias("no_protection"))


def consumption(limit_type: Column, limit: Column, actual: Column) -> Column:
    """The share consumed in [0, 1]; null where limit and amounts contradict each other."""
    share = F.when(limit_type == "output", F.when(limit == 0, 0.0).when((actual > 0) & (limit > 0), ratio(limit, actual))).when(limit_type == "input", F.when((limit > 0) & (actual > 0), ratio(actual, limit)))
    return F.when(share <= 1 + CEILING_TOLERANCE, F.least(share, F.lit(1.0)))


def victim_limits(victims: DataFrame, instructions: DataFrame, decimals: DataFrame) -> DataFrame:
    """Victims (tx, program, from_token, to_token, from_amount, to_amount, inner_missing) with their limit and state.

    Only instructions of the sandwiched program count.  state: measured, out_of_range, ambiguous for several that decode
    (these keep no limit type), and for none missing_inner or unsupported.  decimals: (tx, token, decimals), 9 if unknown.
    """
    found = decode(instructions.select("tx", "program", "data")).where("limit_raw is not null")
    per_tx = found.groupBy(F.col("tx").alias("t"), F.col("program").alias("p")).agg(F.count("*").alias("decoded"), F.min("limit_type").alias("limit_type"), F.min("limit_raw").alias("limit_raw"), F.min("venue").alias("venue"))
    met = victims.join(per_tx, (F.col("tx") == F.col("t")) & (F.col("program") == F.col("p")), "left").drop("t", "p")
    token = F.when(F.col("limit_type") == "input", F.col("from_token")).otherwise(F.col("to_token"))
    met = met.withColumn("limited", token)
    named = decimals.select(F.col("tx").alias("d_tx"), F.col("token").alias("d_token"), "decimals")
    met = met.join(named, (F.col("tx") == F.col("d_tx")) & (F.col("limited") == F.col("d_token")), "left")
    limit = F.col("limit_raw").cast("double") / F.pow(F.lit(10.0), F.coalesce("decimals", F.lit(DECIMALS)))
    actual = F.when(F.col("limit_type") == "input", F.col("from_amount")).otherwise(F.col("to_amount"))
    one = F.col("decoded") == 1
    share = F.when(one, consumption(F.col("limit_type"), limit, actual))
    state = F.when(F.col("decoded") > 1, "ambiguous").when(one, F.when(share.isNotNull(), "measured").otherwise("out_of_range")).when(F.col("inner_missing"), "missing_inner").otherwise("unsupported")
    return met.select(*victims.columns, F.when(one, F.col("venue")).alias("venue"), F.when(one, F.col("limit_type")).otherwise("").alias("limit_type"), F.when(one, limit).alias("limit_amount"), F.when(one, actual).alias("actual_amount"), share.alias("consumption"), state.alias("state"))


def summary(victims: DataFrame, key: str) -> DataFrame:
    """(key, state, consumption): the most urgent state of its victims, else the highest share of at least ``FLOOR``.

    unprotected: all victims are measured and below the floor.
    """
    seen = {s: F.bool_or(F.col("state") == s) for s in STATES}
    top = F.max(F.when((F.col("state") == "measured") & (F.col("consumption") >= FLOOR), F.col("consumption")))
    grouped = victims.groupBy(key).agg(*[e.alias(s) for s, e in seen.items()], top.alias("top"))
    odd = F.coalesce(*[F.when(F.col(s), s) for s in STATES])
    state = F.coalesce(odd, F.when(F.col("top").isNotNull(), "measured").otherwise("unprotected"))
    return grouped.select(key, state.alias("state"), F.when(odd.isNull(), F.col("top")).alias("consumption"))


def venue_names(programs: Mapping[str, str], label: Column) -> Column:
    """The venue of a program: of the table, else its label in a normal form."""
    table = F.create_map(*[F.lit(x) for pair in programs.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col("program")), normalised_label(label))
