"""Transactions as stored by a node: headers, instructions, balance changes by owner, pools, swap owners and transfers.

Rows come with a key ``tx`` of their own.  Balances are a long table (tx, owner, token, delta, pre, post), never nested
maps; wrapped SOL counts as SOL.  Owners that tie are told apart by name.

Defined cases: missing arrays count as empty; instructions that the node has parsed, or whose data is no base58, are
left out; a token account without an owner is its own; a token's balance that is missing on one side is zero.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import BASE58, base58_decode, relative_difference
from .slippage import decode

# Fixed values.
SOL, WRAPPED = "SOL", "So11111111111111111111111111111111111111112"
VOTE = "Vote111111111111111111111111111111111111111"
UNIT, SIGNER_EPSILON, OWNER_TOLERANCE = 1e9, 1e-4, 0.05

_BALANCE = "array<struct<accountIndex:int,mint:string,owner:string,uiTokenAmount:struct<amount:string,decimals:int>>>"
_CALL = "struct<programId:string,programIdIndex:int,data:string,accounts:array<string>,parsed:string>"
META = f"struct<err:string,fee:long,preBalances:array<long>,postBalances:array<long>,preTokenBalances:{_BALANCE},postTokenBalances:{_BALANCE},innerInstructions:array<struct<index:int,instructions:array<{_CALL}>>>,loadedAddresses:struct<writable:array<string>,readonly:array<string>>>"
SCHEMA = f"slot long, blockTime long, transaction struct<signatures:array<string>,message:struct<accountKeys:array<struct<pubkey:string,signer:boolean>>,instructions:array<{_CALL}>>>, meta {META}"
_WIRE_CALL = T.StructType().add("program", T.IntegerType()).add("accounts", T.ArrayType(T.IntegerType())).add("data", T.BinaryType())
WIRE = T.StructType().add("signatures", T.ArrayType(T.StringType())).add("keys", T.ArrayType(T.StringType())).add("signers", T.IntegerType()).add("instructions", T.ArrayType(_WIRE_CALL))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Transactions of JSON files, each an array of them, in the node's parsed form."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return rows.withColumn("tx", F.element_at("transaction.signatures", 1))


def read_blocks(rows: DataFrame) -> DataFrame:
    """(slot, position, ...) of blocks as JSON text: columns slot and block; a slot without a block has no row."""
    block = F.from_json("block", f"blockTime long, transactions array<struct<transaction:struct<signatures:array<string>,message:struct<accountKeys:array<struct<pubkey:string,signer:boolean>>,instructions:array<{_CALL}>>>,meta:{META}>>, rewards array<struct<pubkey:string,lamports:long,rewardType:string>>")
    parsed = rows.select("slot", block.alias("b")).where("b.transactions is not null")
    each = parsed.select("slot", F.col("b.blockTime").alias("blockTime"), F.posexplode("b.transactions").alias("position", "t"))
    return each.select("slot", "blockTime", "position", "t.transaction", "t.meta", F.element_at("t.transaction.signatures", 1).alias("tx"))


def block_leaders(rows: DataFrame) -> DataFrame:
    """(slot, leader): who got a block's fee reward; columns slot and block."""
    rewards = F.from_json("block", "rewards array<struct<pubkey:string,rewardType:string>>")["rewards"]
    fee = F.filter(rewards, lambda r: r["rewardType"] == "Fee")
    return rows.select("slot", F.get(fee, F.lit(0))["pubkey"].alias("leader")).where("leader is not null")


def _base58(raw: bytes) -> str:
    number, out = int.from_bytes(raw, "big"), ""
    while number:
        number, r = divmod(number, 58)
        out = BASE58[r] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out


def parse_wire(raw: bytes) -> dict | None:
    """The parts of a serialised transaction, of either message version; null if it is cut short."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(raw):
            raise EOFError
        at += n
        return raw[at - n : at]

    def count() -> int:  # seven bits a byte, least first
        n = shift = 0
        while True:
            byte = take(1)[0]
            n |= (byte & 127) << shift
            if byte < 128:
                return n
            shift += 7

    try:
        signatures = [_base58(take(64)) for _ in range(count())]
        signers = take(1)[0]
        if signers >= 128:
            signers = take(1)[0]
        take(2)
        keys = [_base58(take(32)) for _ in range(count())]
        take(32)
        instructions = []
        for _ in range(count()):
            program = take(1)[0]
            accounts = list(take(count()))
            instructions.append({"program": program, "accounts": accounts, "data": take(count())})
    except EOFError:
        return None
    return {"signatures": signatures, "keys": keys, "signers": signers, "instructions": instructions}


@F.pandas_udf(WIRE)
def wire_parts(raw: pd.Series) -> pd.DataFrame:
    found = [parse_wire(r) if r is not None else None for r in raw]
    names = ("signatures", "keys", "signers", "instructions")
    return pd.DataFrame([{k: f[k] for k in names} if f else dict.fromkeys(names) for f in found], columns=list(names))


def headers(rows: DataFrame) -> DataFrame:
    """tx, slot, signature, signers, programs, fee, is_failed, is_vote, accounts, inner_missing."""
    keys = F.col("transaction.message.accountKeys")
    programs = F.transform("transaction.message.instructions", lambda i: i["programId"])
    return rows.select(
        "tx", "slot", F.element_at("transaction.signatures", 1).alias("signature"),
        F.transform(F.filter(keys, lambda k: k["signer"]), lambda k: k["pubkey"]).alias("signers"), programs.alias("programs"), F.col("meta.fee").alias("fee"),
        F.col("meta.err").isNotNull().alias("is_failed"), ((F.size(programs) == 1) & (F.get(programs, F.lit(0)) == VOTE)).alias("is_vote"),
        accounts(rows).alias("accounts"), F.col("meta.innerInstructions").isNull().alias("inner_missing"),
    )


def headers_from_wire(rows: DataFrame) -> DataFrame:
    """The same from rows whose transaction is base64 text in ``encoded``."""
    parsed = rows.withColumn("w", wire_parts(F.unbase64("encoded")))
    loaded = F.concat(*[F.coalesce(F.col(f"meta.loadedAddresses.{x}"), F.array().cast("array<string>")) for x in ("writable", "readonly")])
    programs = F.transform("w.instructions", lambda i: F.get(F.col("w.keys"), i["program"]))
    return parsed.select(
        "tx", "slot", F.element_at("w.signatures", 1).alias("signature"), F.slice("w.keys", 1, F.col("w.signers")).alias("signers"), programs.alias("programs"), F.col("meta.fee").alias("fee"),
        F.col("meta.err").isNotNull().alias("is_failed"), ((F.size(programs) == 1) & (F.get(programs, F.lit(0)) == VOTE)).alias("is_vote"),
        F.concat("w.keys", loaded).alias("accounts"), F.col("meta.innerInstructions").isNull().alias("inner_missing"), F.col("w.instructions").alias("calls"),
    )


def accounts(rows: DataFrame) -> Column:
    """All accounts of a transaction: its own, then loaded ones to write, then to read."""
    own = F.transform("transaction.message.accountKeys", lambda k: k["pubkey"])
    return F.concat(own, *[F.coalesce(F.col(f"meta.loadedAddresses.{x}"), F.array().cast("array<string>")) for x in ("writable", "readonly")])


def instructions(rows: DataFrame, programs: list[str]) -> DataFrame:
    """(tx, at, program, data, is_inner, parent) of the named programs, top-level first, then inner ones in order."""
    everything = accounts(rows)
    top = F.transform(F.coalesce("transaction.message.instructions", F.array().cast(f"array<{_CALL}>")), lambda i: F.struct(i.alias("call"), F.lit(False).alias("is_inner"), F.lit(-1).alias("parent")))
    groups = F.coalesce("meta.innerInstructions", F.array().cast(f"array<struct<index:int,instructions:array<{_CALL}>>>"))
    inner = F.flatten(F.transform(groups, lambda g: F.transform(g["instructions"], lambda i: F.struct(i.alias("call"), F.lit(True).alias("is_inner"), g["index"].alias("parent")))))
    each = rows.select("tx", everything.alias("accounts"), F.posexplode(F.concat(top, inner)).alias("at", "x"))
    program = F.coalesce(F.col("x.call.programId"), F.get("accounts", F.col("x.call.programIdIndex")))
    kept = each.select("tx", "at", program.alias("program"), F.col("x.call.data").alias("text"), F.col("x.is_inner").alias("is_inner"), F.col("x.parent").alias("parent"), F.col("x.call.parsed").isNotNull().alias("parsed"))
    kept = kept.where(F.col("program").isin(programs) & ~F.col("parsed") & (F.col("text") != ""))
    return kept.select("tx", "at", "program", base58_decode("text").alias("data"), "is_inner", "parent").where("data is not null")


def token_decimals(rows: DataFrame) -> DataFrame:
    """(tx, token, decimals) of the tokens that a transaction's balances name, SOL included."""
    both = F.concat(*[F.coalesce(F.col(f"meta.{x}TokenBalances"), F.array().cast(_BALANCE)) for x in ("pre", "post")])
    named = rows.select("tx", F.explode(both).alias("b")).select("tx", F.col("b.mint").alias("token"), F.col("b.uiTokenAmount.decimals").alias("decimals"))
    return named.unionByName(rows.select("tx", F.lit(SOL).alias("token"), F.lit(9).alias("decimals"))).groupBy("tx", "token").agg(F.max("decimals").alias("decimals"))


def balances(rows: DataFrame) -> DataFrame:
    """(tx, owner, token, delta, pre, post): sums over an owner's accounts; SOL only where it changed."""
    named = rows.select("tx", "meta", accounts(rows).alias("accounts"))
    sol = named.select("tx", F.explode(F.arrays_zip(F.col("accounts").alias("owner"), F.col("meta.preBalances").alias("pre"), F.col("meta.postBalances").alias("post"))).alias("b")).where("b.owner is not null and b.pre <> b.post")
    sol = sol.select("tx", "b.owner", F.lit(SOL).alias("token"), (F.col("b.pre") / UNIT).alias("pre"), (F.col("b.post") / UNIT).alias("post"), ((F.col("b.post") - F.col("b.pre")) / UNIT).alias("delta"))

    def side(which: str) -> DataFrame:
        each = named.select("tx", "accounts", F.explode(f"meta.{which}TokenBalances").alias("b"))
        account = F.get("accounts", F.col("b.accountIndex"))
        amount = F.coalesce(F.col("b.uiTokenAmount.amount").try_cast("decimal(20,0)"), F.lit(0)).cast("double") / F.pow(F.lit(10.0), F.col("b.uiTokenAmount.decimals"))
        zero = F.lit(0.0)
        out = each.where(account.isNotNull()).select("tx", F.when(F.length("b.owner") > 0, F.col("b.owner")).otherwise(account).alias("owner"), F.when(F.col("b.mint") == WRAPPED, SOL).otherwise(F.col("b.mint")).alias("token"), amount.alias("amount"))
        return out.select("tx", "owner", "token", (F.col("amount") if which == "pre" else zero).alias("pre"), (F.col("amount") if which == "post" else zero).alias("post"), (F.col("amount") * (-1 if which == "pre" else 1)).alias("delta"))

    return sol.unionByName(side("pre")).unionByName(side("post")).groupBy("tx", "owner", "token").agg(F.sum("delta").alias("delta"), F.sum("pre").alias("pre"), F.sum("post").alias("post"))


def pools(changes: DataFrame, top: DataFrame) -> DataFrame:
    """Owners of which one token came and one went: (tx, pool, income_token, income, expense_token, expense).

    A signer's SOL counts without the fee, and not at all under ``SIGNER_EPSILON``; no change counts as coming.
    """
    paid = top.select("tx", "signers", (F.col("fee") / UNIT).alias("fee_sol"))
    met = changes.join(paid, "tx")
    own_sol = F.array_contains("signers", F.col("owner")) & (F.col("token") == SOL)
    amount = F.when(own_sol, F.col("delta") + F.col("fee_sol")).otherwise(F.col("delta"))
    kept = met.select("tx", "owner", "token", amount.alias("amount"), (own_sol & (F.abs(amount) < SIGNER_EPSILON)).alias("dust")).where("not dust")
    went = F.col("amount") < 0
    sums = kept.groupBy("tx", F.col("owner").alias("pool")).agg(
        F.count_if(~went).alias("incomes"), F.count_if(went).alias("expenses"),
        F.max(F.when(~went, F.struct("token", "amount"))).alias("i"), F.max(F.when(went, F.struct("token", "amount"))).alias("e"),
    )
    return sums.where("incomes = 1 and expenses = 1").select("tx", "pool", F.col("i.token").alias("income_token"), F.col("i.amount").alias("income"), F.col("e.token").alias("expense_token"), F.col("e.amount").alias("expense"))


def amm_pools(candidates: DataFrame, changes: DataFrame, top: DataFrame, labelled: DataFrame, owned: DataFrame) -> DataFrame:
    """Those candidates that are pools: labelled (pool), or no signer, with both balances positive before and after, and owned by a program (pool).

    Failed and vote transactions have none.
    """
    real = candidates.where((F.col("income") > 0) & (F.col("expense") < 0) & (F.col("income_token") != F.col("expense_token")))
    met = real.join(top.where(~F.col("is_failed") & ~F.col("is_vote")).select("tx", "signers"), "tx")
    met = met.join(labelled.select("pool", F.lit(True).alias("named")).distinct(), "pool", "left").join(owned.select("pool", F.lit(True).alias("held")).distinct(), "pool", "left")
    side = lambda name: changes.select("tx", F.col("owner").alias("pool"), F.col("token").alias(f"{name}_token"), ((F.col("pre") > 0) & (F.col("post") > 0)).alias(f"{name}_full"))
    met = met.join(side("income"), ["tx", "pool", "income_token"], "left").join(side("expense"), ["tx", "pool", "expense_token"], "left")
    full = F.coalesce("income_full", F.lit(False)) & F.coalesce("expense_full", F.lit(False))
    chosen = F.col("named") | (~F.array_contains("signers", F.col("pool")) & full & F.col("held"))
    return met.where(F.coalesce(chosen, F.lit(False))).select(*candidates.columns)


def pool_legs(amms: DataFrame, changes: DataFrame, top: DataFrame, decoded: DataFrame) -> DataFrame:
    """Legs by (pool, income_token, expense_token) with their swap's source and sink owner and whether the swap is one of several."""
    owners = swap_owners(amms, changes)
    swaps = decoded.where("limit_raw is not null").groupBy("tx").agg(F.count("*").alias("swaps"), F.min_by("program", "at").alias("first_program"))
    per_tx = amms.groupBy("tx").agg(F.count("*").alias("legs"))
    out = owners.join(per_tx, "tx").join(swaps, "tx", "left").join(top.select("tx", "slot", "signers"), "tx")
    return out.withColumn("is_multi_swap", (F.col("legs") > 1) | (F.coalesce("swaps", F.lit(0)) > 1)).drop("legs", "swaps")


def swap_owners(amms: DataFrame, changes: DataFrame) -> DataFrame:
    """Each pool leg with source_owner, sink_owner and has_inline_transfer.

    One owner that both gave the income and got the expense, each within ``OWNER_TOLERANCE``, is both; else the closest
    on either side.  Other pools of the transaction are nobody's owner.
    """
    others = changes.join(amms.select("tx", F.col("pool").alias("owner")), ["tx", "owner"], "left_anti").select("tx", F.col("owner").alias("o"), F.col("token").alias("t"), F.col("delta").alias("d"))
    gave = amms.join(others, "tx").where((F.col("t") == F.col("income_token")) & (F.col("d") < 0)).select("tx", "pool", "o", relative_difference(-F.col("d"), F.col("income")).alias("gave"))
    got = amms.join(others, "tx").where((F.col("t") == F.col("expense_token")) & (F.col("d") > 0)).select("tx", "pool", "o", relative_difference(F.col("d"), -F.col("expense")).alias("got"))
    near = gave.where(F.col("gave") <= OWNER_TOLERANCE).join(got.where(F.col("got") <= OWNER_TOLERANCE), ["tx", "pool", "o"], "full")
    best = near.groupBy("tx", "pool").agg(
        F.min_by("o", F.when(F.col("gave").isNotNull() & F.col("got").isNotNull(), F.struct(F.col("gave") + F.col("got"), F.col("o")))).alias("one"),
        F.min_by("o", F.when(F.col("gave").isNotNull(), F.struct("gave", "o"))).alias("source"),
        F.min_by("o", F.when(F.col("got").isNotNull(), F.struct("got", "o"))).alias("sink"),
    )
    out = amms.join(best, ["tx", "pool"], "left")
    out = out.select(*amms.columns, F.coalesce("one", "source").alias("source_owner"), F.coalesce("one", "sink").alias("sink_owner"))
    return out.withColumn("has_inline_transfer", F.coalesce(F.col("source_owner") != F.col("sink_owner"), F.lit(False)))


def owner_sets(legs: DataFrame, changes: DataFrame, token: Column, inferred: str, sign: int) -> DataFrame:
    """(tx, owners): the inferred owner of a leg, else all whose balance of the token moved that way."""
    moved = changes.where(F.col("delta") * sign > 0).select("tx", F.col("owner").alias("o"), F.col("token").alias("t"))
    met = legs.select("tx", F.col(inferred).alias("own"), token.alias("b")).join(moved, "tx", "left").where(F.col("own").isNotNull() | (F.col("t") == F.col("b")))
    return met.groupBy("tx").agg(F.sort_array(F.collect_set(F.coalesce("own", "o"))).alias("owners"))


def inline_transfers(legs: DataFrame, changes: DataFrame) -> DataFrame:
    """(tx, source_owner, sink_owner, token, amount) of legs whose proceeds went to another owner than the payer."""
    some = legs.where("has_inline_transfer and source_owner is not null and sink_owner is not null")
    gained = changes.select("tx", F.col("owner").alias("sink_owner"), F.col("token").alias("expense_token"), F.col("delta").alias("amount"))
    return some.join(gained, ["tx", "sink_owner", "expense_token"]).where("amount > 0").select("tx", "source_owner", "sink_owner", F.col("expense_token").alias("token"), "amount")


def direct_transfers(between: DataFrame, changes: DataFrame, swapped: DataFrame) -> DataFrame:
    """Transfers of a token from front to back owners between a candidate's legs.

    between: (candidate, tx, token, from_owners, to_owners), a row for each transaction in between; swapped: tx that hold
    swaps and count for nothing.  Returns (candidate, tx, source_owner, sink_owner, token, amount).
    """
    met = between.join(swapped.select("tx").distinct(), "tx", "left_anti").join(changes, ["tx", "token"])
    gives = (F.col("delta") < 0) & F.array_contains("from_owners", F.col("owner"))
    takes = (F.col("delta") > 0) & F.array_contains("to_owners", F.col("owner"))
    sums = met.groupBy("candidate", "tx", "token").agg(F.sum(F.when(gives, -F.col("delta"))).alias("amount"), F.min(F.when(gives, F.col("owner"))).alias("source_owner"), F.min(F.when(takes, F.col("owner"))).alias("sink_owner"))
    return sums.where("amount > 0 and sink_owner is not null").select("candidate", "tx", "source_owner", "sink_owner", "token", "amount")


def linked(candidates: DataFrame, inline: DataFrame, direct: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Candidates whose front and back belong together, with the kind of evidence.

    candidates: (candidate, front_signers, back_signers, front_owners, back_owners, back_b); inline and direct: amounts by
    candidate.  Same signer, else owners of the back among those of the front, else transfers of about the back's amount.
    """
    sums = lambda rows, name: rows.groupBy("candidate").agg(F.sum("amount").alias(name))
    met = candidates.join(sums(inline, "inline_b"), "candidate", "left").join(sums(direct, "direct_b"), "candidate", "left")
    bridge = F.coalesce("inline_b", F.lit(0.0)) + F.coalesce("direct_b", F.lit(0.0))
    evidence = (
        F.when(F.arrays_overlap("front_signers", "back_signers"), "signer")
        .when(F.size(F.array_except("back_owners", "front_owners")) == 0, "owner")
        .when((bridge > 0) & (F.abs(F.col("back_b") - bridge) <= tolerance * F.greatest(F.col("back_b"), bridge)), "transfer")
    )
    return met.select(*candidates.columns, evidence.alias("evidence"), F.col("inline_b").isNotNull().alias("has_inline"), F.col("direct_b").isNotNull().alias("has_direct")).where("evidence is not null")


def decoded_instructions(rows: DataFrame, programs: list[str]) -> DataFrame:
    return decode(instructions(rows, programs))
