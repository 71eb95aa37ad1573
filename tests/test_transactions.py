"""Transactions in the node's form: balances, pools, owners, transfers, limits, and the wire format."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from sequora.functions import scalars
from sequora.operators import slippage, transactions

POOL, USER, SINK, MINT = "poolowner", "useraddress", "sinkowner", "MintAddress"
PROGRAM = slippage.PROGRAMS["raydium_cpmm"][0]


def base58(raw):
    return transactions._base58(raw)


def call(limit):
    import hashlib

    return hashlib.sha256(b"global:swap_base_input").digest()[:8] + struct.pack("<QQ", 2_000_000_000, limit)


def transaction(limit=900_000, inner=True):
    token = lambda i, owner, amount: {"accountIndex": i, "mint": MINT, "owner": owner, "uiTokenAmount": {"amount": str(amount), "decimals": 6}}
    swap = {"programId": PROGRAM, "data": base58(call(limit)), "accounts": [USER, POOL]}
    return {
        "slot": 7, "blockTime": 1_700_000_000,
        "transaction": {"signatures": ["sig1"], "message": {"accountKeys": [{"pubkey": USER, "signer": True}, {"pubkey": POOL, "signer": False}, {"pubkey": "ata1", "signer": False}, {"pubkey": "ata2", "signer": False}], "instructions": [{"programId": "other", "data": "1", "accounts": []}]}},
        "meta": {"err": None, "fee": 5000, "preBalances": [5_000_000_000, 9_000_000_000, 1, 1], "postBalances": [2_999_995_000, 11_000_000_000, 1, 1], "preTokenBalances": [token(2, POOL, 50_000_000), token(3, USER, 0)], "postTokenBalances": [token(2, POOL, 49_000_000), token(3, USER, 1_000_000)],
                 "innerInstructions": [{"index": 0, "instructions": [swap, {"programId": PROGRAM, "parsed": {"x": 1}}]}] if inner else None},
    }


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tx") / "one.json"
    at.write_text(json.dumps([transaction()]))
    return transactions.read_json(spark, str(at))


def test_a_swap_from_stored_form_to_consumption(rows):
    top = transactions.headers(rows)
    head = top.first()
    assert (head.signature, head.signers, head.is_failed, head.is_vote, head.inner_missing) == ("sig1", [USER], False, False, False)
    changes = transactions.balances(rows)
    assert {(r.owner, r.token): round(r.delta, 9) for r in changes.collect()} == {(USER, "SOL"): -2.000005, (POOL, "SOL"): 2.0, (POOL, MINT): -1.0, (USER, MINT): 1.0}
    found = transactions.pools(changes, top)
    assert {r.pool for r in found.collect()} == {POOL, USER}
    spark = rows.sparkSession
    amms = transactions.amm_pools(found, changes, top, spark.createDataFrame([], "pool string"), spark.createDataFrame([(POOL,), (USER,)], "pool string"))
    assert [(r.pool, r.income_token, r.income, r.expense_token, r.expense) for r in amms.collect()] == [(POOL, "SOL", 2.0, MINT, -1.0)]
    calls = transactions.instructions(rows, [PROGRAM])
    decoded = slippage.decode(calls)
    legs = transactions.pool_legs(amms, changes, top, decoded).collect()
    assert [(r.source_owner, r.sink_owner, r.has_inline_transfer, r.is_multi_swap, r.first_program) for r in legs] == [(USER, USER, False, False, PROGRAM)]
    victims = amms.select("tx", F.lit(PROGRAM).alias("program"), F.col("income_token").alias("from_token"), F.col("expense_token").alias("to_token"), F.col("income").alias("from_amount"), (-F.col("expense")).alias("to_amount"), F.lit(False).alias("inner_missing"))
    r = slippage.victim_limits(victims, calls, transactions.token_decimals(rows)).first()
    assert (r.venue, r.limit_type, r.limit_amount, round(r.consumption, 9), r.state) == ("raydium_cpmm", "output", 0.9, 0.9, "measured")
    several = slippage.victim_limits(victims, calls.unionByName(calls), transactions.token_decimals(rows)).first()
    assert (several.state, several.limit_type, several.consumption) == ("ambiguous", "", None)


def test_states_by_urgency(spark):
    rows = [("a", "measured", 0.5), ("a", "measured", 0.2), ("b", "measured", 0.001), ("c", "measured", 0.9), ("c", "out_of_range", None), ("d", "ambiguous", None), ("d", "missing_inner", None), ("e", "unsupported", None), ("e", "out_of_range", None), ("f", "measured", 0.01)]
    got = {r.k: (r.state, r.consumption) for r in slippage.summary(spark.createDataFrame(rows, "k string, state string, consumption double"), "k").collect()}
    assert got == {"a": ("measured", 0.5), "b": ("unprotected", None), "c": ("out_of_range", None), "d": ("missing_inner", None), "e": ("unsupported", None), "f": ("measured", 0.01)}


def test_cut_and_unknown_instructions(spark):
    rows = [("x", PROGRAM, call(5)), ("cut", PROGRAM, call(5)[:20]), ("none", "unknown", call(5)), ("zero", PROGRAM, call(0)), ("big", PROGRAM, call((1 << 64) - 1))]
    got = {r.tx: (r.limit_type, None if r.limit_raw is None else int(r.limit_raw), r.no_protection) for r in slippage.decode(spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], "tx string, program string, data binary")).collect()}
    assert got == {"x": ("output", 5, False), "cut": (None, None, None), "none": (None, None, None), "zero": ("output", 0, True), "big": ("output", (1 << 64) - 1, False)}


def test_transfers_link_signers(spark):
    between = spark.createDataFrame([("c", "t1", MINT, ["f"], ["b"]), ("c", "t2", MINT, ["f"], ["b"])], "candidate string, tx string, token string, from_owners array<string>, to_owners array<string>")
    changes = spark.createDataFrame([("t1", "f", MINT, -9.5), ("t1", "b", MINT, 9.5), ("t2", "f", MINT, -1.0), ("t2", "b", MINT, 1.0)], "tx string, owner string, token string, delta double")
    direct = transactions.direct_transfers(between, changes, spark.createDataFrame([("t2",)], "tx string"))
    assert [tuple(r) for r in direct.collect()] == [("c", "t1", "f", "b", MINT, 9.5)]
    sides = [("c", ["s1"], ["s2"], ["f"], ["b"], 10.0), ("d", ["s1"], ["s1"], ["f"], ["b"], 10.0), ("e", ["s1"], ["s2"], ["f"], ["f"], 10.0), ("g", ["s1"], ["s2"], ["f"], ["b"], 10.0)]
    candidates = spark.createDataFrame(sides, "candidate string, front_signers array<string>, back_signers array<string>, front_owners array<string>, back_owners array<string>, back_b double")
    got = {r.candidate: r.evidence for r in transactions.linked(candidates, direct.limit(0), direct).collect()}
    assert got == {"c": "transfer", "d": "signer", "e": "owner"}


def test_owners_apart(spark):
    amms = spark.createDataFrame([("t", POOL, "A", 10.0, "B", -20.0)], "tx string, pool string, income_token string, income double, expense_token string, expense double")
    changes = spark.createDataFrame([("t", POOL, "A", 10.0), ("t", POOL, "B", -20.0), ("t", "payer", "A", -10.2), ("t", "taker", "B", 19.9), ("t", "far", "A", -5.0)], "tx string, owner string, token string, delta double")
    legs = transactions.swap_owners(amms, changes)
    r = legs.first()
    assert (r.source_owner, r.sink_owner, r.has_inline_transfer) == ("payer", "taker", True)
    assert [tuple(x) for x in transactions.inline_transfers(legs, changes).collect()] == [("t", "payer", "taker", "B", 19.9)]
    assert transactions.owner_sets(legs, changes, F.col("expense_token"), "sink_owner", 1).first().owners == ["taker"]


@pytest.mark.parametrize("version", [b"", b"\x80"])
def test_wire_format(version):
    keys = [bytes([i]) * 32 for i in (1, 2, 3)]
    body = b"\x01" + b"\x07" * 64 + version + bytes([1, 0, 1]) + b"\x03" + b"".join(keys) + b"\x00" * 32 + b"\x01" + bytes([2, 2, 0, 1]) + bytes([3]) + b"abc" + (b"\x00" if version else b"")
    got = transactions.parse_wire(body)
    assert (got["signers"], got["keys"], got["signatures"]) == (1, [base58(k) for k in keys], [base58(b"\x07" * 64)])
    assert got["instructions"] == [{"program": 2, "accounts": [0, 1], "data": b"abc"}]
    assert transactions.parse_wire(body[:100]) is None


def test_wire_and_base58_columns(spark):
    raw = [b"\x00\x00hello", b"", bytes(range(40))]
    rows = spark.createDataFrame([(base58(r),) for r in raw] + [("0OIl",), (None,)], "t string")
    assert [None if r.b is None else bytes(r.b) for r in rows.select(scalars.base58_decode("t").alias("b")).collect()] == [*raw, None, None]


def test_blocks_and_rewards(spark):
    block = json.dumps({"blockTime": 5, "transactions": [{"transaction": transaction()["transaction"], "meta": transaction()["meta"]}], "rewards": [{"pubkey": "v", "rewardType": "Voting"}, {"pubkey": "leader", "rewardType": "Fee"}]})
    rows = spark.createDataFrame([(3, block), (4, None)], "slot long, block string")
    assert [(r.slot, r.position, r.tx) for r in transactions.read_blocks(rows).collect()] == [(3, 0, "sig1")]
    assert [tuple(r) for r in transactions.block_leaders(rows).collect()] == [(3, "leader")]
