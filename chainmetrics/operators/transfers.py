"""Token transfers out of event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hexnum import ZERO_ADDRESS, hex_to_dec, topic_address, u256_decimal, words

#: The event signatures of transfers.
TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
TRANSFER_SINGLE = "0xc3d58168c5aff7974da1a66a788d1049519506fa80b4184e5d6d9da9620699c4"
TRANSFER_BATCH = "0x4a39dc06d4c0dbc64b70af90fd698a233a518aa5d07e595d983b8c0526c8f7fb"

_MOVE = "array<struct<token_standard:string,id_word:string,value_word:string>>"


def transfer_type(sender: Column, receiver: Column) -> Column:
    return F.when(sender == ZERO_ADDRESS, "MINT").when(receiver == ZERO_ADDRESS, "BURN").otherwise("TRANSFER")


def _move(standard: str, id_word: Column | None = None, value_word: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(F.lit(standard).alias("token_standard"), (null if id_word is None else id_word).alias("id_word"), (null if value_word is None else value_word).alias("value_word"))


def _full(word: Column) -> Column:
    return F.coalesce(word.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def extract(logs: DataFrame) -> DataFrame:
    """One row a transfer, in a single pass over logs (address, topics, data and the log's context columns).

    Logs of other events, Transfer with fewer than three topics, TransferSingle and TransferBatch without four give no
    row. Transfer with three topics and one full word is ERC20, with four topics ERC721, else UNKNOWN. Bad data make a
    single transfer UNKNOWN and drop a batch, as do lists of different length; a batch gives a row for each of its ids.

    Words are picked step by step, as columns of their own, and become decimal numbers only in the transfers' rows.
    """
    context = [c for c in ("transaction_hash", "transaction_index", "log_index", "block_number", "block_hash", "block_timestamp", "chain_id") if c in logs.columns]
    topic = lambda i: F.get("topics", F.lit(i))
    rows = logs.withColumns({"_event": F.lower(topic(0)), "_size": F.coalesce(F.array_size("topics"), F.lit(0))})
    kinds = {"plain": (TRANSFER, F.col("_size") >= 3), "single": (TRANSFER_SINGLE, F.col("_size") == 4), "batch": (TRANSFER_BATCH, F.col("_size") == 4)}
    kind = F.lit(None).cast("string")
    for name, (signature, fits) in kinds.items():
        kind = F.when((F.col("_event") == signature) & fits, name).otherwise(kind)
    rows = rows.withColumns({"_kind": kind, "_words": words(F.col("data"))}).where("_kind IS NOT NULL")
    word = lambda i: F.get("_words", i if isinstance(i, Column) else F.lit(i))
    batch = F.col("_kind") == "batch"
    rows = rows.withColumns({f"_at{i}": F.when(batch, hex_to_dec(word(i))) for i in (0, 1)})
    inside = lambda at: (at % 32 == 0) & (at < 32 * F.size("_words").cast("long"))
    rows = rows.withColumns({f"_head{i}": F.when(inside(F.col(f"_at{i}")), (F.col(f"_at{i}") / 32).cast("int")) for i in (0, 1)})
    rows = rows.withColumns({f"_n{i}": hex_to_dec(word(F.col(f"_head{i}"))) for i in (0, 1)})
    fits = F.col("_n0") == F.col("_n1")
    for i in (0, 1):
        fits = fits & (F.col(f"_head{i}") + 1 + F.col(f"_n{i}") <= F.size("_words"))
    part = lambda i: F.when(F.col("_fits"), F.slice("_words", F.col(f"_head{i}") + 2, F.col(f"_n{i}").cast("int")))
    rows = rows.withColumn("_fits", F.coalesce(fits, F.lit(False))).withColumns({"_ids": part(0), "_values": part(1)})
    plain = F.when(F.col("_size") == 4, _move("ERC721", topic(3))).when((F.col("_size") == 3) & (F.size("_words") == 1) & _full(word(0)), _move("ERC20", None, word(0))).otherwise(_move("UNKNOWN"))
    single = F.when(_full(word(0)) & _full(word(1)), _move("ERC1155", word(0), word(1))).otherwise(_move("UNKNOWN"))
    many = F.when(F.forall(F.concat("_ids", "_values"), _full), F.zip_with("_ids", "_values", lambda i, v: _move("ERC1155", i, v)))
    moves = F.when(F.col("_kind") == "plain", F.array(plain)).when(F.col("_kind") == "single", F.array(single)).otherwise(many)
    first = F.when(F.col("_kind") == "plain", 1).otherwise(2)
    rows = rows.select(
        F.lower("address").alias("contract_address"),
        F.when(F.col("_kind") != "plain", topic_address(topic(1))).alias("operator_address"),
        topic_address(F.get("topics", first)).alias("from_address"),
        topic_address(F.get("topics", first + 1)).alias("to_address"),
        F.when(F.col("_kind") != "plain", F.upper("_kind")).alias("erc1155_mode"),
        *context,
        moves.cast(_MOVE).alias("_moves"),
    )
    # outer, and filtered behind it: else Catalyst would push size(_moves) > 0, with all that _moves is made of, below
    rows = rows.select("*", F.inline_outer("_moves")).drop("_moves").where("token_standard IS NOT NULL")
    decimals = {"token_id": u256_decimal(F.col("id_word")), "value": u256_decimal(F.col("value_word"))}
    return rows.withColumns(decimals | {"type": F.lit("token_transfer"), "transfer_type": transfer_type(F.col("from_address"), F.col("to_address"))}).drop("id_word", "value_word")
