"""Raw block and receipt responses to typed entities, their joins, and the table views that fill nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hexnum import hex_to_dec, normalized_address, u256_decimal
from ..schemas import FIELDS
from ..sources.readers import dealt

WIDE = {"difficulty", "total_difficulty", "value", "token_id", "total_supply"}
DATES = {"ath_date", "atl_date"}


def normalised(entity: str, rows: DataFrame) -> DataFrame:
    """The table view of messages: fields in order, nulls filled, fields that the table lacks dropped.

    Columns that rows do not have count as null. Wide numbers stay decimal text and get a double beside them
    (`<name>_double`). Of ticks, id becomes coin_id, ath and atl dates that cannot be read are null, and last_updated
    is a timestamp that must be readable.
    """
    out = []
    for name, kind, default in FIELDS[entity]:
        if default == "*":
            continue
        value = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        if default != "-":
            value = F.coalesce(value, F.lit(default).cast(kind))
        if name in DATES:
            value = F.try_to_timestamp(value)
        if name == "last_updated":
            value = F.to_timestamp(value)
        out.append(value.alias("coin_id" if (entity, name) == ("tick", "id") else name))
        if name in WIDE and kind == "string":
            out.append(value.try_cast("double").alias(f"{name}_double"))
    return rows.select(out)


def withdrawals(blocks: DataFrame) -> DataFrame:
    """One row a withdrawal; blocks without any give none."""
    w = blocks.select(F.col("number").alias("block_number"), F.col("timestamp").alias("block_timestamp"), F.col("hash").alias("block_hash"), F.inline("withdrawals"))
    return w.select("block_number", "block_timestamp", "block_hash", F.coalesce("index", F.lit(0)).alias("index"), F.coalesce("validator_index", F.lit(0)).alias("validator_index"), F.coalesce("address", F.lit("")).alias("address"), F.coalesce("amount", F.lit("0")).alias("amount"))


def logs(receipts: DataFrame) -> DataFrame:
    """One row a log, topic0 being its first topic or ''."""
    rows = receipts.select(F.inline("logs"))
    zero, empty = F.lit(0), F.lit("")
    return rows.select(
        F.coalesce("block_number", zero).alias("block_number"),
        F.coalesce("block_timestamp", zero).alias("block_timestamp"),
        F.coalesce("block_hash", empty).alias("block_hash"),
        F.coalesce("transaction_hash", empty).alias("transaction_hash"),
        F.coalesce("transaction_index", zero).cast("int").alias("transaction_index"),
        F.coalesce("log_index", zero).cast("int").alias("log_index"),
        F.coalesce("address", empty).alias("address"),
        F.coalesce(F.get("topics", zero), empty).alias("topic0"),
        "topics",
        F.coalesce("data", empty).alias("data"),
    )


def nested_receipts(flat_logs: DataFrame, key: str = "transaction_hash") -> DataFrame:
    """One row a key with its logs as an array, by log_index; a transaction's logs are few by the block's gas.

    Logs are shuffled first: lists gain nothing from being begun before it, and tasks would sort and spill their splits for that.
    """
    rest = ["log_index", *(c for c in flat_logs.columns if c not in (key, "log_index"))]
    return dealt(flat_logs, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("logs"))


# raw responses


def _block_columns(b: Column) -> dict[str, Column]:
    texts = {"hash": "hash", "mix_hash": "mixHash", "parent_hash": "parentHash", "nonce": "nonce", "sha3_uncles": "sha3Uncles", "logs_bloom": "logsBloom", "transactions_root": "transactionsRoot", "state_root": "stateRoot", "receipts_root": "receiptsRoot", "extra_data": "extraData", "withdrawals_root": "withdrawalsRoot", "parent_beacon_block_root": "parentBeaconBlockRoot"}
    numbers = {"number": "number", "size": "size", "gas_limit": "gasLimit", "gas_used": "gasUsed", "timestamp": "timestamp", "blob_gas_used": "blobGasUsed", "excess_blob_gas": "excessBlobGas"}
    return (
        {"type": F.lit("block")}
        | {k: b[v] for k, v in texts.items()}
        | {k: hex_to_dec(b[v]) for k, v in numbers.items()}
        | {
            "miner": normalized_address(b["miner"]),
            "difficulty": u256_decimal(b["difficulty"]),
            "total_difficulty": u256_decimal(b["totalDifficulty"]),
            "base_fee_per_gas": F.coalesce(hex_to_dec(b["baseFeePerGas"]), F.lit(0).cast("long")),
            "transaction_count": F.coalesce(F.array_size(b["transactions"]), F.lit(0)).cast("long"),
            "withdrawals": F.transform(F.coalesce(b["withdrawals"], F.array()), lambda w: F.struct(hex_to_dec(w["index"]).alias("index"), hex_to_dec(w["validatorIndex"]).alias("validator_index"), normalized_address(w["address"]).alias("address"), u256_decimal(w["amount"]).alias("amount"))),
        }
    )


def raw_blocks(raw: DataFrame) -> DataFrame:
    """Blocks of landed responses. Failed or missing blocks, and negative numbers, give no row."""
    rows = raw.where("error IS NULL AND block IS NOT NULL").select([c.alias(k) for k, c in _block_columns(F.col("block")).items()])
    return rows.where("number >= 0")


def _of_good_blocks(raw: DataFrame) -> DataFrame:
    b = F.col("block")
    return raw.where("error IS NULL AND block IS NOT NULL").select(hex_to_dec(b["number"]).alias("block_number"), b["hash"].alias("block_hash"), hex_to_dec(b["timestamp"]).alias("block_timestamp"), b["transactions"].alias("transactions"), "receipts")


def raw_transactions(raw: DataFrame) -> DataFrame:
    """Transactions of good blocks, with their block's number, hash and timestamp."""
    t = F.col("t")
    rows = _of_good_blocks(raw).select("block_number", "block_hash", "block_timestamp", F.explode("transactions").alias("t")).where("t IS NOT NULL")
    numbers = {"nonce": "nonce", "chain_id": "chainId", "transaction_index": "transactionIndex", "gas": "gas", "gas_price": "gasPrice", "max_fee_per_gas": "maxFeePerGas", "max_priority_fee_per_gas": "maxPriorityFeePerGas", "transaction_type": "type", "max_fee_per_blob_gas": "maxFeePerBlobGas"}
    return rows.select(F.lit("transaction").alias("type"), t["hash"].alias("hash"), "block_number", "block_hash", "block_timestamp", normalized_address(t["from"]).alias("from_address"), normalized_address(t["to"]).alias("to_address"), u256_decimal(t["value"]).alias("value"), t["input"].alias("input"), t["blobVersionedHashes"].alias("blob_versioned_hashes"), *(hex_to_dec(t[v]).alias(k) for k, v in numbers.items()))


def raw_receipts(raw: DataFrame) -> DataFrame:
    """Receipts of good blocks with their logs nested; the logs carry their block and, if they lack it, the receipt's transaction."""
    r = F.col("r")
    rows = _of_good_blocks(raw).select("block_number", "block_hash", "block_timestamp", F.explode("receipts").alias("r")).where("r IS NOT NULL")

    def log(entry: Column) -> Column:
        return F.struct(
            F.lit("log").alias("type"),
            hex_to_dec(entry["logIndex"]).alias("log_index"),
            F.coalesce(entry["transactionHash"], r["transactionHash"]).alias("transaction_hash"),
            F.coalesce(hex_to_dec(entry["transactionIndex"]), hex_to_dec(r["transactionIndex"])).alias("transaction_index"),
            F.col("block_hash"),
            F.col("block_number"),
            F.col("block_timestamp"),
            normalized_address(entry["address"]).alias("address"),
            entry["data"].alias("data"),
            F.coalesce(entry["topics"], F.array().cast("array<string>")).alias("topics"),
        )

    numbers = {"transaction_index": "transactionIndex", "cumulative_gas_used": "cumulativeGasUsed", "gas_used": "gasUsed", "effective_gas_price": "effectiveGasPrice", "blob_gas_used": "blobGasUsed", "blob_gas_price": "blobGasPrice", "status": "status"}
    return rows.select(
        F.lit("receipt").alias("type"),
        "block_number",
        "block_hash",
        "block_timestamp",
        r["transactionHash"].alias("transaction_hash"),
        normalized_address(F.coalesce(r["from"], r["fromAddress"])).alias("from_address"),
        normalized_address(F.coalesce(r["to"], r["toAddress"])).alias("to_address"),
        normalized_address(r["contractAddress"]).alias("contract_address"),
        r["logsBloom"].alias("logs_bloom"),
        r["root"].alias("root"),
        F.transform(F.coalesce(r["logs"], F.array()), log).alias("logs"),
        *(hex_to_dec(r[v]).alias(k) for k, v in numbers.items()),
    )


def with_receipts(transactions: DataFrame, receipts: DataFrame) -> DataFrame:
    """Transactions with the eight receipt_* columns of the receipt of their hash (any case); null without one."""
    names = ["cumulative_gas_used", "effective_gas_price", "gas_used", "blob_gas_price", "blob_gas_used", "contract_address", "status", "root"]
    right = receipts.select(F.lower("transaction_hash").alias("_hash"), *(F.col(c).alias(f"receipt_{c}") for c in names))
    return transactions.withColumn("_hash", F.lower("hash")).join(right, "_hash", "left").drop("_hash")


def with_block(children: DataFrame, blocks: DataFrame, key: str = "block_number") -> DataFrame:
    """Children with block_hash and block_timestamp of their block; children of a block that is not there are dropped."""
    right = blocks.select(F.col("number").alias(key), F.col("hash").alias("block_hash"), F.col("timestamp").alias("block_timestamp"))
    return children.drop("block_hash", "block_timestamp").join(right, key)


def touched_contracts(receipts: DataFrame, flat_logs: DataFrame) -> DataFrame:
    """Distinct addresses that a batch created or that logs came from."""
    created = receipts.select(F.lower("contract_address").alias("address"))
    return created.union(flat_logs.select(F.lower("address").alias("address"))).where("address IS NOT NULL AND address <> ''").distinct()


def unseen(addresses: DataFrame, known: DataFrame) -> DataFrame:
    """Addresses that no row of known has."""
    return addresses.join(known.select("address"), "address", "left_anti")


def creators(contracts: DataFrame, transactions: DataFrame) -> DataFrame:
    """For each contract the first transaction without a recipient whose receipt created it."""
    made = transactions.where("to_address IS NULL OR to_address = ''").select(F.lower("receipt_contract_address").alias("address"), F.struct("block_number", "transaction_index", "hash", "from_address").alias("t"))
    first = made.groupBy("address").agg(F.min("t").alias("t"))
    return contracts.select("address").join(first, "address").select("address", F.col("t.from_address").alias("creator_address"), F.col("t.hash").alias("creation_hash"), F.col("t.block_number").alias("creation_block"))
