"""Declared schemas of all entities, and the defaults that stand in for nulls in tables.

A field is `name type`, or `name type = default` where the table view fills nulls. Numbers of up to 256 bits are
decimal text. Fields marked with * stay out of the table.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

WITHDRAWAL = "index long, validator_index long, address string, amount string"
LOG = "type string, log_index long, transaction_hash string, transaction_index long, block_hash string, block_number long, block_timestamp long, address string, data string, topics array<string>"

#: One line a field: name, type, default ("-" for none, "*" if it is not in the table).
_ENTITIES = {
    "block": f"""
type|string|block
chain_id|long|0
number|long|0
hash|string|
parent_hash|string|
nonce|string|
sha3_uncles|string|
logs_bloom|string|
transactions_root|string|
state_root|string|
receipts_root|string|
miner|string|
difficulty|string|0
total_difficulty|string|0
size|long|0
extra_data|string|
gas_limit|long|0
gas_used|long|0
base_fee_per_gas|long|0
blob_gas_used|long|0
excess_blob_gas|long|0
transaction_count|int|0
timestamp|long|0
withdrawals_root|string|
parent_beacon_block_root|string|
mix_hash|string|*
withdrawals|array<struct<{WITHDRAWAL.replace(' ', ':').replace(',:', ',')}>>|*""",
    "transaction": """
type|string|transaction
hash|string|
nonce|long|0
chain_id|long|0
block_hash|string|
block_number|long|0
block_timestamp|long|0
transaction_index|int|0
from_address|string|
to_address|string|
value|string|0
gas|long|0
gas_price|long|0
input|string|
max_fee_per_gas|long|0
max_priority_fee_per_gas|long|0
transaction_type|int|0
max_fee_per_blob_gas|long|0
blob_versioned_hashes|array<string>|-
receipt_cumulative_gas_used|long|0
receipt_effective_gas_price|long|0
receipt_gas_used|long|0
receipt_blob_gas_price|long|0
receipt_blob_gas_used|long|0
receipt_contract_address|string|
receipt_status|int|0
receipt_root|string|""",
    "receipt": f"""
type|string|receipt
block_number|long|0
block_hash|string|
transaction_hash|string|
transaction_index|int|0
from_address|string|
to_address|string|
contract_address|string|
cumulative_gas_used|long|0
gas_used|long|0
effective_gas_price|long|0
blob_gas_used|long|0
blob_gas_price|long|0
status|int|0
root|string|
logs_bloom|string|
logs|array<struct<{LOG.replace(' ', ':').replace(',:', ',')}>>|*""",
    "token_transfer": """
type|string|token_transfer
token_standard|string|unknown
transfer_type|string|unknown
contract_address|string|
operator_address|string|
from_address|string|
to_address|string|
token_id|string|0
value|string|0
erc1155_mode|string|
transaction_index|int|0
transaction_hash|string|
log_index|int|0
block_number|long|0
block_hash|string|
block_timestamp|long|0
chain_id|long|0""",
    "contract": """
type|string|contract
address|string|
chain_id|long|0
name|string|
symbol|string|
decimals|int|0
total_supply|string|0
bytecode|string|
bytecode_hash|string|
function_sighashes|array<string>|-
is_proxy|boolean|false
proxy_type|string|
implementation_address|string|
is_erc20|boolean|false
is_erc721|boolean|false
is_erc1155|boolean|false
supports_erc165|boolean|false
impl_category|string|
impl_detected_by|array<string>|-
impl_classify_confidence|float|0
block_number|long|0
block_timestamp|long|0
block_hash|string|""",
    "protocol": """
slug|string|-
name|string|-
symbol|string|
category|string|Unknown
chains|array<string>|-
tvl|double|0
change_1h|double|0
change_1d|double|0
change_7d|double|0
mcap|double|0
revenue_24h|double|0
last_updated|string|-""",
    "tick": """
id|string|-
symbol|string|-
name|string|
eth_contract_address|string|
current_price|double|0
market_cap|double|0
market_cap_rank|long|0
fully_diluted_valuation|double|0
total_volume|double|0
high_24h|double|0
low_24h|double|0
price_change_24h|double|0
price_change_percentage_24h|double|0
price_change_percentage_1h|double|0
price_change_percentage_7d|double|0
market_cap_change_24h|double|0
market_cap_change_percentage_24h|double|0
circulating_supply|double|0
total_supply|double|0
max_supply|double|0
ath|double|0
ath_change_percentage|double|0
ath_date|string|-
atl|double|0
atl_change_percentage|double|0
atl_date|string|-
last_updated|string|-
image|string|*
roi|struct<times:double,currency:string,percentage:double>|*""",
}

FIELDS: dict[str, list[tuple[str, str, str]]] = {name: [tuple(line.split("|")) for line in body.strip().split("\n")] for name, body in _ENTITIES.items()}


def schema(entity: str) -> StructType:
    """The full schema of an entity's messages."""
    return StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind, _ in FIELDS[entity]))


#: Table layout: partition expression and sort columns.
LAYOUTS = {
    "blocks": ("date_format(timestamp_seconds(timestamp), 'yyyyMM')", ["number", "hash"]),
    "withdrawals": ("date_format(timestamp_seconds(block_timestamp), 'yyyyMM')", ["address", "validator_index", "block_number"]),
    "transactions": ("block_number div 1000000", ["block_number", "transaction_index"]),
    "receipts": ("block_number div 1000000", ["block_number", "transaction_index"]),
    "logs": ("date_format(timestamp_seconds(block_timestamp), 'yyyyMM')", ["address", "topic0", "block_number", "log_index"]),
    "token_transfers": ("date_format(timestamp_seconds(block_timestamp), 'yyyyMM')", ["block_number", "log_index"]),
    "contracts": (None, ["address", "chain_id"]),
    "coin_market_history": ("date_format(last_updated, 'yyyyMM')", ["last_updated", "coin_id"]),
    "protocol_metrics": ("date_format(last_updated, 'yyyyMM')", ["last_updated", "slug"]),
    "daily_market_metrics": ("date_format(date, 'yyyyMM')", ["date", "coin_id"]),
    "hourly_trending_metrics": ("date_format(hour, 'yyyyMM')", ["hour", "coin_id"]),
}
#: Key and version of the tables of which only the newest version of a row counts.
VERSIONED = {
    "contracts": (["address", "chain_id"], "block_number"),
    "protocol_metrics": (["last_updated", "slug"], "last_updated"),
    "daily_market_metrics": (["date", "coin_id"], "calculated_at"),
    "hourly_trending_metrics": (["hour", "coin_id"], "calculated_at"),
}

_HEX = "hash string, number string, parentHash string, nonce string, sha3Uncles string, logsBloom string, transactionsRoot string, stateRoot string, receiptsRoot string, miner string, difficulty string, totalDifficulty string, size string, extraData string, gasLimit string, gasUsed string, timestamp string, baseFeePerGas string, mixHash string, withdrawalsRoot string, blobGasUsed string, excessBlobGas string, parentBeaconBlockRoot string"
_RAW_TX = "hash string, nonce string, chainId string, blockHash string, blockNumber string, transactionIndex string, from string, to string, value string, gas string, gasPrice string, input string, maxFeePerGas string, maxPriorityFeePerGas string, type string, maxFeePerBlobGas string"
_RAW_LOG = "logIndex string, transactionHash string, transactionIndex string, blockHash string, blockNumber string, address string, data string"
_RAW_RECEIPT = "transactionHash string, transactionIndex string, blockHash string, blockNumber string, from string, to string, fromAddress string, toAddress string, contractAddress string, cumulativeGasUsed string, gasUsed string, effectiveGasPrice string, blobGasUsed string, blobGasPrice string, logsBloom string, root string, status string"


def _struct(fields: str, *more: str) -> str:
    return "struct<" + ",".join(f.strip().replace(" ", ":", 1) for f in [*fields.split(","), *more]) + ">"


#: One row a landed block number: its block and receipt responses.
RAW = (
    "number long, "
    f"block {_struct(_HEX, 'blobVersionedHashes array<string>', 'transactions array<' + _struct(_RAW_TX, 'blobVersionedHashes array<string>') + '>', 'withdrawals array<' + _struct('index string, validatorIndex string, address string, amount string') + '>')}, "
    f"receipts array<{_struct(_RAW_RECEIPT, 'logs array<' + _struct(_RAW_LOG, 'topics array<string>') + '>')}>, "
    "error struct<code:int,message:string>"
)
