"""Classification of contracts from landed bytecode, storage slots and call results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytecode import clean, fingerprint, has_all, has_any, minimal_proxy_target, selectors
from ..functions.hexnum import abi_text, hex_to_dec, u256_decimal, word_address
from ..sources.readers import dealt

#: Selectors of the standards, all of which a contract must have.
ERC20 = ["0x18160ddd", "0x70a08231", "0xa9059cbb"]
ERC721 = ["0x6352211e", "0x70a08231", "0xa22cb465", "0x01ffc9a7"]
ERC721_TRANSFERS = ["0x23b872dd", "0x42842e0e"]
ERC1155 = ["0x4e1273f4", "0x2eb2c2d6", "0xa22cb465", "0x01ffc9a7"]
ERC165 = ["0x01ffc9a7"]
#: Selectors of kinds of contract.
TRANSPARENT = ["0x3659cfe6", "0x4f1ef286"]
UUPS = ["0x4f1ef286"]
DIAMOND = ["0x7a0ed627", "0x52ef6b2c", "0xcdffacc6", "0x1f931c1c"]
FACTORY = ["0xc9c65396", "0xa1671295", "0xe6a43905"]
ROUTER = ["0x38ed1739", "0xe8e33700", "0xc04b8d59", "0xac9650d8"]
VAULT = ["0x6e553f65", "0xb460af94", "0x385aa0b0", "0xc9968493"]
GOVERNANCE = ["0xda95691a", "0x56781388", "0x3e4f49e6", "0x78619111"]
ORACLE = ["0xfeaf968c", "0x313ce567", "0x7284e416"]
BRIDGE = ["0x74f8a252", "0x37c547e8", "0x2e1a7d4d"]
#: Storage slots of proxies.
SLOT_ZERO = "0x0000000000000000000000000000000000000000"
SLOT_IMPLEMENTATION = "0x360894a13ba1a3210667c828492db98dca3e2076cc3735a920a3ca505d382bbc"
SLOT_BEACON = "0xa3f0ad74e5423aebfd80d3ef4346578335a9a72aeaee59ff6cb3582b35133d50"
#: Canonical master copies of safes, by chain.
MASTER_COPIES = {
    1: ["0x8942595a2dc5181df0465af0d7be08c8f23c93af", "0xd9db270c1b5e3bd161e8c8503c55ceabee709552", "0x3e5c63644e683549055b9be8653de26e0b4cd36e", "0xa6b71e26c5e0845f74c812102ca7114b6a896ab2", "0x41675c099f32341bf84bfc5382af534df5c7461a"],
    137: ["0xd9db270c1b5e3bd161e8c8503c55ceabee709552", "0x3e5c63644e683549055b9be8653de26e0b4cd36e", "0xa6b71e26c5e0845f74c812102ca7114b6a896ab2"],
    10: ["0xd9db270c1b5e3bd161e8c8503c55ceabee709552", "0x3e5c63644e683549055b9be8653de26e0b4cd36e"],
    42161: ["0xd9db270c1b5e3bd161e8c8503c55ceabee709552", "0x3e5c63644e683549055b9be8653de26e0b4cd36e"],
}

_CLASS = "struct<category:string,detected_by:array<string>,confidence:float>"


def standards(have: Column) -> dict[str, Column]:
    return {
        "is_erc20": has_all(have, ERC20),
        "is_erc721": has_all(have, ERC721) & has_any(have, ERC721_TRANSFERS),
        "is_erc1155": has_all(have, ERC1155),
        "supports_erc165": has_all(have, ERC165),
    }


def category(have: Column, label: str, heuristics: bool) -> Column:
    """category, detected_by and confidence: the first that fits of the token standards and then, with heuristics, of the other kinds."""
    own = standards(have)
    rules = [(own["is_erc20"], "TOKEN", f"{label}:erc20", 1.0), (own["is_erc721"], "NFT", f"{label}:erc721", 1.0), (own["is_erc1155"], "MULTI_TOKEN", f"{label}:erc1155", 1.0)]
    if heuristics:
        rules += [
            (has_any(have, FACTORY), "FACTORY", "heuristic:dex_factory", 0.9),
            (has_any(have, ROUTER), "ROUTER", "heuristic:dex_router", 0.9),
            (has_all(have, VAULT), "VAULT", "heuristic:erc4626", 0.95),
            (has_any(have, GOVERNANCE), "GOVERNANCE", "heuristic:governance", 0.8),
            (has_any(have, ORACLE), "ORACLE", "heuristic:oracle", 0.9),
            (has_any(have, BRIDGE), "BRIDGE", "heuristic:bridge", 0.8),
        ]
    out = F.struct(F.lit("UNKNOWN").alias("category"), F.array().cast("array<string>").alias("detected_by"), F.lit(0.0).alias("confidence")).cast(_CLASS)
    for holds, name, by, confidence in reversed(rules):
        out = F.when(holds, F.struct(F.lit(name).alias("category"), F.array(F.lit(by)).alias("detected_by"), F.lit(confidence).alias("confidence")).cast(_CLASS)).otherwise(out)
    return out


def master_copies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(chain, a) for chain, own in MASTER_COPIES.items() for a in own], "chain_id long, master_copy string")


def slot_addresses(contracts: DataFrame, slots: DataFrame) -> DataFrame:
    """Contracts with slot0_address, implementation_slot and beacon_slot; slots: address, slot, value, one row a slot.

    The three slots are gathered in one aggregation, so the slot table is shuffled once, and before texts are sorted to be aggregated.
    """
    key = F.lower("slot")
    own = slots.where(key.isin(SLOT_ZERO, SLOT_IMPLEMENTATION, SLOT_BEACON)).withColumn("address", F.lower("address")).transform(dealt, "address").groupBy("address")
    gathered = own.agg(*(F.max(F.when(key == slot, word_address(F.col("value")))).alias(name) for name, slot in (("slot0_address", SLOT_ZERO), ("implementation_slot", SLOT_IMPLEMENTATION), ("beacon_slot", SLOT_BEACON))))
    # never broadcast: a file of few compressed bytes has many of them
    return contracts.join(gathered.hint("merge"), "address", "left")


def classify(code: DataFrame, slots: DataFrame, direct_heuristics: bool = False, implementation_upgrades: bool = False) -> DataFrame:
    """Contracts (address, chain_id, bytecode, block_number) with their proxy kind, standards and category.

    In order: no code is a plain account; a minimal proxy; a proxy by slots (safe master copy, implementation, beacon);
    a diamond; else an implementation of its own. direct_heuristics also gives those the six heuristic categories.
    implementation_upgrades tells UUPS proxies by where the upgrade functions are: on the proxy TRANSPARENT, on the
    implementation UUPS; without it a proxy by implementation slot is TRANSPARENT.
    """
    base = code.select(F.lower("address").alias("address"), "chain_id", "block_number", "bytecode")
    rows = slot_addresses(base, slots).withColumns({"function_sighashes": selectors(F.col("bytecode")), "minimal": minimal_proxy_target(F.col("bytecode"))})
    copies = master_copies(code.sparkSession).select("chain_id", F.col("master_copy").alias("slot0_address"), F.lit(True).alias("is_safe"))
    rows = rows.join(F.broadcast(copies), ["chain_id", "slot0_address"], "left")  # a dozen fixed rows
    have = F.col("function_sighashes")
    rows = rows.withColumns(
        {
            "is_account": clean(F.col("bytecode")).isNull(),
            "implementation_address": F.coalesce("minimal", F.when(F.col("is_safe"), F.col("slot0_address")), "implementation_slot", "beacon_slot"),
        }
    )
    upgrade = F.lit("TRANSPARENT")
    if implementation_upgrades:
        other = rows.select(F.col("address").alias("implementation_address"), has_any(have, TRANSPARENT).alias("impl_upgrades"))
        rows = rows.join(other, "implementation_address", "left")
        upgrade = F.when(has_any(have, TRANSPARENT), "TRANSPARENT").when(F.col("impl_upgrades"), "UUPS").otherwise("TRANSPARENT")
    by_slot = F.when(F.col("is_safe"), "GNOSIS_SAFE").when(F.col("implementation_slot").isNotNull(), upgrade).when(F.col("beacon_slot").isNotNull(), "BEACON")
    proxy = F.when(~F.col("is_account"), F.when(F.col("minimal").isNotNull(), "MINIMAL").otherwise(F.coalesce(by_slot, F.when(has_any(have, DIAMOND), F.lit("DIAMOND")))))
    own = category(have, "direct", direct_heuristics)
    rows = rows.withColumn("proxy_type", proxy).withColumn("is_proxy", F.col("proxy_type").isNotNull())
    direct = ~F.col("is_proxy") & ~F.col("is_account")
    flags = {k: F.when(direct, v).otherwise(False) for k, v in standards(have).items()}
    unknown = category(F.array().cast("array<string>"), "direct", False)
    rows = rows.withColumns(flags | {"class": F.when(direct, own).otherwise(unknown)})
    return rows.select(
        "address",
        "chain_id",
        "block_number",
        "bytecode",
        fingerprint(F.col("bytecode")).alias("bytecode_hash"),
        "function_sighashes",
        "is_proxy",
        "proxy_type",
        F.when(F.col("is_proxy"), F.col("implementation_address")).alias("implementation_address"),
        *flags,
        F.col("class.category").alias("impl_category"),
        F.col("class.detected_by").alias("impl_detected_by"),
        F.col("class.confidence").alias("impl_classify_confidence"),
    )


def resolve_proxies(contracts: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Proxies with what their implementation is, one level deep: standards, category, and metadata that they lack.

    metadata: address, name, symbol, decimals, total_supply. An implementation that is a proxy itself is read as plain
    code, by its own selectors.
    """
    names = ["name", "symbol", "decimals", "total_supply"]
    if metadata is None:
        metadata = contracts.select("address", *(F.lit(None).cast(k).alias(n) for n, k in zip(names, ("string", "string", "int", "string")))).limit(0)
    rows = contracts.join(metadata, "address", "left")
    flags = standards(F.col("function_sighashes"))
    found = category(F.col("function_sighashes"), "implementation", True)
    other = rows.select(F.col("address").alias("implementation_address"), *(F.col(n).alias(f"i_{n}") for n in names), *(v.alias(f"i_{k}") for k, v in flags.items()), found.alias("i_class"))
    joined = rows.join(other, "implementation_address", "left")
    has = F.col("is_proxy") & F.col("i_class").isNotNull()
    blank = lambda n: F.when(F.col(n).cast("string").isin("", "0"), None).otherwise(F.col(n))
    pick = {n: F.when(has, F.coalesce(blank(n), f"i_{n}")).otherwise(F.col(n)) for n in names}
    pick |= {k: F.when(has, F.col(f"i_{k}")).otherwise(F.col(k)) for k in flags}
    pick |= {
        "impl_category": F.when(has & (F.col("i_class.category") != "UNKNOWN"), F.col("i_class.category")).otherwise(F.col("impl_category")),
        "impl_detected_by": F.when(has, F.col("i_class.detected_by")).otherwise(F.col("impl_detected_by")),
        "impl_classify_confidence": F.when(has, F.col("i_class.confidence")).otherwise(F.col("impl_classify_confidence")),
    }
    return joined.select(*(pick[c].alias(c) if c in pick else F.col(c) for c in [*contracts.columns, *names]))


def token_metadata(contracts: DataFrame, calls: DataFrame) -> DataFrame:
    """address, name, symbol, decimals, total_supply from landed call results (address, field, result in hex).

    ERC20 contracts take all four fields; ERC721 and ERC1155 take name and symbol, and have 0 decimals. Others give no row.
    Texts are aggregated by sorting, so calls are shuffled first: else a task would sort all calls of the split that it reads.
    """
    value = F.col("result")
    picked = calls.withColumn("address", F.lower("address")).transform(dealt, "address").groupBy("address").agg(
        F.max(F.when(F.col("field") == "name", abi_text(value))).alias("name"),
        F.max(F.when(F.col("field") == "symbol", abi_text(value))).alias("symbol"),
        F.max(F.when(F.col("field") == "decimals", hex_to_dec(value))).cast("int").alias("decimals"),
        F.max(F.when(F.col("field") == "totalSupply", u256_decimal(value))).alias("total_supply"),
    )
    nft = F.col("is_erc721") | F.col("is_erc1155")
    tokens = contracts.where(F.col("is_erc20") | nft).select("address", "is_erc20", "is_erc721", "is_erc1155")
    rows = tokens.join(picked.hint("merge"), "address", "left")  # as in slot_addresses
    return rows.select("address", "name", "symbol", F.when(F.col("is_erc20"), F.col("decimals")).otherwise(0).alias("decimals"), F.when(F.col("is_erc20"), F.col("total_supply")).alias("total_supply"))
