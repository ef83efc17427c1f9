"""Scalar column expressions: emission, difficulty, work, money, scripts, maturity, fees and small classifiers."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COIN = 100_000_000
POS_START = 259_201
MATURITY = 100
BUDGET_CYCLE = 43_200

# Fixed values: (height above which it holds, block reward in satoshi).
ERAS = (
    (3_715_200, 1_000_000_000), (1_153_160, 500_000_000), (648_000, 450_000_000), (604_800, 900_000_000), (561_600, 1_350_000_000),
    (518_400, 1_800_000_000), (475_200, 2_250_000_000), (432_000, 2_700_000_000), (388_800, 3_150_000_000), (345_600, 3_600_000_000),
    (302_400, 4_050_000_000), (151_200, 4_500_000_000), (86_400, 22_500_000_000), (1, 25_000_000_000),
)
PREMINE, GENESIS_ERA = 6_000_100_000_000, 25_000_000_000


def era_reward(height: Column) -> Column:
    """The block reward at a height; null for a null height."""
    out = F.when(height.isNull(), F.lit(None).cast("long"))
    for low, reward in ERAS:
        out = out.when(height > low, F.lit(reward).cast("long"))
    return out.when(height == 1, F.lit(PREMINE).cast("long")).otherwise(F.lit(GENESIS_ERA).cast("long"))


def era_staker(height: Column) -> Column:
    """The staker's share at a height: none before staking, fixed in the last two eras, half of the reward between."""
    share = F.when(height.isNull(), F.lit(None).cast("long")).when(height < POS_START, F.lit(0).cast("long"))
    return share.when(height > 3_715_200, 400_000_000).when(height > 1_153_160, 200_000_000).otherwise(div(era_reward(height), 2))


def with_era(df: DataFrame, height: str = "era_height") -> DataFrame:
    """df with era_reward and era_staker of its height: two conditional expressions, no join; rows without a height stay."""
    return df.withColumns({"era_reward": era_reward(F.col(height)), "era_staker": era_staker(F.col(height))})


def difficulty(nbits) -> Column:
    bits = F.col(nbits) if isinstance(nbits, str) else nbits
    mant, exp = bits.bitwiseAND(0xFFFFFF), F.shiftright(bits, 24)
    return F.when(mant == 0, 0.0).otherwise(65535.0 * F.pow(F.lit(256.0), 29 - exp) / mant)


def block_work(nbits: Column) -> Column:
    """2**256 div (target + 1) for exponents 20 to 34 as DECIMAL(38,0); null outside, where the formula isn't exact.

    With p = 2**(280 - 8 * exponent) it is p div mantissa, less 1 where the mantissa divides p. Long division
    over digits of 30 bits keeps every step within 64 bits.
    """
    mant, exp = nbits.bitwiseAND(0xFFFFFF), F.shiftright(nbits, 24)
    bit = (280 - 8 * exp).cast("int")
    rest, work = F.lit(0).cast("long"), F.lit(0).cast("decimal(38,0)")
    for i in range(4, -1, -1):
        digit = F.when(div(bit, 30) == i, F.call_function("shiftleft", F.lit(1).cast("long"), bit % 30)).otherwise(0)
        now = rest * (1 << 30) + digit
        part = div(now, mant).cast("decimal(10,0)") * F.lit(Decimal(1 << (30 * i))).cast("decimal(38,0)")
        work = (work + part.cast("decimal(38,0)")).cast("decimal(38,0)")
        rest = now % mant
    return F.when((mant > 0) & exp.between(20, 34), F.when(rest == 0, work - 1).otherwise(work)).cast("decimal(38,0)")


def money(satoshi: Column) -> Column:
    """[-]W.FFFFFFFF"""
    a = F.abs(satoshi)
    return F.concat(F.when(satoshi < 0, "-").otherwise(""), div(a, COIN).cast("string"), F.lit("."), F.lpad((a % COIN).cast("string"), 8, "0"))


def div(a: Column, b) -> Column:
    """Integer division that truncates."""
    return F.call_function("div", a.cast("long"), (b if isinstance(b, Column) else F.lit(b)).cast("long"))


def confirmations(height: Column, tip: Column) -> Column:
    return F.when(height <= 0, 0).otherwise(F.greatest(tip - height + 1, F.lit(0))).cast("long")


def spendable(ty: Column, vout: Column, height: Column, tip: Column) -> Column:
    """Coinbase and coinstake mature after 100 blocks; a coinstake's output 0 never is; heights below 0 never are."""
    return F.when(height < 0, False).when((ty == 1) & (vout == 0), False).when(ty == 0, True).otherwise(tip - height >= MATURITY)


def height_status(height: Column) -> Column:
    return F.when(height == -1, "orphan").when(height == -2, "unresolved").when(height == 0, "genesis").when(height > 0, "canonical").otherwise("invalid")


def relay_fee(size: Column, priority: Column) -> Column:
    """10,000 satoshi for each started 1,000 bytes, times 1, 2 or 5 by priority."""
    factor = F.when(priority == "high", 5).when(priority == "medium", 2).otherwise(1)
    return (F.ceil(size / 1000) * 10_000 * factor).cast("long")


def hodl_band(age_blocks: Column, per_day: int = 1440) -> Column:
    d = div(age_blocks, per_day)
    return F.when(d < 30, "<1m").when(d < 90, "1-3m").when(d < 180, "3-6m").when(d < 365, "6-12m").when(d < 730, "1-2y").otherwise(">2y")


def query_kind(q: Column) -> Column:
    n = F.length(q)
    return (
        F.when(q.isNull() | (F.trim(q) == ""), "unknown").when(q.rlike("^[0-9]+$"), "height").when(q.rlike("^[0-9a-fA-F]{64}$"), "hash")
        .when(q.startswith("xpub") & n.between(100, 120), "account").when(q.rlike("^[DS67E]") & n.between(26, 40), "address").otherwise("unknown")
    )


def reversed_hex(id_hex: Column) -> Column:
    return F.array_join(F.reverse(F.regexp_extract_all(id_hex, F.lit("(..)"), 1)), "")


def address_role(address: Column) -> Column:
    first = F.substring(address, 1, 1)
    return F.when(first == "S", "staker").when(first == "D", "owner").when(first.isin("6", "7"), "script").when(first == "E", "exchange").otherwise("unknown")


def redacted(key: Column) -> Column:
    return F.when(F.length(key) > 12, F.concat(F.left(key, F.lit(8)), F.lit("..."), F.right(key, F.lit(4)))).otherwise("<invalid>")


def script_type(hex_script: Column) -> Column:
    """By byte template of an upper-case hex script."""
    n = F.length(hex_script) / 2
    has = lambda p: hex_script.rlike(p)
    return (
        F.when(n == 0, "nonstandard").when((n == 51) & has("^76A97B63D[12]14.{40}6714.{40}6888AC$"), "coldstake").when((n == 25) & has("^76A914.{40}88AC$"), "pubkeyhash")
        .when((n == 26) & has("^E076A914.{40}88AC$"), "exchangeaddress").when((n == 23) & has("^A914.{40}87$"), "scripthash")
        .when(((n == 35) & has("^21.{66}AC$")) | ((n == 67) & has("^41.{130}AC$")), "pubkey").when(has("^C1"), "zerocoinmint").when(has("^C2"), "zerocoinspend")
        .when(has("^C3"), "zerocoinpublicspend").when(has("^6A"), "nulldata").otherwise("unknown")
    )


def shield_shape(n_vin: Column, n_vout: Column, value_balance: Column, shielded: Column) -> Column:
    return F.when(~shielded, F.lit(None)).when((n_vin == 0) & (n_vout == 0), "shielded").when(value_balance < 0, "shielding").when(value_balance > 0, "de-shielding")


RANGES = {"24h": 1, "7d": 7, "30d": 30, "90d": 90, "1y": 365, "all": 3650}


def range_days(name: str) -> int:
    return RANGES.get(name, 30)
