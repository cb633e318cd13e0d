"""Local transaction precheck on a table of payments (validate, price, policy,
flags, gas, ERC-20 call-data decode) - one output row per input row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwire import constants as K
from tripwire.operators.policy import violations
from tripwire.functions.text import py_round
from tripwire.params import PolicyParams
from tripwire.plans.strategy import ensure_parallelism, pushdown_barrier
from tripwire.regex import WS

ADDRESS_RE = r"(?i)^0x[0-9a-f]{40}\z"   # Python's '$' would also accept a trailing newline
FIELDS = {"chain_id": "chain_id", "data": "data", "from_": "from_addr", "to": "to_addr", "value": "value_wei"}


def _missing(df: DataFrame) -> Column:
    names = sorted(FIELDS)
    return F.array_compact(F.array(*[F.when(F.col(FIELDS[n]).isNull(), F.lit(n)) for n in names]))


def uint256_decimal(hex_digits: Column) -> Column:
    """Unsigned hex -> DECIMAL(38,0), NULL when the value does not fit (>= 1e38).

    ``conv`` is 64-bit, so the value is folded from four 32-bit limbs with
    overflow-checked decimal arithmetic."""
    h = F.regexp_replace(hex_digits, "^0+", "")
    fits = F.length(h) <= 32
    p = F.lpad(h, 32, "0")
    acc = F.lit(0).cast("decimal(38,0)")
    for i in range(4):
        limb = F.conv(F.substring(p, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")
        acc = F.try_add(F.try_multiply(acc, F.lit(4294967296).cast("decimal(38,0)")), limb)
    return F.when(fits, acc.cast("decimal(38,0)"))


def python_int16_digits(raw: Column) -> Column:
    """Digits accepted by Python ``int(raw, 16)`` (surrounding whitespace, optional 0x,
    single underscores between digits), with underscores removed; NULL when rejected."""
    s = F.regexp_replace(raw, "^" + WS + "+|" + WS + "+$", "")
    ok = s.rlike(r"^(?:0[xX]_?)?[0-9a-fA-F](?:_?[0-9a-fA-F])*\z")
    return F.when(ok, F.regexp_replace(F.regexp_replace(s, "^0[xX]", ""), "_", ""))


def precheck(tx: DataFrame, params: PolicyParams = PolicyParams(), daily_total: Column | None = None,
             allowlist_active: Column | None = None, in_allowlist: Column | None = None,
             single_limit: Column | None = None, daily_limit: Column | None = None) -> DataFrame:
    """The limits are those of ``params``, or columns of the payments.

    Staged so each derived value (validation error, USD value, call-data digits,
    violations) is computed once and later steps read it as a column."""
    to, frm, val, data = F.col("to_addr"), F.col("from_addr"), F.col("value_wei"), F.col("data")
    missing = _missing(tx)
    error = (F.when(F.size(missing) > 0, F.concat(F.lit("Missing required fields: "), F.array_join(missing, ", ")))
             .when(~to.rlike(ADDRESS_RE), F.concat(F.lit("Invalid recipient address: '"), to, F.lit("'")))
             .when(~frm.rlike(ADDRESS_RE), F.concat(F.lit("Invalid sender address: '"), frm, F.lit("'")))
             .when(val < 0, F.concat(F.lit("Invalid value: '"), val.cast("string"),
                                     F.lit("' — must be a non-negative number"))))
    eth = val.cast("double") / F.lit(1e18)
    erc20 = F.lower(data).startswith(K.ERC20_TRANSFER_SELECTOR) & (F.length(data) >= 138)
    extra = [c for c in [daily_total, allowlist_active, in_allowlist] if c is not None]
    tx = ensure_parallelism(tx)
    d = tx.select("*", error.alias("error"), eth.alias("_eth"), (eth * F.lit(params.eth_usd)).alias("_usd"),
                  F.lower(to).alias("_to_lc"), (~data.isin(*K.NON_CALL_DATA)).alias("_is_call"),
                  F.when(erc20, python_int16_digits(F.substring(data, 75, 64))).alias("_digits"),
                  *[c.alias(f"_x{i}") for i, c in enumerate(extra)])
    xs = iter([F.col(f"_x{i}") for i in range(len(extra))])
    dt = next(xs) if daily_total is not None else F.lit(0.0)
    aa = next(xs) if allowlist_active is not None else None
    ia = next(xs) if in_allowlist is not None else None
    ok = F.col("error").isNull()
    digits = F.col("_digits")
    single = F.lit(params.single_limit) if single_limit is None else single_limit
    daily = F.lit(params.daily_limit) if daily_limit is None else daily_limit
    pv = violations(F.col("_usd"), dt, to, single, daily, aa, ia)
    transfer = F.when(digits.isNotNull(), F.struct(
        F.lit("ERC-20 transfer").alias("type"),
        F.concat(F.lit("0x"), F.substring(F.substring(data, 11, 64), -40, 40)).alias("to"),
        F.lower(digits).alias("amount_hex"), uint256_decimal(digits).alias("amount")))
    d = d.select("*", F.when(ok, pv).alias("_pv"), F.array_compact(F.array(transfer)).alias("_tt"))
    is_burn = F.col("_to_lc").isin(*K.BURN_ADDRESSES)
    flags = F.concat(
        F.transform(F.col("_pv"), lambda v: F.concat(F.lit("POLICY:"), v["rule"], F.lit(" — "), v["detail"])),
        F.array_compact(F.array(F.when(is_burn, F.lit(
            "SUSPICIOUS_RECIPIENT:burn/null address — funds will be unrecoverable")))))
    warnings = F.array_compact(F.array(
        F.when(is_burn, F.lit("Sending to the burn/null address is irreversible.")),
        F.when(F.col("_to_lc") == F.lower(frm), F.lit("Sender and recipient are the same address."))))
    is_call = F.col("_is_call")
    gas = F.when(is_call, F.lit(K.BASE_GAS) + F.floor(F.length(data) / 2).cast("bigint") * K.GAS_PER_BYTE) \
        .otherwise(F.lit(K.BASE_GAS)).cast("bigint")
    return pushdown_barrier(d.select(
        *tx.columns, ok.alias("success"), ok.alias("simulated"), "error",
        F.when(ok, py_round(F.col("_eth"), 8)).alias("value_eth"),
        F.when(ok, py_round(F.col("_usd"), 2)).alias("value_usd_est"),
        F.when(ok, gas).alias("gas_estimate"), F.when(ok, is_call).alias("is_contract_call"),
        F.when(ok, F.col("_tt")).alias("token_transfers"),
        F.when(ok, flags).alias("policy_flags"), F.when(ok, warnings).alias("warnings")))
