"""Column functions over hex and ABI text, result payloads, labels and kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

ZERO_ADDRESS = "0x" + "0" * 40
#: Fixed values of the chain: selectors of keeper traffic, precompiles, label rules.
ORACLE_SELECTORS = ("0xf8ac93e8", "0xae27861b")
SYSTEM, CPI, HELPER = ("0xff" + "0" * 37 + d for d in "789")
WITHDRAW = "0x42" + "0" * 36 + "16"
NAME_LABELS = (("compound", "Compound"), ("comet", "Comet"), ("aave", "Aave V3"), ("uniswap v3", "Uniswap V3"), ("uniswap v2", "Uniswap V2"), ("uniswap", "Uniswap"))
CODE_LABELS = (("128acb08", "Uniswap V3"),)
BUCKETS = ((0, "0"), (1, "1"), (5, "2-5"), (20, "6-20"), (50, "21-50"))
LAST_BUCKET = "50+"


def chain(rules, otherwise) -> Column:
    """when(..).when(..).otherwise(..) from (condition, value) pairs."""
    out = None
    for test, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def bare(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "^0x", "")


def topic_to_address(c: Column, strict: bool = False) -> Column:
    """Last 40 digits of a topic; shorter text gives "" (strict: null unless 32 bytes with 12 zero bytes in front)."""
    h = bare(c)
    address = F.concat(F.lit("0x"), F.right(h, F.lit(40)))
    return F.when(h.rlike("^0{24}[0-9a-f]{40}$"), address) if strict else F.when(F.length(h) >= 40, address).otherwise("")


def bool_word(c: Column, strict: bool = False) -> Column:
    """Loose: any non-zero digit. Strict: exactly a 32-byte 0 or 1, else null."""
    h = bare(c)
    return F.when(h.rlike("^0{63}[01]$"), F.right(h, F.lit(1)) == "1") if strict else F.coalesce(h.rlike("[1-9a-f]"), F.lit(False))


def word(c: Column, k: int) -> Column:
    """The k-th 32-byte word of hex data, as 64 digits; null beyond the end."""
    w = F.substring(bare(c), 1 + 64 * k, 64)
    return F.when(F.length(w) == 64, w)


def abi_string(c: Column) -> Column:
    """A single dynamic string: offset word, length word, bytes; null where the data ends too soon."""
    h = bare(c)
    offset, zero = F.conv(F.right(word(c, 0), F.lit(8)), 16, 10).cast("bigint"), F.lit("0" * 56)
    length = F.conv(F.right(F.substr(h, (offset * 2 + 1).cast("int"), F.lit(64)), F.lit(8)), 16, 10).cast("bigint")
    body = F.substr(h, (offset * 2 + 65).cast("int"), (length * 2).cast("int"))
    good = F.left(word(c, 0), F.lit(56)) == zero
    return F.when(good & (F.length(body) == 2 * length), F.try_to_binary(body, F.lit("hex")).cast("string"))


def tx_status(result: Column) -> Column:
    """From the result's JSON text: null is pending; no exit reason is failed; code 0, or text from "Succeed" on, is success."""
    code = F.get_json_object(result, "$.exit_reason.code").cast("bigint")
    reason = F.get_json_object(result, "$.exit_reason.reason")
    return chain([(result.isNull(), "pending"), (code.isNotNull(), F.when(code == 0, "success").otherwise("failed")), (F.coalesce(reason.startswith("Succeed"), F.lit(False)), "success")], "failed")


def revert_reason(result: Column) -> Column:
    return F.when(tx_status(result) == "failed", F.nullif(F.get_json_object(result, "$.exit_reason.reason"), F.lit("")))


def is_oracle(method: Column) -> Column:
    return F.coalesce(method.isin(*ORACLE_SELECTORS), F.lit(False))


def method_name(signature: Column) -> Column:
    return F.substring_index(signature, "(", 1)


def epoch_to_ts(c: Column) -> Column:
    """Seconds, truncated; null outside what a timestamp holds."""
    s = c.cast("decimal(38,6)").cast("bigint")
    return F.when(s.between(-62135596800, 253402300799), F.timestamp_seconds(s))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def number_or_hex(c: Column) -> Column:
    """Decimal or 0x-hex text as bigint, held at its top; absent or bad is 0."""
    top = F.lit((1 << 63) - 1)
    h = bare(c)
    hexed = F.when(F.length(F.regexp_replace(h, "^0+", "")) > 15, top).otherwise(F.conv(h, 16, 10).cast("bigint"))
    dec = F.coalesce(c.try_cast("bigint"), F.when(c.rlike("^[0-9]+$"), top))
    return F.coalesce(F.when(c.rlike("^0[xX][0-9a-fA-F]+$"), hexed).otherwise(dec), F.lit(0).cast("bigint"))


def gas_report(result: Column) -> dict[str, Column]:
    """gas_used, gas_price, gas_recipient, priority_fee, base_fee of a result's JSON text."""
    at = lambda k: F.get_json_object(result, f"$.gas_report.{k}")
    used, price, priority = (exact_number(at(k)) for k in ("gas_value", "gas_price", "priority_fee"))
    priority = F.coalesce(priority, F.lit(0).cast("decimal(38,0)"))
    total = F.try_multiply(used, price).cast("decimal(38,0)")
    return {"gas_used": used, "gas_price": price, "gas_recipient": F.lower(at("gas_recipient")), "priority_fee": priority, "base_fee": F.when(total.isNotNull(), F.greatest(F.lit(0).cast("decimal(38,0)"), (total - priority).cast("decimal(38,0)")))}


def exact_number(c: Column) -> Column:
    """Decimal or 0x-hex text of up to 38 digits as decimal(38,0), nothing held or rounded; null for other text."""
    h = F.regexp_replace(bare(c), "^0+(?=.)", "")
    part = lambda start, n: F.conv(F.substring(F.lpad(h, 32, "0"), start, n), 16, 10).cast("decimal(20,0)")
    hexed = F.when(F.length(h) <= 31, (part(1, 16) * F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(38,0)") + part(17, 16)).cast("decimal(38,0)")
    return F.when(c.rlike("^0[xX][0-9a-fA-F]+$"), hexed).when(c.rlike("^[0-9]{1,38}$"), c.try_cast("decimal(38,0)"))


def json_array_len(text: Column) -> Column:
    """Elements of a JSON array; 0 for null and for what is no array."""
    return F.coalesce(F.json_array_length(text), F.lit(0))


def effective_from(decoded: Column, source: Column) -> Column:
    """The decoded sender, else the source's."""
    return F.coalesce(decoded, source)


def format_amount(amount: Column, decimals: Column) -> Column:
    """Decimal text of an integer's text moved by ``decimals`` places, without trailing zeros."""
    n = F.greatest(decimals, F.lit(0))
    padded = F.lpad(amount, F.greatest(F.length(amount), n + 1).cast("int"), F.lit("0"))
    whole = F.left(padded, F.length(padded) - n)
    rest = F.regexp_replace(F.right(padded, n), "0+$", "")
    return F.when(rest == "", whole).otherwise(F.concat_ws(".", whole, rest))


def escape_like(q: Column) -> Column:
    for sign in ("\\", "%", "_"):
        q = F.replace(q, F.lit(sign), F.lit("\\" + sign))
    return q


def entity_url(kind: Column, key: Column) -> Column:
    path = {"tx": "/tx/", "block": "/block/", "token": "/token/", "address": "/address/"}
    return F.concat(chain([(kind == k, v) for k, v in path.items()], "/search?q="), key)


def histogram_bucket(n: Column) -> Column:
    return chain([(n <= top, name) for top, name in BUCKETS], LAST_BUCKET)


def slot_rate(slots: Column, seconds: Column) -> tuple[Column, Column]:
    """Slots a second and milliseconds a slot; 0 and 0 unless both are positive."""
    good = (slots > 0) & (seconds > 0)
    return F.when(good, slots / seconds).otherwise(0.0), F.when(good, seconds * 1000.0 / slots).otherwise(0.0)


def holder_share(balance: Column, total: Column) -> Column:
    return F.when(total > 0, balance / total)


#: Fixed values of the output that carry the chain's name.
CHAIN_PRECOMPILE, DEPOSIT_TAG = "precompile_rome", "rome_deposit"


def address_kind(address: Column, is_token: Column, is_contract: Column, by_solana: Column) -> Column:
    a = F.lower(address)
    last = F.conv(F.right(a, F.lit(2)), 16, 10).cast("int")
    return chain([(a == ZERO_ADDRESS, "burn"), (a.isin(SYSTEM, CPI, HELPER, WITHDRAW), CHAIN_PRECOMPILE), (a.startswith("0x" + "0" * 38) & (F.length(a) == 42) & last.between(1, 10), "precompile_eth"), (is_token, "token"), (is_contract, "contract"), (by_solana, "account")], "eoa")


def token_kind(mint: Column, owner: Column, token_2022: str = "token-2022") -> Column:
    return chain([(mint.isNull(), "ERC-20"), (F.coalesce(owner == token_2022, F.lit(False)), "Token-2022")], "SPL")


def gated_verdict(module: Column, allowed: Column) -> Column:
    """No module: not gated. A module: gated unless transfers are allowed; unknown stays unknown."""
    return F.when(module.isNull() | (module == ZERO_ADDRESS), False).otherwise(~allowed)


def normalize_label(name: Column, symbol: Column, code: Column) -> tuple[Column, Column]:
    """Label and detail: first name rule that occurs, a code rule if the name is empty, a short symbol, the name."""
    name, symbol = F.trim(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(symbol, F.lit("")))
    low, hexed = F.lower(name), bare(F.coalesce(code, F.lit("")))
    rules = [(low.contains(x), label) for x, label in NAME_LABELS] + [((name == "") & hexed.contains(x), label) for x, label in CODE_LABELS]
    ruled = chain(rules, F.lit(None).cast("string"))
    short = (symbol != "") & (F.octet_length(symbol) <= 16)
    label = F.coalesce(ruled, F.when(short, symbol), F.nullif(name, F.lit("")))
    detail = F.when(ruled.isNotNull(), F.coalesce(F.nullif(symbol, F.lit("")), F.when((name != "") & (name != ruled), name))).when(short | (name == ""), F.lit(None)).otherwise(F.nullif(symbol, F.lit("")))
    return label, detail


def fingerprint_code(code: Column) -> Column:
    return chain([(bare(code).contains(x), label) for x, label in CODE_LABELS], F.lit(None).cast("string"))


def label_from_probe(name: Column, symbol: Column, code: Column, description: Column) -> tuple[Column, Column, Column]:
    """(read, label, detail) of an address that was probed. Nothing read at all: read is false and the row is skipped. What
    has only a description is a "Price Feed" with it as detail; a read without any of them gets a null label, the marker
    that the address was seen."""
    read = name.isNotNull() | symbol.isNotNull() | code.isNotNull() | description.isNotNull()
    label, detail = normalize_label(name, symbol, code)
    told = F.nullif(F.trim(description), F.lit(""))
    return read, F.coalesce(label, F.when(told.isNotNull(), "Price Feed")), F.when(label.isNull(), told).otherwise(detail)


def _ordered(c: Column, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        fields = [_ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(c, lambda _, v: _ordered(v, kind.valueType)))))
    return c


def evidence_hash_of(schema: StructType) -> Column:
    """SHA-256 of a row's JSON, keys in order at every depth, nulls kept."""
    fields = [_ordered(F.col(f.name), f.dataType).alias(f.name) for f in sorted(schema.fields, key=lambda f: f.name)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def evidence_hash(*columns: str) -> Column:
    """SHA-256 of JSON with keys in order and nulls kept; for flat columns."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def log_completeness(lines: Column) -> Column:
    """Whether log lines can serve as evidence: not null, not empty, not cut."""
    return F.coalesce((F.size(lines) > 0) & ~F.exists(lines, lambda x: x.contains("Log truncated")), F.lit(False))


def legs_build(signatures: Column, chain_name: Column, kind: Column) -> Column:
    """Leg structs of a transaction over several chains, in the order given; no legs for other kinds."""
    none = F.array().cast("array<struct<solChain:string,solSignature:string>>")
    legs = F.transform(signatures, lambda s: F.struct(chain_name.alias("solChain"), s.alias("solSignature")))
    return F.coalesce(F.when(kind == "Romulus", legs), none)


def legs_parse(text: Column) -> Column:
    """Legs of a JSON array; an element that lacks either text is left out, and what is no array has none."""
    none = F.array().cast("array<struct<sol_chain:string,sol_signature:string>>")
    items = F.from_json(text, "array<string>")
    legs = F.transform(items, lambda x: F.struct(F.get_json_object(x, "$.solChain").alias("sol_chain"), F.get_json_object(x, "$.solSignature").alias("sol_signature")))
    return F.coalesce(F.filter(legs, lambda g: g["sol_chain"].isNotNull() & g["sol_signature"].isNotNull()), none)


#: Fixed value: the digits of the key text form.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


@F.pandas_udf(StringType())
def _base58(words):  # noqa: ANN001, ANN202
    def text(w: str | None) -> str | None:
        if w is None:
            return None
        n, out = int(w, 16), ""
        zeros = (64 - len(w.lstrip("0"))) // 2
        while n:
            n, k = divmod(n, 58)
            out = BASE58[k] + out
        return "1" * zeros + out

    return words.__class__([text(w) for w in words], dtype=object)


def bytes32_to_base58(c: Column) -> Column:
    """Key text of a 32-byte hex word, a leading 1 for each leading zero byte; null for anything else."""
    return _base58(F.when(bare(c).rlike("^[0-9a-fA-F]{64}$"), bare(c)))
