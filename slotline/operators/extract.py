"""Nested payloads to rows: logs, transfers, registry-driven event decoding, program log lines."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotline.functions import u256
from slotline.functions.hexabi import CPI, bare, bytes32_to_base58, chain, number_or_hex, topic_to_address

from .classify import TRANSFER, once

LOGS = "array<struct<address:string,topics:array<string>,data:string>>"


def logs_project(result: Column) -> Column:
    """A result's logs; absent data is 0x."""
    logs = F.coalesce(F.from_json(result, f"logs {LOGS}")["logs"], F.array().cast(LOGS))
    return F.transform(logs, lambda g: F.struct(g["address"].alias("address"), g["topics"].alias("topics"), F.coalesce(g["data"], F.lit("0x")).alias("data")))


def explode_logs(results: DataFrame, keys: list[str], result: str) -> DataFrame:
    """A row a log; its index is the place in the full array."""
    return results.select(*keys, F.posexplode(logs_project(F.col(result))).alias("log_index", "log")).select(*keys, "log_index", "log.*")


def extract_transfers(results: DataFrame, keys: list[str], result: str) -> DataFrame:
    """Fungible transfers: the transfer topic with exactly three topics."""
    logs = explode_logs(results, keys, result).where((F.size("topics") == 3) & (F.lower(F.get("topics", F.lit(0))) == TRANSFER))
    return logs.select(*keys, "log_index", F.lower("address").alias("token"), topic_to_address(F.get("topics", F.lit(1))).alias("sender"), topic_to_address(F.get("topics", F.lit(2))).alias("receiver"), u256.from_hex(F.col("data")).alias("amount"))


def extract_token_created(results: DataFrame, keys: list[str], result: str, topic0: str) -> DataFrame:
    logs = explode_logs(results, keys, result).where((F.size("topics") == 4) & (F.lower(F.get("topics", F.lit(0))) == topic0))
    return logs.select(*keys, "log_index", F.lower("address").alias("factory"), topic_to_address(F.get("topics", F.lit(1))).alias("creator"), F.lower(F.get("topics", F.lit(2))).alias("mint"), topic_to_address(F.get("topics", F.lit(3))).alias("token"))


#: The two gate events and the restriction type they are about.
MODULE_SET = "0xe5d41ffde12968cb577153d35b775280c377967d3bcb834268d42e7e687ca312"
TOGGLED = "0x70a23fe37c63b4aecb5c585cbcc7e044a1601e38986a22eaf1932b87030ba097"
TRANSFER_RESTRICTION = "0x16d3efd52fe4afa679136c32a17cfe3bac40019518e3dd5b5d42aeb676bcb941"


def extract_gate_events(results: DataFrame, keys: list[str], result: str) -> DataFrame:
    """Gate events: event_type, token (wirings only), module, transfers_allowed (toggles only). A wiring of another
    restriction type, an empty emitter or module, and a toggle without data are no gate events."""
    topic = lambda k: F.lower(F.get("topics", F.lit(k)))
    emitter, wired = F.nullif(F.lower("address"), F.lit("")), topic(0) == MODULE_SET
    module = F.when(wired, F.nullif(topic_to_address(topic(2)), F.lit(""))).otherwise(emitter)
    word = F.nullif(bare(F.col("data")), F.lit(""))
    found = explode_logs(results, keys, result).where(((topic(0) == MODULE_SET) & (topic(1) == TRANSFER_RESTRICTION)) | (topic(0) == TOGGLED))
    made = found.select(*keys, "log_index", F.when(wired, "module_wired").otherwise("transfers_toggled").alias("event_type"), F.when(wired, emitter).alias("token"), module.alias("module"), F.when(~wired, word.rlike("[^0]")).alias("transfers_allowed"), emitter.alias("_by"))
    return made.where(F.col("_by").isNotNull() & F.col("module").isNotNull() & ((F.col("event_type") == "module_wired") | F.col("transfers_allowed").isNotNull())).drop("_by")


def gate_history(events: DataFrame, order: list[str]) -> DataFrame:
    """Gate events with their token: a toggle takes the token its module was last wired to before it, null if there is none."""
    w = W.partitionBy("module").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    wired = F.last(F.when(F.col("event_type") == "module_wired", F.col("token")), ignorenulls=True).over(w)
    return events.withColumn("token", F.coalesce("token", wired))


def stale_gates(tokens: DataFrame, history: DataFrame, order: list[str]) -> DataFrame:
    """Token rows after gate events: the last wired module, and ``gated`` unknown again wherever an event met the token. A
    token that has no row gets one. tokens: token, module, gated."""
    seen = history.where(F.col("token").isNotNull()).groupBy("token").agg(F.max_by(F.when(F.col("event_type") == "module_wired", F.col("module")), F.when(F.col("event_type") == "module_wired", F.struct(*order))).alias("_module"))
    both = tokens.join(seen.withColumn("_met", F.lit(True)), "token", "full")
    return both.select("token", F.coalesce("_module", "module").alias("module"), F.when(F.col("_met").isNull(), F.col("gated")).alias("gated"))


def decode_events(logs: DataFrame, registry: DataFrame) -> DataFrame:
    """Logs with the event that (source kind, topic 0) names, its arguments as a map, and a reason where that fails.

    registry: source_kind, topic0, event_name, tag, args array<struct<name,type,indexed>>. Types: address, uint256, bool,
    bytes32, string. Indexed arguments come from topics, the others from 32-byte words in order.
    """
    data = bare(F.coalesce("data", F.lit("0x")))
    # what the registry alone tells is made once an event, not once a log
    flagged = F.transform("args", lambda a, i: F.struct(a["name"].alias("name"), a["type"].alias("type"), a["indexed"].alias("indexed"), F.size(F.filter(F.slice("args", F.lit(1), i), lambda b: b["indexed"] == a["indexed"])).alias("k")))
    told = {"_spec": flagged, "_topics": F.size(F.filter("args", lambda a: a["indexed"])) + 1, "_words": F.size(F.filter("args", lambda a: ~a["indexed"])), "_texts": F.exists("args", lambda a: a["type"] == "string"), "_bools": F.exists("args", lambda a: a["type"] == "bool"), "_dynamic": F.exists("args", lambda a: a["indexed"] & (a["type"] == "string"))}
    known = registry.withColumns(told).drop("args")
    joined = logs.withColumn("topic0", F.lower(F.get("topics", F.lit(0)))).join(F.broadcast(known), ["source_kind", "topic0"], "left").withColumn("_data", data)  # some ninety rows
    raw = F.transform("_spec", lambda a: F.struct(a["name"].alias("name"), a["type"].alias("type"), a["indexed"].alias("indexed"), F.when(a["indexed"], bare(F.get("topics", a["k"] + 1))).otherwise(F.substr(F.col("_data"), a["k"] * 64 + 1, F.lit(64))).alias("word")))
    staged = once(joined, "_args", raw)
    at = lambda x: F.conv(F.right(x, F.lit(8)), 16, 10).cast("int")
    text_len = lambda a: at(F.substr(F.col("_data"), at(a["word"]) * 2 + 1, F.lit(64)))
    text_hex = lambda a: F.substr(F.col("_data"), at(a["word"]) * 2 + 65, text_len(a) * 2)
    value = lambda a: F.when(a["type"] == "address", F.concat(F.lit("0x"), F.right(a["word"], F.lit(40)))).when(a["type"] == "bool", F.when(F.right(a["word"], F.lit(1)) == "1", "true").otherwise("false")).when(a["type"] == "string", F.try_to_binary(text_hex(a), F.lit("hex")).cast("string")).otherwise(F.concat(F.lit("0x"), a["word"]))
    words, texts = F.col("_words"), F.col("_texts")
    tails = F.when(texts, F.aggregate("_args", F.lit(0), lambda n, a: n + F.when((a["type"] == "string") & ~a["indexed"], 64 + F.ceil(F.coalesce(text_len(a), F.lit(0)) / 32).cast("int") * 64).otherwise(0))).otherwise(0)
    reason = (
        F.when(F.col("topic0").isNull(), "missing_topic0")
        .when(F.col("event_name").isNull(), "unknown_topic")
        .when(F.size("topics") != F.col("_topics"), "topic_count")
        .when(F.col("_dynamic"), "indexed_dynamic")
        .when(F.length("_data") < words * 64, "short_data")
        .when(~F.col("_data").rlike("^[0-9a-f]*$"), "bad_hex")
        .when(F.col("_bools") & F.exists("_args", lambda a: (a["type"] == "bool") & ~a["word"].rlike("^0{63}[01]$")), "bad_bool")
        .when(texts & F.exists("_args", lambda a: (a["type"] == "string") & F.coalesce(F.length(text_hex(a)) < text_len(a) * 2, F.lit(True))), "malformed_dynamic")
        .when(texts & F.exists("_args", lambda a: (a["type"] == "string") & ~F.is_valid_utf8(F.try_to_binary(text_hex(a), F.lit("hex")).cast("string"))), "bad_utf8")
        .when(F.length("_data") != words * 64 + tails, "trailing_data")
    )
    made = F.map_from_entries(F.transform("_args", lambda a: F.struct(a["name"].alias("key"), value(a).alias("value"))))
    judged = once(staged, "reason", reason)
    return judged.withColumn("decoded", F.when(F.col("reason").isNull(), made)).drop("_args", "_data", *told)


def split_quarantine(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    return decoded.where("reason IS NULL").drop("reason"), decoded.where("reason IS NOT NULL").drop("decoded")


def receipt_numbers(receipt: Column) -> dict[str, Column]:
    """block_number, tx_index and first_log_index of a receipt's JSON text, in hex or plain numbers."""
    at = lambda k: number_or_hex(F.get_json_object(receipt, f"$.{k}"))
    return {"block_number": at("block_number"), "tx_index": at("tx_index").cast("int"), "first_log": at("first_log_index").cast("int")}


def event_envelope(logs: DataFrame, txs: DataFrame, results: DataFrame, blocks: DataFrame) -> DataFrame:
    """Block number, hash, time, place of the transaction, signer, and the block-wide log index: place in the transaction
    plus the receipt's first. Four inner joins; logs: tx_hash, log_ordinal; txs: tx_hash, signer; blocks: block_number."""
    n = receipt_numbers(F.col("receipt_params"))
    head = results.select("tx_hash", n["block_number"].alias("block_number"), n["tx_index"].alias("tx_index"), n["first_log"].alias("_first"))
    return logs.join(head, "tx_hash").join(txs.select("tx_hash", "signer"), "tx_hash").join(blocks, "block_number").withColumn("log_index", F.col("log_ordinal") + F.col("_first")).drop("_first")


def logs_of(logs: DataFrame, results: DataFrame, address: str, topic0: str, result: str = "tx_result") -> DataFrame:
    """All logs of one source and event with their data, taken from the result's log array by the log's place, and their
    position; a place beyond the array has null data. Sort by the position columns where order matters."""
    n = receipt_numbers(F.col("receipt_params"))
    own = logs.where((F.lower("address") == address.lower()) & (F.lower(F.get("topics", F.lit(0))) == topic0.lower()))
    head = results.select("tx_hash", n["block_number"].alias("block_number"), n["tx_index"].alias("tx_index"), n["first_log"].alias("_first"), F.col(result).alias("_result"))
    joined = own.join(head, "tx_hash")
    data = F.get(logs_project(F.col("_result")), F.col("log_ordinal"))["data"]
    return joined.select("tx_hash", "block_number", "tx_index", (F.col("log_ordinal") + F.col("_first")).alias("log_index"), "topics", data.alias("data"))


def filter_logs(logs: DataFrame, first: int, last: int, addresses: list[str] | None, topics: list) -> DataFrame:
    """Log filter: block range, any of the addresses, and per topic place null, one or any of several."""
    out = logs.where(F.col("block_number").between(first, last))
    if addresses:
        out = out.where(F.lower("address").isin([a.lower() for a in addresses]))
    for k, want in enumerate(topics):
        if want is not None:
            out = out.where(F.lower(F.get("topics", F.lit(k))).isin([w.lower() for w in ([want] if isinstance(want, str) else want)]))
    return out


def parse_invokes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Program invocations with their depth."""
    hit = r"^Program (\S+) invoke \[(\d+)\]"
    return lines.where(F.col("line").rlike(hit)).select(*keys, "line_no", F.regexp_extract("line", hit, 1).alias("program"), F.regexp_extract("line", hit, 2).cast("int").alias("depth"))


def top_level_programs(invokes: DataFrame, keys: list[str]) -> DataFrame:
    return invokes.where("depth = 1").groupBy(*keys).agg(F.array_sort(F.collect_set("program")).alias("programs"))


def gathered(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` of each key (line_no, line) as one array in order, as a transaction holds its log."""
    return lines.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("lines"))


def cpi_target(lines: DataFrame, keys: list[str], plumbing: list[str]) -> DataFrame:
    """``cpi_targets`` of lines that come a row each."""
    return cpi_targets(gathered(lines, keys), plumbing).select(*keys, "program", "instruction")


def cpi_targets(txs: DataFrame, plumbing: list[str], lines: str = "lines") -> DataFrame:
    """First deeper program that is no plumbing, with the instruction named before the next invoke or success; transactions
    without one are out. ``lines``: array of log lines. No line leaves its row."""
    head = r"^Program (\S+) invoke \[(\d+)\]"
    # plain tests of the text go before the patterns
    invoked = lambda x: x.startswith("Program ") & x.contains(" invoke [") & x.rlike(head)
    mark = lambda x: x.startswith("Program ") & (x.contains(" invoke") | x.contains(" success")) & x.rlike(r"^Program \S+ (invoke|success)")
    target = lambda x: invoked(x) & (F.regexp_extract(x, head, 2).try_cast("int") >= 2) & ~F.regexp_extract(x, head, 1).isin(plumbing)
    named = lambda x: F.when(x.contains("Instruction: "), F.nullif(F.regexp_extract(x, r"Instruction: (.+)$", 1), F.lit("")))
    whole = F.size(lines)
    places = lambda of, start: F.filter(F.transform(of, lambda x, i: F.when(start(x), i)), lambda i: i.isNotNull())
    read = once(txs, "_at", F.get(places(F.col(lines), target), F.lit(0))).where("_at IS NOT NULL")
    read = once(read, "_rest", F.slice(lines, F.col("_at") + 2, whole))
    span = F.slice("_rest", F.lit(1), F.coalesce(F.get(places(F.col("_rest"), mark), F.lit(0)), F.size("_rest")))
    first = F.get(lines, F.col("_at"))
    told = F.filter(F.transform(F.concat(F.array(first), span), named), lambda x: x.isNotNull())
    return read.withColumns({"program": F.regexp_extract(first, head, 1), "instruction": F.get(told, F.lit(0))}).drop("_at", "_rest")


#: Fixed value: the router's line that states how many hooks it runs, and for which mint.
STATES_HOOKS = r"^Program log: Meta-Hook Router: executing (\d+) "


def stated_hooks(line: Column) -> Column:
    """How many hooks the router's line states; null for other lines."""
    return F.when(line.startswith("Program log: Meta-Hook Router: executing "), F.regexp_extract(line, STATES_HOOKS, 1).try_cast("bigint"))


def hook_invocations(txs: DataFrame, lines: str = "lines", error: str = "error", keys: str = "account_keys") -> DataFrame:
    """mint, hook_count, outcome and fee_payer of router transactions. ``lines``: array of log lines; ``error`` and
    ``keys``: JSON text of the error and of the account keys (texts, or objects with a pubkey)."""
    named = F.filter(lines, lambda x: x.contains("for mint ") & F.regexp_extract(x, r"for mint (.*)$", 1).rlike(r"[^\s,]"))
    mint = F.regexp_replace(F.trim(F.regexp_extract(F.get(named, F.lit(0)), r"for mint (.*)$", 1)), r"[,\s]+$", "")
    counts = F.filter(F.transform(lines, lambda x: stated_hooks(x).try_cast("int")), lambda n: n.isNotNull())
    failed = F.lower(F.nullif(F.trim(error), F.lit("null")))
    outcome = F.when(failed.isNull(), "success").when(failed.rlike("revert|reject|custom"), "reject").otherwise("error")
    first = F.get_json_object(keys, "$[0]")
    payer = F.coalesce(F.get_json_object(first, "$.pubkey"), F.when(~first.startswith("{"), first))
    return txs.withColumns({"mint": mint, "hook_count": F.coalesce(F.get(counts, F.lit(0)), F.lit(0)), "outcome": outcome, "fee_payer": payer})


EXECUTION = "array<struct<hook_address:string,hook_kind:string,result:string,reason:string,gas_used:bigint>>"
OPENS, ENDS, HOOK, UNITS, FAIL, TARGET, REASON, MARK = range(1, 9)


def executions_of(lines: Column, router: str) -> Column:
    """Hook calls inside the router's frames, in order: hook_address, hook_kind, result, reason, gas_used.

    A deeper invocation opens a hook; a call line names its EVM target, which then is the address; a marker line closes the
    call with a result, and the open hook's first failure closes it as rejected. Each of these, and the router's end, forgets
    what was read for the call. ``lines``: a transaction's log as an array; it is folded in its row, so none is shuffled.
    """
    rest = F.transform(lines, lambda x: F.struct(x.alias("line"), F.when(x.startswith("Program "), F.substring(x, 9, 1 << 30)).alias("r")))

    def kind(x: Column) -> Column:
        """The first that fits; what stands outside the router's frames is left out by the fold."""
        line, r = x["line"], x["r"]
        log = lambda head: line.startswith(f"Program log: {head}")
        own = r.startswith(router)
        invoked = r.contains(" invoke [")
        cases = [(own & invoked, OPENS), (own & (r.endswith(" success") | r.contains(" failed")), ENDS), (invoked & (F.substring_index(r, " invoke [", 1) != router), HOOK), (r.contains(" consumed "), UNITS), (r.contains(" failed:"), FAIL), (log("Call: "), TARGET), (log("EVM callback reverted: "), REASON), (log("Hook["), MARK)]
        return chain([(test, F.lit(code)) for test, code in cases], F.lit(0))

    def text(x: Column) -> Column:
        """The program of a hook and a failure, the target of a call, the reason of a revert."""
        line, r, k = x["line"], x["r"], x["kind"]
        call = F.regexp_extract(line, r", to (.*)$", 1)
        target = F.lower(F.regexp_replace(F.trim(call), r"[,\s]+$", ""))
        target = F.when(call != "", F.when(target.startswith("0x"), target).otherwise(F.concat(F.lit("0x"), target)))
        return F.when(k == HOOK, F.substring_index(r, " invoke [", 1)).when(k == FAIL, F.substring_index(r, " failed:", 1)).when(k == TARGET, target).when(k == REASON, F.trim(F.substring(line, 37, 1 << 30)))

    def result(x: Column) -> Column:
        return F.when(x["kind"] == MARK, F.when(x["line"].contains("result="), F.regexp_extract(x["line"], r"result=(\S*)", 1)).otherwise("unknown"))

    def why(x: Column) -> Column:
        words = F.regexp_extract(x["line"], r"result=(\S*)(?:\s+(.*))?$", 2)
        tail = F.trim(F.regexp_replace(F.element_at(F.split(x["r"], " failed:", 2), 2), "^:", ""))
        return F.when(x["kind"] == MARK, F.nullif(F.trim(words), F.lit(""))).when(x["kind"] == FAIL, tail)

    kinds = F.filter(F.transform(rest, lambda x: F.struct(x["line"].alias("line"), x["r"].alias("r"), kind(x).alias("kind"))), lambda x: x["kind"] > 0)
    units = lambda x: F.when(x["kind"] == UNITS, F.regexp_extract(x["r"], r" consumed (\d+) of ", 1).try_cast("bigint"))
    read = F.transform(kinds, lambda x: F.struct(x["kind"].alias("kind"), text(x).alias("text"), units(x).alias("units"), result(x).alias("result"), why(x).alias("why")))
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(False).alias("on"), none.alias("hook"), none.alias("target"), F.lit(None).cast("bigint").alias("units"), none.alias("why"), F.array().cast(EXECUTION).alias("out"))

    def step(s: Column, x: Column) -> Column:
        k = x["kind"]
        on = s["on"]
        closes = on & (k == FAIL) & F.coalesce(x["text"] == s["hook"], F.lit(False))
        marks = on & (k == MARK)
        forgets = (k == ENDS) | closes | marks | (on & (k == HOOK))
        kept = lambda name, code, value: F.when(forgets, None).when(on & (k == code), F.coalesce(value, s[name])).otherwise(s[name])
        address = F.coalesce(s["target"], s["hook"], F.lit(""))
        reason = F.when(closes, F.coalesce(s["why"], x["why"])).otherwise(F.coalesce(x["why"], s["why"]))
        made = F.struct(address.alias("hook_address"), F.when(s["target"].isNotNull(), "evm_custom").otherwise("native").alias("hook_kind"), F.when(closes, "reject").otherwise(x["result"]).alias("result"), reason.alias("reason"), s["units"].alias("gas_used"))
        return F.struct(
            F.when(k == OPENS, True).when(k == ENDS, False).otherwise(on).alias("on"),
            F.when((k == ENDS) | closes, None).when(on & (k == HOOK), x["text"]).otherwise(s["hook"]).alias("hook"),
            kept("target", TARGET, x["text"]).alias("target"),
            kept("units", UNITS, x["units"]).alias("units"),
            kept("why", REASON, x["text"]).alias("why"),
            F.when((closes | marks) & (address != ""), F.concat(s["out"], F.array(made).cast(EXECUTION))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(read, start, step, lambda s: s["out"])


def hook_executions(txs: DataFrame, keys: list[str], router: str, lines: str = "lines") -> DataFrame:
    """A row a hook call: keys, hook_address, hook_kind, result, reason, gas_used, idx (from 1). ``lines``: array of log lines."""
    runs = txs.select(*keys, F.posexplode(executions_of(F.col(lines), router)).alias("_at", "x"))
    return runs.select(*keys, "x.*", (F.col("_at") + 1).alias("idx"))


def hook_mismatch(txs: DataFrame, keys: list[str], router: str, lines: str = "lines") -> DataFrame:
    """Transactions whose parsed hooks differ in number from what the router states, unless it stopped at a rejection."""
    stating = F.filter(F.transform(lines, stated_hooks), lambda n: n.isNotNull())
    read = once(txs, "stated", F.get(stating, F.lit(0)).cast("bigint")).where("stated IS NOT NULL")
    read = once(read, "_runs", executions_of(F.col(lines), router)).withColumn("parsed", F.size("_runs").cast("bigint"))
    last = F.coalesce(F.try_element_at("_runs", F.lit(-1))["result"], F.lit(""))
    return read.where((F.col("parsed") != F.col("stated")) & ~((F.col("parsed") < F.col("stated")) & (last == "reject"))).select(*keys, "stated", "parsed")


#: Selectors of the two calls, native programs, native token instructions by tag, and a pool program's
#: two ids and instructions (a discriminator is the start of sha256 of "global:" and the name in snake case).
INVOKE_SELECTORS = ("7480cb86", "b94f3733")
PROGRAM_LABELS = {
    "TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA": "SPL-Token",
    "TokenzQdBNbLqP5VEhdkAS6EPFLC1PHnBqCXEpPxuEb": "Token-2022",
    "ATokenGPvbdGVxr1b2hvZbsiqW5xWH25efTNsLJA8knL": "ATA",
    "11111111111111111111111111111111": "System",
    "ComputeBudget111111111111111111111111111111": "ComputeBudget",
}
TOKEN_PROGRAMS = ("TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA", "TokenzQdBNbLqP5VEhdkAS6EPFLC1PHnBqCXEpPxuEb")
TOKEN_INSTRUCTIONS = "InitializeMint InitializeAccount InitializeMultisig Transfer Approve Revoke SetAuthority MintTo Burn CloseAccount FreezeAccount ThawAccount TransferChecked ApproveChecked MintToChecked BurnChecked - SyncNative".split()
POOL_LABEL = "Meteora DAMM v1"
POOL_PROGRAMS = ("Eo7WjKq67rjJQSZxS6z3YkapzY3eMj6Xy8X5EQVn5UaB", "ammbh4CQztZ6txJ8AaQgPsWjd6o7GhmvopS2JAo5bCB")
POOL_INSTRUCTIONS = """AddBalanceLiquidity AddImbalanceLiquidity BootstrapLiquidity ClaimFee CloseConfig CreateConfig CreateLockEscrow CreateMintMetadata EnableOrDisablePool
InitializeCustomizablePermissionlessConstantProductPool InitializePermissionedPool InitializePermissionlessConstantProductPoolWithConfig InitializePermissionlessPool
InitializePermissionlessPoolWithFeeTier Lock MoveLockedLp OverrideCurveParam PartnerClaimFee RemoveBalanceLiquidity RemoveLiquiditySingleSide SetPoolFees Swap UpdateActivationPoint GetPoolInfo""".split()


def discriminator(name: str) -> str:
    snake = re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()
    return hashlib.sha256(f"global:{snake}".encode()).hexdigest()[:16]


def decode_call_target(txs: DataFrame, to: str, calldata: str) -> DataFrame:
    """``txs`` with program, label and instruction of a call to the CPI precompile; all null for another target or selector,
    and where an offset or length points outside the data. Key text is made once for each program, and joined back."""
    h = bare(F.col(calldata))
    args = F.substring(h, 9, 1 << 30)
    size = F.floor(F.length(args) / 2).cast("decimal(20,0)")
    # an offset or length: 24 zero bytes, then 8 that count
    number = lambda w: F.when((F.length(w) == 64) & (F.left(w, F.lit(48)) == "0" * 48), F.conv(F.right(w, F.lit(16)), 16, 10).cast("decimal(20,0)"))
    piece = lambda start, n: F.when(start + n <= size, F.substr(args, (start * 2 + 1).cast("int"), (n * 2).cast("int")))
    good = (bare(F.col(to)) == bare(F.lit(CPI))) & (F.length(h) % 2 == 0) & h.rlike("^[0-9a-f]*$") & F.left(h, F.lit(8)).isin(*INVOKE_SELECTORS) & (F.length(args) >= 64)
    read = once(txs, "_at", F.when(good, number(F.substring(args, 129, 64))))
    read = once(read, "_n", number(piece(F.col("_at"), F.lit(32))))
    read = once(read, "_data", piece(F.col("_at") + 32, F.col("_n")))
    read = read.withColumn("_word", F.when(F.col("_data").isNotNull(), F.substring(args, 1, 64)))
    words = read.select("_word").where("_word IS NOT NULL").distinct()
    names = words.withColumn("program", bytes32_to_base58(F.concat(F.lit("0x"), F.col("_word"))))
    named = read.join(names, "_word", "left")
    program, data = F.col("program"), F.col("_data")
    label = chain([(program == k, v) for k, v in PROGRAM_LABELS.items()] + [(program.isin(*POOL_PROGRAMS), POOL_LABEL)], F.lit(None).cast("string"))
    tag, head = F.conv(F.left(data, F.lit(2)), 16, 10).cast("int"), F.left(data, F.lit(16))
    native = chain([(tag == k, v) for k, v in enumerate(TOKEN_INSTRUCTIONS) if v != "-"], F.lit(None).cast("string"))
    pool = chain([(head == discriminator(x), x) for x in POOL_INSTRUCTIONS], F.concat(F.lit("anchor:"), head))
    told = F.when(program.isin(*TOKEN_PROGRAMS), native).when(F.length(data) < 16, F.lit(None)).when(program.isin(*POOL_PROGRAMS), pool).otherwise(F.concat(F.lit("anchor:"), head))
    return named.withColumns({"label": label, "instruction": F.when(program.isNotNull(), told)}).drop("_at", "_n", "_data", "_word")
