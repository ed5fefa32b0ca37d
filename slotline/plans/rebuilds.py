"""The audit's lists, yields, sales, roles and changes of code, rebuilt from events made of the event table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotline.functions import u256
from slotline.operators import audit, classify
from slotline.plans.chain import H, hx
from slotline.plans.queries import SEC, register, stack_sql
from slotline.sources.io import table

TOKEN, MODULE, ROUTER, SANCTIONS, STOREFRONT, BLACKLIST, YIELD, PAID, MULTISIG = 1000, 2000, 3000, 5000, 6000, 7000, 8000, 9000, 14


def issuance_events(s, d):
    """Signups are sanctions, errors blacklist updates, clicks grants and upgrades, views transfers of three kinds, purchases
    distributions and sales, each of one of ten assets."""
    e, a, kind = F.col("event_id"), F.col("user_id") % 10, F.col("event_type")
    sec = F.unix_timestamp("ts")
    at = lambda base: hx(a + base, 40)
    fixed = lambda n: hx(F.lit(n), 40)
    credit, leg, grant, close = (kind == "view") & (e % 3 == 0), (kind == "view") & (e % 3 == 1), (kind == "click") & (e % 2 == 0), (kind == "purchase") & (e % 5 == 0)
    moves = {"from": F.when(credit, at(TOKEN)).when(leg, at(STOREFRONT)).otherwise(hx(e % 20 + 1, 40)), "to": F.when(credit, hx(e % 20 + 1, 40)).when(leg, hx(e % 25 + 1, 40)).otherwise(at(STOREFRONT)), "value": hx(e, 64)}
    rows = [
        (kind == "signup", fixed(SANCTIONS), "GLOBAL_SANCTIONS", F.when(e % 3 != 0, "Sanctioned").otherwise("Unsanctioned"), {"account": hx(e % 40 + 1, 40)}),
        (kind == "error", at(BLACKLIST), "YIELD_BLACKLIST", F.lit("YieldBlacklistUpdated"), {"account": hx(e % 30, 40), "isBlacklisted": (e % 4 != 0).cast("string")}),
        (kind == "view", F.when(credit, fixed(YIELD)).when(leg, at(TOKEN)).otherwise(fixed(PAID)), "ARC_TOKEN", F.lit("Transfer"), moves),
        (grant, at(TOKEN), "ARC_TOKEN", F.when(e % 6 != 0, "RoleGranted").otherwise("RoleRevoked"), {"role": F.concat(F.lit("r"), (e % 4).cast("string")), "account": hx(e % 15 + 1, 40)}),
        (kind == "click", at(TOKEN), "ARC_TOKEN", F.lit("Upgraded"), {"implementation": F.when(e % 11 != 0, hx(e % 9 + 1, 40))}),
        (close, at(TOKEN), "ARC_TOKEN", F.lit("YieldDistributed"), {"token": fixed(YIELD), "amount": F.when(e % 25 != 0, hx(e * 3, 64))}),
        (kind == "purchase", at(STOREFRONT), "STOREFRONT", F.lit("PurchaseMade"), {"tokenContract": at(TOKEN), "buyer": F.when(e % 13 != 0, hx(e % 25 + 1, 40)), "amount": hx(e, 64), "pricePaid": hx(e * 2, 64)}),
    ]
    source = place = name = F.lit(None).cast("string")
    args = F.lit(None)
    for test, from_, sort, event, own in reversed(rows):
        pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in own.items()])
        source, place, name = F.when(test, from_).otherwise(source), F.when(test, F.lit(sort)).otherwise(place), F.when(test, event).otherwise(name)
        args = F.when(test, F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))).otherwise(args)
    at_log = [F.floor(sec / 3600).alias("block"), (F.floor(sec / 600) % 6).alias("tx"), e.alias("log")]
    made = classify.once(table(s, d, "events"), "args", args)
    return made.select("event_id", source.alias("source"), place.alias("source_kind"), name.alias("event_name"), *at_log, F.when(e % 5 != 0, hx(e % 16 + 1, 40)).alias("signer"), "args")


def issued(s, d):
    n = F.col("id")
    own = lambda base: hx(n + base, 40)
    one = lambda base: hx(F.lit(base), 40).alias("address")
    name = F.concat(F.lit("asset"), n.cast("string")).alias("asset_id")
    ten = s.range(10)
    assets = ten.select(name, own(TOKEN).alias("token"), own(MODULE).alias("module"), hx(F.lit(ROUTER), 40).alias("router"), F.lit(None).cast("string").alias("factory"), own(STOREFRONT).alias("storefront"))
    lists = [ten.select(name, x) for x in (own(BLACKLIST).alias("address"), one(YIELD), one(PAID))]
    config = audit.Config(assets, *lists, s.range(1).select(one(SANCTIONS)), s.range(1).select(hx(F.lit(ROUTER), 40).alias("router")), "t", "0x" + f"{MULTISIG:040x}")
    return audit.rebuild_all(issuance_events(s, d), config)


def ends(df):
    return df.withColumns({"from_log": F.col("from_pos.log"), "to_log": F.col("to_pos.log")}).drop("from_pos", "to_pos")


EVENTS = f"e AS (SELECT event_id, event_type AS kind, user_id % 10 AS a, {SEC} // 3600 AS block, {SEC} // 600 % 6 AS tx, event_id AS log FROM events)"


def spells(name: str, source: str, key: str) -> str:
    """Spells of flag f by ``key`` of ``source`` (key, f, block, tx, log)."""
    return f"""{name}0 AS (SELECT *, coalesce(lag(f) OVER (PARTITION BY {key} ORDER BY block, tx, log), false) AS was FROM ({source})),
{name} AS (SELECT * FROM (SELECT *, lead(log) OVER w AS to_log, lead(block) OVER w AS to_block FROM {name}0 WHERE f <> was WINDOW w AS (PARTITION BY {key} ORDER BY block, tx, log)) WHERE f)"""


DENIED = spells("m", f"SELECT {H('event_id % 40 + 1', 40)} AS address, block, tx, log, event_id % 3 <> 0 AS f FROM e WHERE kind = 'signup'", "address")


@register("rebuild_sanction_denyset", f"WITH {EVENTS}, {DENIED} SELECT {H(str(SANCTIONS), 40)} AS source, address, log AS from_log, to_log FROM m")
def rebuild_sanction_denyset(s, d):
    return ends(issued(s, d)["sanction_denyset_interval"])


BARRED = spells("m", "SELECT a, event_id % 30 AS n, block, tx, log, event_id % 4 <> 0 AS f FROM e WHERE kind = 'error' AND event_id % 30 <> 0", "a, n")


@register("rebuild_yield_blacklist", f"WITH {EVENTS}, {BARRED} SELECT 'asset' || a AS asset_id, {H('n', 40)} AS account, log AS from_log, to_log FROM m")
def rebuild_yield_blacklist(s, d):
    return ends(issued(s, d)["yield_blacklist_interval"])


FLOW = """y AS (SELECT a, block, tx, log, event_id, kind = 'view' AS credit, CASE WHEN kind = 'view' THEN event_id WHEN event_id % 25 <> 0 THEN event_id * 3 END AS u FROM e WHERE (kind = 'view' AND event_id % 3 = 0) OR (kind = 'purchase' AND event_id % 5 = 0)),
r AS (SELECT *, coalesce(sum(CASE WHEN credit THEN 0 ELSE 1 END) OVER (PARTITION BY a ORDER BY block, tx, log ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM y)"""


@register("rebuild_yield_run", f"""WITH {EVENTS}, {FLOW}, g AS (SELECT a, CAST(run AS BIGINT) AS run, count(*) FILTER (credit) AS credits, coalesce(sum(u) FILTER (credit), 0) AS credited, max(u) FILTER (NOT credit) AS stated, count(*) FILTER (NOT credit) > 0 AS closed FROM r GROUP BY 1, 2)
SELECT 'asset' || a AS asset_id, {H(str(YIELD), 40)} AS yield_token, run, credits, CAST(credited AS VARCHAR) AS credited, CAST(stated AS VARCHAR) AS stated, closed, CAST(stated - credited AS VARCHAR) AS remainder, coalesce(stated < credited, false) AS over_credit FROM g""")
def rebuild_yield_run(s, d):
    return issued(s, d)["yield_run"].withColumns({c: u256.to_string(F.col(c)) for c in ("credited", "stated", "remainder")})


@register("rebuild_yield_credit", f"WITH {EVENTS}, {FLOW} SELECT 'asset' || a AS asset_id, {H(str(YIELD), 40)} AS yield_token, CAST(run AS BIGINT) AS run, log, {H('event_id % 20 + 1', 40)} AS holder, CAST(u AS VARCHAR) AS share FROM r WHERE credit")
def rebuild_yield_credit(s, d):
    return issued(s, d)["yield_credit"].withColumn("share", u256.to_string(F.col("share"))).drop("block", "tx")


HELD = spells("h", "SELECT a, event_id % 4 AS role, event_id % 15 + 1 AS who, block, tx, log, event_id % 6 <> 0 AS f FROM e WHERE kind = 'click' AND event_id % 2 = 0", "a, role, who")


@register("rebuild_role_interval", f"WITH {EVENTS}, {HELD} SELECT {H(f'a + {TOKEN}', 40)} AS source, 'r' || role AS role, {H('who', 40)} AS account, log AS from_log, to_log FROM h")
def rebuild_role_interval(s, d):
    return ends(issued(s, d)["role_interval"])


@register("rebuild_code_change", f"""WITH {EVENTS}, {HELD}, c AS (SELECT a, block, log, CASE WHEN event_id % 5 <> 0 THEN event_id % 16 + 1 END AS who, event_id % 9 + 1 AS v, lag(event_id % 9 + 1) OVER (PARTITION BY a ORDER BY block, tx, log) AS was FROM e WHERE kind = 'click' AND event_id % 2 = 1 AND event_id % 11 <> 0)
SELECT 'asset' || c.a AS asset_id, c.log, 'UPGRADE' AS kind, {H(f'c.a + {TOKEN}', 40)} AS subject, {H('c.was', 40)} AS before, {H('c.v', 40)} AS after,
CASE WHEN c.who IS NULL THEN 'UNKNOWN' WHEN c.who = {MULTISIG} THEN 'MULTISIG' WHEN EXISTS (SELECT 1 FROM h WHERE h.a = c.a AND h.who = c.who AND c.block >= h.block AND (h.to_block IS NULL OR c.block <= h.to_block)) THEN 'ISSUER_KEY' ELSE 'UNKNOWN' END AS signed_by FROM c""")
def rebuild_code_change(s, d):
    return issued(s, d)["code_change"].drop("event_id", "block", "tx")


BOUGHT = "kind = 'purchase' AND event_id % 5 <> 0 AND event_id % 13 <> 0"
SPOT = "(a * 10000000 + block) * 6 + tx AS g"
LEGS = ",\n".join(stack_sql(name, f"SELECT {SPOT}, event_id, kind = 'view' AS o FROM e WHERE (kind = 'view' AND event_id % 3 = {k}) OR ({BOUGHT})") for name, k in (("t", 1), ("p", 2)))


@register("rebuild_sale", f"""WITH RECURSIVE {EVENTS}, {LEGS} SELECT 'asset' || e.a AS asset_id, e.event_id AS purchase_event, {H('e.event_id % 25 + 1', 40)} AS buyer, CAST(e.event_id AS VARCHAR) AS amount, CAST(e.event_id * 2 AS VARCHAR) AS price_paid, t.m AS token_leg, p.m AS payment_leg
FROM t JOIN p USING (event_id) JOIN e USING (event_id) WHERE NOT t.o AND NOT p.o""")
def rebuild_sale(s, d):
    return issued(s, d)["sale"].select("asset_id", "purchase_event", "buyer", u256.to_string(F.col("amount")).alias("amount"), u256.to_string(F.col("price_paid")).alias("price_paid"), "token_leg", "payment_leg")
