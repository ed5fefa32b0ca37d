"""The audit's event descriptors as a table: what each kind of source emits and how its arguments are laid out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Kinds of source; then event, tag, topic 0 and arguments in declared order (* indexed).
EVENTS = """
ARC_TOKEN YIELD_TOKEN PURCHASE_TOKEN UV2_PAIR
Transfer PRIMARY ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef from:address* to:address* value:uint256

ARC_TOKEN AXIS1_MODULE YIELD_BLACKLIST ROUTER GLOBAL_SANCTIONS STOREFRONT FACTORY
RoleGranted SUPPORTING 2f8788117e7eff1d82e926ec794901d17c78024a50270940304540a733656f0d role:bytes32* account:address* sender:address*
RoleRevoked SUPPORTING f6391f5c32d9c69d2a47ea670b442974b53935d1edc7fd64eb21e047a839171b role:bytes32* account:address* sender:address*

ARC_TOKEN FACTORY ROUTER STOREFRONT GLOBAL_SANCTIONS
RoleAdminChanged SUPPORTING bd79b86ffe0ab8e8776151514217cd7cacd52c909f66475c3af44e129f0b00ff role:bytes32* previousAdminRole:bytes32* newAdminRole:bytes32*

ARC_TOKEN AXIS1_MODULE YIELD_BLACKLIST ROUTER STOREFRONT FACTORY
Upgraded SUPPORTING bc7cd75a20ee27fd9adebab32041f755214dbc6bffa90cc0225b39da2e5c2d3b implementation:address*

ARC_TOKEN ROUTER STOREFRONT FACTORY
Initialized SUPPORTING c7f505b2f371ae2175ee4913f4499e1f2633a7b5936321eed1cdaeb6115181d2 version:uint256

ARC_TOKEN
SpecificRestrictionModuleSet PRIMARY e5d41ffde12968cb577153d35b775280c377967d3bcb834268d42e7e687ca312 typeId:bytes32* moduleAddress:address*
YieldTokenUpdated PRIMARY f94eb881bab685626983a1af865d32af77acd21bea663ae50e2d92c5ba9daeaf newYieldToken:address*
YieldDistributed PRIMARY 464b8a29d43599ace210dd9e04279148ebcfd132907c4e35b77835a05a8e2879 amount:uint256 token:address*
Approval SUPPORTING 8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925 owner:address* spender:address* value:uint256
TokenNameUpdated SUPPORTING 762b25d500491264178acdce1980fd11ed12ac2c6a25eb3a15759a9f34fa82c2 oldName:string newName:string
SymbolUpdated SUPPORTING e539f7c7cd6b523196945e98454143f55e93314cc40672ad65628a7df42d483f oldSymbol:string newSymbol:string
TokenURIUpdated SUPPORTING 3d25540fafb277423a5c9552c25096f7c0c69178c044fd61c947046f08fb09ca newTokenURI:string

FACTORY
TokenRegistered PRIMARY 487c37289624c10056468f1f98ebffbad01edce11374975179672e32e2543bf0 token:address* implementation:address*
TokenCreated SUPPORTING 87432a53b4bacb04ae99226b6316d9930f169c481d75cf5b513f4eccc485b1db tokenAddress:address* owner:address* implementation:address* name:string symbol:string tokenUri:string decimals:uint256
ModuleLinked SUPPORTING 0540e31d60db77ecc418386b102018f04fd47bd4815a8ef97a3c3c9de8082613 tokenAddress:address* moduleAddress:address* moduleType:bytes32*
ImplementationWhitelisted SUPPORTING 489c65b6ac39f6046967b57c184dcd1290e0e48217c30c899c74fddee8beecad implementation:address*
ImplementationRemoved SUPPORTING af23121e2402485071dadf421078b368d7b67e54cabcc81540563c5d6bf1a4c3 implementation:address*
TokenUpgraded SUPPORTING cd23a18833879e1f289f88200345417e6288fcb73ad4cdfdbf7759d735444ae5 token:address* newImplementation:address*

GLOBAL_SANCTIONS
Sanctioned PRIMARY 63d72e072b8020c07d946ff140e00fdb10195e4cd045c83d7db998ad1239d101 account:address*
Unsanctioned PRIMARY 6341cf58a5c9c850948623b3033047d31cfb1e741434141a9b4cafabe9cc9572 account:address*
TransferScreened PRIMARY 6722dfcb37c25fad39b85791cf1db49a3f82299501ed35c38a1736963f9c23a1 from:address* to:address* amount:uint256
SanctionedSet PRIMARY e120f1c2a7416d3ef8776f69c89583cdc9ab7f2c3e525f55df52c5b5ce453608 account:address* sanctioned:bool
TransferScreened PRIMARY edcf706d8177eb31edf03ec879920a41a678ebc47c659dcdd5ed35d660f8d11f asset:address* from:address* to:address* amount:uint256
AssetFrozenSet PRIMARY 68e2297c215eb4de4ed9a376854b97df7af5350d4b0d2e489620509ce1147575 asset:address* frozen:bool

MORPHO
CreateMarket PRIMARY ac4b2400f169220b0c0afdde7a0b32e775ba727ea1cb30b35f935cdaab8683ac id:bytes32* loanToken:address collateralToken:address oracle:address irm:address lltv:uint256
Supply PRIMARY edf8870433c83823eb071d3df1caa8d008f12f6440918c20d75a3602cda30fe0 id:bytes32* caller:address* onBehalf:address* assets:uint256 shares:uint256
Withdraw PRIMARY a56fc0ad5702ec05ce63666221f796fb62437c32db1aa1aa075fc6484cf58fbf id:bytes32* caller:address onBehalf:address* receiver:address* assets:uint256 shares:uint256
Borrow PRIMARY 570954540bed6b1304a87dfe815a5eda4a648f7097a16240dcd85c9b5fd42a43 id:bytes32* caller:address onBehalf:address* receiver:address* assets:uint256 shares:uint256
Repay PRIMARY 52acb05cebbd3cd39715469f22afbf5a17496295ef3bc9bb5944056c63ccaa09 id:bytes32* caller:address* onBehalf:address* assets:uint256 shares:uint256
SupplyCollateral PRIMARY a3b9472a1399e17e123f3c2e6586c23e504184d504de59cdaa2b375e880c6184 id:bytes32* caller:address* onBehalf:address* assets:uint256
WithdrawCollateral PRIMARY e80ebd7cc9223d7382aab2e0d1d6155c65651f83d53c8b9b06901d167e321142 id:bytes32* caller:address onBehalf:address* receiver:address* assets:uint256
Liquidate PRIMARY a4946ede45d0c6f06a0f5ce92c9ad3b4751452d2fe0e25010783bcab57a67e41 id:bytes32* caller:address* borrower:address* repaidAssets:uint256 repaidShares:uint256 seizedAssets:uint256 badDebtAssets:uint256 badDebtShares:uint256
SetOwner SUPPORTING 167d3e9c1016ab80e58802ca9da10ce5c6a0f4debc46a2e7a2cd9e56899a4fb5 newOwner:address*
SetFee SUPPORTING 139d6f58e9a127229667c8e3b36e88890a66cfc8ab1024ddc513e189e125b75b id:bytes32* newFee:uint256
SetFeeRecipient SUPPORTING 2e979f80fe4d43055c584cf4a8467c55875ea36728fc37176c05acd784eb7a73 newFeeRecipient:address*
EnableIrm SUPPORTING 590e04cdebeccba40f566186b9746ad295a4cd358ea4fefaaea6ce79630d96c0 irm:address*
EnableLltv SUPPORTING 297b80e7a896fad470c630f6575072d609bde997260ff3db851939405ec29139 lltv:uint256
FlashLoan SUPPORTING c76f1b4fe4396ac07a9fa55a415d4ca430e72651d37d3401f3bed7cb13fc4f12 caller:address* token:address* assets:uint256
SetAuthorization SUPPORTING d5e969f01efe921d3f766bdebad25f0a05e3f237311f56482bf132d0326309c0 caller:address* authorizer:address* authorized:address* newIsAuthorized:bool
IncrementNonce SUPPORTING a58af1a0c70dba0c7aa60d1a1a147ebd61000d1690a968828ac718bca927f2c7 caller:address* authorizer:address* usedNonce:uint256
AccrueInterest SUPPORTING 9d9bd501d0657d7dfe415f779a620a62b78bc508ddc0891fbbd8b7ac0f8fce87 id:bytes32* prevBorrowRate:uint256 interest:uint256 feeShares:uint256

ROUTER
ModuleTypeRegistered PRIMARY cc4abcb2a030ec3e5fd29297416c74497d3225bdfeeac99e1f918ae95da249f9 typeId:bytes32* isGlobal:bool globalImplementation:address
ModuleTypeRemoved PRIMARY dff785f41263b72f976d1eed0524dd42f4e07d938b6d8591800435d9a439cade typeId:bytes32*
GlobalImplementationUpdated PRIMARY 13de69f292a4fc57344c45d3be3f70addbd82b90ae265191b774e72e1d95f7b6 typeId:bytes32* newGlobalImplementation:address*

STOREFRONT
PurchaseTokenUpdated PRIMARY 668a2250c20049ce9de599e4808eb8685f0aa54cb49d1563548266404553cc23 newPurchaseToken:address*
PurchaseMade PRIMARY 69103e55e7d412d83b3be1a3fd0908d8197fb33a5485f2b57346a9120bb1f321 buyer:address* tokenContract:address* amount:uint256 pricePaid:uint256
TokenSaleEnabled SUPPORTING efd79f18d51c3ec48a6fafa0646e05e45ea5e4aeec68ce1b8f61900a21be5307 tokenContract:address* numberOfTokens:uint256 tokenPrice:uint256
TokenSaleDisabled SUPPORTING 59ed64a38b2390a57dd06250e69f1be104c45582d10a3d8273f04c2f77dff889 tokenContract:address*
StorefrontConfigSet SUPPORTING 258d321800a3233c6496a1cfd966d172f299594970268086cdc2f8a30f3b04d4 tokenContract:address* domain:string
TokenFactoryUpdated SUPPORTING 06d64f41e0c8bfe9eab59ac2d4e14dadfeee426e0ce29bcda6d82a5bf1a1c1cf newFactory:address*

UV2_PAIR
Swap SUPPORTING d78ad95fa46c994b6551d0da85fc275fe613ce37657fb8d5e3d130840159d822 sender:address* amount0In:uint256 amount1In:uint256 amount0Out:uint256 amount1Out:uint256 to:address*
Mint SUPPORTING 4c209b5fc8ad50758f13e2e1088ba56a560dff690a1c6fef26394f4c03821c4f sender:address* amount0:uint256 amount1:uint256
Burn SUPPORTING dccd412f0b1252819cb1fd330b93224ca42612892bb3f4f789976e6d81936496 sender:address* amount0:uint256 amount1:uint256 to:address*
Sync SUPPORTING 1c411e9a96e071241c2f21f7726b17ae89e3cab4c78be50e062b03a9fffbbad1 reserve0:uint256 reserve1:uint256

AXIS1_MODULE
WhitelistStatusChanged PRIMARY 8daaf060c3306c38e068a75c054bf96ecd85a3db1252712c4d93632744c42e0d account:address* isWhitelisted:bool
TransfersRestrictionToggled PRIMARY 70a23fe37c63b4aecb5c585cbcc7e044a1601e38986a22eaf1932b87030ba097 transfersAllowed:bool
AddedToWhitelist SUPPORTING a850ae9193f515cbae8d35e8925bd2be26627fc91bce650b8652ed254e9cab03 account:address*
RemovedFromWhitelist SUPPORTING cdd2e9b91a56913d370075169cefa1602ba36be5301664f752192bb1709df757 account:address*

YIELD_BLACKLIST
YieldBlacklistUpdated PRIMARY 4c77449574928f5f4a39c96b8322ace61cffe0c0cfe2970d4f5e128b0ce8a0c3 account:address* isBlacklisted:bool
"""
SCHEMA = "source_kind string, topic0 string, event_name string, tag string, args array<struct<name:string,type:string,indexed:boolean>>"


def descriptors() -> list[tuple]:
    """(kind, topic0, event, tag, [(name, type, indexed)]) rows of the table above."""
    out = []
    for group in EVENTS.strip().split("\n\n"):
        kinds, *lines = group.split("\n")
        for name, tag, topic, *args in map(str.split, lines):
            spec = [(n, t.rstrip("*"), t.endswith("*")) for n, t in (a.split(":") for a in args)]
            out += [(kind, f"0x{topic}", name, tag, spec) for kind in kinds.split()]
    return out


def registry(spark: SparkSession) -> DataFrame:
    """One row an event and kind of source, for ``extract.decode_events``; some ninety rows."""
    return spark.createDataFrame(descriptors(), SCHEMA)
